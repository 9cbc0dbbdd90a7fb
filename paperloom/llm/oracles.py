"""Oracle SQL (DuckDB) of the training-data queries that SQL can express."""

from __future__ import annotations

from . import fim, license, quality

#: The CRC-32 table from its polynomial, and a checksum of a hexadecimal string's bytes.
_CRC = """crc_bits AS (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(0, 256) r(n)),
crc_table AS (SELECT list(v ORDER BY n) AS crc FROM crc_bits)"""


def crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST(('0x' || x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])), 4294967295)"


def _draw(key: str, node: str) -> str:
    return f"((CAST(('0x' || substr(md5({key} || '|{node}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _winner(key: str, nodes: list[str], weights: list[float]) -> str:
    scores = [f"ln({_draw(key, n)}) / {w}::DOUBLE" for n, w in zip(nodes, weights, strict=True)]
    return f"CAST(list_position([{', '.join(scores)}], list_max([{', '.join(scores)}])) - 1 AS INTEGER)"


def _shard(key: str, extra: int) -> str:
    region = _winner(key, ["0", "1", *map(str, range(2, 2 + extra))], [12.0, 12.0, *[1.0] * extra])
    rack = [_winner(key, [f"{r}/{k}" for k in range(3)], [4.0] * 3) for r in (0, 1)]
    leaf = [[_winner(key, [f"{r}/{k}/{s}" for s in range(4)], [1.0] * 4) for k in range(3)] for r in (0, 1)]
    inside = [f"(CASE {rack[r]} WHEN 0 THEN {leaf[r][0]} WHEN 1 THEN 4 + {leaf[r][1]} ELSE 8 + {leaf[r][2]} END)" for r in (0, 1)]
    more = "".join(f" WHEN {2 + k} THEN {24 + k}" for k in range(extra))
    return f"CAST(CASE {region} WHEN 0 THEN {inside[0]} WHEN 1 THEN 12 + {inside[1]}{more} END AS INTEGER)"


OP4 = f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST({crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_table),
n AS (SELECT greatest(64, CAST(ceil(count(*) / 2400000.0) AS BIGINT)) AS buckets FROM (SELECT DISTINCT doc_id, size, text_crc32 FROM d)),
s AS (SELECT doc_id, size, text_crc32, {_shard('k', 0)} AS shard, {_shard('k', 1)} AS grown_shard, floor({_draw("(k || '|' || text_crc32)", 'slot')} * buckets) AS bucket FROM d, n)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s"""

_BITS = "array_to_string(list_transform(regexp_extract_all(h, '.'), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '')"
_HOST = "regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_REST = "regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?([^#]*)', 1)"
OP1 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT p.*, {_BITS.replace('(h,', '(p.h,')} AS bits, first FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
 CASE WHEN regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://') THEN array_to_string(list_reverse(string_split(lower({_HOST}), '.')), ',') || ')' || CASE WHEN {_REST} = '' THEN '/' ELSE {_REST} END ELSE split_part(url, '#', 1) END AS url_key,
 strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM b"""


# --- licences: the same rules, every pair of matches compared, then kept one by one by priority


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op2() -> str:
    values = ",\n".join(f"({k}, {_quoted(label)}, {_quoted(key)}, {_quoted(license.spaced(e))})" for k, (label, key, e) in enumerate(license.rules()))
    places, labels = [], []
    for phrase, label in license.BASE:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(0, greatest(0, len(w) - {len(words) - 1})), lambda i: {test})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    return rf"""
WITH rules(rank, label, key, expr) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT rid, doc_id, w, CASE WHEN len(w) = 0 THEN ' ' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS norm, {' || '.join(places)} AS places, {' || '.join(labels)} AS base FROM d),
parts AS (SELECT rid, rank, label, string_split(regexp_replace(norm, expr, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p FROM n JOIN rules ON contains(norm, key)),
part AS (SELECT rid, rank, label, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM parts WHERE len(p) > 1),
spot AS (SELECT rid, rank, label, x, coalesce(sum(length(replace(x, chr(2), ''))) OVER (PARTITION BY rid, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM part),
found AS (SELECT rid, rank, label, CAST(a AS BIGINT) AS a, CAST(a + length(split_part(x, chr(2), 1)) AS BIGINT) AS z FROM spot WHERE contains(x, chr(2))),
outermost AS (SELECT * FROM found d WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.rid = d.rid AND e.a <= d.a AND d.z <= e.z AND (e.a <> d.a OR e.z <> d.z OR e.rank < d.rank))),
lists AS (SELECT rid, list({{'a': a, 'z': z, 'label': label}} ORDER BY rank, a) AS l FROM outermost GROUP BY rid),
kept AS (SELECT rid, list_reduce(list_prepend(l[1:0], list_transform(l, lambda x: [x])), lambda k, x: CASE WHEN len(list_filter(k, lambda y: y.a < x[1].z AND x[1].a < y.z)) > 0 THEN k ELSE list_concat(k, x) END) AS l FROM lists)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
 array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || list_transform(coalesce(l, []), lambda y: y.label))), ',') AS labels,
 CASE WHEN len(base) > 0 OR list_max(list_transform(l, lambda y: y.z - y.a)) >= {license.NOTICE} THEN 1.0 WHEN len(l) > 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS score, CAST(coalesce(len(l), 0) AS INTEGER) AS n_detections
FROM n LEFT JOIN kept USING (rid)"""


# --- near duplicates: exact shingle sets, all pairs that share a shingle, smallest reachable ids

OP6 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g, len(w) >= 5 AS whole FROM d),
n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id),
class AS (SELECT rid, doc_id, n, h FROM n JOIN (SELECT rid, md5(string_agg(g, chr(10) ORDER BY g) || CASE WHEN bool_and(whole) THEN 'f' ELSE 's' END) AS h FROM s GROUP BY rid) USING (rid) WHERE doc_id IS NOT NULL),
rep AS (SELECT h, any_value(n) AS n, min(rid) AS rid, min(doc_id) AS id FROM class GROUP BY h),
rs AS (SELECT r.rid, r.id, r.n, s.g, s.whole FROM rep r JOIN s USING (rid)),
overlap AS (SELECT x.id AS u, y.id AS v, x.n AS nx, y.n AS ny, count(*) AS c FROM rs x JOIN rs y ON x.g = y.g AND x.whole = y.whole AND x.rid < y.rid AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY x.rid, y.rid, x.id, y.id, x.n, y.n),
link AS (SELECT u, v FROM overlap WHERE 100 * c >= 85 * (nx + ny - c) AND u <> v UNION SELECT v, u FROM overlap WHERE 100 * c >= 85 * (nx + ny - c) AND u <> v
 UNION SELECT doc_id, id FROM class JOIN rep USING (h) WHERE doc_id <> id UNION SELECT id, doc_id FROM class JOIN rep USING (h) WHERE doc_id <> id),
reach AS (SELECT DISTINCT doc_id AS node, doc_id AS low FROM class UNION SELECT link.v, reach.low FROM reach JOIN link ON reach.node = link.u WHERE reach.low < link.v),
comp AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(low, d.doc_id), true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN comp ON comp.node = d.doc_id"""


# --- quality rules: counts, the ladders of the first half of the labels, the binomial test on the other half

_UNIT = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x})::DOUBLE))"
_MEAN = "(word_chars::DOUBLE / greatest(n_words, 1))"
_SIGNALS = {
    "symbols": _UNIT("n_symbols::DOUBLE / greatest(n_words, 1)"),
    "repeats": _UNIT("n_repeat_words::DOUBLE / greatest(n_words, 1)"),
    "dup_lines": _UNIT("n_dup_lines::DOUBLE / greatest(n_lines, 1)"),
    "long_words": _UNIT(f"({_MEAN} - 5) / 15::DOUBLE"),
    "short_words": _UNIT(f"(5 - {_MEAN}) / 5::DOUBLE"),
}
_BINS = f"unnest([{', '.join(repr(k) for k in _SIGNALS)}]) AS rule, unnest([{', '.join(f'CAST(floor({v} * {quality.GRID}) AS INTEGER)' for v in _SIGNALS.values())}]) AS bin"
_REACH = lambda c: f"sum({c}) OVER (PARTITION BY s, rule ORDER BY bin DESC)"
_ALL = lambda c: f"sum({c}) OVER (PARTITION BY s, rule)"
_ALPHA, _DELTA = 0.02, 0.05
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
lin AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, CASE WHEN len(w) < 100 THEN 0 WHEN len(w) < 300 THEN 1 WHEN len(w) < 1000 THEN 2 ELSE 3 END AS s FROM d LEFT JOIN cov USING (rid) LEFT JOIN lin USING (rid)),
b AS (SELECT rid, s, {_BINS} FROM c),
l AS (SELECT doc_id, min(quality) > 0 AS good, substr(md5('holdout ' || doc_id), 1, 1) < '8' AS held FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT rid, good, held FROM c JOIN l USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) = 1),
h AS (SELECT s, rule, bin, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS p FROM b JOIN k USING (rid) WHERE NOT held GROUP BY ALL),
grid AS (SELECT s, rule, bin, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM (SELECT * FROM (SELECT DISTINCT s, rule FROM h) CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {quality.GRID + 1}))) LEFT JOIN h USING (s, rule, bin)),
r AS (SELECT s, rule, bin, {_REACH('g')} AS gr, {_REACH('p')} AS pr, {_ALL('g')} AS gt, {_ALL('p')} AS pt FROM grid),
v AS (SELECT s, rule, bin, CASE WHEN bin > 0 AND pr::DOUBLE / greatest(1, pt) > 2 * (gr::DOUBLE / greatest(1, gt)) THEN greatest(0, least({quality.LEVELS}, floor(log2(2 * {_ALPHA}::DOUBLE / ((gr + 0.5::DOUBLE) / (gt + 1))) * 6 + 1e-9::DOUBLE))) ELSE 0 END AS level FROM r),
ladder AS (SELECT s, rule, bin, max(level) OVER (PARTITION BY s, rule ORDER BY bin) AS level FROM v),
sev AS (SELECT rid, s, coalesce(max(level), 0) AS level FROM b LEFT JOIN ladder USING (s, rule, bin) GROUP BY rid, s),
seen AS (SELECT s, level FROM sev JOIN k USING (rid) WHERE held AND good),
n AS (SELECT s, count(*) AS n FROM seen GROUP BY s),
pmf AS (SELECT s, x, exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({_ALPHA}::DOUBLE) + (n - x) * ln(1 - {_ALPHA}::DOUBLE)) AS q FROM n, LATERAL (SELECT unnest(range(0, CAST(floor(n.n * {_ALPHA}::DOUBLE) AS BIGINT) + 1)) AS x)),
cdf AS (SELECT s, x, sum(q) OVER (PARTITION BY s ORDER BY x) AS q FROM pmf),
most AS (SELECT s, max(x) AS most FROM cdf WHERE q <= {_DELTA / 4}::DOUBLE GROUP BY s),
tries AS (SELECT m.s, t.k, count(*) FILTER (e.level >= t.k) AS rejected, any_value(m.most) AS most FROM most m JOIN seen e ON e.s = m.s, (SELECT range AS k FROM range(1, {quality.LEVELS + 1})) t GROUP BY m.s, t.k),
cut AS (SELECT s, min(k) AS cut FROM tries WHERE rejected <= most GROUP BY s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(level >= cut, false) AS kept
FROM c JOIN sev USING (rid) LEFT JOIN cut ON cut.s = c.s"""

ORACLE = {"op1_warc_index_merge": OP1, "op2_license_scan": _op2(), "op4_hash_tree_sharding": OP4, "op5_quality_rules": OP5, "op6_minhash_near_dedup": OP6, "op12_fill_in_middle": fim.ORACLE}
