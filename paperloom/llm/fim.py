"""Fill-in-the-middle by escaped delimiters (operator 12); DataFrame functions only.

A text is cut into units (lines, by default) without a list of them: characters that could be
taken for the delimiter are escaped, `regexp_replace` writes the delimiter after each unit, and
counting it counts the units. `substring_index` then takes the first, middle or last of them
by rank, and what it took is freed of delimiters and unescaped. Two ranks drawn from a
SHA-256 of seed and doc_id end prefix and middle; a third draw leaves a text plain, a fourth
chooses between the orders prefix-suffix-middle (psm) and suffix-prefix-middle (spm).

A marker can't arise across a joint of two parts, as it starts with its only ``<`` and ends
with its only ``>``; so `restore` finds each where it was written.

Cases: null and empty text have no unit and stay plain (null stays null in ``output``); so does
a text that holds a marker; a null doc_id is drawn for as the text 'null'; repeated rows come
out alike; the delimiter and the escape character may stand in a text; an empty table gives an
empty result; input columns keep their names, and the new ones take a trailing ``_`` where
theirs (compared without case) is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

MARKERS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"
ESCAPE, DELIMITER = "\x01", "\x02"
RATE, SPM, SEED = 100, 50, "7"  # percent of the texts that are transformed, and of those in the order spm


def escaped(text: Column) -> Column:
    """The text without the delimiter; the escape character always stands before one of two letters."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def ranked(marked: Column, rank: Column) -> Column:
    """The first units of a marked text, as many as rank says; the last ones if it is negative."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def draws(seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: str = SEED, unit: str = UNIT) -> DataFrame:
    """docs(doc_id, text, ...) and ``n`` units, ``form``, ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``."""
    h1, h2, h3, h4 = draws(seed)
    row = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"), F.array(h1, h2, h3, h4).alias("h"))
    body = F.coalesce("text", F.lit(""))
    row = row.withColumn("marked", F.regexp_replace(escaped(body), unit, "$0" + DELIMITER))
    row = row.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    a, b = (F.get("h", k) % (F.col("n") + 1) for k in (F.lit(0), F.lit(1)))
    plain = (body == "") | (F.get("h", F.lit(2)) % 100 >= rate)
    for m in MARKERS:
        plain = plain | F.contains(body, F.lit(m))
    row = row.withColumns({"i": F.least(a, b), "j": F.greatest(a, b), "form": F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < spm, "spm").otherwise("psm")})
    some = F.col("form") != "plain"
    # a marked text ends with a delimiter, behind which an empty part counts from the right
    head = ranked(F.col("marked"), F.col("j"))
    parts = {
        "prefix": ranked(F.col("marked"), F.col("i")),
        "middle": F.when(F.col("i") == 0, head).otherwise(F.when(F.col("j") == F.col("i"), "").otherwise(ranked(head, F.col("i") - F.col("j")))),
        "suffix": ranked(F.col("marked"), F.col("j") - F.col("n") - 1),
    }
    row = row.withColumns({k: F.when(some, unescaped(v)) for k, v in parts.items()})
    p, s, m = (F.lit(x) for x in MARKERS)
    out = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    names = fresh(docs.columns, "n", "form", "prefix", "middle", "suffix", "output")
    new = {"n": F.col("n"), "form": F.col("form"), "prefix": F.col("prefix"), "middle": F.col("middle"), "suffix": F.col("suffix"), "output": out}
    return row.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[v.alias(names[k]) for k, v in new.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = MARKERS
    cut = lambda x, marker, n: F.substring_index(x, marker, n)
    body = F.substring(output, len(p) + 1, 2**31 - 1)
    first = F.when(form == "psm", cut(body, s, 1)).otherwise(cut(body, p, 1))
    rest = F.when(form == "psm", cut(body, s, -1)).otherwise(cut(body, p, -1))
    second, middle = cut(rest, m, 1), cut(rest, m, -1)
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, checksums of the output and of the text restored from it."""
    out = fill_in_middle(docs.select("doc_id", "text")).withColumn("output", F.coalesce("output", F.lit("")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same for DuckDB, by lists of lines.
ORACLE = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
ranks AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, n, form, t, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s FROM ranks)
SELECT doc_id::BIGINT AS doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
"""
