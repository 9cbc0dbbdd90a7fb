"""What the contract queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the oracle's regular expressions.
ORACLE_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle_tokens(expr: str) -> str:
    clean = f"replace(replace(replace({expr}, chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl')"
    return f"list_filter(regexp_split_to_array({clean}, '{ORACLE_WS}'), lambda x: x <> '')"


def synthesised(text: str = "text") -> Column:
    """Markdown from a plain text's lines by their positions."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def dress(x, i):
        return (
            F.when(i == 0, F.concat(F.lit("# "), x))
            .when(i % 10 == 5, F.concat(F.lit("### "), x))
            .when(i % 5 == 0, F.concat(F.lit("## "), x))
            .when(i % 7 == 3, F.concat(F.lit("- "), x))
            .when(i % 11 == 6, "---")
            .when(i % 13 == 9, "<!-- pagebreak -->")
            .otherwise(x)
        )

    return F.array_join(F.transform(lines, dress), "\n\n")


#: The same blocks for the oracle: doc_id, block_ix, t, level, text.
ORACLE_BLOCKS = """
lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x,
                 generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents),
dressed AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '# ' || x WHEN i % 10 = 5 THEN '### ' || x WHEN i % 5 = 0 THEN '## ' || x
                   WHEN i % 7 = 3 THEN '- ' || x WHEN i % 11 = 6 THEN '---' WHEN i % 13 = 9 THEN '<!-- pagebreak -->' ELSE x END AS p FROM lines),
blocks AS (SELECT doc_id, i AS block_ix,
  CASE WHEN regexp_matches(p, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(p, '^(-{3,}|\\*{3,}|_{3,})$') THEN 'rule'
       WHEN p = '<!-- pagebreak -->' THEN 'pagebreak' WHEN regexp_matches(p, '^([-*+] |[0-9]+\\. )') THEN 'list'
       WHEN starts_with(p, '```') THEN 'code' WHEN starts_with(p, '> ') THEN 'quote'
       WHEN regexp_matches(p, '^!\\[[^\\]]*\\]\\([^)]*\\)$') THEN 'image' ELSE 'para' END AS t,
  CASE WHEN regexp_matches(p, '^#{1,6} ') THEN least(3, length(regexp_extract(p, '^(#+) ', 1))) END AS level,
  regexp_replace(p, '^(#{1,6} |[-*+] |[0-9]+\\. |> )', '') AS text FROM dressed),
lifted AS (SELECT *, min(CASE WHEN t = 'heading' AND level = 1 THEN block_ix END) OVER (PARTITION BY doc_id) AS title_ix FROM blocks),
rest AS (SELECT * FROM lifted WHERE block_ix IS DISTINCT FROM title_ix)
"""
