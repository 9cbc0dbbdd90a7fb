"""Cleaning of spreadsheets over sparse cells (key..., row, col, text, is_numeric).

The order of the steps is fixed: empty columns, leading blank rows, preamble, header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, letters_to_index

# fixed values: share of filled cells of a header; formats that are dates by their number; caps
HEADER_FILL = 0.6
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58)
MAX_ROWS, MAX_COLS, MAX_CELLS = 200, 25, 1_000_000


def used_range(cells: DataFrame, key: list[str]) -> DataFrame:
    """Bounds of all addressed cells, empty ones too, and how many there are."""
    return cells.groupBy(*key).agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"), F.count("*").alias("n_cells"))


def drop_empty_columns(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells of columns that hold some text, renumbered without gaps from 0."""
    full = cells.where("text <> ''").select(*key, "col").distinct()
    full = full.withColumn("new_col", F.dense_rank().over(Window.partitionBy(*key).orderBy("col")) - 1)
    return cells.join(full, [*key, "col"]).drop("col").withColumnRenamed("new_col", "col")


def trim_leading_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """Without the rows before the first one with text; blank rows further on stay."""
    first = F.min(F.when(F.col("text") != "", F.col("row"))).over(Window.partitionBy(*key))
    return cells.withColumn("first_row", first).where("row >= first_row").drop("first_row")


def lift_preamble(cells: DataFrame, key: list[str]) -> DataFrame:
    """part = 'preamble' before the first row with two cells of text or more, else 'table'."""
    filled = F.count_if(F.trim("text") != "").over(Window.partitionBy(*key, "row"))
    marked = cells.withColumn("filled", filled)
    start = F.min(F.when(F.col("filled") >= 2, F.col("row"))).over(Window.partitionBy(*key))
    return marked.withColumn("part", F.when(F.col("row") < start, "preamble").otherwise("table")).drop("filled")


def header_rows(cells: DataFrame, key: list[str], n_cols: Column | None = None) -> DataFrame:
    """By row: whether it looks like a header, no number in it and at least 60 % filled."""
    width = n_cols if n_cols is not None else F.count("*")
    got = cells.groupBy(*key, "row").agg(F.bool_or("is_numeric").alias("any_number"), F.count_if(F.trim("text") != "").alias("filled"), width.alias("width"))
    return got.select(*key, "row", (~F.col("any_number") & (F.col("filled") / F.col("width") >= HEADER_FILL)).alias("is_header"))


def refusals(cells: DataFrame, key: list[str], max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> DataFrame:
    """By sheet: status ok, empty or refused, and why."""
    r = used_range(cells, key).withColumns({"rows": F.col("r2") - F.col("r1") + 1, "cols": F.col("c2") - F.col("c1") + 1})
    text = cells.groupBy(*key).agg(F.count_if(F.col("text") != "").alias("filled"))
    r = r.join(text, key)
    status, reason = verdict(F.col("rows"), F.col("cols"), F.col("filled"), max_rows, max_cols)
    return r.select(*key, status.alias("status"), reason.alias("reason"), "rows", "cols")


def verdict(rows: Column, cols: Column, filled: Column, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> tuple[Column, Column]:
    """(status, reason) of a sheet by the size of its used range and how many cells hold text."""
    why = F.when(rows * cols > MAX_CELLS, F.format_string("%d cells", rows * cols)).when((rows > max_rows) | (cols > max_cols), F.format_string("%d rows and %d columns", rows, cols))
    status = F.when(filled == 0, "empty").when(why.isNotNull(), "refused").otherwise("ok")
    return status, F.when(status == "refused", why)


def parse_range(ref) -> Column:
    """'A1:B2' as a struct r1, c1, r2, c2 from 0; null if malformed."""
    part = lambda g: F.regexp_extract(col(ref), "^([A-Za-z]+)([0-9]+):([A-Za-z]+)([0-9]+)$", g)
    row = lambda g: part(g).cast("long") - 1
    good = F.rlike(col(ref), F.lit("^[A-Za-z]+[0-9]+:[A-Za-z]+[0-9]+$"))
    return F.when(good, F.struct(row(2).alias("r1"), letters_to_index(part(1)).alias("c1"), row(4).alias("r2"), letters_to_index(part(3)).alias("c2")))


def flatten_merges(cells: DataFrame, merges: DataFrame, key: list[str]) -> DataFrame:
    """Cells inside a merged range but for its first lose their text; merges(key..., r1, c1, r2, c2)."""
    m = merges.select(*[F.col(k).alias(f"m_{k}") for k in key], "r1", "c1", "r2", "c2")
    on = [F.col(k) == F.col(f"m_{k}") for k in key]
    inside = F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))
    other = (F.col("row") != F.col("r1")) | (F.col("col") != F.col("c1"))
    hit = cells.join(m, [*on, inside & other]).select(*key, "row", "col").distinct().withColumn("merged", F.lit(True))
    out = cells.join(hit, [*key, "row", "col"], "left")
    return out.withColumns({"text": F.when(F.col("merged"), "").otherwise(F.col("text")), "is_numeric": F.col("is_numeric") & F.col("merged").isNull()}).drop("merged")


def shared_strings(cells: DataFrame, strings: DataFrame, key: list[str]) -> DataFrame:
    """Texts of cells (key..., ix) by index, left outer: a miss is blank and ``missed``."""
    return cells.join(strings.withColumnRenamed("text", "found"), [*key, "ix"], "left").withColumns({"missed": F.col("found").isNull(), "text": F.coalesce("found", F.lit(""))}).drop("found")


def looks_like_date(code) -> Column:
    """A format code with d, m, y, h or s outside quotes and brackets."""
    bare = F.regexp_replace(F.regexp_replace(col(code), '"[^"]*"', ""), "\\[[^\\]]*\\]", "")
    return F.rlike(bare, F.lit("(?i)[dmyhs]"))


def is_date_format(num_fmt_id, code) -> Column:
    return col(num_fmt_id).isin(*DATE_FORMATS) | F.coalesce(looks_like_date(code), F.lit(False))


def serial_to_text(serial, date1904=None) -> Column:
    """A spreadsheet's serial day as ISO text, with HH:MM (cut, not rounded) if a part of a day is given."""
    s = col(serial).cast("double")
    epoch = F.lit("1899-12-30").cast("date") if date1904 is None else F.when(col(date1904), F.lit("1904-01-01").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    day = F.floor(s)
    ms = F.floor((s - day) * 86_400_000 + 0.5).cast("long")
    over = F.floor(ms / 86_400_000)
    date = F.date_format(F.date_add(epoch, (day + over).cast("int")), "yyyy-MM-dd")
    minutes = F.floor((ms % 86_400_000) / 60_000)
    clock = F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.when(F.abs(s - day) < 1e-9, date).otherwise(F.concat(date, F.lit(" "), clock))
