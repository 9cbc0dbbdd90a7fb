"""Measures of a page, dates of a file, and what stands in a letterhead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# fixed values: page sizes in points, millimetres in a point
PAGE_PT = {"A4": (595.28, 841.89), "Letter": (612.0, 792.0)}
MM_IN_POINT = 0.352778
LAST_EPOCH = 8_640_000_000_000  # seconds up to which a date can be written


def units(pt, in_a_point: float) -> Column:
    """Points in another unit, to the nearest whole: 2 for half points, 8 for eighths, 20 for twentieths, 12,700 for EMU."""
    return F.floor(col(pt) * F.lit(float(in_a_point)) + 0.5).cast("long")


def _side(size, k: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, sides in PAGE_PT.items() for x in (name, sides[k])]), col(size))


def column_dxa(size, margin_pt) -> Column:
    """The text column's width in twentieths of a point."""
    return units(_side(size, 0) - col(margin_pt) * 2, 20)


def landscape_dxa(size, margin_pt) -> Column:
    """The same on the sheet turned on its side."""
    return units(_side(size, 1) - col(margin_pt) * 2, 20)


def sizing(size, margin_pt, body_pt) -> Column:
    """What a table's widths are worked out from: both columns and the body's size."""
    return F.struct(column_dxa(size, margin_pt).alias("total"), landscape_dxa(size, margin_pt).alias("landscape"), col(body_pt).cast("double").alias("body_pt"))


def to_mm(pt) -> Column:
    return F.format_string("%.2fmm", col(pt).cast("double") * MM_IN_POINT)


def cover_statement_pt(title_pt, h2_pt) -> Column:
    """The size of a cover's statement: half the title's, but no smaller than a second heading's."""
    return F.greatest(col(title_pt) * 0.5, col(h2_pt))


def epoch_of(modified, override: str | None = None) -> Column:
    """Seconds that date a document: the override's digits if it is set, else the file's time, never negative."""
    if override:
        if not override.isdecimal():
            raise ValueError(f"the date override must be a whole number of seconds, got {override!r}")
        return F.lit(int(override)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.unix_seconds(col(modified)))


def date_of(epoch) -> Column:
    """The time of an epoch; null outside what can be written."""
    e = col(epoch)
    return F.when((e >= 0) & (e <= LAST_EPOCH) & (e == F.floor(e)), F.timestamp_seconds(e.cast("long")))


def letterhead_lines(entity, date) -> Column:
    """Entity, then date; what is unset or empty leaves no line."""
    return F.filter(F.array(col(entity), col(date)), lambda x: F.coalesce(x, F.lit("")) != "")


def inline_paint(svg) -> Column:
    """Where a drawing is painted other than by class (where, found); null if nowhere."""
    s = col(svg)
    attribute = F.regexp_extract(s, "(?i)\\b((fill|stroke)\\s*=\\s*(?:\"[^\"]*\"|'[^']*'))", 1)
    style = F.regexp_extract(s, "(?i)\\bstyle\\s*=\\s*(\"[^\"]*\"|'[^']*')", 1)
    sheet = F.regexp_extract(s, "(?is)<style[^>]*>(.*?)</style>", 1)
    rule = lambda text: F.regexp_extract(text, "(?i)\\b((fill|stroke)\\s*:)", 1)
    word = lambda found: F.regexp_extract(found, "(?i)^(fill|stroke)", 1)
    row = lambda where, found: F.struct(where.alias("where"), found.alias("found"))
    return (
        F.when(attribute != "", row(F.concat(F.lit('a "'), word(attribute), F.lit('" attribute')), attribute))
        .when(rule(style) != "", row(F.concat(F.lit('"'), word(rule(style)), F.lit(':" inside a style attribute')), rule(style)))
        .when(rule(sheet) != "", row(F.concat(F.lit('"'), word(rule(sheet)), F.lit(':" inside a <style> element')), rule(sheet)))
    )
