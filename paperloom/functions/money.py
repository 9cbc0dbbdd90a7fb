"""Money in whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, number_text, pad_number

HALF_CENT = 1e-6
NBSP = " "


def cents_error(value) -> Column:
    """Why an amount is refused, or null."""
    v = col(value).cast("double")
    scaled = v * 100
    return (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "not a number")
        .when(v < 0, "negative")
        .when(F.abs(scaled - F.floor(scaled + 0.5)) > HALF_CENT, "more than two decimals")
    )


def to_cents(value) -> Column:
    """Whole cents of an amount of at most two decimals; null where it is refused."""
    return F.when(cents_error(value).isNull(), F.floor(col(value).cast("double") * 100 + 0.5).cast("long"))


def format_money(cents) -> Column:
    """'€ 4 500,00' with no-break blanks between sign, thousands and digits."""
    c = col(cents).cast("long")
    whole = F.floor(F.abs(c) / 100).cast("long")
    groups = F.replace(F.format_number(whole, 0), F.lit(","), F.lit(NBSP))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("€" + NBSP), groups, F.lit(","), pad_number(F.abs(c) % 100))


def days_label(hours) -> Column:
    """A week's hours as days of eight hours."""
    h = col(hours).cast("double")
    days = h / 8
    return F.when(h == 0, "—").otherwise(F.concat(number_text(days), F.when(days <= 1, " day / week").otherwise(" days / week")))
