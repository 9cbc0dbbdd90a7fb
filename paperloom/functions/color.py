"""Steps of a heatmap, tints and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, pad_number

# fixed values: tints of the steps, palest first; the band behind a statement
SCALE_STEPS = (0.18, 0.32, 0.6, 1.0)
STATEMENT_TINT = 0.08


def step_of(value, most, steps: int) -> Column:
    """0 for nothing, else 1..steps by the share of the largest value, rounded up."""
    v, m = col(value), col(most)
    return F.when((v <= 0) | (m <= 0), 0).otherwise(F.least(F.lit(steps), F.ceil(v / m * steps))).cast("int")


def channel(color, k: int) -> Column:
    return F.conv(F.substring(F.replace(col(color), F.lit("#"), F.lit("")), 1 + 2 * k, 2), 16, 10).cast("int")


def mix_to_white(color, t) -> Column:
    """A colour '#RRGGBB' blended with white; t = 1 leaves it, t = 0 is white."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    parts = [F.lpad(F.hex(F.floor(channel(color, k) * t + 255 * (1 - t) + 0.5).cast("int")), 2, "0") for k in range(3)]
    return F.concat(F.lit("#"), *parts)


def luminance(color) -> Column:
    """Relative luminance after WCAG."""
    def linear(k):
        c = channel(color, k) / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def readable_on(fill, ink) -> Column:
    """The ink or white, whichever has the larger contrast on a fill."""
    ground = luminance(fill)
    return F.when(contrast(ground, luminance(ink)) >= contrast(ground, F.lit(1.0)), col(ink)).otherwise(F.lit("#FFFFFF"))


def week_label(i) -> Column:
    return F.concat(F.lit("W"), pad_number(col(i) + 1))
