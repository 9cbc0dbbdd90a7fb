"""Link targets: which are refused, and how to name where they pointed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

REFUSED = "(?i)^(javascript|vbscript|data):"  # fixed value: schemes that a reader could run


def strip_controls(href) -> Column:
    """Without blanks and control characters, which browsers skip in a scheme."""
    return F.regexp_replace(col(href), "[\\x00-\\x20\\x7f]", "")


def scheme_is_refused(href) -> Column:
    return F.rlike(strip_controls(href), F.lit(REFUSED))


def refused_target(href) -> Column:
    """Host with a port that isn't its scheme's own, else the scheme, else what stands before the first colon."""
    clean = strip_controls(href)
    scheme = F.lower(F.regexp_extract(clean, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    authority = F.regexp_extract(clean, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)
    host = F.lower(authority)
    host = F.when(scheme == "http:", F.regexp_replace(host, ":80$", "")).when(scheme == "https:", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(host != "", host).when(scheme != "", scheme).otherwise(F.split_part(clean, F.lit(":"), F.lit(1)))


def refused_text(href, text) -> Column:
    return F.concat(col(text), F.lit(" ("), refused_target(href), F.lit(")"))


def image_markup(src, alt) -> Column:
    """An image that carries its data, or a placeholder that names where it would come from."""
    from .text import escape_html

    own = F.concat(F.lit('<img src="'), escape_html(src), F.lit('" alt="'), escape_html(alt), F.lit('">'))
    other = F.concat(F.lit('<span class="image-missing">'), escape_html(alt), F.lit(" ("), escape_html(refused_target(src)), F.lit(")</span>"))
    return F.when(F.startswith(col(src), F.lit("data:")), own).otherwise(other)
