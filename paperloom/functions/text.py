"""Text scalars: tokens, white space, numbers as text, escapes. All built from SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as the documents' own tools define it (wider than the regex \s)
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACES = f"[{WHITE}]+"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenise(text) -> Column:
    """Words of a text: soft hyphens vanish, the fi and fl ligatures become letters."""
    t = F.replace(col(text), F.lit("­"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.filter(F.split(t, SPACES), lambda x: x != "")


def collapse(text) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACES, " "))


def truncate(text, n: int = 40) -> Column:
    t = collapse(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def strip_digits(text) -> Column:
    return F.regexp_replace(col(text), "[0-9]+", "")


def strip_tags(markup) -> Column:
    """Tags become blanks, entities characters, white space one blank."""
    return collapse(decode_entities(F.regexp_replace(col(markup), "<[^>]*>", " ")))


# fixed values: the five named entities of XML
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(text) -> Column:
    """Named entities of XML and numeric ones as characters; unknown ones stay, and nothing is decoded twice."""
    held = "\uE000"  # an ampersand that was written as one
    t = F.replace(col(text), F.lit("&amp;"), F.lit(held))
    for name, plain in NAMED:
        t = F.replace(t, F.lit(name), F.lit(plain))
    numeric = F.array_distinct(F.regexp_extract_all(t, F.lit("(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")))
    code = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.substring_index(F.substring(e, 4, 9), ";", 1), 16, 10)).otherwise(F.substring_index(F.substring(e, 3, 9), ";", 1)).cast("int")
    legal = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    step = lambda acc, e: F.when(legal(code(e)), F.replace(acc, e, letter(code(e)))).otherwise(acc)
    return F.replace(F.aggregate(numeric, t, step), F.lit(held), F.lit("&"))


def decode_entities_py(s: str) -> str:
    """The same for a reader's Python code."""
    names = {n[1:-1]: p for n, p in NAMED}

    def one(m):
        x = m[1]
        if x[0] != "#":
            return names.get(x, m[0])
        n = int(x[2:], 16) if x[1] in "xX" else int(x[1:])
        return chr(n) if 0 < n < 0xD800 or 0xE000 <= n < 0x110000 else m[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z]+);", one, s)


def escape_html(text) -> Column:
    """The five characters that markup gives a meaning."""
    t = col(text)
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(plain), F.lit(name))
    return t


def round_half_up(x) -> Column:
    """Nearest whole number, halves upward also below zero."""
    return F.floor(col(x) + 0.5).cast("long")


def number_text(x) -> Column:
    """A number as people write it: whole ones without a fraction."""
    x = col(x).cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def pad_number(n, width: int = 2) -> Column:
    """Zeros before a number up to a width; longer numbers stay whole."""
    t = col(n).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(t))), t)


def letters_to_index(letters) -> Column:
    """Zero-based column number of spreadsheet letters (A is 0, AA is 26)."""
    t = F.upper(col(letters))
    digits = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 26 + d) - 1
