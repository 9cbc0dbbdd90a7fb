"""Raster images by their leading bytes: kind and size."""

from __future__ import annotations

import functools
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# fixed values: signatures of the formats
SIGNATURES = (("image/png", b"\x89PNG\r\n\x1a\n"), ("image/jpeg", b"\xff\xd8\xff"), ("image/gif", b"GIF8"), ("image/bmp", b"BM"))


def sniff(data) -> Column:
    """The media type that the first bytes tell, or null."""
    out = None
    for mime, magic in SIGNATURES:
        hit = F.startswith(col(data), F.lit(magic))
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out


def _number(data, at: int, n: int, little: bool) -> Column:
    """An unsigned number of n bytes from byte `at` (from 0)."""
    places = range(n)[::-1] if little else range(n)
    return F.conv(F.concat(*[F.hex(F.substring(col(data), at + 1 + k, 1)) for k in places]), 16, 10).cast("long")


def png_size(data) -> Column:
    fits = F.startswith(col(data), F.lit(SIGNATURES[0][1])) & (F.length(col(data)) >= 24)
    return F.when(fits, F.struct(_number(data, 16, 4, False).alias("width"), _number(data, 20, 4, False).alias("height")))


def gif_size(data) -> Column:
    fits = F.startswith(col(data), F.lit(b"GIF8")) & (F.length(col(data)) >= 10)
    return F.when(fits, F.struct(_number(data, 6, 2, True).alias("width"), _number(data, 8, 2, True).alias("height")))


def jpeg_size_py(b: bytes) -> tuple[int, int] | None:
    """Walk the segments to the first frame header."""
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return (w, h) if w and h else None
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        elif mark in (0xD9, 0xDA):
            return None
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def bmp_size_py(b: bytes) -> tuple[int, int] | None:
    if b[:2] != b"BM" or len(b) < 26:
        return None
    kind = struct.unpack("<I", b[14:18])[0]
    if kind == 12:
        w, h = struct.unpack("<HH", b[18:22])
    elif kind >= 40:
        w, h = struct.unpack("<ii", b[18:26])
    else:
        return None
    return (w, abs(h)) if w > 0 and h else None


@functools.cache
def _sizes(kind: str):
    """A reader of sizes as a vectorised function; made on the driver only."""
    read = {"jpeg": jpeg_size_py, "bmp": bmp_size_py}[kind]

    @F.pandas_udf("width long, height long")
    def size(s: pd.Series) -> pd.DataFrame:
        got = [read(bytes(x)) if x is not None else None for x in s]
        return pd.DataFrame({"width": pd.array([g and g[0] for g in got], "Int64"), "height": pd.array([g and g[1] for g in got], "Int64")})

    return size


def raster_size(data) -> Column:
    """Width and height by the first reader that succeeds; the fields are null if none does."""
    kind = sniff(data)
    jpeg, bmp = _sizes("jpeg")(col(data)), _sizes("bmp")(col(data))
    png, gif = png_size(data), gif_size(data)
    pick = lambda f: F.when(kind == "image/png", png[f]).when(kind == "image/gif", gif[f]).when(kind == "image/jpeg", jpeg[f]).when(kind == "image/bmp", bmp[f])
    return F.struct(pick("width").alias("width"), pick("height").alias("height"), kind.alias("type"))


def can_embed(src) -> Column:
    """True for a data: URI of one of the four formats whose size can be read."""
    body = F.regexp_extract(col(src), "^data:image/(?:png|jpeg|gif|bmp);base64,(.*)$", 1)
    size = raster_size(F.try_to_binary(body, F.lit("base64")))
    return F.coalesce((body != "") & (size["width"] > 0) & (size["height"] > 0), F.lit(False))
