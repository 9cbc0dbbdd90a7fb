import struct

import pytest
from pyspark.sql import functions as F

from paperloom.functions import color, images, links, money, text


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column).collect()]


def blanks(texts):
    """Texts with plain blanks in place of no-break ones, of which there must be some."""
    assert any("\u00a0" in t for t in texts)
    return [t.replace("\u00a0", " ") for t in texts]


def test_tokens(spark):
    rows = ["\u20ac\u00a04\u00a0500,00", "soft\u00adhyphen", "\ufb01gure \ufb02ow", "\u2003a\tb\u3000c\ufeffd ", "", None]
    assert values(spark, text.tokenise("x"), rows) == [["\u20ac", "4", "500,00"], ["softhyphen"], ["figure", "flow"], ["a", "b", "c", "d"], [], None]


def test_truncate_and_tags(spark):
    assert values(spark, text.truncate("x", 5), ["a  b", "abcdefgh"]) == ["a b", "abcde…"]
    assert values(spark, text.strip_tags("x"), ["<p>a&amp;b<br>c</p>"]) == ["a&b c"]


@pytest.mark.parametrize("raw, want", [("&lt;&gt;&quot;&apos;&amp;", "<>\"'&"), ("&amp;lt;", "&lt;"), ("&#65;&#x20AC;", "A€"), ("&amp;#66;", "&#66;"), ("&#38;lt;", "&lt;"), ("&copy; &middot;", "&copy; &middot;"), ("&#0;&#xD800;", "&#0;&#xD800;"), ("&#x1F600;", "😀")])
def test_entities(spark, raw, want):
    assert values(spark, text.decode_entities("x"), [raw]) == [want]
    assert text.decode_entities_py(raw) == want


def test_letters_and_numbers(spark):
    assert values(spark, text.letters_to_index("x"), ["A", "Z", "AA", "AB", "XFD"]) == [0, 25, 26, 27, 16383]
    assert values(spark, text.number_text("x"), [20.0, 12345678.0, 1.5, -3.0], "double") == ["20", "12345678", "1.5", "-3"]
    assert values(spark, text.pad_number("x"), [5, 100], "int") == ["05", "100"]
    assert values(spark, text.round_half_up("x"), [2.5, -2.5, 1.49], "double") == [3, -2, 1]


def test_cents(spark):
    rows = [45.0, 45.5, 0.01, 88000.0, 45.55, 45.555, -1.0, float("nan"), None]
    assert values(spark, money.to_cents("x"), rows, "double") == [4500, 4550, 1, 8800000, 4555, None, None, None, None]
    assert values(spark, money.cents_error("x"), rows, "double") == [None] * 5 + ["more than two decimals", "negative", "not a number", "not a number"]


def test_money(spark):
    assert blanks(values(spark, money.format_money("x"), [450000, 5, 123456789, 0], "long")) == ["€ 4 500,00", "€ 0,05", "€ 1 234 567,89", "€ 0,00"]
    assert values(spark, money.days_label("x"), [4, 16, 0, 8, 9], "int") == ["0.5 day / week", "2 days / week", "—", "1 day / week", "1.125 days / week"]


def test_steps_and_colors(spark):
    rows = [0, 1, 4, 5, 8, 12, 13, 16]
    assert values(spark, color.step_of("x", F.lit(16), 4), rows, "int") == [0, 1, 1, 2, 2, 3, 4, 4]
    assert values(spark, color.step_of("x", F.lit(0), 4), [0], "int") == [0]
    assert [values(spark, color.mix_to_white("x", t), ["#DA291C"])[0] for t in (1, 0, 0.32)] == ["#DA291C", "#FFFFFF", "#F3BBB6"]
    assert values(spark, color.week_label("x"), [0, 15, 99], "int") == ["W01", "W16", "W100"]
    assert values(spark, color.readable_on("x", F.lit("#1A1A1A")), ["#1A1A1A", "#FFFFFF"]) == ["#FFFFFF", "#1A1A1A"]


def test_links(spark):
    rows = ["javascript:x", "java\tscript:x", " DATA:a", "https://User@Ex.com:8080/a", "http://h:80/", "mailto:a@b", "no colon", "vbscript:"]
    assert values(spark, links.scheme_is_refused("x"), rows) == [True, True, True, False, False, False, False, True]
    assert values(spark, links.refused_target("x"), rows) == ["javascript:", "javascript:", "data:", "ex.com:8080", "h", "mailto:", "nocolon", "vbscript:"]


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 300, 20)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc4" + struct.pack(">H", 2) + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 70, 90) + b"\0" * 8
    bmp = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -9) + b"\0" * 8
    rows = [bytearray(x) for x in (png, gif, jpeg, bmp, png[:20], b"", b"\xff\xd8\xff")] + [None]
    got = values(spark, images.raster_size("x"), rows, "binary")
    assert [(r["type"], r["width"], r["height"]) for r in got] == [("image/png", 640, 480), ("image/gif", 300, 20), ("image/jpeg", 90, 70), ("image/bmp", 7, 9), ("image/png", None, None), (None, None, None), ("image/jpeg", None, None), (None, None, None)]


def test_embedding(spark):
    import base64

    png = base64.b64encode(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 2, 3)).decode()
    assert values(spark, images.can_embed("x"), [f"data:image/png;base64,{png}", "data:image/svg+xml;base64,AAAA", "http://x/y.png", "data:image/png;base64,AAAA", None]) == [True, False, False, False, False]
