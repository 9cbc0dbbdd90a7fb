"""PDF pages as rectangles and text runs, and from them as headings, paragraphs and tables.

The decoder reads files with plain or Flate-compressed streams (object streams too) and
simple fonts, replaying each page's operators with a stack of matrices: rectangles go to
page space, text is kept where it isn't rotated, and rotated text is counted. Everything
that can't be read refuses the file, by name.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import pages as P
from .base import kept, rows_by_document

PAGES = "doc_id long, page int, width_pt double, height_pt double, rotated int, images int, error string"

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
# fixed values: how many operands each path operator takes
PATH = {b"m": 2, b"l": 2, b"c": 6, b"v": 4, b"y": 4, b"h": 0, b"re": 4}
PAINT = {b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"}


def multiply(m: tuple, n: tuple) -> tuple:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])


class Ref(tuple):
    """A reference to an object: its number and generation."""


class Name(str):
    """A name object."""


TOKEN = re.compile(
    rb"[\s\x00]*(?:%[^\r\n]*[\s\x00]*)*(?:(?P<ref>(\d+)[\s\x00]+(\d+)[\s\x00]+R(?![A-Za-z]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\s\x00()<>\[\]{}/%]*)|(?P<dict><<)|(?P<end>>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<str>\()|(?P<open>\[)|(?P<close>\])|(?P<word>[^\s\x00()<>\[\]{}/%]+))"
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets from behind its opening one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(m[0], 8) & 255)
                at += 1 + len(m[0])
                continue
            if nxt == b"\r" and data[at + 2 : at + 3] == b"\n":
                at += 3
                continue
            if nxt not in (b"\n", b"\r"):
                out += ESCAPES.get(nxt, nxt)
            at += 2
            continue
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), at + 1
        out += c
        at += 1
    return bytes(out), at


def values(data: bytes, at: int = 0):
    """Objects and operator words of a stream, each with where it ends."""
    stack: list[list] = []
    while m := TOKEN.match(data, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup else "word"
        for name in ("ref", "num", "name", "dict", "end", "hex", "str", "open", "close", "word"):
            if m[name] is not None:
                kind = name
                break
        if kind == "ref":
            v = Ref((int(m[2]), int(m[3])))
        elif kind == "num":
            v = float(m["num"]) if b"." in m["num"] else int(m["num"])
        elif kind == "name":
            v = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"][1:]).decode("latin-1"))
        elif kind == "hex":
            h = re.sub(rb"\s", b"", m["hex"][1:-1])
            v = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif kind == "str":
            v, at = literal(data, at)
        elif kind in ("dict", "open"):
            stack.append([kind])
            continue
        elif kind in ("end", "close"):
            if not stack:
                continue
            opened, *items = stack.pop()
            v = dict(zip(items[::2], items[1::2], strict=False)) if opened == "dict" else items
        else:
            word = m["word"]
            v = {b"true": True, b"false": False, b"null": None}.get(word, word)
            if isinstance(v, bytes) and not stack:
                yield ("op", v, at)
                continue
        if stack:
            stack[-1].append(v)
        else:
            yield ("value", v, at)


class Refused(ValueError):
    """Why a file can't be read."""


class File:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Refused("not a PDF")
        self.data = data
        self.at = {int(m[1]): m.end() for m in re.finditer(rb"(?<!\d)(\d+)[ \t\r\n]+\d+[ \t\r\n]+obj\b", data)}
        self.packed: dict[int, object] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Refused("encrypted")
        for n in list(self.at):
            body = self.get(Ref((n, 0)))
            if isinstance(body, dict) and body.get("Type") == "ObjStm":
                self.unpack(n, body)

    def unpack(self, n: int, head: dict) -> None:
        data = self.stream(Ref((n, 0)))
        first, count = self.get(head["First"]), self.get(head["N"])
        numbers = [v for kind, v, _ in values(data[:first]) if kind == "value"][: 2 * count]
        for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
            found = next((v for kind, v, _ in values(data, first + offset) if kind == "value"), None)
            self.packed.setdefault(number, found)

    def get(self, v):
        for _ in range(20):
            if not isinstance(v, Ref):
                return v
            if v[0] in self.packed:
                v = self.packed[v[0]]
            elif v[0] in self.at:
                v = next((x for kind, x, _ in values(self.data, self.at[v[0]]) if kind == "value"), None)
            else:
                return None
        return None

    def stream(self, v) -> bytes:
        """A stream's content; only Flate filters are read."""
        if not isinstance(v, Ref) or v[0] not in self.at:
            return b""
        start = self.at[v[0]]
        head = self.get(v)
        m = re.compile(rb"stream\r?\n").search(self.data, start)
        if not isinstance(head, dict) or m is None:
            return b""
        length = self.get(head.get("Length"))
        end = m.end() + length if isinstance(length, int) and self.data[m.end() + length :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
        body = self.data[m.end() : end]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise Refused(f"filter {f}")
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error as e:
                raise Refused("a broken stream") from e
        return body

    def pages(self) -> list[dict]:
        """Page objects in order, with what they inherit."""
        root = next((self.get(Ref((n, 0))) for n in [*self.at, *self.packed] if isinstance(self.get(Ref((n, 0))), dict) and self.get(Ref((n, 0))).get("Type") == "Catalog"), None)
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 50:
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        if root is None:
            raise Refused("no catalog")
        walk(root.get("Pages"), {}, 0)
        return out

    def decoder(self, font):
        """Characters of a font's codes: its own table if it has one, else Windows Latin."""
        font = self.get(font) or {}
        table: dict[int, str] = {}
        width = 2 if font.get("Subtype") == "Type0" else 1
        if isinstance(font.get("ToUnicode"), Ref):
            text = self.stream(font["ToUnicode"])
            utf = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    table[int(a, 16)] = utf(b)
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
                for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    for k in range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1):
                        table[k] = utf(b)[:-1] + chr(ord(utf(b)[-1]) + k - int(a, 16))

        def read(raw: bytes) -> str:
            codes = [int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)]
            return "".join(table.get(c) or (bytes([c]).decode("cp1252", "replace") if c < 256 else "�") for c in codes)

        return read


def page_geometry(file: File, page: dict) -> dict:
    """Rectangles and runs of one page, in points from its lower left corner."""
    box = [float(file.get(x)) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    resources = file.get(page.get("Resources")) or {}
    fonts = {k: file.decoder(v) for k, v in (file.get(resources.get("Font")) or {}).items()}
    contents = file.get(page.get("Contents"))
    streams = [file.stream(x) for x in contents] if isinstance(contents, list) else [file.stream(page.get("Contents"))]
    ctm, saved = (1.0, 0.0, 0.0, 1.0, -box[0], -box[1]), []
    rects: list[tuple] = []
    runs: list[tuple] = []
    pending: list[tuple] = []
    line: list[tuple[float, float]] = []
    rotated = images = 0
    tm = tlm = IDENTITY
    font, size, leading = None, 0.0, 0.0
    operands: list = []

    def show(raw: bytes) -> None:
        nonlocal rotated, tm
        text = fonts.get(font, lambda b: b.decode("cp1252", "replace"))(raw)
        m = multiply(tm, ctm)
        if abs(m[1]) > 1e-6 or abs(m[2]) > 1e-6:
            rotated += 1
        elif text.strip():
            x, y = apply(m, 0, 0)
            runs.append((text, x, y, abs(size * m[3])))
        tm = multiply((1, 0, 0, 1, size * 0.5 * len(text), 0), tm)

    def flush(paint: bool) -> None:
        if len(line) >= 4:
            xs, ys = {round(p[0], 4) for p in line}, {round(p[1], 4) for p in line}
            if len(xs) == 2 and len(ys) == 2:
                pending.append((min(xs), min(ys), max(xs), max(ys)))
        if paint:
            rects.extend(pending)
        pending.clear()
        line.clear()

    for kind, v, _ in values(b"\n".join(streams)):
        if kind == "value":
            operands.append(v)
            continue
        n = [x for x in operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if v == b"q":
            saved.append(ctm)
        elif v == b"Q" and saved:
            ctm = saved.pop()
        elif v == b"cm" and len(n) == 6:
            ctm = multiply(tuple(n), ctm)
        elif v in PATH:
            if len(n) < PATH[v]:
                raise Refused(f"path operator {v.decode()} with {len(n)} operands")
            if v == b"re":
                x, y, w, h = n[-4:]
                (a, b), (c, d) = apply(ctm, x, y), apply(ctm, x + w, y + h)
                pending.append((min(a, c), min(b, d), max(a, c), max(b, d)))
            elif v in (b"m", b"l"):
                line.append(apply(ctm, *n[-2:]))
        elif v in PAINT:
            flush(v != b"n")
        elif v == b"BT":
            tm = tlm = IDENTITY
        elif v == b"Tf" and len(operands) >= 2:
            font, size = operands[-2], float(operands[-1])
        elif v == b"TL" and n:
            leading = n[-1]
        elif v in (b"Td", b"TD") and len(n) >= 2:
            leading = -n[-1] if v == b"TD" else leading
            tm = tlm = multiply((1, 0, 0, 1, n[-2], n[-1]), tlm)
        elif v == b"Tm" and len(n) == 6:
            tm = tlm = tuple(n)
        elif v in (b"T*", b"'", b'"'):
            tm = tlm = multiply((1, 0, 0, 1, 0, -leading), tlm)
        elif v == b"Do":
            images += 1
        if v in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
            show(operands[-1])
        elif v == b"TJ" and operands and isinstance(operands[-1], list):
            show(b"".join(x for x in operands[-1] if isinstance(x, bytes)))
        operands.clear()
    return {"width": box[2] - box[0], "height": box[3] - box[1], "rects": rects, "runs": runs, "rotated": rotated, "images": images}


def _decode(data, max_pages: int = P.MAX_PAGES) -> tuple[list[dict], str | None]:
    try:
        file = File(bytes(data or b""))
        pages = file.pages()
        if len(pages) > max_pages:
            return [], f"{len(pages)} pages; at most {max_pages} are read"
        out = [page_geometry(file, p) for p in pages]
    except Refused as e:
        return [], str(e)
    except (RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError) as e:
        return [], f"unreadable: {type(e).__name__}"
    crowded = next((k for k, p in enumerate(out) if len(p["rects"]) > P.MAX_RECTS), None)
    return ([], f"page {crowded + 1} has {len(out[crowded]['rects'])} rectangles") if crowded is not None else (out, None)


DECODED = f"{PAGES}, rects array<struct<x0:double,y0:double,x1:double,y1:double>>, runs array<struct<text:string,x:double,y:double,size_pt:double>>"


def decoded_rows(doc_id, data) -> list[dict]:
    """A row for each page, or one that says why the file is refused."""
    got, error = _decode(data)
    blank = dict.fromkeys(x.split(" ")[0] for x in PAGES.split(", ")) | {"doc_id": doc_id, "rects": [], "runs": []}
    if error:
        return [blank | {"error": error}]
    return [
        blank
        | {"page": k, "width_pt": p["width"], "height_pt": p["height"], "rotated": p["rotated"], "images": p["images"]}
        | {"rects": [dict(zip(("x0", "y0", "x1", "y1"), r, strict=True)) for r in p["rects"]], "runs": [dict(zip(("text", "x", "y", "size_pt"), r, strict=True)) for r in p["runs"]]}
        for k, p in enumerate(got)
    ]


def geometry(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rects, runs, pages) of files(doc_id, content); a file is decoded once, and its pages are written for all that follows."""
    pages = kept(rows_by_document(files.select("doc_id", "content"), decoded_rows, DECODED))
    rects = pages.select("doc_id", "page", F.posexplode("rects").alias("rect_ix", "r")).select("doc_id", "page", "rect_ix", "r.*")
    runs = pages.select("doc_id", "page", F.posexplode("runs").alias("run_ix", "r")).select("doc_id", "page", "run_ix", "r.*")
    return rects, runs, pages.drop("rects", "runs")


def read(files: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """blocks, cells of tables, repeated furniture and what was lost, of files(doc_id, content).

    rules(doc_id, above, below) declares which furniture goes. A document whose blocks would not hold
    the source's tokens in the source's order is refused and gives no block.
    """
    rects, runs, pages = geometry(files)
    key = ["doc_id", "page"]
    body, said = A.chrome(runs, rules)
    sized = rects.join(pages.select(*key, "width_pt", "height_pt"), key)
    framed = P.without_page_frame(sized, F.col("width_pt"), F.col("height_pt")).select(*rects.columns)
    xs, ys = P.find_grids(framed, key)
    cells = kept(P.table_cells(body, xs, ys, key))
    made = A.assemble(body, xs, ys, cells)
    apart = kept(made["divergence"])
    blocks = made["blocks"].join(apart.select("doc_id"), "doc_id", "left_anti")
    say = lambda df, kind, message: df.select("doc_id", F.lit(kind).alias("kind"), message.alias("message"))
    dropped = say(pages.where("error is not null"), "refused", F.col("error"))
    dropped = dropped.unionByName(say(apart, "refused", F.format_string("token %d: the source reads %s, the document %s", "pos", F.coalesce("expected", F.lit("nothing")), F.coalesce("found", F.lit("nothing")))))
    dropped = dropped.unionByName(say(pages.where("rotated > 0"), "rotated", F.format_string("page %d: %d rotated runs", F.col("page") + 1, "rotated")))
    dropped = dropped.unionByName(say(pages.where("images > 0"), "image", F.format_string("page %d: %d images", F.col("page") + 1, "images")))
    return {"blocks": blocks, "cells": cells, "repeated": P.find_repeated(body, ["doc_id"]), "dropped": dropped.unionByName(said).unionByName(made["dropped"])}
