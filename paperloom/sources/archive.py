"""Office packages: spreadsheets and word-processing documents as normalised tables.

A package is a zip of XML parts. Decoding a part is one task's work on one file; everything
after that (typing, lookups, cleaning, numbering) is a plan over the decoded tables.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import SIGNATURES
from ..functions.text import letters_to_index, number_text
from ..operators import sheets as S
from .base import kept, rows_by_document

REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


@lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    for k, v in e.attrib.items():
        if local(k) == name:
            return v
    return None


def value(e: ET.Element | None) -> str | None:
    """What an element of one value says."""
    return None if e is None else attribute(e, "val")


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e if local(x.tag) == name]


def first(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        for x in e:
            if local(x.tag) == name:
                break
        else:
            x = None
        e = x
    return e


def descend(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if local(x.tag) == name]


class Package:
    """Parts of a zip by name; a broken package has an ``error`` and no parts."""

    def __init__(self, data: bytes):
        self.error: str | None = None
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.zip.namelist())
        except (zipfile.BadZipFile, OSError) as e:
            self.error, self.names = f"not a readable package: {e}", set()

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        try:
            return ET.fromstring(self.zip.read(name))
        except (ET.ParseError, zipfile.BadZipFile, RuntimeError):
            self.error = f"{name} is not well-formed"
            return None

    def elements(self, name: str, wanted: tuple[str, ...]) -> Iterator[ET.Element]:
        """The elements of some names in a part, one at a time as it is read; what was gone by is let go of."""
        if name not in self.names:
            return
        try:
            with self.zip.open(name) as part:
                above, within = [], 0
                for event, e in ET.iterparse(part, ("start", "end")):
                    hit = local(e.tag) in wanted
                    if event == "start":
                        above.append(e)
                        within += hit
                        continue
                    above.pop()
                    within -= hit
                    if hit and not within:
                        yield e
                    if above and not within:
                        above[-1].remove(e)
        except (ET.ParseError, zipfile.BadZipFile, RuntimeError):
            self.error = f"{name} is not well-formed"

    def relations(self, name: str) -> dict[str, tuple[str, str, bool]]:
        """Relationship id to (type, target within the package, external)."""
        folder, _, base = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in children(root, "Relationship"):
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                parts: list[str] = [] if target.startswith("/") else folder.split("/")
                for p in target.strip("/").split("/"):
                    parts = parts[:-1] if p == ".." else [*parts, p]
                target = "/".join(x for x in parts if x)
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, external)
        return out


# --- spreadsheets

#: Cells move in packs: parallel arrays of some cells of one sheet, in the order of its part. ``whole`` says that a pack
#: is all of a plain sheet (each cell once, row by row, no merged range, nothing left to look up).
WORKBOOK = """doc_id long, kind string, sheet_ix int, sheet string, n_sheets int, whole boolean, styled boolean, date1904 boolean, row array<int>, col array<int>,
ref array<string>, t array<string>, s array<int>, v array<string>, has_formula array<boolean>, num_fmt_id array<int>, code array<string>, found array<string>, ix int, text string, error string"""
CELL = ("ref", "t", "s", "v", "has_formula", "num_fmt_id", "code", "found")  # what a pack knows of each cell besides its place
PACK, PACK_CHARS = 1000, 1 << 18  # of cells and their characters that go on together
HELD, HELD_CHARS = 100_000, 1 << 21  # of shared strings that are looked up while a workbook is read; a join finds the others
REF = re.compile(r"([A-Za-z]{1,6})([0-9]{1,9})")
NAMED_SHEETS = re.compile(r"Sheet1$")


def workbook_rows(doc_id, data) -> Iterator[dict]:
    """A workbook as raw attributes, read once and part by part: shared strings, cell formats, number formats and the
    date system, then its sheets, every addressed cell and merged range. A part that breaks off is an error row of its sheet."""
    p = Package(bytes(data or b""))
    book = p.xml("xl/workbook.xml")
    if book is None:
        yield {"kind": "error", "sheet_ix": None, "sheet": None, "error": p.error or "no workbook part"}
        return
    relations = p.relations("xl/workbook.xml")
    for k, si in enumerate(p.elements("xl/sharedStrings.xml", ("si",))):
        yield {"kind": "string", "ix": k, "v": "".join(t.text or "" for t in descend(si, "t"))}
    styles = p.xml("xl/styles.xml")
    for k, xf in enumerate(children(first(styles, "cellXfs"), "xf")):
        yield {"kind": "format", "ix": k, "num_fmt_id": int(xf.get("numFmtId", "0"))}
    for f in children(first(styles, "numFmts"), "numFmt"):
        yield {"kind": "code", "num_fmt_id": int(f.get("numFmtId", "0")), "v": f.get("formatCode", "")}
    props = first(book, "workbookPr")
    yield {"kind": "book", "date1904": props is not None and props.get("date1904") in ("1", "true"), "styled": styles is not None}
    sheets = children(first(book, "sheets"), "sheet")
    for k, sheet in enumerate(sheets):
        where = {"sheet_ix": k, "sheet": sheet.get("name", "")}
        yield where | {"kind": "sheet", "n_sheets": len(sheets)}
        target = relations.get(sheet.get(f"{REL}id") or attribute(sheet, "id") or "", ("", "", False))[1]
        p.error = None
        for c in p.elements(target, ("c", "mergeCell")):
            if local(c.tag) == "mergeCell":
                yield {"kind": "merge", "sheet_ix": k, "ref": c.get("ref")}
                continue
            parts: dict[str, ET.Element] = {}
            for e in c:
                parts.setdefault(local(e.tag), e)
            inline, v = parts.get("is"), parts.get("v")
            text = "".join(t.text or "" for t in descend(inline, "t")) if inline is not None else None if v is None else (v.text or "")
            yield {"kind": "cell", "sheet_ix": k, "ref": c.get("r"), "t": c.get("t", "n"), "s": int(c.get("s")) if (c.get("s") or "").isdigit() else None, "v": text, "has_formula": "f" in parts}
        if p.error or target not in p.names:
            yield where | {"kind": "error", "error": "the sheet's part is missing"}
        yield {"kind": "end", "sheet_ix": k}


def string_index(v: str | None) -> int | None:
    """The number of a shared string as it stands in a cell; blank is the first."""
    try:
        return int(float((v or "0").strip().rstrip("dDfF").replace("_", "?") or "0"))
    except (ValueError, OverflowError):
        return None


@lru_cache(1 << 14)
def place_of(ref: str | None) -> tuple[int, int] | None:
    """Row and column from 0 of a cell's reference."""
    m = REF.fullmatch(ref or "")
    if not m or m[2].strip("0") == "":
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def packed_rows(doc_id, data) -> Iterator[dict]:
    """`workbook_rows` with cells in packs, their formats and shared strings looked up while the workbook is read."""
    arrays = lambda pack: dict(zip(("row", "col", *CELL), map(list, zip(*pack, strict=True)), strict=True))
    strings: list[str] = []
    formats: dict[int, int] = {}
    codes: dict[int, str] = {}
    room, all_held = HELD_CHARS, True
    book = {"doc_id": doc_id}
    for r in workbook_rows(doc_id, data):
        kind = r["kind"]
        if kind == "cell":
            if r["ref"] is None:
                continue
            at, fmt, found = place_of(r["ref"]), formats.get(r["s"]), None
            if r["t"] == "s":
                ix = string_index(r["v"])
                if ix is not None and 0 <= ix < len(strings):
                    found = strings[ix]
                plain = plain and (all_held or found is not None)
            plain = plain and at is not None and at > last
            if at is not None:
                last = at
            pack.append((*(at or (None, None)), r["ref"], r["t"], r["s"], r["v"], r["has_formula"], fmt, codes.get(fmt), found))
            chars += len(r["v"] or "") + len(found or "")
            if len(pack) >= PACK or chars >= PACK_CHARS:
                yield here | arrays(pack) | {"kind": "cells", "whole": False}
                pack, chars, plain = [], 0, False
        elif kind == "string":
            all_held = all_held and len(strings) < HELD and room > 0
            if all_held:
                strings.append(r["v"])
                room -= len(r["v"])
            else:
                yield {"doc_id": doc_id, "kind": "string", "ix": r["ix"], "text": r["v"]}
        elif kind == "format":
            formats[r["ix"]] = r["num_fmt_id"]
        elif kind == "code":
            codes[r["num_fmt_id"]] = r["v"]
        elif kind == "book":
            book |= {"styled": r["styled"], "date1904": r["date1904"]}
        elif kind == "sheet":
            here = book | {"sheet_ix": r["sheet_ix"], "sheet": r["sheet"], "n_sheets": r["n_sheets"]}
            yield here | {"kind": "sheet"}
            pack, chars, plain, last = [], 0, True, (-1, -1)
        elif kind == "end":
            if pack:
                yield here | arrays(pack) | {"kind": "cells", "whole": plain}
        elif kind == "merge":
            plain = False
            yield here | {"kind": "merge", "text": r["ref"]}
        else:
            plain = False
            yield {"doc_id": doc_id, "kind": kind, "sheet_ix": r["sheet_ix"], "sheet": r["sheet"], "error": r["error"]}


def decode_workbooks(files: DataFrame, deal: bool = True) -> DataFrame:
    """The packed rows of files(doc_id, content); each file is opened once, and its rows are written for what follows.
    Files that were dealt out already, made by tasks of this very plan, need not move again (``deal``)."""
    return kept(rows_by_document(files.select("doc_id", "content"), packed_rows, WORKBOOK, deal))


def read_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, dropped) of files(doc_id, content): typed cells (doc_id, sheet_ix, sheet, row, col, text, is_numeric), and what was lost."""
    return typed_cells(decode_workbooks(files))


def cell_number(v):
    """What a cell's value is as a number; blank is 0."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v.try_cast("double"), F.when(v == "", 0.0).otherwise(F.try_to_number(v, F.lit("999999999999999.999999999999999")).cast("double")))


def cell_text(c, styled, date1904):
    """A cell's text as it is shown; ``c`` gives the attributes of a cell by name."""
    number = F.when(c("t") == "n", cell_number(c("v")))
    is_date = F.coalesce(S.is_date_format(c("num_fmt_id"), c("code")), F.lit(False)) & number.isNotNull()
    return (
        F.when(c("v").isNull(), "")
        .when(c("t") == "s", F.coalesce(c("found"), F.lit("")))
        .when(c("t") == "b", F.when(c("v") == "1", "TRUE").otherwise("FALSE"))
        .when(is_date, S.serial_to_text(number, date1904))
        .when((c("t") == "n") & styled & number.isNotNull(), number_text(number))
        .otherwise(c("v"))
    )


def typed_cells(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`read_workbooks` of decoded rows.

    Shared strings that were not held while a workbook was read are resolved by a join; ranges that span rows refuse their
    sheet, and so does a part that isn't whole; ranges within a row keep their first cell; formulas keep their cached
    value and are reported.
    """
    of = lambda kind: raw.where(F.col("kind") == kind)
    key = ["doc_id", "sheet_ix"]
    cells = of("cells").select(*key, "sheet", "styled", "date1904", F.inline(F.arrays_zip(*CELL)))
    letters, digits = F.regexp_extract("ref", "^([A-Za-z]+)", 1), F.regexp_extract("ref", "([0-9]+)$", 1)
    cells = cells.withColumns({"row": digits.cast("long") - 1, "col": letters_to_index(letters).cast("int")})
    strings = of("string").select("doc_id", "ix", F.col("text").alias("later"))
    cells = cells.withColumn("ix", F.when((F.col("t") == "s") & F.col("found").isNull(), cell_number("v").try_cast("int")))
    late = cells.where("ix is not null").join(strings, ["doc_id", "ix"], "left").withColumn("found", F.col("later")).drop("later")
    cells = cells.where("ix is null").unionByName(late)
    typed = cells.withColumns({"text": cell_text(F.col, F.col("styled"), F.col("date1904")), "is_numeric": (F.col("t") == "n") & F.col("v").isNotNull()})

    merges = of("merge").select(*key, S.parse_range("text").alias("m")).where("m is not null").select(*key, "m.r1", "m.c1", "m.r2", "m.c2")
    tall = merges.where("r2 > r1").groupBy(*key).count()
    broken = of("error")
    refused = tall.select(*key).unionByName(broken.select(*key)).distinct()
    good = S.flatten_merges(typed.join(refused, key, "left_anti"), merges.where("r2 = r1"), key)
    out = good.select(*key, "sheet", "row", "col", "text", "is_numeric")

    lost = lambda df, kind, message: df.select("doc_id", F.lit(kind).alias("kind"), message.alias("message"))
    dropped = lost(broken, "refused", F.concat_ws(": ", "sheet", "error"))
    dropped = dropped.unionByName(lost(tall, "refused", F.format_string("sheet %d: %d merged ranges span rows", "sheet_ix", "count")))
    dropped = dropped.unionByName(lost(typed.where("t = 's' and found is null and v is not null"), "lookup", F.concat(F.lit("no shared string for cell "), F.col("ref"))))
    dropped = dropped.unionByName(lost(typed.where("styled and s is not null and num_fmt_id is null and t = 'n'"), "style", F.concat(F.lit("unknown style of cell "), F.col("ref"))))
    formulas = of("cells").groupBy("doc_id").agg(F.sum(F.size(F.filter("has_formula", lambda x: x))).alias("count")).where("count > 0")
    dropped = dropped.unionByName(lost(formulas, "formula", F.format_string("%d formulas: cached values are used", "count")))
    return out, dropped


def sheet_tables(cells: DataFrame, max_rows: int = S.MAX_ROWS, max_cols: int = S.MAX_COLS) -> tuple[DataFrame, DataFrame]:
    """(cells with part and is_header, status by sheet): the cleaning steps in their fixed order."""
    key = ["doc_id", "sheet_ix"]
    trimmed = S.trim_leading_rows(S.drop_empty_columns(cells, key), key)
    status = S.refusals(trimmed, key, max_rows, max_cols)
    ok = trimmed.join(status.where("status = 'ok'").select(*key), key, "left_semi")
    parted = S.lift_preamble(ok, key)
    heads = S.header_rows(parted.where("part = 'table'"), key)
    top = heads.groupBy(*key).agg(F.min_by("is_header", "row").alias("headed"), F.min("row").alias("row"))
    head = top.where("headed").select(*key, "row", F.lit(True).alias("head"))
    return parted.join(head, [*key, "row"], "left").withColumn("is_header", F.coalesce("head", F.lit(False))).drop("head"), status


def rendered_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a table as arrays of text: missing cells are blank, blank rows inside stay."""
    bounds = S.used_range(cells, key)
    spine = bounds.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    full = spine.join(cells.select(*key, "row", "col", "text"), [*key, "row", "col"], "left")
    return full.groupBy(*key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"))


SHEET = ["doc_id", "sheet_ix", "sheet", "n_sheets", "status", "reason", "captions", "headed", "lines"]


def whole_sheets(packs: DataFrame, max_rows: int) -> DataFrame:
    """`SHEET` of packs that are whole plain sheets, by `sheet_tables`' steps over each pack's own cells: nothing is shuffled."""
    shown = lambda x: F.trim(x["text"]) != ""
    typed = F.transform(F.arrays_zip("row", "col", *CELL), lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), cell_text(lambda k: x[k], F.col("styled"), F.col("date1904")).alias("text"), ((x["t"] == "n") & x["v"].isNotNull()).alias("is_numeric")))
    df = packs.select("doc_id", "sheet_ix", "sheet", "n_sheets", typed.alias("cells"))
    filled = F.filter("cells", lambda x: x["text"] != "")
    df = df.withColumn("filled", filled).where("size(filled) > 0")
    df = df.select("*", F.array_sort(F.array_distinct(F.transform("filled", lambda x: x["col"]))).alias("cols"), F.array_min(F.transform("filled", lambda x: x["row"])).alias("top"))
    df = df.withColumn("cells", F.filter("cells", lambda x: (x["row"] >= F.col("top")) & F.array_contains("cols", x["col"])))
    df = df.withColumn("n_rows", F.array_max(F.transform("cells", lambda x: x["row"])) - F.col("top") + 1)
    status, reason = S.verdict(F.col("n_rows").cast("long"), F.size("cols").cast("long"), F.size("filled"), max_rows)
    df = df.select(*SHEET[:4], "cells", "cols", status.alias("status"), reason.alias("reason"))

    # a row of the sheet: its number, its cells, how many of them show something
    rows = F.transform(F.array_distinct(F.transform("cells", lambda x: x["row"])), lambda r: F.struct(r.alias("row"), F.filter("cells", lambda x: x["row"] == r).alias("cells")))
    df = df.withColumn("rows", F.when(F.col("status") == "ok", F.transform(rows, lambda r: F.struct(r["row"].alias("row"), r["cells"].alias("cells"), F.size(F.filter(r["cells"], shown)).alias("n")))))
    df = df.withColumn("start", F.get(F.filter("rows", lambda r: r["n"] >= 2), F.lit(0))["row"])
    above = lambda r: F.coalesce(r["row"] < F.col("start"), F.lit(False))
    caption = lambda r: F.struct(r["row"].cast("long").alias("row"), F.filter(r["cells"], shown)[0]["text"].alias("text"))
    captions = F.transform(F.filter("rows", lambda r: above(r) & (r["n"] > 0)), caption)
    df = df.select(*SHEET[:6], "cols", captions.alias("captions"), F.filter("rows", lambda r: ~above(r)).alias("rows"))
    texts = lambda r: F.transform("cols", lambda c: F.coalesce(F.get(F.filter(r["cells"], lambda x: x["col"] == c), F.lit(0))["text"], F.lit("")))
    gap = lambda r, i: F.array_repeat(F.transform("cols", lambda _: F.lit("")), F.when(i > 0, r["row"] - F.get("rows", i - 1)["row"] - 1).otherwise(0))
    lines = F.flatten(F.transform("rows", lambda r, i: F.concat(gap(r, i), F.array(texts(r)))))
    head = F.col("rows")[0]
    headed = ~F.exists(head["cells"], lambda x: x["is_numeric"]) & (head["n"] / F.size(head["cells"]) >= S.HEADER_FILL)
    return df.select(*SHEET[:7], headed.alias("headed"), lines.alias("lines"))


def other_sheets(raw: DataFrame, max_rows: int) -> DataFrame:
    """`SHEET` of sheets in several packs, with merged ranges or with strings to look up: cell by cell, over all sheets at once."""
    key = ["doc_id", "sheet_ix"]
    cells, _ = typed_cells(raw)
    tables, status = sheet_tables(kept(cells), max_rows)
    tables, status = kept(tables), kept(status)
    captions = tables.where("part = 'preamble' and trim(text) <> ''").groupBy(*key, "row").agg(F.min_by("text", "col").alias("text"))
    captions = captions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("captions"))
    body = tables.where("part = 'table'")
    bounds = S.used_range(body, key).select(*key, "r1", "r2").join(S.used_range(tables, key).select(*key, "c1", "c2"), key)
    spine = bounds.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    full = spine.join(body.select(*key, "row", "col", "text"), [*key, "row", "col"], "left")
    rows = full.groupBy(*key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"))
    heads = body.groupBy(*key).agg(F.bool_or("is_header").alias("headed"))
    lines = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda x: x["texts"]).alias("lines")).join(heads, key)
    sheets = raw.where("kind = 'sheet'").select(*key, "sheet", "n_sheets")
    out = sheets.join(status, key).join(captions, key, "left").join(lines, key, "left")
    return out.withColumn("captions", F.coalesce("captions", F.array().cast("array<struct<row: bigint, text: string>>"))).select(*SHEET)


def workbook_blocks(files: DataFrame, max_rows: int = S.MAX_ROWS) -> dict[str, DataFrame]:
    """`decoded_blocks` of files(doc_id, content)."""
    return decoded_blocks(decode_workbooks(files), max_rows)


def decoded_blocks(raw: DataFrame, max_rows: int = S.MAX_ROWS) -> dict[str, DataFrame]:
    """blocks (doc_id, block_ix, t, level, text, head, rows), titles (doc_id, title) lifted from a caption, dropped, and the cells.

    Each sheet gives a heading with its name (not a lone 'Sheet1'), its captions as paragraphs and a table. The one
    caption of a workbook's only sheet is the title instead. A workbook all of whose sheets are refused is refused.
    """
    cells, lost = typed_cells(raw)
    is_whole = F.coalesce("whole", F.lit(False))
    sheets = kept(whole_sheets(raw.where((F.col("kind") == "cells") & is_whole), max_rows).unionByName(other_sheets(raw.where(~is_whole), max_rows)))
    good = sheets.where("status = 'ok'")
    lifted = (F.col("n_sheets") == 1) & (F.size("captions") == 1)
    alone = good.where(lifted).select("doc_id", F.col("captions")[0]["text"].alias("title"))

    blank = F.transform(F.col("lines")[0], lambda x: F.lit(""))
    table = good.select("doc_id", "sheet_ix", "sheet", F.when(F.col("headed"), F.col("lines")[0]).otherwise(blank).alias("head"), F.when(F.col("headed"), F.slice("lines", 2, 2**31 - 1)).otherwise(F.col("lines")).alias("rows"), "headed")

    nothing = [F.lit(None).cast("array<string>").alias("head"), F.lit(None).cast("array<array<string>>").alias("rows")]
    place = lambda at: (F.col("sheet_ix").cast("long") * 10_000_000 + at).alias("block_ix")
    level = F.lit(None).cast("int").alias("level")
    heading = good.where("not (n_sheets = 1 and sheet = 'Sheet1')").select("doc_id", place(F.lit(0)), F.lit("heading").alias("t"), F.lit(1).alias("level"), F.col("sheet").alias("text"), *nothing)
    para = good.where(~lifted).select("doc_id", "sheet_ix", F.inline("captions")).select("doc_id", place(F.col("row") + 1), F.lit("para").alias("t"), level, "text", *nothing)
    grid = table.select("doc_id", place(F.lit(9_999_999)), F.lit("table").alias("t"), level, F.array_join(F.flatten(F.concat(F.array("head"), F.col("rows"))), " ").alias("text"), "head", "rows")

    say = lambda df, kind, message: df.select("doc_id", F.lit(kind).alias("kind"), message.alias("message"))
    named = F.concat(F.lit('sheet "'), F.col("sheet"), F.lit('"'))
    dropped = lost.withColumn("kind", F.when(F.col("kind") == "refused", "sheet").otherwise(F.col("kind")))
    dropped = dropped.unionByName(say(sheets.where("status = 'refused'"), "sheet", F.concat(named, F.lit(" refused: "), F.col("reason"), F.lit(f"; at most {max_rows} rows and {S.MAX_COLS} columns are taken"))))
    dropped = dropped.unionByName(say(sheets.where("status = 'empty'"), "empty", F.concat(named, F.lit(" is empty"))))
    dropped = dropped.unionByName(say(table.where("not headed"), "header", F.concat(named, F.lit(": the first row is not a header, every row is kept as data"))))
    unreadable = lost.where("kind = 'refused'").select("doc_id").distinct()
    none = unreadable.unionByName(sheets.where("status = 'refused'").select("doc_id")).distinct().join(good.select("doc_id"), "doc_id", "left_anti")
    dropped = dropped.unionByName(say(none, "refused", F.lit("every sheet in the workbook was refused")))
    return {"blocks": heading.unionByName(para).unionByName(grid), "titles": alone, "dropped": dropped, "cells": cells}


# --- word-processing documents

#: One file's rows by ``tag``: para (with its atoms in order), number (numbering definitions), media, loss, date.
WORD = """doc_id long, tag string, para_ix int, kind string, style string, num_id string, ilvl int, n_rows int, atoms array<struct<kind: string, v: string, bold: boolean, italic: boolean, href: string, r_id: string>>,
abstract_id string, num_fmt string, start int, lvl_restart int, r_id string, mime string, content binary, message string"""


def is_on(properties: ET.Element | None, name: str) -> bool:
    """A toggle property: there, and not switched off."""
    e = first(properties, name)
    return e is not None and attribute(e, "val") not in ("0", "false", "off")


def field_target(instruction: str) -> str | None:
    m = re.search(r"(?i)\bHYPERLINK\s+\"([^\"]*)\"", instruction)
    return m[1] if m else None


def paragraph_atoms(p: ET.Element, relations: dict, lose) -> list[dict]:
    """Text, page breaks and drawings of a paragraph in order; fields show what they display."""
    out: list[dict] = []
    fields: list[dict] = []

    def run(r: ET.Element, href: str | None) -> None:
        properties = first(r, "rPr")
        look = {"bold": is_on(properties, "b"), "italic": is_on(properties, "i")}
        for e in r:
            name = local(e.tag)
            if name == "fldChar":
                kind = attribute(e, "fldCharType")
                if kind == "begin":
                    fields.append({"code": "", "shown": False})
                elif kind == "separate" and fields:
                    fields[-1]["shown"] = True
                elif kind == "end" and fields:
                    fields.pop()
                continue
            if name == "instrText" and fields:
                fields[-1]["code"] += e.text or ""
                continue
            if fields and not fields[-1]["shown"]:
                continue
            link = href or (field_target(fields[-1]["code"]) if fields else None)
            if name == "t":
                out.append({"kind": "text", "v": e.text or "", "href": link} | look)
            elif name == "tab":
                out.append({"kind": "text", "v": " ", "href": link} | look)
            elif name == "br":
                kind = attribute(e, "type")
                out.append({"kind": "pagebreak", "v": None, "href": None} | look if kind == "page" else {"kind": "text", "v": " ", "href": link} | look)
            elif name in ("drawing", "pict"):
                blip = next((x for x in e.iter() if attribute(x, "embed") or (local(x.tag) == "imagedata" and attribute(x, "id"))), None)
                out.append({"kind": "drawing", "v": None, "href": None, "r_id": (attribute(blip, "embed") or attribute(blip, "id")) if blip is not None else None} | look)
            elif name not in ("rPr", "lastRenderedPageBreak", "noBreakHyphen", "softHyphen", "delText", "delInstrText"):
                lose("run", name)

    def walk(e: ET.Element, href: str | None) -> None:
        for x in e:
            name = local(x.tag)
            if name == "r":
                run(x, href)
            elif name == "hyperlink":
                rid = attribute(x, "id")
                target = relations.get(rid, ("", "", False))[1] if rid else None
                if rid and rid not in relations:
                    lose("link", f"no target for {rid}")
                anchor = attribute(x, "anchor")
                walk(x, target or (f"#{anchor}" if anchor else None))
            elif name == "fldSimple":
                walk(x, field_target(attribute(x, "instr") or "") or href)
            elif name in ("ins", "smartTag", "sdt", "sdtContent", "moveTo"):
                if name == "ins":
                    lose("tracked", "insertion")
                walk(x, href)
            elif name in ("del", "moveFrom"):
                lose("tracked", "deletion")

    walk(p, None)
    return out


def _body(p: Package) -> list[ET.Element]:
    root = p.xml("word/document.xml")
    body = first(root, "body") if root is not None else None
    return [] if body is None else [x for x in body if local(x.tag) in ("p", "tbl", "sdt")]


MONTH_DATE = re.compile(r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b")


def word_rows(doc_id, data) -> Iterator[dict]:
    """A word-processing file as `WORD`: its package is opened once and each part parsed once."""
    p = Package(bytes(data or b""))
    row = lambda tag, **more: {"doc_id": doc_id, "tag": tag} | more
    units = _body(p)
    if not units:
        yield row("para", kind="error", message=p.error or "no document part")
    relations, lost = p.relations("word/document.xml"), []
    used = set()
    for k, e in enumerate(units):
        if local(e.tag) == "tbl":
            n = len(children(e, "tr"))
            yield row("para", para_ix=k, kind="tbl", n_rows=n)
            yield row("loss", kind="table", message=f"a table of {n} rows")
            continue
        properties = first(e, "pPr")
        number = first(properties, "numPr")
        num_id, named = value(first(number, "numId")), first(number, "ilvl")
        depth = None if num_id in (None, "0") else int(value(named) or 0)
        used.add(depth)
        atoms = paragraph_atoms(e, relations, lambda kind, what: lost.append(row("loss", kind=kind, message=what)))
        yield row("para", para_ix=k, kind="p", style=value(first(properties, "pStyle")), num_id=None if depth is None else num_id, ilvl=depth, atoms=atoms)
        yield from lost
        lost.clear()
    dated = False
    for name in sorted(x for x in p.names if re.fullmatch(r"word/(header|footer)\d*\.xml", x)):
        if (root := p.xml(name)) is not None:
            text = "".join(t.text or "" for t in descend(root, "t"))
            if text.strip():
                yield row("loss", kind="letterhead", message=text.strip()[:60])
            if not dated and (m := MONTH_DATE.search(text)):  # the first long date in headers and footers, by part name
                dated = True
                yield row("date", kind=name, message=m[0])
    for r in numbering_rows(p, used):
        yield row("number") | r
    for r in media_rows(p, relations):
        yield row("media") | r


def numbering_rows(p: Package, used: set[int]) -> Iterator[dict]:
    """Numbers, levels, overrides and style links, each with its kind. Of a definition's levels those at which an item stands
    can answer, else level 0; the first of all tells that it has some."""
    root = p.xml("word/numbering.xml")
    val = lambda e, *path: value(first(e, *path))
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    for a in children(root, "abstractNum"):
        key = attribute(a, "abstractNumId")
        for kind in ("styleLink", "numStyleLink"):
            if (style := val(a, kind)) is not None:
                yield {"kind": kind, "abstract_id": key, "style": style}
        for k, level in enumerate(children(a, "lvl")):
            ilvl = number(attribute(level, "ilvl"))
            if k > 0 and ilvl != 0 and ilvl not in used:
                continue
            yield {"kind": "level", "abstract_id": key, "ilvl": ilvl, "num_fmt": val(level, "numFmt"), "start": number(val(level, "start")), "lvl_restart": number(val(level, "lvlRestart"))}
    for n in children(root, "num"):
        num_id = attribute(n, "numId")
        yield {"kind": "num", "num_id": num_id, "abstract_id": val(n, "abstractNumId")}
        for o in children(n, "lvlOverride"):
            if (start := number(val(o, "startOverride"))) is not None:
                yield {"kind": "override", "num_id": num_id, "ilvl": number(attribute(o, "ilvl")), "start": start}


def heading_level(style):
    """Levels 1 to 3 of the styles Heading1..6 and DocH1..3; null for others."""
    n = F.regexp_extract(style, "^(?:Heading ?([1-6])|DocH([1-3]))$", 1)
    m = F.regexp_extract(style, "^DocH([1-3])$", 1)
    return F.when(n != "", F.least(F.lit(3), n.cast("int"))).when(m != "", m.cast("int"))


def read_word(files: DataFrame, deal: bool = True) -> dict[str, DataFrame]:
    """Tables of files(doc_id, content): blocks (headings, paragraphs, numbered list items in order, with their atoms), paras, atoms,
    media, dropped, dates. Each file is opened once, and its rows are written; only paragraphs of lists meet their definitions.
    ``deal`` as in `decode_workbooks`."""
    from ..operators.numbering import item_numbers, resolve_levels

    raw = kept(rows_by_document(files.select("doc_id", "content"), word_rows, WORD, deal))
    of = lambda tag: raw.where(F.col("tag") == tag)
    text = F.array_join(F.transform("atoms", lambda a: F.coalesce(a["v"], F.lit(""))), "")
    paras = of("para").where("kind = 'p'").select("doc_id", "para_ix", "style", "num_id", "ilvl", "atoms", text.alias("text"))
    numbering = of("number")
    part = lambda kind, *cols: numbering.where(F.col("kind") == kind).select("doc_id", *cols)
    links = numbering.where("kind in ('styleLink', 'numStyleLink')").select("doc_id", "style", "abstract_id", "kind")
    listed = paras.where("num_id is not null").select("doc_id", "para_ix", "num_id", "ilvl")
    resolved = resolve_levels(listed, part("num", "num_id", "abstract_id"), part("level", "abstract_id", "ilvl", "num_fmt", F.coalesce("start", F.lit(1)).alias("start"), "lvl_restart"), part("override", "num_id", "ilvl", "start"), links)
    numbers = kept(item_numbers(resolved.where("resolved")).select("doc_id", "para_ix", "number", "num_fmt"))
    level = heading_level(F.col("style"))
    said = paras.where("text <> ''")
    none = [F.lit(None).cast(numbers.schema[c].dataType).alias(c) for c in ("number", "num_fmt")]
    rows = said.where("num_id is null").select("*", *none).unionByName(said.where("num_id is not null").join(numbers, ["doc_id", "para_ix"], "left"))
    t = F.when(F.col("num_fmt").isNotNull(), "list").when(level.isNotNull(), "heading").otherwise("para")
    blocks = rows.select("doc_id", F.col("para_ix").alias("block_ix"), t.alias("t"), F.when(t == "heading", level).alias("level"), "text", (F.col("num_fmt") != "bullet").alias("ordered"), F.when(t == "list", F.col("ilvl")).alias("depth"), "num_id", "number", "atoms")
    dropped = of("loss").select("doc_id", "kind", "message")
    lost = resolved.where("not resolved").select("doc_id", F.lit("numbering").alias("kind"), F.concat(F.lit("no definition of list "), F.col("num_id")).alias("message"))
    errors = of("para").where("kind = 'error'").select("doc_id", F.lit("refused").alias("kind"), "message")
    atoms = paras.select("doc_id", "para_ix", F.posexplode("atoms").alias("atom_ix", "a")).select("doc_id", "para_ix", "atom_ix", "a.*")
    media = of("media").select("doc_id", "r_id", "mime", "content", F.col("message").alias("dropped"))
    dates = of("date").select("doc_id", F.col("kind").alias("part"), F.col("message").alias("date"))
    return {"blocks": blocks, "paras": paras, "atoms": atoms, "media": media, "dropped": dropped.unionByName(lost).unionByName(errors), "dates": dates}


def word_blocks(files: DataFrame, deal: bool = True) -> dict[str, DataFrame]:
    """blocks of word-processing files with spans, whole lists, page breaks and images, and what was dropped.

    blocks(doc_id, block_ix, t, level, text, spans, ordered, depth, start, items, src, alt). Neighbouring items of
    one list and depth are one block; an image's bytes stand in its src.
    """
    from ..operators.numbering import islands

    word = read_word(files, deal)
    blocks = word["blocks"]
    node = lambda t, href: F.struct(F.lit(t).alias("t"), href.cast("string").alias("href"), F.lit(0).alias("node"))
    path = lambda a: F.array_compact(F.array(F.when(a["href"].isNotNull(), node("link", a["href"])), F.when(a["bold"], node("strong", F.lit(None))), F.when(a["italic"], node("em", F.lit(None)))))
    spans = F.transform(F.filter("atoms", lambda a: a["kind"] == "text"), lambda a: F.struct(a["v"].alias("v"), path(a).alias("path")))

    none = lambda kind: F.lit(None).cast(kind)
    place = (F.col("block_ix").cast("long") * 1000 + 500).alias("block_ix")
    prose = blocks.where("t <> 'list'")
    prose = prose.select("doc_id", place, "t", "level", "text", spans.alias("spans"), none("boolean").alias("ordered"), none("int").alias("depth"), none("int").alias("start"), none("array<string>").alias("items"), none("string").alias("src"), none("string").alias("alt"))
    unspanned = F.lit(None).cast(prose.schema["spans"].dataType).alias("spans")
    # a list ends where another block stands, so all take part, but only items with their text
    order = blocks.select("doc_id", "block_ix", "t", "ordered", "depth", "num_id", "number", F.when(F.col("t") == "list", F.col("text")).alias("text"))
    runs = islands(order, ["doc_id"], "block_ix", F.col("t"), F.col("ordered"), F.col("depth"), F.col("num_id")).where("t = 'list'")
    items = runs.groupBy("doc_id", "island", "ordered", "depth").agg(F.min("block_ix").alias("block_ix"), F.min("number").cast("int").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"]).alias("items"))
    lists = items.select("doc_id", place, F.lit("list").alias("t"), none("int").alias("level"), F.array_join("items", " ").alias("text"), unspanned, "ordered", "depth", F.when(F.col("ordered"), F.col("start")).alias("start"), "items", none("string").alias("src"), none("string").alias("alt"))

    # page breaks and images stand before their paragraph's text if they come first in it, else after
    opens = F.array_position(F.transform("atoms", lambda a: (a["kind"] == "text") & (F.trim(a["v"]) != "")), F.lit(True)) - 1
    other = word["paras"].select("doc_id", "para_ix", opens.alias("opens"), F.posexplode("atoms").alias("atom_ix", "a")).where("a.kind <> 'text'")
    at = F.col("para_ix").cast("long") * 1000 + F.when(F.col("atom_ix") < F.col("opens"), 0).otherwise(501) + F.least(F.col("atom_ix"), F.lit(400))
    other = other.select("doc_id", at.alias("block_ix"), "a.kind", "a.r_id")
    media = word["media"]
    drawn = other.where("kind = 'drawing'").join(media.where("content is not null").select("doc_id", "r_id", "mime", "content"), ["doc_id", "r_id"])
    src = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("content"))
    mark = lambda df, t, src, alt: df.select("doc_id", "block_ix", F.lit(t).alias("t"), none("int").alias("level"), none("string").alias("text"), unspanned, none("boolean").alias("ordered"), none("int").alias("depth"), none("int").alias("start"), none("array<string>").alias("items"), src.alias("src"), alt.alias("alt"))
    marks = mark(other.where("kind = 'pagebreak'"), "pagebreak", none("string"), none("string")).unionByName(mark(drawn, "image", src, F.lit("")))
    lost = media.where("dropped is not null").select("doc_id", F.lit("image").alias("kind"), F.concat(F.lit("an image is left out: "), F.col("dropped")).alias("message"))
    return {"blocks": prose.unionByName(lists).unionByName(marks), "dropped": word["dropped"].unionByName(lost), "dates": word["dates"]}


def media_rows(p: Package, relations: dict) -> Iterator[dict]:
    """Every image relationship: its bytes if they are of a known format, else why not."""
    for rid, (kind, target, external) in sorted(relations.items()):
        if kind != "image":
            continue
        body = p.zip.read(target) if not external and target in p.names else None
        mime = next((m for m, magic in SIGNATURES if body and body.startswith(magic)), None)
        why = "external" if external else "missing" if body is None else None if mime else "unknown format"
        yield {"r_id": rid, "mime": mime, "content": body if mime else None, "message": why}


def read_media(files: DataFrame) -> DataFrame:
    return read_word(files)["media"]
