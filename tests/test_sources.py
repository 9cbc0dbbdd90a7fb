import io
import json
import os
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom import jobs
from paperloom.operators.render import render_markdown
from paperloom.sinks import writers
from paperloom.sources import archive, discover, markdown, pdf
from paperloom.streaming import watch

KITCHEN = """# Title of *all*

Some **bold _both_** text, `code|x`, [link](http://a.b/c) and ~~gone~~ <b>raw</b>.

## Second

### Third

##### Fifth

1. First
2. Second
   - a nested aside
3. Third
4. Fourth

- one
  more
- two

> quoted *text*
>
> second

```ts
const x = `a`;
```

| A | B | C |
|:--|--:|:-:|
| 1 | 2\\|3 | |
| 4 | 5 |

---

<!-- pagebreak -->

![alt](data:image/png;base64,AAAA)

![lost](http://x/y.png)

Under
=====

<div>html</div>
"""


def test_blocks_of_every_kind():
    b = markdown.Lexer(KITCHEN).blocks
    kinds = [x["t"] for x in b]
    assert kinds == ["heading", "para", "heading", "heading", "heading", "list", "list", "list", "list", "quote", "code", "table", "rule", "pagebreak", "image", "heading"]
    lists = [x for x in b if x["t"] == "list"]
    assert [(x["ordered"], x["depth"], x["start"], x["items"]) for x in lists] == [(True, 0, None, ["First", "Second"]), (False, 1, None, ["a nested aside"]), (True, 0, 3, ["Third", "Fourth"]), (False, 0, None, ["one more", "two"])]
    table = b[11]
    assert (table["head"], table["align"], table["rows"]) == (["A", "B", "C"], ["l", "r", "c"], [["1", "2|3", ""], ["4", "5", ""]])
    assert b[4]["level"] == 3 and b[10]["lang"] == "ts" and b[15]["level"] == 1
    assert {k for k, _ in markdown.Lexer(KITCHEN).dropped} == {"heading", "image", "html"}


def test_spans():
    lost = []
    got = markdown.spans_of("a **b *c*** `d` ~~e~~ [f](g) \\* <i>h</i>", lambda *x: lost.append(x))
    assert "".join(s["v"] or "" for s in got) == "a b c d e f * h"
    assert [[e["t"] for e in s["path"]] for s in got if s["path"]] == [["strong"], ["strong", "em"], ["code"], ["link"]]
    assert [k for k, _ in lost] == ["strikethrough", "html", "html"]
    assert markdown.spans_of("[](x)") == [{"v": None, "path": [{"t": "link", "href": "x", "node": 1}]}]


ODD = ["", "\n\n", "plain", "* * *", "#", "#no heading", "- ", "```\nopen", "| a |\n|---|", "1) x\n\n\n2) y", "> ", "    code\n\n    more", "a\n---", "x\r\ny\r\n\r\nz", KITCHEN, None]


def test_all_sources_reach_a_fixed_point(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    once = {r.doc_id: r.markdown for r in markdown.normalise(df).collect()}
    text = once[ODD.index(KITCHEN)]
    assert text.startswith("# Title of *all*\n\nSome **bold _both_**") and "3. Third\n4. Fourth" in text
    again = markdown.normalise(spark.createDataFrame(list(once.items()), df.schema))
    assert {r.doc_id: r.markdown for r in again.collect()} == once


# --- packages


def make_zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(rows, strings=(), styles=None, date1904=False, merges=(), name="Data"):
    sheet = "".join(f'<row r="{k}">{cells}</row>' for k, cells in enumerate(rows, 1))
    merged = f"<mergeCells>{''.join(f'<mergeCell ref={chr(34)}{m}{chr(34)}/>' for m in merges)}</mergeCells>" if merges else ""
    parts = {
        "xl/workbook.xml": f'<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="{name}" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{sheet}</sheetData>{merged}</worksheet>",
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si>{x}</si>" for x in strings) + "</sst>",
    }
    if styles is not None:
        parts["xl/styles.xml"] = f"<styleSheet>{styles}</styleSheet>"
    return make_zip(parts)


def read_cells(spark, data):
    cells, dropped = archive.read_workbooks(spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary"))
    return {(r.row, r.col): (r.text, r.is_numeric) for r in cells.collect()}, sorted((r.kind, r.message) for r in dropped.collect())


def test_shared_strings_and_formulas(spark):
    data = workbook(['<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>', '<c r="A2" t="s"><v>2</v></c><c r="B2"><f>1+2</f><v>3</v></c><c r="C2" t="s"><v>9</v></c><c r="D2" t="b"><v>1</v></c>'], ["<t>Name</t>", "<t>Cou</t><r><t>nt</t></r>", "<t>Alice</t>"])
    cells, dropped = read_cells(spark, data)
    assert cells == {(0, 0): ("Name", False), (0, 1): ("Count", False), (1, 0): ("Alice", False), (1, 1): ("3", True), (1, 2): ("", False), (1, 3): ("TRUE", False)}
    assert dropped == [("formula", "1 formulas: cached values are used"), ("lookup", "no shared string for cell C2")]


def test_dates_and_styles(spark):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs>'
    row = '<c r="A1" s="1"><v>45107</v></c><c r="B1" s="2"><v>45107</v></c><c r="C1" s="7"><v>45107</v></c><c r="D1" s="0"><v>1.50</v></c>'
    cells, dropped = read_cells(spark, workbook([row], styles=styles))
    assert [cells[0, k][0] for k in range(4)] == ["2023-06-30", "2023-06-30", "45107", "1.5"]
    assert dropped == [("style", "unknown style of cell C1")]
    plain, _ = read_cells(spark, workbook(['<c r="A1"><v>1.50</v></c>']))
    assert plain[0, 0] == ("1.50", True)


def test_merges(spark):
    row = lambda n: f'<c r="A{n}" t="str"><v>x</v></c><c r="B{n}" t="str"><v>y</v></c>'
    cells, _ = read_cells(spark, workbook([row(1)], merges=["A1:B1"]))
    assert cells == {(0, 0): ("x", False), (0, 1): ("", False)}
    cells, dropped = read_cells(spark, workbook([row(1), row(2)], merges=["A1:A2"]))
    assert cells == {} and dropped == [("refused", "sheet 0: 1 merged ranges span rows")]


def test_broken_package_is_refused(spark):
    cells, dropped = read_cells(spark, b"not a zip")
    assert cells == {} and dropped[0][0] == "refused"


def test_sheet_tables(spark):
    data = workbook(['<c r="B1" t="str"><v>Caption</v></c>', '<c r="B2" t="str"><v>Name</v></c><c r="C2" t="str"><v>Role</v></c>', "", '<c r="B4" t="str"><v>Ann</v></c><c r="C4"><v>2</v></c>'])
    cells, _ = archive.read_workbooks(spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary"))
    clean, status = archive.sheet_tables(cells)
    assert [r.status for r in status.collect()] == ["ok"]
    assert {(r.row, r.part, r.is_header) for r in clean.collect()} == {(0, "preamble", False), (1, "table", True), (3, "table", False)}
    rows = archive.rendered_rows(clean.where("part = 'table'"), ["doc_id", "sheet_ix"]).orderBy("row").collect()
    assert [r.texts for r in rows] == [["Name", "Role"], ["", ""], ["Ann", "2"]]


W = 'xmlns:w="http://w" xmlns:r="http://r"'


def word(body, numbering="", header=None):
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId5" Type="x/hyperlink" Target="http://a" TargetMode="External"/></Relationships>', "word/numbering.xml": f"<w:numbering {W}>{numbering}</w:numbering>"}
    if header:
        parts["word/header1.xml"] = f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>"
    return make_zip(parts)


def p(text, style=None, num=None, ilvl=0):
    properties = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{ilvl}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_numbering_and_headings(spark):
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>' for k in range(2))
    numbering = f'<w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    body = p("Head", "Heading5") + p("a", num=1) + p("b", num=1) + p("b1", num=1, ilvl=1) + p("c", num=1) + p("c1", num=1, ilvl=1) + p("lost", num=9) + "<w:tbl><w:tr/><w:tr/></w:tbl>" + p("end")
    got = archive.read_word(spark.createDataFrame([(1, bytearray(word(body, numbering, "Sent June 3, 2024")))], "doc_id long, content binary"))
    blocks = [(r.t, r.level, r.text, r.number) for r in got["blocks"].orderBy("block_ix").collect()]
    assert blocks == [("heading", 3, "Head", None), ("list", None, "a", 1), ("list", None, "b", 2), ("list", None, "b1", 1), ("list", None, "c", 3), ("list", None, "c1", 1), ("para", None, "lost", None), ("para", None, "end", None)]
    assert {(r.kind, r.message) for r in got["dropped"].collect()} == {("table", "a table of 2 rows"), ("letterhead", "Sent June 3, 2024"), ("numbering", "no definition of list 9")}
    assert [r.date for r in got["dates"].collect()] == ["June 3, 2024"]


def test_word_links_and_fields(spark):
    body = '<w:p><w:hyperlink r:id="rId5"><w:r><w:t>here</w:t></w:r></w:hyperlink><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>HYPERLINK "http://f"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>field</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    got = archive.read_word(spark.createDataFrame([(1, bytearray(word(body)))], "doc_id long, content binary"))
    assert [(r.v, r.bold, r.italic, r.href) for r in got["atoms"].orderBy("atom_ix").collect()] == [("here", False, False, "http://a"), ("bold", True, False, None), ("field", False, False, "http://f")]


def test_word_round_trip(spark):
    source = "# T\n\nA **b** c\n\n## H\n\n1. x\n2. y\n\n- z\n"
    blocks, _ = markdown.read(spark.createDataFrame([(1, source)], "doc_id long, text string"))
    titles, rest = markdown.with_titles(blocks)
    made = writers.render("docx", titles, rest)
    assert made.first().content == writers.render("docx", titles, rest).first().content
    got = archive.read_word(made)
    assert [(r.t, r.text, r.number) for r in got["blocks"].orderBy("block_ix").collect()] == [("para", "T", None), ("para", "A b c", None), ("heading", "H", None), ("list", "x", 1), ("list", "y", 2), ("list", "z", 1)]
    assert any(r.bold and r.v == "b" for r in got["atoms"].collect())


# --- PDF


def make_pdf(contents, packed=True):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(contents)))}] /Count {len(contents)} /MediaBox [0 0 612 792] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out = [b"%PDF-1.4"] + [f"{k} 0 obj\n{o}\nendobj".encode() for k, o in enumerate(objects, 1)]
    for k, c in enumerate(contents):
        body = zlib.compress(c.encode()) if packed else c.encode()
        out.append(f"{4 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R /Resources << /Font << /F1 3 0 R >> >> >>\nendobj".encode())
        out.append(f"{5 + 2 * k} 0 obj\n<< /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + body + b"\nendstream\nendobj")
    return b"\n".join(out) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def page(k, n):
    grid = "".join(f"{50 + 150 * i} {600 - 20 * j} 150 20 re S " for i in range(2) for j in range(3))
    text = lambda s, x, y, size=10: f"BT /F1 {size} Tf 1 0 0 1 {x} {y} Tm ({s}) Tj ET "
    cells = "".join(text(f"r{j}c{i}", 55 + 150 * i, 605 - 20 * j) for i in range(2) for j in range(3))
    return text("Letterhead", 50, 780) + text(f"{k} / {n}", 300, 20) + text("Big \\(head\\)", 50, 740, 18) + text("some body text", 50, 700) + grid + cells


def test_pdf_tables_and_prose(spark):
    got = pdf.read(spark.createDataFrame([(1, bytearray(make_pdf([page(1, 2), page(2, 2)])))], "doc_id long, content binary"))
    cells = {(r.page, r.row, r.col): r.text for r in got["cells"].collect()}
    assert cells == {(p_, j, i): f"r{j}c{i}" for p_ in (0, 1) for i in range(2) for j in range(3)}
    first = [(r.t, r.text) for r in got["blocks"].where("page = 0").orderBy("block_ix").collect()]
    assert first == [("para", "Letterhead"), ("heading", "Big (head)"), ("para", "some body text"), ("table", "r0c0 r0c1 r1c0 r1c1 r2c0 r2c1"), ("para", "1 / 2")]
    assert got["blocks"].where("t = 'table'").count() == 2  # the second page repeats the head
    assert ["1 / 2", "2 / 2"] in [r.texts for r in got["repeated"].collect()]


def test_pdf_streams_packed_or_not():
    packed, plain = (pdf._decode(make_pdf([page(1, 1)], x))[0] for x in (True, False))
    assert packed == plain and len(packed[0]["rects"]) == 6


def test_pdf_refusals(spark):
    got = pdf.read(spark.createDataFrame([(1, bytearray(b"nope")), (2, bytearray(make_pdf(["BT ET"] * 61))), (3, None)], "doc_id long, content binary"))
    assert {r.doc_id: r.message for r in got["dropped"].where("kind = 'refused'").collect()} == {1: "not a PDF", 2: "61 pages; at most 60 are read", 3: "not a PDF"}


def test_matrices_and_rotation():
    assert pdf.apply((0.24, 0, 0, -0.24, 0, 850.08), 252, 3509.375) == pytest.approx((60.48, 7.83))
    file = pdf.File(make_pdf(["q 2 0 0 2 10 10 cm 0 0 5 5 re f Q 0 1 -1 0 0 0 cm BT /F1 9 Tf (x) Tj ET"]))
    got = pdf.page_geometry(file, file.pages()[0])
    assert got["rects"] == [(10, 10, 20, 20)] and got["runs"] == [] and got["rotated"] == 1


# --- jobs and streams


def text_at(s, x, y, size=10):
    return f"BT /F1 {size} Tf 1 0 0 1 {x} {y} Tm ({s}) Tj ET "


def sheet(rows, top=600, left=50, extra="", furniture=True):
    """A page's content: a letterhead, a footer, a grid with one text a cell, and whatever else."""
    grid = "".join(f"{left + 150 * i} {top - 20 * j} 150 20 re S " for j in range(len(rows)) for i in range(len(rows[0])))
    cells = "".join(text_at(c, left + 5 + 150 * i, top + 5 - 20 * j) for j, r in enumerate(rows) for i, c in enumerate(r))
    return (text_at("Letterhead", 50, 780) + text_at("Footer", 50, 20) if furniture else "") + grid + cells + extra


def pdf_blocks(spark, *docs, rules=None):
    files = spark.createDataFrame([(k, bytearray(make_pdf(pages))) for k, pages in enumerate(docs, 1)], "doc_id long, content binary")
    got = pdf.read(files, None if rules is None else spark.createDataFrame(rules, "doc_id long, above double, below double"))
    blocks, said = {}, {}
    for r in got["blocks"].orderBy("doc_id", "block_ix").collect():
        blocks.setdefault(r.doc_id, []).append((r.t, r.head, r.rows) if r.t == "table" else (r.t, r.text))
    for r in got["dropped"].collect():
        said.setdefault(r.doc_id, []).append((r.kind, r.message))
    return blocks, said


def test_pdf_table_goes_on_over_furniture(spark):
    one, two = [["name", "sum"], ["a", "1"]], [["b", "2"], ["c", "3"]]
    joined = [sheet(one), sheet(two), sheet([["d", "4"]])]
    headed = [sheet(one), sheet(one)]
    parted = [sheet(one), sheet(two, extra=text_at("A section of its own", 50, 700))]
    moved = [sheet(one), sheet(two, left=80)]
    gap = [sheet(one), text_at("Letterhead", 50, 780) + text_at("Footer", 50, 20), sheet(two)]
    blank = [sheet(one, furniture=False), "", sheet(two, furniture=False)]
    noted = [sheet(one, furniture=False), text_at("A note", 50, 400), sheet(two, furniture=False)]
    blocks, said = pdf_blocks(spark, joined, headed, parted, moved, gap, blank, noted)
    head, tail = ("para", "Letterhead"), ("para", "Footer")
    assert blocks[1] == [head, ("table", ["name", "sum"], [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"]]), tail]
    assert sum("repeated furniture between" in m for _, m in said[1]) == 4  # above pages 2 and 3, and the footers before them
    table = lambda rows: ("table", rows[0], rows[1:])
    assert blocks[2] == [head, table(one), tail, head, table(one), tail]
    assert blocks[3] == [head, table(one), tail, head, ("para", "A section of its own"), table(two), tail]
    assert blocks[4] == [head, table(one), tail, head, table(two), tail]
    assert blocks[6] == [("table", ["name", "sum"], [["a", "1"], ["b", "2"], ["c", "3"]])]
    assert blocks[7] == [table(one), ("para", "A note"), table(two)]
    # the table goes on over a page that holds furniture only, which then stands elsewhere than in the source
    assert 5 not in blocks and [k for v in said for k, _ in said[v] if k == "refused"] == ["refused"] and said[5][0][0] == "refused"


def test_pdf_declared_furniture(spark):
    pages = [sheet([["h", "k"], ["a", "1"]]), sheet([["b", "2"]])]
    blocks, said = pdf_blocks(spark, pages, pages, pages, rules=[(1, 770.0, 30.0), (2, 790.0, None), (3, 10.0, 20.0)])
    assert blocks[1] == [("table", ["h", "k"], [["a", "1"], ["b", "2"]])]
    assert [m for k, m in said[1] if k == "furniture"] == ["page furniture: 4 runs removed by the declared rule: Footer, Letterhead"]
    assert any(m.startswith("the declared rule removed nothing") for _, m in said[2])
    assert ("rule", "the upper line must lie above the lower") in said[3] and len(blocks[3]) == 3


def test_pdf_token_gate_refuses(spark):
    """Wrapped lines of a cell that stand at different places: cell by cell they read otherwise than from the left."""
    page = "50 600 150 40 re S 200 600 150 40 re S 50 560 150 40 re S 200 560 150 40 re S " + text_at("first", 90, 625) + text_at("second", 55, 610) + text_at("x", 205, 620) + text_at("y", 55, 570) + text_at("z", 205, 570)
    blocks, said = pdf_blocks(spark, [page])
    assert 1 not in blocks and said[1][0] == ("refused", "token 0: the source reads second, the document first")


def book(sheets, numbers=""):
    """A workbook of sheets (name, {ref: text or number})."""
    parts = {"xl/workbook.xml": f'<workbook xmlns:r="{archive.REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="x/worksheet" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>"
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    for k, (_, cells) in enumerate(sheets):
        parts[f"xl/worksheets/s{k}.xml"] = "<worksheet><sheetData><row>" + "".join(cell(r, v) for r, v in cells.items()) + f"</row></sheetData>{numbers}</worksheet>"
    return make_zip(parts)


def test_workbooks_as_blocks(spark):
    table = {"A3": "item", "C3": "n", "A4": "x", "C4": 7, "A6": "y", "C6": 8}
    wide = {f"{chr(65 + k)}1": f"c{k}" for k in range(26)}
    books = [book([("Register", {"A1": "Of things"} | table)]), book([("Sheet1", {"A1": 1, "B1": 2, "A2": 3, "B2": 4})]), book([("One", {"A1": "cap"} | table), ("Two", {"A1": "z", "B1": "w"}), ("None", {})]), book([("Wide", wide)]), b"no"]
    files = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(books, 1)], "doc_id long, content binary")
    got = archive.workbook_blocks(files)
    blocks = {}
    for r in got["blocks"].orderBy("doc_id", "block_ix").collect():
        blocks.setdefault(r.doc_id, []).append((r.t, r.head, r.rows) if r.t == "table" else (r.t, r.text))
    rows = [["x", "7"], ["", ""], ["y", "8"]]
    assert blocks[1] == [("heading", "Register"), ("table", ["item", "n"], rows)]
    assert blocks[2] == [("table", ["", ""], [["1", "2"], ["3", "4"]])]
    assert blocks[3] == [("heading", "One"), ("para", "cap"), ("table", ["item", "n"], rows), ("heading", "Two"), ("table", ["z", "w"], [])]
    assert {r.doc_id: r.title for r in got["titles"].collect()} == {1: "Of things"}
    lost = {(r.doc_id, r.kind) for r in got["dropped"].collect()}
    assert {(2, "header"), (4, "sheet"), (4, "refused"), (5, "refused")} <= lost and 4 not in blocks and 5 not in blocks


def results_of(spark, folder, *args, **more):
    outputs, results = jobs.build(spark, str(folder), *args, **more)
    return outputs, {os.path.basename(r.path): (r.status, r.reason, sorted(os.path.basename(x) for x in r.written)) for r in results.collect()}, results


def test_inspect_and_build(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext [to](http://x) and `code`\n\n![dot](data:image/gif;base64,R0lGODlhAQABAAAAACw=)")
    (tmp_path / "b.docx").write_bytes(word(p("x") + p("one", num=1) + p("two", num=1), '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'))
    (tmp_path / "c.xlsx").write_bytes(book([("S", {"A1": "h", "B1": "k", "A2": "v", "B2": 1})]))
    (tmp_path / "d.pdf").write_bytes(make_pdf([sheet([["h", "k"], ["a", "1"]])]))
    (tmp_path / "broken.pdf").write_text("no")
    (tmp_path / "skip.txt").write_text("no")
    got = {os.path.basename(r.path): (r.status, r.title, r.n_para, r.n_table) for r in jobs.inspect(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ok", "A", 1, 0), "b.docx": ("ok", "b", 1, 0), "c.xlsx": ("ok", "c", 0, 1), "d.pdf": ("ok", "d", 2, 1), "broken.pdf": ("refused", "broken", 0, 0)}
    outputs, got, results = results_of(spark, tmp_path, ["md", "docx"], out="/out")
    assert {k: v[0] for k, v in got.items()} == {"a.md": "ok", "b.docx": "ok", "c.xlsx": "ok", "d.pdf": "ok", "broken.pdf": "refused"}
    assert got["a.md"][2] == ["a.plain.docx", "a.plain.md"] and got["broken.pdf"][1] == "not a PDF"
    text = {os.path.basename(r.target): r.content.decode() for r in outputs.where("format = 'md'").collect()}
    assert text["b.plain.md"] == "# b\n\nx\n\n3. one\n4. two\n" and "| h | k |\n| :-- | :-- |\n| v | 1 |" in text["c.plain.md"] and "| a | 1 |" in text["d.plain.md"]
    made = {os.path.basename(r.target): zipfile.ZipFile(io.BytesIO(r.content)) for r in outputs.where("format = 'docx'").collect()}
    main, links = made["a.plain.docx"].read("word/document.xml").decode(), made["a.plain.docx"].read("word/_rels/document.xml.rels").decode()
    assert 'Target="http://x" TargetMode="External"' in links and "w:hyperlink" in main and "Courier New" in main and "word/media/image1.gif" in made["a.plain.docx"].namelist()
    assert 'w:type="dxa"' in made["c.plain.docx"].read("word/document.xml").decode()
    assert jobs.summary(results)[0].first().exit_code == 3


def test_settings_files_and_refused_targets(spark, tmp_path):
    (tmp_path / "a.md").write_text("text")
    (tmp_path / "a.settings.json").write_text('{"title": "Given", "to": ["md"], "theme": "plain"}')
    (tmp_path / "a.docx").write_bytes(word(p("x")))
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "b.settings.json").write_text('{"titel": "x"}')
    (tmp_path / "c.md").write_text("c")
    (tmp_path / "c.plain.md").write_text("made before")
    (tmp_path / "d.markdown").write_text("d")
    (tmp_path / "d.settings.json").write_text('{"to": ["pdf", "md"]}')
    outputs, got, results = results_of(spark, tmp_path, ["md"])
    assert got["a.md"][0] == got["a.docx"][0] == "refused" and "a.docx" in got["a.md"][1]
    assert got["b.md"][:2] == ("failed", "unknown key titel")
    assert got["c.plain.md"][0] == "own output" and got["c.md"] == ("ok", None, ["c.plain.md"])
    assert jobs.summary(results)[0].first().exit_code == 1
    (tmp_path / "a.docx").unlink()
    outputs, got, _ = results_of(spark, tmp_path)
    assert got["a.md"] == ("ok", None, ["a.plain.md"])
    assert outputs.where("path like '%/a.md'").first().content.decode() == "# Given\n\ntext\n"
    assert got["d.markdown"][:2] == ("refused", "no writer for pdf") and got["d.markdown"][2] == ["d.plain.md"]
    assert got["c.md"][:2] == ("refused", "no writer for pdf")


def test_build_writes_and_returns_codes(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    args = ["build", str(tmp_path / "in"), str(tmp_path / "out"), "--to", "md"]
    assert jobs.main(args) == 2
    (tmp_path / "in/a.md").write_text("# A\n\ntext")
    assert jobs.main(args) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    monkeypatch.setattr(jobs.B, "violations", lambda blocks: blocks.selectExpr("doc_id", "block_ix", "'broken' AS why"))
    assert jobs.main(args) == 3


DATA = {"template": "./t.md", "kind": "k", "project": "p", "date": "d", "author": {"name": "n", "email": "e"}, "team": [{"role": "r", "rate": 45, "hoursPerWeek": [4, 16]}]}


def test_proposals(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DATA))
    (tmp_path / "b.json").write_text(json.dumps(DATA | {"date": ""}))
    good, bad = jobs.proposals(spark, str(tmp_path))
    assert [(r.weeks, r.roles, r.total_cents) for r in good.collect()] == [(2, 1, 90000)]
    assert [r.why for r in bad.collect()] == ["date is required"]


def test_proposals_as_documents(spark, tmp_path):
    template = "# Offer {{number}}\n\nFor {{author.name}}.{{?annex}} With annex.{{/?}}\n\n{{@summary}}\n\n{{@budget}}\n\n{{@schedule}}\n\n{{@heatmap style=marks}}\n\n{{section:end}}\n"
    (tmp_path / "t.md").write_text(template)
    (tmp_path / "annex.md").write_text(template + "\n{{@pagebreak}}\n\n{{@annex}}\n\n{{@clientlogo}}\n")
    (tmp_path / "inline.md").write_text("- {{number}}\n\n  text\n\n{{@budget}}\n\n> a\n")
    (tmp_path / "list.xlsx").write_bytes(book([("Sheet1", {"A1": "h", "B1": "k", "A2": "v", "B2": 1})]))
    (tmp_path / "logo.png").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    full = DATA | {"number": "7", "sections": {"end": "Last *words*."}, "summary": [{"item": "all", "price": 900, "covers": "budget"}]}
    cases = {
        "good": full,
        "whole": full | {"template": "annex.md", "annex": "list.xlsx", "clientLogo": "logo.png"},
        "absent": full | {"template": "none.md"},
        "nofield": {k: v for k, v in full.items() if k != "number"},
        "differs": full | {"summary": [{"item": "all", "price": 901, "covers": "budget"}]},
        "unplaced": full | {"annex": "list.xlsx"},
        "noannex": full | {"template": "annex.md", "clientLogo": "logo.png"},
        "broken": full | {"date": ""},
        "nosection": full | {"sections": {}},
    }
    for name, d in cases.items():
        (tmp_path / f"{name}.proposal.json").write_text(json.dumps(d))
    docs, blocks, bad = jobs.propose(spark, str(tmp_path))
    got = {r.stem: r.doc_id for r in docs.collect()}
    assert set(got) == {"good", "whole"} and {r.title for r in docs.collect()} == {"Offer 7"}
    why = {}
    for r in bad.collect():
        why.setdefault(os.path.basename(r.path).split(".")[0], []).append(r.why)
    money = lambda s: s.replace(" ", "\u00a0")
    assert why == {
        "absent": ["cannot read the template none.md"],
        "nofield": ["{{number}} has no value"],
        "differs": ['summary line "all" says ' + money("€ 901,00") + ", hours times rates come to " + money("€ 900,00")],
        "unplaced": ["annex is named in the data, but the template never places it"],
        "noannex": ["{{@annex}} has nothing to print: the data file names none"],
        "broken": ["date is required"],
        "nosection": ["the data file has no section end"],
    }
    rows = [(r.t, r.head, r.rows) if r.head else (r.t, r.text) for r in blocks.where(F.col("doc_id") == got["good"]).orderBy("block_ix").collect()]
    assert rows[0] == ("para", "For n.") and rows[-1] == ("para", "Last *words*.")
    assert rows[1] == ("table", ["DESCRIPTION", "PRICE"], [["all", money("€ 900,00")]])
    assert rows[2][2] == [["r", "20", money("€ 45,00"), money("€ 900,00")], ["TOTAL", "", "", money("€ 900,00")]]
    assert rows[3] == ("table", ["Discipline", "W01", "W02"], [["r", "0.5 day / week", "2 days / week"]])
    assert rows[4] == ("heatmap", ["", "W01", "W02"], [["r", "4", "16"]])
    kinds = [r.t for r in blocks.where(F.col("doc_id") == got["whole"]).orderBy("block_ix").collect()]
    assert kinds == ["para", "table", "table", "table", "heatmap", "para", "pagebreak", "table", "image"]
    md = render_markdown(docs.withColumn("subtitle", F.lit(None).cast("string")), blocks).where(F.col("doc_id") == got["good"]).first().markdown
    assert "|  | W01 | W02 |\n| :-- | :-: | :-: |\n| r | ▪ | ▪▪▪ |" in md


def test_doctor(spark):
    assert jobs.doctor(spark).where("not ok").count() == 0


def test_watched_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\none two")
    (tmp_path / "b.md").write_text("three")
    files = watch.watch(spark, str(tmp_path))
    totals = watch.block_totals(watch.stream_blocks(files))
    q = totals.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.t: r["count"] for r in spark.table("totals").collect()} == {"heading": 1, "para": 2}


def test_html(spark):
    blocks, _ = markdown.read(spark.createDataFrame([(1, "# T\n\na <b\n\n- x\n\n| h |\n|---|\n| 1 |")], "doc_id long, text string"))
    titles, rest = markdown.with_titles(blocks)
    text = writers.render("html", titles, rest).select(F.decode("content", "UTF-8")).first()[0]
    assert "<p>a &lt;b</p>" in text and "<ul><li>x</li></ul>" in text and "<th>h</th>" in text and "<td>1</td>" in text
    with pytest.raises(ValueError):
        writers.render("pdf", titles, rest)


def test_media(spark):
    parts = {"word/document.xml": f"<w:document {W}><w:body/></w:document>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Type="x/image" Target="media/a.png"/><Relationship Id="r2" Type="x/image" Target="media/none.png"/><Relationship Id="r3" Type="x/image" Target="http://x" TargetMode="External"/></Relationships>', "word/media/a.png": b"\x89PNG\r\n\x1a\nrest"}
    got = archive.read_media(spark.createDataFrame([(1, bytearray(make_zip(parts)))], "doc_id long, content binary"))
    assert {r.r_id: (r.mime, r.dropped) for r in got.collect()} == {"r1": ("image/png", None), "r2": (None, "missing"), "r3": (None, "external")}


def test_tokens_and_recolouring(spark):
    raw = json.dumps({"color": {"brand": {"$value": ["#DA291C", "#000000"]}, "ink": "#1A1A1A"}})
    tokens = discover.design_tokens(spark.createDataFrame([(1, raw)], "doc_id long, raw string"))
    assert {r.name: r.value for r in tokens.collect()} == {"brand": "#DA291C", "ink": "#1A1A1A"}
    svg, misses = discover.recolour(spark.createDataFrame([(1, '<a class="brand"/><b class="none"/>')], "doc_id long, svg string"), tokens)
    assert svg.first().svg == '<a fill="#DA291C"/><b class="none"/>'
    assert [r.name for r in misses.collect()] == ["none"]


def test_themes(spark, tmp_path):
    good = {"id": "b", "colors": {"ink": "#000000"}, "type": {"h1Pt": 20}, "logo": {"svg": "<svg><path class='x'/></svg>"}, "letterhead": ["One", "Two"]}
    bad = {"id": "a", "colors": {"ink": "black"}, "page": {"size": "A9", "marginPt": 300}, "type": {"bodyPt": 0}, "font": {"embed": "x"}, "logo": {"svg": "<svg fill='red'/>", "png": "a.png"}, "cornerMark": {"svg": "no"}}
    for d in (good, bad):
        (tmp_path / f"{d['id']}.json").write_text(json.dumps(d))
    a, b = discover.load_themes(spark, str(tmp_path)).collect()
    assert (b.id, b.title, b.title_pt, b.h2_pt, b.muted, b.page, b.margin_pt, b.letterhead, b.violations) == ("b", "#000000", 20.0, 13.0, "#6B6B6B", "A4", 48.0, ["One", "Two"], [])
    assert {v.split(":")[0] for v in a.violations} == {"colors.ink", "colors.title", "page.size", "page.marginPt", "type.bodyPt", "font.embed", "logo.svg", "logo.png", "cornerMark.svg"}
    one = discover.theme_json(discover.load_themes(spark, str(tmp_path))).where("id = 'b'").first().json
    assert json.loads(one)["brand_on_light"] == "#1A1A1A" and "violations" not in one
    tokens = spark.createDataFrame([(1, "g", "brand", "#111111"), (2, "g", "other", "x")], "doc_id long, group string, name string, value string")
    assert sorted((r.doc_id, r.value, r.why) for r in discover.required_token(tokens, "brand").collect()) == [(1, "#111111", None), (2, None, "token source carries no brand")]


def test_layout(spark):
    from paperloom.functions import layout as Y

    df = spark.createDataFrame([("A4", 48.0, "E", "", 86400, '<svg><a style="fill:red"/></svg>'), ("Letter", 72.0, None, "d", -1, "<svg><style>.x{stroke: red}</style></svg>"), ("A4", 48.0, "", None, 0, "<svg STROKE='x'/>")], "size string, margin double, entity string, date string, epoch long, svg string")
    got = df.select(Y.column_dxa("size", "margin"), Y.landscape_dxa("size", "margin"), Y.sizing("size", "margin", F.lit(9))["body_pt"], Y.letterhead_lines("entity", "date"), F.date_format(Y.date_of("epoch"), "yyyy-MM-dd"), Y.inline_paint("svg")["where"], Y.to_mm("margin"), Y.cover_statement_pt("margin", F.lit(30.0)), Y.units("margin", 2)).collect()
    assert [tuple(r) for r in got] == [
        (9986, 14918, 9.0, ["E"], "1970-01-02", '"fill:" inside a style attribute', "16.93mm", 30.0, 96),
        (9360, 12960, 9.0, ["d"], None, '"stroke:" inside a <style> element', "25.40mm", 36.0, 144),
        (9986, 14918, 9.0, [], "1970-01-01", 'a "STROKE" attribute', "16.93mm", 30.0, 96),
    ]
    when = spark.sql("select timestamp_seconds(-5) as m union all select timestamp_seconds(7)")
    assert sorted(r[0] for r in when.select(Y.epoch_of("m")).collect()) == [0, 7]
    assert when.select(Y.epoch_of("m", "9")).first()[0] == 9
    with pytest.raises(ValueError):
        Y.epoch_of("m", "x")


def test_word_tables_headings_and_turned_sections():
    blocks = [{"t": "table", "head": ["a"] * 3, "rows": [["1", "2", "3"]]}, {"t": "table", "head": ["b"], "rows": []}, {"t": "table", "head": [f"c{k}" for k in range(18)], "rows": []}, {"t": "heatmap", "lang": "scale", "head": ["", "W01", "W02"], "rows": [["r", "1", "4"]]}, {"t": "para", "text": "x", "spans": [{"v": "bad", "path": [{"t": "link", "href": "java script:x"}]}]}]
    data, lost = writers.package("T", blocks)
    main = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert main.count('w:line="20"') == 1 and main.count("w:sectPr>") == 6 and main.count('w:orient="landscape"') == 1
    assert lost == ["a link is left out: java script:x"] and 'w:fill="BABABA"' not in main and main.count("w:shd ") == 2
    assert sum(int(x) for x in re.findall(r'gridCol w:w="(\d+)"', main)[:3]) == 9986


def test_render_markdown_of_bare_document(spark):
    docs = spark.createDataFrame([(1, "T", "S")], "doc_id long, title string, subtitle string")
    blocks, _ = markdown.read(spark.createDataFrame([], "doc_id long, text string"))
    assert render_markdown(docs, blocks).first().markdown == "# T\n\n*S*\n"


def test_folders_that_cannot_be_read_are_rows(spark, tmp_path):
    """A link to a folder above it, mixed-case endings, links to folders and files, and broken links."""
    from paperloom.sources import discover as D

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (tmp_path / "a" / "x.Md").write_text("x")
    (tmp_path / "a" / "b" / "y.MARKDOWN").write_text("y")
    (tmp_path / "a" / "b" / "z.txt").write_text("z")
    (tmp_path / "other" / "w.md").write_text("w")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "a" / "side").symlink_to(tmp_path / "other")
    (tmp_path / "a" / "link.md").symlink_to(tmp_path / "other" / "w.md")
    (tmp_path / "a" / "broken.md").symlink_to(tmp_path / "nowhere.md")
    inputs, own, bad = D.discover(spark, str(tmp_path), True)
    short = lambda p: p.split(tmp_path.name, 1)[1]
    assert sorted(short(r.path) for r in inputs.collect()) == ["/a/b/y.MARKDOWN", "/a/link.md", "/a/side/w.md", "/a/x.Md", "/other/w.md"]
    assert [(short(r.folder), r.reason) for r in bad.collect()] == [("/a/up", "a link to a folder above it")]
    flat, *_ = D.discover(spark, str(tmp_path / "a"))
    assert sorted(short(r.path) for r in flat.collect()) == ["/a/link.md", "/a/x.Md"]
    _, results = jobs.build(spark, str(tmp_path), ["md"], recursive=True, out="/out")
    got = {short(r.path): (r.status, r.reason) for r in results.collect()}
    assert got["/a/up"] == ("failed", "folder can't be read: a link to a folder above it") and got["/a/x.Md"][0] == "ok"
    assert jobs.summary(results)[0].first().exit_code == 1


def test_a_folder_without_permission(spark, tmp_path, monkeypatch):
    import errno

    from paperloom.sources import folders as L

    def refuse(path):
        raise PermissionError(errno.EACCES, os.strerror(errno.EACCES), path)

    monkeypatch.setattr(L.os, "scandir", refuse)
    assert L.look(f"file:{tmp_path}") == ([], "Permission denied")
    monkeypatch.undo()
    assert [(r.reason is None) for r in L.folders(spark, str(tmp_path / "missing"), True).collect()] == [False]
    if os.geteuid() == 0:
        pytest.skip("root may read every folder")
    (tmp_path / "no").mkdir(mode=0)
    (tmp_path / "yes.md").write_text("x")
    got = L.folders(spark, str(tmp_path), True).where("reason is not null").collect()
    assert [r.folder.rsplit("/", 1)[1] for r in got] == ["no"]


def test_a_very_large_sheet_is_read_in_bounded_memory(spark):
    """A register of 94,309 rows: rows come while the part is read, and neither a tree nor a list of all is made."""
    import tracemalloc

    n = 94_309
    cells = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="inlineStr"><is><t>item {k}</t></is></c><c r="C{k}" s="0"/></row>' for k in range(1, n + 1))
    parts = {"xl/workbook.xml": f'<workbook xmlns:r="{archive.REL[1:-1]}"><sheets><sheet name="S" r:id="r0"/><sheet name="T" r:id="r1"/></sheets></workbook>'}
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships><Relationship Id="r0" Type="x/worksheet" Target="worksheets/s0.xml"/><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s1.xml"/></Relationships>'
    parts["xl/worksheets/s0.xml"] = f"<worksheet><sheetData>{cells}</sheetData></worksheet>"
    parts["xl/worksheets/s1.xml"] = '<worksheet><sheetData><row><c r="A1"><v>1</v></c></row><row><c r="A2'  # breaks off
    data = make_zip(parts)
    tracemalloc.start()
    count, last = 0, None
    for r in archive.workbook_rows(1, data):
        count += r["kind"] == "cell"
        last = r["v"] if r["kind"] == "cell" and r["sheet_ix"] == 0 and r["v"] else last
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 3 * n + 1 and last == f"item {n}" and peak < 16 * 2**20
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(book([("Sheet1", {"A1": "h", "B1": "k", "A2": "v", "B2": 1})])))], "doc_id long, content binary")
    got = archive.workbook_blocks(files)
    assert [(r.doc_id, r.t) for r in got["blocks"].collect()] == [(2, "table")]
    said = sorted(r.message for r in got["dropped"].where("doc_id = 1").collect())
    assert any("94309" in m for m in said) and "T: the sheet's part is missing" in said


def test_flags(spark, tmp_path, capsys):
    p = jobs.parser()
    a = p.parse_args(["build", "in", "--to", "md, docx", "--to", "html", "--theme", "t", "--out", "o", "--title", "T", "--date", "D", "--entity", "E", "--plain-names", "--recursive", "--no-config"])
    assert (a.folder, a.to, a.theme, a.out, a.title, a.date, a.entity, a.plain_names, a.recursive, a.no_config, a.config) == ("in", ["md", "docx", "html"], "t", "o", "T", "D", "E", True, True, True, None)
    assert p.parse_args(["inspect", "in"]).json is None and p.parse_args(["proposal", "in", "--to", "md"]).to == ["md"]
    for wrong in ([], ["build"], ["build", "in", "--nothing"], ["build", "in", "--title"], ["build", "a", "b", "c"], ["inspect", "in", "--to", "md"], ["build", "in", "--config", "c", "--no-config"], ["proposal", "in", "--recursive"], ["fly"]):
        assert jobs.main(wrong) == 2
    capsys.readouterr()

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Own\n\ntext")
    (tmp_path / "in" / "a.settings.json").write_text('{"title": "Beside", "date": "May 1", "to": ["md"]}')
    (tmp_path / "one.json").write_text('{"title": "Named", "entity": "Firm"}')
    folder = str(tmp_path / "in")
    said = lambda *args: (jobs.main(["inspect", folder, "--json", *args]), json.loads(capsys.readouterr().out.strip().split("\n")[-1]))
    pick = lambda r: (r[0], r[1]["title"], r[1].get("date"), r[1].get("entity"))
    assert pick(said()) == (0, "Beside", "May 1", None)
    assert pick(said("--no-config")) == (0, "Own", None, None)
    assert pick(said("--config", str(tmp_path / "one.json"), "--date", "June")) == (0, "Named", "June", "Firm")
    assert pick(said("--title", "Flag", "--entity", "E")) == (0, "Flag", "May 1", "E")
    assert said("--theme", "none")[0] == 1
    assert jobs.main(["inspect", folder]) == 0
    assert capsys.readouterr().out.strip().endswith("a.md: Beside: 1 para")
    assert jobs.main(["build", folder, "--out", str(tmp_path / "out"), "--title", "Flag", "--to", "md"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().content.decode() == "# Flag\n\ntext\n"
    assert jobs.main(["build", folder]) == 2
    # a command leaves no table of its own behind
    from paperloom.sources.base import KEPT

    assert not KEPT
