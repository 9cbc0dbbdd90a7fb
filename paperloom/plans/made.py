"""Files made from table rows, for queries that run the readers on whole files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbook(caption: str, head: list[str], rows: list[tuple[int, int, str, str]]) -> bytes:
    """One sheet 'Orders': a caption, a blank row, a head and rows (number, day's serial, shared string, inline text); the third column is empty."""
    strings = sorted({r[2] for r in rows})
    inline = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    lines = [f'<row r="1">{inline("A1", caption)}</row>', '<row r="3">' + "".join(inline(f"{c}3", h) for c, h in zip("ABDE", head, strict=True)) + "</row>"]
    for k, (number, day, shared, text) in enumerate(rows, 4):
        lines.append(f'<row r="{k}"><c r="A{k}"><v>{number}</v></c><c r="B{k}" s="1"><v>{day}</v></c><c r="C{k}" s="0"/><c r="D{k}" t="s"><v>{strings.index(shared)}</v></c>{inline(f"E{k}", text)}</row>')
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Orders" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
            "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{escape(x)}</t></si>" for x in strings) + "</sst>",
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        }
    )


def pdf(pages: list[list[list[str]]]) -> bytes:
    """A page for each table: a letterhead, a grid of boxes with one text each, a footer with the page's number."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} /MediaBox [0 0 612 792] >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    text = lambda s, x, y: f"BT /F1 10 Tf 1 0 0 1 {x} {y} Tm ({s}) Tj ET "
    for k, rows in enumerate(pages):
        grid = "".join(f"{50 + 150 * i} {700 - 20 * j} 150 20 re S " for j, r in enumerate(rows) for i in range(len(r)))
        cells = "".join(text(c, 55 + 150 * i, 705 - 20 * j) for j, r in enumerate(rows) for i, c in enumerate(r))
        body = (text("Register of customers", 50, 770) + grid + cells + text(f"page {k + 1}", 500, 20)).encode("latin-1")
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode())
        objects.append(f"<< /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream")
    return b"%PDF-1.4\n" + b"\n".join(f"{k} 0 obj\n".encode() + o + b"\nendobj" for k, o in enumerate(objects, 1)) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"
