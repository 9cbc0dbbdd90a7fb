"""Documents as files: Markdown, HTML and word-processing packages, one file a document."""

from __future__ import annotations

import base64
import io
import json
import math
import re
import struct
import zipfile
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import SCALE_STEPS
from ..operators import widths as W
from ..operators.config import FORMATS
from ..operators.render import render_html, render_markdown
from ..sources.base import dealt_out
from ..sources.markdown import spans_of

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
STYLES = {1: "Heading1", 2: "Heading2", 3: "Heading3"}
BODY_PT, MARGIN_PT = 10.0, 48.0
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/bmp": "bmp"}


class Parts:
    """What a main part refers to: link targets and images, numbered in order of use; and what could not be carried."""

    def __init__(self):
        self.links: list[str] = []
        self.images: list[tuple[str, bytes]] = []
        self.lost: list[str] = []

    def link(self, target: str) -> str:
        if target not in self.links:
            self.links.append(target)
        return f"rIdL{self.links.index(target) + 1}"

    def image(self, src: str) -> str | None:
        m = re.fullmatch(r"data:([a-z/]+);base64,([A-Za-z0-9+/=\s]+)", src or "")
        if not m or m[1] not in EXTENSIONS:
            return None
        self.images.append((EXTENSIONS[m[1]], base64.b64decode(m[2])))
        return f"rIdI{len(self.images)}"

    def relations(self) -> str:
        out = [f'<Relationship Id="rIdL{k}" Type="{OFFICE}/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for k, t in enumerate(self.links, 1)]
        out += [f'<Relationship Id="rIdI{k}" Type="{OFFICE}/image" Target="media/image{k}.{ending}"/>' for k, (ending, _) in enumerate(self.images, 1)]
        return "".join(out)


def _run(text: str, code: bool = False, **marks: bool) -> str:
    properties = ('<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>' if code else "") + "".join(f"<w:{k}/>" for k, on in marks.items() if on)
    clean = re.sub("[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", text)  # what XML can hold
    return f"<w:r>{f'<w:rPr>{properties}</w:rPr>' if properties else ''}<w:t xml:space=\"preserve\">{escape(clean)}</w:t></w:r>"


def _para(inner: str, properties: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}{inner}</w:p>"


def refused(href: str) -> bool:
    return bool(re.match("(?i)(javascript|vbscript|data):", re.sub(r"[\x00-\x20\x7f]", "", href)))


def _spans(spans: list[dict] | None, text: str | None, parts: Parts) -> str:
    """Runs of a text: emphasis, code and links; a link whose scheme is refused keeps its text only."""
    out = []
    for s in spans if spans else [{"v": text or "", "path": []}]:
        kinds = {e["t"] for e in s["path"] or ()}
        href = next((e["href"] for e in s["path"] or () if e["t"] == "link" and e["href"]), None)
        run = _run(s["v"] or "", "code" in kinds, b="strong" in kinds, i="em" in kinds, u=bool(href))
        if href and refused(href):
            parts.lost.append(f"a link is left out: {href[:40]}")
        elif href and href.startswith("#"):
            run = f"<w:hyperlink w:anchor={quoteattr(href[1:])}>{run}</w:hyperlink>"
        elif href:
            run = f'<w:hyperlink r:id="{parts.link(href)}">{run}</w:hyperlink>'
        out.append(run)
    return "".join(out)


def column_widths(head: list[str], rows: list[list[str]], total: int) -> list[int]:
    body = [[len(r[k]) if k < len(r) else 0 for r in rows] for k in range(len(head))]
    demand = [max(len(h), float(np.percentile(c, 75)) if c else 0.0) for h, c in zip(head, body, strict=True)]
    longest = [max([len(h), *c]) for h, c in zip(head, body, strict=True)]
    return W.solve(demand, longest, all(not h.strip() for h in head), total, BODY_PT)


def table_xml(head: list[str], rows: list[list[str]], widths: list[int], parts: Parts, shade=lambda j, k: None) -> str:
    """A table with fixed widths; inline Markdown in a cell becomes runs."""
    def cell(text: str, j: int, k: int) -> str:
        fill = f'<w:shd w:val="clear" w:fill="{shade(j, k)}"/>' if shade(j, k) else ""
        return f'<w:tc><w:tcPr><w:tcW w:w="{widths[k]}" w:type="dxa"/>{fill}</w:tcPr>{_para(_spans(spans_of(text), text, parts))}</w:tc>'

    lines = ([head] if any(h.strip() for h in head) else []) + rows
    shift = len(lines) - len(rows)
    body = "".join("<w:tr>" + "".join(cell(c, j - shift, k) for k, c in enumerate(r[: len(widths)])) + "</w:tr>" for j, r in enumerate(lines))
    grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in widths)
    return f'<w:tbl><w:tblPr><w:tblW w:w="{sum(widths)}" w:type="dxa"/><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{body}</w:tbl>'


def heat_xml(b: dict, total: int, parts: Parts) -> str:
    """A heatmap: its labels take 28 % of the width; steps are tints, squares or numbers by its style."""
    rows, weeks = b["rows"] or [], max(1, len(b["head"]) - 1)
    number = lambda v: float(v) if re.fullmatch(r"\d+(\.\d+)?", v or "") else 0.0
    most = max((number(v) for r in rows for v in r[1:]), default=0.0)
    step = lambda v, n: 0 if number(v) <= 0 or most <= 0 else min(n, math.ceil(number(v) / most * n))
    label = math.floor(total * 0.28)
    widths = [label, *W.largest_remainder([(total - label) / weeks] * weeks, total - label)]
    shown = [[r[0], *("▪" * step(v, 3) if b["lang"] == "marks" else v if b["lang"] == "numbers" and number(v) > 0 else "" for v in r[1:])] for r in rows]

    def shade(j: int, k: int) -> str | None:
        if b["lang"] != "scale" or j < 0 or k < 1 or not (s := step(rows[j][k], len(SCALE_STEPS))):
            return None
        t = SCALE_STEPS[s - 1]
        return "".join(f"{math.floor(0x1A * t + 255 * (1 - t) + 0.5):02X}" for _ in range(3))

    return table_xml(b["head"], shown, widths, parts, shade)


def picture(rid: str, alt: str, number: int, data: bytes) -> str:
    """An inline picture at 96 pixels an inch, no wider than the page."""
    w, h = (struct.unpack(">II", data[16:24]) if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24 else struct.unpack("<HH", data[6:10]) if data[:4] == b"GIF8" else (400, 300))
    scale = min(1.0, (595.28 - 2 * MARGIN_PT) / max(1.0, w * 0.75))
    x, y = int(max(w, 1) * 9525 * scale), int(max(h, 1) * 9525 * scale)
    name = quoteattr(alt or f"image {number}")
    return (
        f'<w:r><w:drawing><wp:inline xmlns:wp="{DRAWING}/wordprocessingDrawing"><wp:extent cx="{x}" cy="{y}"/><wp:docPr id="{number}" name={name} descr={name}/>'
        f'<a:graphic xmlns:a="{DRAWING}/main"><a:graphicData uri="{DRAWING}/picture"><pic:pic xmlns:pic="{DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="{number}" name={name}/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{x}" cy="{y}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def block_xml(b: dict, number: int, parts: Parts, total: int) -> str:
    """A block as paragraphs or a table of the main part; lists use numbering ``number``, tables span ``total``."""
    t, inline = b["t"], lambda x: _spans(spans_of(x or ""), x, parts)
    if t == "heading":
        return _para(_spans(b.get("spans"), b.get("text"), parts), f'<w:pStyle w:val="{STYLES[b["level"]]}"/>')
    if t == "list":
        level = f'<w:numPr><w:ilvl w:val="{b.get("depth") or 0}"/><w:numId w:val="{number}"/></w:numPr>'
        return "".join(_para(inline(x), level) for x in b["items"] or ())
    if t == "quote":
        return "".join(_para(inline(x), '<w:ind w:left="400"/>') for x in b["items"] or ())
    if t == "pagebreak":
        return _para('<w:r><w:br w:type="page"/></w:r>')
    if t == "rule":
        return _para("", '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>')
    if t == "code":
        return "".join(_para(_run(x, True)) for x in (b.get("text") or "").split("\n"))
    if t == "table":
        return table_xml(b["head"], b["rows"] or [], column_widths(b["head"], b["rows"] or [], total), parts)
    if t == "heatmap":
        return heat_xml(b, total, parts)
    if t == "image":
        rid = parts.image(b.get("src"))
        if rid:
            return _para(picture(rid, b.get("alt") or "", len(parts.images), parts.images[-1][1]))
        parts.lost.append(f"an image is left out: {(b.get('src') or '')[:40]}")
        return _para(_run(f"[{b.get('alt') or ''}]"))
    return _para(_spans(b.get("spans"), b.get("text"), parts))


def dxa(pt: float) -> int:
    return math.floor(pt * 20 + 0.5)


def is_wide(b: dict) -> bool:
    """Whether a table needs a sheet on its side: its narrowest legible columns don't fit the upright one."""
    columns = len(b["head"] or ()) if b["t"] in ("table", "heatmap") else 0
    return columns * dxa(W.MARGINS + W.MIN_CHARS * BODY_PT * W.GLYPH) > dxa(595.28 - 2 * MARGIN_PT)


def section_xml(wide: bool) -> str:
    w, h = (841.89, 595.28) if wide else (595.28, 841.89)
    turned = ' w:orient="landscape"' if wide else ""
    margin = " ".join(f'w:{side}="{dxa(MARGIN_PT)}"' for side in ("top", "right", "bottom", "left"))
    return f'<w:sectPr><w:pgSz w:w="{dxa(w)}" w:h="{dxa(h)}"{turned}/><w:pgMar {margin} w:header="480" w:footer="480" w:gutter="0"/></w:sectPr>'


def body_xml(title: str, blocks: list[dict], parts: Parts) -> str:
    """All blocks, a section for each run of one orientation, a hairline paragraph between neighbouring tables and after a last one."""
    out, number, wide = [_para(_run(title), '<w:pStyle w:val="Title"/>')], 0, False
    hairline = _para("", '<w:spacing w:before="0" w:after="0" w:line="20" w:lineRule="exact"/>')
    after_table = False
    for b in blocks:
        turned = is_wide(b)
        if turned != wide:
            out.append(_para("", section_xml(wide)))
            wide = turned
        elif after_table and b["t"] in ("table", "heatmap"):
            out.append(hairline)
        number += b["t"] == "list"
        out.append(block_xml(b, number, parts, dxa((841.89 if wide else 595.28) - 2 * MARGIN_PT)))
        after_table = b["t"] in ("table", "heatmap")
    return "".join([*out, *([hairline] if after_table else []), section_xml(wide)])


@lru_cache(512)
def levels_xml(start: int, ordered: bool) -> str:
    return "".join(f'<w:lvl w:ilvl="{d}"><w:start w:val="{start}"/><w:numFmt w:val="{"decimal" if ordered else "bullet"}"/><w:lvlText w:val={quoteattr(f"%{d + 1}." if ordered else "•")}/></w:lvl>' for d in range(9))


def numbering_xml(lists: list[dict]) -> str:
    """A definition for each list block, so that each starts where it should."""
    out = []
    for k, b in enumerate(lists, 1):
        levels = levels_xml(b.get("start") or 1, bool(b["ordered"]))
        out.append(f'<w:abstractNum w:abstractNumId="{k}">{levels}</w:abstractNum>')
    out += [f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(1, len(lists) + 1)]
    return f'<?xml version="1.0" encoding="UTF-8"?><w:numbering xmlns:w="{WORD}">{"".join(out)}</w:numbering>'


def package(title: str, blocks: list[dict], date: tuple = (1980, 1, 1, 0, 0, 0)) -> tuple[bytes, list[str]]:
    """A word-processing package with fixed times (equal documents give equal bytes), and what it could not carry."""
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    spread, head = Parts(), '<?xml version="1.0" encoding="UTF-8"?>'
    body = body_xml(title, blocks, spread)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/></w:style>' for s in ("Normal", "Title", *STYLES.values()))
    images = "".join(f'<Default Extension="{e}" ContentType="image/{e}"/>' for e in sorted({e for e, _ in spread.images}))
    packages = "http://schemas.openxmlformats.org/package/2006"
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": f'{head}<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{images}<Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{kind}.numbering+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{OFFICE}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{OFFICE}/numbering" Target="numbering.xml"/>{spread.relations()}</Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{WORD}" xmlns:r="{OFFICE}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'{head}<w:styles xmlns:w="{WORD}">{styles}</w:styles>',
        "word/numbering.xml": numbering_xml([b for b in blocks if b["t"] == "list"]),
    }
    parts |= {f"word/media/image{k}.{ending}": data for k, (ending, data) in enumerate(spread.images, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, date), content, zipfile.ZIP_DEFLATED)
    return out.getvalue(), spread.lost


def render_docx(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, content, lost): a document's blocks come together in one row, of one document's size, dealt out over all cores."""
    fields = [c for c in ("t", "level", "text", "ordered", "depth", "start", "items", "head", "align", "rows", "src", "alt", "lang", "spans") if c in blocks.columns]
    rows = blocks.select("doc_id", "block_ix", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    body = dealt_out(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ix", "json"))).alias("blocks"))
    src = docs.join(body, "doc_id", "left").select("doc_id", "title", F.transform("blocks", lambda b: b["json"]).alias("blocks"))

    def run(batches):
        for b in batches:
            made = [package(t or "Untitled", [json.loads(x) for x in bs or ()]) for t, bs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in made], pa.binary()), pa.array([x for _, x in made], pa.list_(pa.string()))], names=["doc_id", "content", "lost"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("lost", T.ArrayType(T.StringType()))]))


def render(kind: str, docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, content, lost) in one of the formats that need no browser; 'pdf' is refused by name."""
    none = F.array().cast("array<string>").alias("lost")
    if kind == "md":
        return render_markdown(docs, blocks).select("doc_id", F.encode("markdown", "UTF-8").alias("content"), none)
    if kind == "html":
        return render_html(docs.withColumn("lang", F.lit("en")) if "lang" not in docs.columns else docs, blocks).select("doc_id", F.encode("html", "UTF-8").alias("content"), none)
    if kind == "docx":
        return render_docx(docs, blocks)
    raise ValueError(f"no writer for {kind!r}; formats are {', '.join(f for f in FORMATS if f != 'pdf')} and html")
