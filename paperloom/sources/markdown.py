"""Markdown as normalised tables: a lexer of the block and inline forms that documents use.

A document's blocks: headings (# and underlined), paragraphs, lists (nested ones become
siblings, numbering goes on across a split), tables, fenced and indented code, quotes,
rules, page breaks, images. What has no place in the model is reported in ``dropped``: raw
HTML, headings deeper than three, quotes' inner structure. Strike-through keeps its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.render import block_markdown, gap_after
from .base import kept, rows_by_document

SPAN = "struct<v:string,path:array<struct<t:string,href:string,node:int>>>"
BLOCK_SCHEMA = (
    "doc_id long, block_ix int, t string, level int, text string, ordered boolean, depth int, start int, "
    f"items array<string>, head array<string>, align array<string>, rows array<array<string>>, src string, alt string, lang string, spans array<{SPAN}>, n_cols int, n_aligned int"
)
FIELDS = [x.split(" ")[0] for x in re.split(r", (?![^<]*>)", BLOCK_SCHEMA)]
PAGEBREAK = "<!-- pagebreak -->"

_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( *)(?:([-*+])|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")


class Lexer:
    """One document's blocks, in order, and what was lost."""

    def __init__(self, source: str):
        self.blocks: list[dict] = []
        self.dropped: list[tuple[str, str]] = []
        self.lines = source.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
        self.at = 0
        while self.at < len(self.lines):
            self.block()

    def add(self, t: str, **fields) -> None:
        self.blocks.append({"t": t} | fields)

    def lose(self, kind: str, what: str) -> None:
        self.dropped.append((kind, re.sub(r"\s+", " ", what).strip()[:40]))

    def block(self) -> None:
        line = self.lines[self.at]
        if not line.strip():
            self.at += 1
        elif line.strip() == PAGEBREAK:
            self.at += 1
            self.add("pagebreak")
        elif m := _HEAD.match(line):
            self.at += 1
            self.heading(len(m[1]), m[2] or "")
        elif _RULE.match(line):
            self.at += 1
            self.add("rule")
        elif m := _FENCE.match(line):
            self.code(m[1], m[2])
        elif line.lstrip().startswith(">"):
            self.quote()
        elif _ITEM.match(line):
            self.listing()
        elif line.startswith("    "):
            self.indented()
        elif "|" in line and self.at + 1 < len(self.lines) and "-" in self.lines[self.at + 1] and _TABLE_RULE.match(self.lines[self.at + 1]) and len(split_row(line)) == len(split_row(self.lines[self.at + 1])):
            self.table()
        elif _HTML.match(line) and not re.match(r" {0,3}<[A-Za-z][A-Za-z0-9+.-]*:", line):
            self.html()
        else:
            self.para()

    def heading(self, level: int, text: str) -> None:
        if level > 3:
            self.lose("heading", f"level {level}: {text}")
        self.add("heading", level=min(level, 3), text=text.strip())

    def code(self, mark: str, lang: str) -> None:
        self.at += 1
        body = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            self.at += 1
            if re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", line):
                break
            body.append(line)
        self.add("code", text="\n".join(body), lang=lang or None)

    def indented(self) -> None:
        body = []
        while self.at < len(self.lines) and (self.lines[self.at].startswith("    ") or not self.lines[self.at].strip()):
            body.append(self.lines[self.at][4:])
            self.at += 1
        self.add("code", text="\n".join(body).rstrip("\n"))

    def quote(self) -> None:
        body = []
        while self.at < len(self.lines) and self.lines[self.at].lstrip().startswith(">"):
            body.append(re.sub(r"^ *> ?", "", self.lines[self.at]))
            self.at += 1
        inner = Lexer("\n".join(body))
        paras = [b["text"] for b in inner.blocks if b["t"] == "para"]
        for b in inner.blocks:
            if b["t"] != "para":
                self.lose("quote", f"{b['t']} inside a quote: {b.get('text') or ''}")
        self.dropped += inner.dropped
        if paras:
            self.add("quote", items=paras)

    def html(self) -> None:
        body = []
        while self.at < len(self.lines) and self.lines[self.at].strip():
            body.append(self.lines[self.at])
            self.at += 1
        self.lose("html", " ".join(body))

    def table(self) -> None:
        head = split_row(self.lines[self.at])
        align = [("c" if a[-1] == ":" and a[0] == ":" else "r" if a[-1] == ":" else "l") for a in split_row(self.lines[self.at + 1])]
        self.at += 2
        rows = []
        while self.at < len(self.lines) and "|" in self.lines[self.at] and self.lines[self.at].strip():
            row = split_row(self.lines[self.at])[: len(head)]
            rows.append(row + [""] * (len(head) - len(row)))
            self.at += 1
        self.add("table", head=head, align=align, rows=rows)

    def listing(self) -> None:
        """Items with their indent; text after a nested list opens a further block of the outer one."""
        rows: list[tuple[int, str | None, int | None, str]] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if (m := _ITEM.match(line)) and not _RULE.match(line):
                rows.append((len(m[1]), m[2], int(m[3]) if m[3] else None, (m[4] or "").strip()))
            elif not line.strip():
                nxt = next((x for x in self.lines[self.at :] if x.strip()), "")
                if not ((_ITEM.match(nxt) and not _RULE.match(nxt)) or (nxt.startswith("  ") and rows)):
                    break
                if _ITEM.match(nxt) and not nxt.startswith(" ") and rows and (_ITEM.match(nxt)[2] is None) != (rows[-1][1] is None) and rows[-1][0] == 0:
                    break
            elif line.startswith("  ") and rows:
                rows[-1] = (*rows[-1][:3], f"{rows[-1][3]} {line.strip()}".strip())
            elif rows and not _interrupts(line):
                rows[-1] = (*rows[-1][:3], f"{rows[-1][3]} {line.strip()}".strip())
            else:
                break
            self.at += 1
        indents: list[int] = []
        counter: dict[int, int] = {}
        block: dict | None = None
        for indent, bullet, number, text in rows:
            while indents and indent < indents[-1]:
                counter.pop(len(indents) - 1, None)
                indents.pop()
            if not indents or indent >= indents[-1] + 2:
                indents.append(indent)
                counter[len(indents) - 1] = number if number is not None else 1
            depth, ordered = len(indents) - 1, bullet is None
            n = counter.get(depth, number or 1)
            counter[depth] = n + 1
            if block is None or block["depth"] != depth or block["ordered"] != ordered:
                block = {"ordered": ordered, "depth": depth, "start": n if ordered and n != 1 else None, "items": []}
                self.add("list", **block)
                block = self.blocks[-1]
            block["items"].append(text)

    def para(self) -> None:
        body = []
        while self.at < len(self.lines) and self.lines[self.at].strip():
            line = self.lines[self.at]
            if body and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
                self.at += 1
                self.heading(1 if line.strip()[0] == "=" else 2, " ".join(body))
                return
            if body and _interrupts(line):
                break
            body.append(line.strip())
            self.at += 1
        text = "\n".join(body)
        images = re.fullmatch(r"!\[([^\]]*)\]\((\S+?)(?:\s+\"[^\"]*\")?\)", text)
        if images:
            if images[2].startswith("data:"):
                self.add("image", src=images[2], alt=images[1])
            else:
                self.lose("image", images[2])
        else:
            self.add("para", text=text)


def _interrupts(line: str) -> bool:
    item = _ITEM.match(line)
    return bool(_HEAD.match(line) or _RULE.match(line) or _FENCE.match(line) or line.lstrip().startswith(">") or line.strip() == PAGEBREAK or (item and item[4] and (item[2] or item[3] == "1")))


def split_row(line: str) -> list[str]:
    """Cells of a table's line; an escaped pipe is part of its cell."""
    cells = re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|\s*$", "", re.sub(r"^\s*\|", "", line)))
    return [c.strip().replace("\\|", "|") for c in cells]


_INLINE = re.compile(r"(?P<code>`+)(?P<body>.+?)(?<!`)(?P=code)(?!`)|!\[(?P<alt>[^\]]*)\]\([^)]*\)|\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\]\((?P<href>[^\s)]*)(?:\s+\"[^\"]*\")?\)|\*\*(?P<strong>.+?)\*\*(?!\*)|__(?P<strong2>.+?)__(?!_)|\*(?P<em>[^*\s](?:.*?[^*\s])?)\*|(?<!\w)_(?P<em2>[^_\s](?:.*?[^_\s])?)_(?!\w)|~~(?P<strike>.+?)~~|\\(?P<escaped>[!-/:-@\[-`{-~])|<(?P<auto>[a-z][a-z0-9+.-]*:[^>\s]*)>|(?P<html></?[A-Za-z][^>]*>)", re.S)


def spans_of(text: str, lose=None, path: tuple = (), count=None) -> list[dict]:
    """Leaves of a text with their ancestors; nodes are numbered so that neighbours stay apart."""
    count = count if count is not None else iter(range(1, 10**9))
    out: list[dict] = []

    def leaf(v: str) -> None:
        if v and out and out[-1]["path"] == list(path):
            out[-1]["v"] += v
        elif v:
            out.append({"v": v, "path": list(path)})

    def inside(t: str, body: str, href: str | None = None) -> None:
        node = {"t": t, "href": href, "node": next(count)}
        got = [{"v": body, "path": [*path, node]}] if t == "code" else spans_of(body, lose, (*path, node), count)
        out.extend(got or [{"v": None, "path": [*path, node]}])

    at = 0
    for m in _INLINE.finditer(text):
        leaf(text[at : m.start()])
        at = m.end()
        if m["code"]:
            inside("code", m["body"].strip() or m["body"])
        elif m["label"] is not None:
            inside("link", m["label"], m["href"])
        elif m["strong"] or m["strong2"]:
            inside("strong", m["strong"] or m["strong2"])
        elif m["em"] or m["em2"]:
            inside("em", m["em"] or m["em2"])
        elif m["strike"]:
            if lose:
                lose("strikethrough", m["strike"])
            out.extend(spans_of(m["strike"], lose, path, count))
        elif m["escaped"]:
            leaf(m["escaped"])
        elif m["auto"]:
            inside("link", m["auto"], m["auto"])
        elif lose:
            lose("image" if m["alt"] is not None else "html", m[0])
    leaf(text[at:])
    return out


def block_row(doc_id, k: int, b: dict, spans: list[dict] | None) -> dict:
    width = len(b["head"]) if b["t"] == "table" else None
    return dict.fromkeys(FIELDS) | b | {"doc_id": doc_id, "block_ix": k, "spans": spans, "n_cols": width, "n_aligned": len(b["align"]) if width else None}


def block_rows(doc_id, text: str | None) -> list[dict]:
    return [r for r in read_rows(doc_id, text) if r["loss"] is None]


LOSS = "loss struct<seq: int, kind: string, message: string>"


def read_rows(doc_id, text: str | None) -> Iterator[dict]:
    """A text's blocks, and behind them what was lost, from one reading."""
    lexer = Lexer(text or "")
    for k, b in enumerate(lexer.blocks):
        spans = spans_of(b["text"], lexer.lose) if b["t"] in ("para", "heading") else None
        for piece in b.get("items") or ():
            spans_of(piece or "", lexer.lose)
        yield block_row(doc_id, k, b, spans) | {"loss": None}
    for k, (kind, what) in enumerate(lexer.dropped):
        yield dict.fromkeys(FIELDS) | {"doc_id": doc_id, "loss": {"seq": k, "kind": kind, "message": what}}


def read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, dropped) of docs(doc_id, text); a text is lexed once, and its rows are written for both."""
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = kept(rows_by_document(src, read_rows, f"{BLOCK_SCHEMA}, {LOSS}"))
    return rows.where("loss is null").drop("loss"), rows.where("loss is not null").select("doc_id", "loss.seq", "loss.kind", "loss.message")


def with_titles(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs(doc_id, title, subtitle), blocks): the first level-1 heading becomes the title."""
    from ..operators.blocks import lift_title

    titles, rest = lift_title(blocks)
    return titles.withColumn("subtitle", F.lit(None).cast("string")), rest


def normalise(docs: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc_id, markdown): documents read and written again in one fixed form; a column ``tag`` of docs comes along.

    A text is lexed once, and its blocks are dealt out once: title and neighbours by windows, then the text.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"))
    rows = rows_by_document(src, lambda doc_id, text, tag: [r | {"tag": tag} for r in block_rows(doc_id, text)], BLOCK_SCHEMA + ", tag string")
    whole = Window.partitionBy("doc_id")
    ordered = whole.orderBy("block_ix")
    first = F.min(F.when((F.col("t") == "heading") & (F.col("level") == 1), F.struct("block_ix", "text"))).over(whole)
    rows = rows.withColumn("first", first).withColumn("is_title", F.col("block_ix").eqNullSafe(F.col("first.block_ix")))
    follows = F.when(F.lead("is_title").over(ordered), F.lead("t", 2).over(ordered)).otherwise(F.lead("t").over(ordered))
    rows = rows.withColumn("follows", follows)
    piece = F.when(~F.col("is_title"), F.struct("block_ix", F.concat(block_markdown(), gap_after(F.col("follows"))).alias("md")))
    pieces = F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["md"])
    out = rows.groupBy("doc_id").agg(F.coalesce(F.max("first.text"), F.lit("Untitled")).alias("title"), pieces.alias("pieces"), F.max("tag").alias("tag"))
    text = F.concat(F.lit("# "), F.col("title"), F.when(F.size("pieces") > 0, F.concat(F.lit("\n\n"), F.array_join("pieces", ""))).otherwise("\n"))
    return out.select("doc_id", text.alias("markdown"), *([F.col("tag").alias(tag)] if tag else []))
