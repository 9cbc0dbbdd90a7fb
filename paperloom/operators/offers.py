"""Proposals as documents: a template filled from a data file, with computed blocks where directives stand.

``data(prop_id, path, raw)`` are JSON data files; ``files(path, content)`` whatever they name beside them.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import week_label
from ..functions.images import SIGNATURES
from ..functions.money import days_label, format_money, to_cents
from ..functions.text import number_text
from ..sources.base import dealt_out, kept, rows_by_document
from . import proposals as P

ANNEX_ROWS = 2000  # fixed value: rows that a sheet of an annex may have
PLACED = ("annex", "clientLogo")


def beside(path, name) -> Column:
    """A file's path that another file names relative to its own folder."""
    folder = F.regexp_extract(path, "^(.*/)?", 0)
    return F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(folder, F.regexp_replace(name, "^(\\./)+", "")))


@functools.lru_cache(64)
def parsed(template: str) -> list[P.Node]:
    return P.parse_template(template)


def fill_rows(prop_id, raw: str, template: str | None) -> list[dict]:
    """The Markdown of one proposal (kind md), its directives by number, and every error of template and fields."""
    row = lambda kind, ix, name="", text="": {"prop_id": prop_id, "kind": kind, "ix": ix, "name": name, "text": text}
    if template is None:
        return []
    data = json.loads(raw)
    errors: list[str] = []
    found: list[P.Node] = []

    def value(path: str):
        at = data
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    def text(nodes: list[P.Node]) -> str:
        out = []
        for n in nodes:
            v = value(n.value) if n.kind in ("field", "presence") else None
            absent = v in (None, "", [])
            if n.kind == "text":
                out.append(n.value)
            elif n.kind == "presence":
                out.append(text(n.children) if absent != n.positive else "")
            elif n.kind == "field" and absent:
                errors.append(f"{{{{{n.value}}}}} has no value")
            elif n.kind == "field" and (isinstance(v, (dict, list, bool))):
                errors.append(f"{{{{{n.value}}}}} is not a printable value")
            elif n.kind == "field":
                out.append(str(int(v)) if isinstance(v, float) and v.is_integer() else str(v))
            elif n.value == "section":
                named = (data.get("sections") or {}).get(n.args["name"])
                if named is None:
                    errors.append(f"the data file has no section {n.args['name']}")
                out.append(named or "")
            else:
                found.append(n)
                out.append(f"[[{len(found) - 1}:{n.value}]]")
        return "".join(out)

    try:
        md = text(parsed(template))
    except P.TemplateError as e:
        return [row("error", k, text=x) for k, x in enumerate(e.errors)]
    rows = [row("md", 0, text=md)] + [row("directive", k, n.value, json.dumps(n.args)) for k, n in enumerate(found)]
    return rows + [row("error", k, text=x) for k, x in enumerate(errors)]


def computed(data: DataFrame) -> dict[str, DataFrame]:
    """By directive the table it stands for (prop_id, t, head, align, rows, lang)."""
    d = data.select("prop_id", F.from_json("raw", P.SCHEMA).alias("d"))
    text = lambda xs: F.lit(list(xs)).cast("array<string>")
    shape = lambda df, head, align, rows, t="table", lang=None: df.select("prop_id", F.lit(t).alias("t"), head.alias("head"), align.alias("align"), rows.alias("rows"), F.lit(lang).cast("string").alias("lang"))
    lines = F.transform("d.summary", lambda s: F.array(s["item"], format_money(to_cents(s["price"]))))
    summary = shape(d.where("size(d.summary) > 0"), text(("DESCRIPTION", "PRICE")), text("lr"), lines)
    team = P.team_hours(data)
    cells = F.struct("role_ix", F.array(F.col("role"), F.coalesce(F.col("hours").cast("string"), F.lit("")), F.coalesce(format_money("rate_cents"), F.lit("")), F.col("amount")).alias("cells"))
    budget = P.budget_table(team, ["prop_id"]).groupBy("prop_id").agg(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["cells"]).alias("rows"))
    budget = shape(budget, text(("DESCRIPTION", "Hours", "Rate", "Budget")), text("lrrr"), F.col("rows"))

    hours = lambda cell: F.transform("d.team", lambda r: F.concat(F.array(r["role"]), F.transform(r["hoursPerWeek"], cell)))
    weeks = F.transform(F.col("d.team")[0]["hoursPerWeek"], lambda _, k: week_label(k))
    align = F.concat(text("l"), F.transform(weeks, lambda _: F.lit("c")))
    schedule = shape(d, F.concat(text(("Discipline",)), weeks), align, hours(days_label))
    heat = shape(d, F.concat(text(("",)), weeks), align, hours(number_text), "heatmap", "scale")
    return {"summary": summary, "budget": budget, "schedule": schedule, "heatmap": heat}


def assemble(data: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """docs (doc_id, title), blocks of the whole model, dropped (doc_id, kind, message) and violations (prop_id, why).

    A proposal with a violation has no document: broken data, a file that is named and not there, a template or field
    that can't be filled, a directive without what it prints or without a paragraph of its own, an annex with
    a refused sheet, an annex or logo that no directive places, and a summary line that claims
    to cover the budget and differs from it.
    """
    from ..sources import archive, markdown
    from ..sources.discover import shaped

    data = dealt_out(data.select("prop_id", *[c for c in data.columns if c != "prop_id"]))
    invalid = kept(P.data_violations(data.select("prop_id", "raw")))
    good = kept(data.join(invalid.select("prop_id").distinct(), "prop_id", "left_anti"))
    named = good.select("prop_id", "path", F.explode(F.create_map(*[x for k in ("template", *PLACED) for x in (F.lit(k), F.get_json_object("raw", f"$.{k}"))])).alias("what", "name")).where("name is not null")
    # an annex is read once, whoever names it, so its bytes stay with the files
    content = F.when(F.col("what") != "annex", F.col("content")).alias("content")
    found = kept(named.withColumn("at", beside(F.col("path"), F.col("name"))).join(files.select(F.col("path").alias("at"), "content"), "at", "left").select("prop_id", "what", "name", "at", F.col("content").isNotNull().alias("there"), content))
    bad = [invalid, found.where("not there").select("prop_id", F.concat(F.lit("cannot read the "), "what", F.lit(" "), "name").alias("why"))]

    source = good.join(found.where("what = 'template'").select("prop_id", F.decode("content", "UTF-8").alias("template")), "prop_id")
    rows = kept(rows_by_document(source.select("prop_id", "raw", "template"), fill_rows, "prop_id long, kind string, ix int, name string, text string"))
    bad.append(rows.where("kind = 'error'").select("prop_id", F.col("text").alias("why")))
    asked = rows.where("kind = 'directive'").select("prop_id", F.col("ix").alias("directive_ix"), "name", F.get_json_object("text", "$.style").alias("style"))

    team = P.team_hours(good)
    claims = good.select("prop_id", F.explode(F.from_json("raw", P.SCHEMA)["summary"]).alias("s")).select("prop_id", F.col("s.item").alias("item"), F.col("s.covers").alias("covers"), to_cents("s.price").alias("price_cents"))
    differ = P.covers_check(claims, team, ["prop_id"])
    bad.append(differ.select("prop_id", F.concat(F.lit('summary line "'), "item", F.lit('" says '), format_money("claimed_cents"), F.lit(", hours times rates come to "), format_money("computed_cents")).alias("why")))

    # the files that are annexes, each under the number of the first proposal that names it
    annexes = found.where("what = 'annex' and there").select("prop_id", "at")
    books = kept(annexes.groupBy("at").agg(F.min("prop_id").alias("book")))
    naming = annexes.join(books, "at").select("prop_id", "book")
    annex = archive.workbook_blocks(books.join(files.select(F.col("path").alias("at"), "content"), "at").select(F.col("book").alias("doc_id"), "content"), ANNEX_ROWS)
    by_proposal = lambda df: naming.join(df.withColumnRenamed("doc_id", "book"), "book").withColumnRenamed("prop_id", "doc_id").drop("book")
    annex_lost = by_proposal(kept(annex["dropped"]))
    bad.append(annex_lost.where("kind in ('refused', 'sheet')").select(F.col("doc_id").alias("prop_id"), F.concat(F.lit("annex: "), "message").alias("why")))
    logos = found.where("what = 'clientLogo' and there")
    mime = F.coalesce(*[F.when(F.startswith("content", F.lit(bytes(magic))), F.lit(m)) for m, magic in SIGNATURES])
    logos = logos.select("prop_id", mime.alias("mime"), "content")
    bad.append(logos.where("mime is null").select("prop_id", F.lit("clientLogo: not an image format that is read").alias("why")))

    # what each directive stands for, as numbered rows of the block model
    tables = computed(good)
    blank = lambda df, name: shaped(df.withColumn("doc_id", F.col("prop_id")).withColumn("block_ix", F.lit(0))).withColumn("name", F.lit(name)).withColumn("sub_ix", F.lit(0).cast("long"))
    parts = [blank(t, name) for name, t in tables.items()]
    parts.append(blank(good.select("prop_id", F.lit("pagebreak").alias("t")), "pagebreak"))
    parts.append(by_proposal(shaped(kept(annex["blocks"]))).withColumns({"name": F.lit("annex"), "sub_ix": F.col("block_ix")}))
    src = F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content"))
    parts.append(blank(logos.where("mime is not null").select("prop_id", F.lit("image").alias("t"), src.alias("src"), F.lit("the client's logo").alias("alt")), "clientlogo"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    expanded = kept(asked.withColumnRenamed("prop_id", "doc_id").join(every, ["doc_id", "name"], "left"))
    bad.append(expanded.where("t is null").select(F.col("doc_id").alias("prop_id"), F.concat(F.lit("{{@"), "name", F.lit("}} has nothing to print: the data file names none")).alias("why")))
    bad.append(asked.where((F.col("name") == "heatmap") & ~F.coalesce("style", F.lit("scale")).isin(*P.STYLES)).select("prop_id", F.concat(F.lit("unknown heatmap style "), "style").alias("why")))
    expanded = expanded.where("t is not null").withColumn("lang", F.when(F.col("t") == "heatmap", F.coalesce("style", "lang")).otherwise(F.col("lang"))).drop("name", "style")
    unplaced = found.where(F.col("what").isin(*PLACED)).select("prop_id", "what", F.lower("what").alias("name")).join(asked, ["prop_id", "name"], "left_anti")
    bad.append(unplaced.select("prop_id", F.concat("what", F.lit(" is named in the data, but the template never places it")).alias("why")))

    blocks, lost = markdown.read(rows.where("kind = 'md'").select(F.col("prop_id").alias("doc_id"), "text"))
    titles, rest = markdown.with_titles(kept(blocks))
    spliced, swallowed = P.splice(rest, expanded)
    bad.append(swallowed.select(F.col("doc_id").alias("prop_id"), F.lit("a directive did not stand alone as a paragraph of its own").alias("why")))
    violations = bad[0].select("prop_id", "why")
    for x in bad[1:]:
        violations = violations.unionByName(x.select("prop_id", "why"))
    violations = kept(violations.distinct())
    refused = violations.select(F.col("prop_id").alias("doc_id")).distinct()
    order = Window.partitionBy("doc_id").orderBy("block_ix", "sub_ix")
    whole = spliced.join(refused, "doc_id", "left_anti").withColumn("block_ix", (F.row_number().over(order) - 1).cast("long")).drop("sub_ix")
    dropped = lost.select("doc_id", "kind", "message").unionByName(annex_lost.select("doc_id", "kind", F.concat(F.lit("annex: "), "message").alias("message")))
    return {"docs": titles.join(refused, "doc_id", "left_anti"), "blocks": whole, "dropped": dropped, "violations": violations}
