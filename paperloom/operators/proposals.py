"""Proposals: hours, budget and schedule in exact cents, the template language, checks.

``team(prop_id, role_ix, role, rate_cents, week_ix, hours)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import step_of, week_label
from ..functions.money import cents_error, days_label, format_money, to_cents
from ..functions.text import number_text

STYLES = ("scale", "numbers", "marks")  # fixed value


def role_budget(team: DataFrame, key: list[str]) -> DataFrame:
    """Hours and cents by role."""
    return team.groupBy(*key, "role_ix", "role", "rate_cents").agg(F.sum("hours").cast("long").alias("hours")).withColumn("cents", F.col("hours") * F.col("rate_cents"))


def budget_table(team: DataFrame, key: list[str]) -> DataFrame:
    """Rows by role and a TOTAL row, whose hours and rate stay blank."""
    roles = role_budget(team, key)
    total = roles.groupBy(*key).agg(F.sum("cents").alias("cents"), (F.max("role_ix") + 1).alias("role_ix"))
    rows = roles.select(*key, "role_ix", "role", "hours", "rate_cents", "cents")
    last = total.select(*key, "role_ix", F.lit("TOTAL").alias("role"), F.lit(None).cast("long").alias("hours"), F.lit(None).cast("long").alias("rate_cents"), "cents")
    return rows.unionByName(last).withColumn("amount", format_money("cents"))


def covers_check(summary: DataFrame, team: DataFrame, key: list[str]) -> DataFrame:
    """Summary lines that claim to cover the budget and differ from hours times rates."""
    total = role_budget(team, key).groupBy(*key).agg(F.sum("cents").alias("computed_cents"))
    return summary.where("covers = 'budget'").join(total, key).where("price_cents <> computed_cents").select(*key, "item", F.col("price_cents").alias("claimed_cents"), "computed_cents")


def schedule(team: DataFrame, key: list[str]) -> DataFrame:
    """Each role's weeks in words."""
    return team.select(*key, "role_ix", "role", "week_ix", week_label("week_ix").alias("week"), days_label("hours").alias("label"))


def heatmap(cells: DataFrame, key: list[str], style: str) -> DataFrame:
    """(key..., label, week, value, mark): steps against the matrix's largest value, in one of three styles."""
    if style not in STYLES:
        raise ValueError(f"unknown heatmap style {style!r}: scale, numbers or marks")
    most = cells.groupBy(*key).agg(F.max("value").alias("most"))
    rows = cells.join(most, key)
    if style == "scale":
        mark = step_of("value", "most", 4).cast("string")
    elif style == "marks":
        mark = F.repeat(F.lit("▪"), step_of("value", "most", 3))
    else:
        mark = F.when(F.col("value") > 0, number_text("value")).otherwise("")
    return rows.select(*key, "label", week_label("week_ix").alias("week"), "value", mark.alias("mark"))


def inspect(team: DataFrame, key: list[str]) -> DataFrame:
    """One row a proposal: weeks, roles, total."""
    weeks = team.groupBy(*key).agg((F.max("week_ix") + 1).alias("weeks"), F.count_distinct("role_ix").alias("roles"))
    total = role_budget(team, key).groupBy(*key).agg(F.sum("cents").alias("total_cents"))
    return weeks.join(total, key).withColumn("total", format_money("total_cents"))


# fixed values: keys that a proposal, its author, a role and a summary line may have
TOP_KEYS = ("template", "kind", "project", "date", "stage", "number", "docNumber", "rev", "currency", "author", "team", "summary", "sections", "annex", "clientLogo", "cover")
AUTHOR_KEYS = ("name", "email", "phone")
ROLE_KEYS = ("role", "rate", "hoursPerWeek")
SUMMARY_KEYS = ("item", "price", "covers")

SCHEMA = """template string, kind string, project string, date string, stage string, number string, docNumber string, rev string,
currency string, author struct<name: string, email: string, phone: string>, team array<struct<role: string, rate: double, hoursPerWeek: array<double>>>,
summary array<struct<item: string, price: double, covers: string>>, sections map<string, string>, annex string, clientLogo string, cover boolean"""


def data_violations(files: DataFrame) -> DataFrame:
    """Every broken rule of proposal files (prop_id, raw JSON) as a row (prop_id, why): unknown keys, what is
    required, amounts, weeks that differ, more than one line that covers the budget."""
    whole = files.withColumn("d", F.from_json("raw", SCHEMA)).withColumn("keys", F.json_object_keys("raw"))
    d = F.col("d")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    one = [F.when(F.col("keys").isNull(), F.lit("the data file must hold one JSON object"))]
    ok = F.col("keys").isNotNull()
    one += [F.when(ok & blank(d[k]), F.lit(f"{k} is required")) for k in ("template", "kind", "project", "date")]
    one += [F.when(ok & d["currency"].isNotNull() & (d["currency"] != "EUR"), F.lit("currency: only EUR is known"))]
    one += [F.when(ok & blank(d["author"][k]), F.lit(f"author.{k}: expected a non-empty string")) for k in ("name", "email")]
    one += [F.when(ok & (F.coalesce(F.size(d["team"]), F.lit(0)) <= 0), F.lit("team is required and must hold at least one role"))]
    weeks = F.array_distinct(F.transform(d["team"], lambda r: F.size(r["hoursPerWeek"])))
    one += [F.when(F.size(weeks) > 1, F.lit("every hoursPerWeek must cover the same weeks"))]
    covering = F.size(F.filter(d["summary"], lambda s: s["covers"] == "budget"))
    one += [F.when(covering > 1, F.concat(F.lit("summary: "), covering.cast("string"), F.lit(' lines claim covers:"budget"')))]
    unknown = F.transform(F.array_except("keys", F.lit(list(TOP_KEYS))), lambda k: F.concat(F.lit("unknown key "), k))

    def listed(items: Column, name: str, test) -> Column:
        return F.flatten(F.transform(items, lambda x, i: F.transform(F.array_compact(test(x)), lambda why: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."), why))))

    hours = lambda r: F.exists(r["hoursPerWeek"], lambda h: h.isNull() | (h < 0) | (h != F.floor(h)))
    roles = listed(d["team"], "team", lambda r: F.array(F.when(blank(r["role"]), "role: expected a non-empty string"), F.concat(F.lit("rate: "), cents_error(r["rate"])), F.when((F.coalesce(F.size(r["hoursPerWeek"]), F.lit(0)) <= 0) | hours(r), "hoursPerWeek: expected whole hours")))
    lines = listed(d["summary"], "summary", lambda s: F.array(F.when(blank(s["item"]), "item: expected a non-empty string"), F.concat(F.lit("price: "), cents_error(s["price"])), F.when(s["covers"].isNotNull() & (s["covers"] != "budget"), "covers: the only known value is budget")))
    none = F.array().cast("array<string>")
    why = F.concat(F.array_compact(F.array(*one)), F.coalesce(unknown, none), F.coalesce(roles, none), F.coalesce(lines, none))
    return whole.select("prop_id", F.explode(why).alias("why"))


def team_hours(files: DataFrame) -> DataFrame:
    """team(prop_id, role_ix, role, rate_cents, week_ix, hours) of valid data files (prop_id, raw)."""
    d = files.select("prop_id", F.from_json("raw", SCHEMA).alias("d"))
    roles = d.select("prop_id", F.posexplode("d.team").alias("role_ix", "r"))
    return roles.select("prop_id", "role_ix", F.col("r.role").alias("role"), to_cents("r.rate").alias("rate_cents"), F.posexplode("r.hoursPerWeek").alias("week_ix", "hours")).withColumn("hours", F.col("hours").cast("long"))


# --- the template language: parsed once on the driver, run as a column expression


@dataclass
class Node:
    kind: str  # text, field, presence, directive
    value: str = ""
    positive: bool = True
    args: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)


class TemplateError(ValueError):
    """Everything that is wrong with a template."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


DIRECTIVES = ("summary", "budget", "schedule", "heatmap", "annex", "clientlogo", "pagebreak", "section")
PATH = r"[A-Za-z]\w*(?:\.[A-Za-z]\w*)*"
# one alternative for each kind of tag; the last one takes whatever the others don't
TAG = re.compile(
    rf"""\{{\{{\s*(?:
        (?P<close>/[?^])
      | (?P<when>[?^])\s*(?P<of>{PATH})
      | @(?P<directive>[^\s{{}}]*)(?P<args>(?:\s+[^\s{{}}]+)*)
      | section:(?P<section>[^\n]*?)
      | (?P<path>{PATH})
      | (?P<other>[^\n]*?)
    )\s*\}}\}}""",
    re.VERBOSE,
)
ALONE = re.compile(r"^[^\S\n]*(\{\{\s*@[^\n]*?\}\})[^\S\n]*$", re.MULTILINE)
ARGUMENT = re.compile(r"([^=\s]+)=(\S*)")


def tokens(source: str):
    """(text, None) and (tag's text, its match) in turn."""
    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            yield source[at : m.start()], None
        yield m[0], m
        at = m.end()
    if at < len(source):
        yield source[at:], None


def leaf(m: re.Match, alone: set[int]) -> tuple[Node, list[str]]:
    """The node of a tag that opens and closes nothing, and what is wrong with it."""
    if m["path"]:
        return Node("field", m["path"]), []
    if m["section"] is not None:
        return Node("directive", "section", args={"name": m["section"].strip()}), []
    if m["directive"] is None:
        return Node("text"), [f"cannot read {m[0]}"]
    given = {x: ARGUMENT.fullmatch(x) for x in (m["args"] or "").split()}
    wrong = [f"{m[0]}: cannot read argument {x}" for x, ok in given.items() if not ok]
    if m.start() not in alone:
        wrong.append(f"{m[0]} must stand alone on its own line")
    if m["directive"] not in DIRECTIVES:
        wrong.append(f"unknown directive {m[0]}")
    return Node("directive", m["directive"], args=dict(ok.groups() for ok in given.values() if ok)), wrong


def parse_template(source: str) -> list[Node]:
    """{{field}}, {{?there}}..{{/?}}, {{^absent}}..{{/^}}, {{@directive k=v}} alone on its line, {{section:name}}.

    ``template = (text | leaf | open template close)*``, read by descent; everything that is wrong is reported at once.
    """
    errors: list[str] = []
    alone = {m.start(1) for m in ALONE.finditer(source)}
    stream = tokens(source)

    def sequence(end: str | None) -> tuple[list[Node], bool]:
        """Nodes up to the closing mark ``end``, and whether it came."""
        nodes: list[Node] = []
        for text, m in stream:
            if m is None:
                nodes.append(Node("text", text))
            elif m["when"]:
                inside, closed = sequence("/" + m["when"])
                nodes.append(Node("presence", m["of"], m["when"] == "?", children=inside))
                if not closed:
                    errors.append(f"{text} is not closed")
            elif m["close"]:
                if m["close"] == end:
                    return nodes, True
                errors.append(f"{text} closes no open block")
            else:
                node, wrong = leaf(m, alone)
                nodes.append(node)
                errors.extend(wrong)
        return nodes, end is None

    nodes, _ = sequence(None)
    if errors:
        raise TemplateError(errors)
    return nodes


def fill_template(nodes: list[Node], fields: dict[str, Column]) -> Column:
    """The template over rows: a text, null where a field that must be printed is absent.

    A directive becomes a paragraph ``[[k:name]]``, numbered in order, for ``splice``; a section stands
    in ``fields`` as 'sections.<name>'.
    """
    count = iter(range(10**6))

    def absent(path: str) -> Column:
        c = fields.get(path)
        return F.lit(True) if c is None else F.coalesce(c.cast("string"), F.lit("")) == ""

    def text(ns: list[Node]) -> Column:
        parts = [F.lit("")]
        for n in ns:
            if n.kind == "text":
                parts.append(F.lit(n.value))
            elif n.kind == "field":
                c = fields.get(n.value, F.lit(None).cast("string")).cast("string")
                parts.append(F.when(absent(n.value), None).otherwise(c))
            elif n.kind == "presence":
                inside = text(n.children)
                parts.append(F.when(absent(n.value) != F.lit(n.positive), inside).otherwise(""))
            elif n.value == "section":
                parts.append(fields.get("sections." + n.args["name"], F.lit(None).cast("string")))
            else:
                parts.append(F.lit(f"[[{next(count)}:{n.value}]]"))
        return F.concat(*parts)

    return text(nodes)


def directives(nodes: list[Node]) -> list[Node]:
    """All directives but sections, in order."""
    out: list[Node] = []
    for n in nodes:
        out += directives(n.children) if n.kind == "presence" else [n] if n.kind == "directive" and n.value != "section" else []
    return out


def splice(blocks: DataFrame, expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put what directives stand for in the place of their paragraphs.

    ``blocks(doc_id, block_ix, t, text, ...)`` and ``expanded(doc_id, directive_ix, sub_ix, t, text, ...)`` with the same
    further columns. The spliced blocks with sub_ix, and (doc_id, directive_ix) of directives that had no paragraph of their own.
    """
    rest = [c for c in blocks.columns if c not in ("doc_id", "block_ix")]
    mark = F.regexp_extract("text", "^\\[\\[([0-9]+):[a-z]+\\]\\]$", 1)
    tagged = blocks.withColumn("directive_ix", F.when((F.col("t") == "para") & (mark != ""), F.try_to_number(F.nullif(mark, F.lit("")), F.lit("999999")).cast("int")))
    kind = expanded.schema["sub_ix"].dataType
    plain = tagged.where("directive_ix is null").select("doc_id", "block_ix", F.lit(0).cast(kind).alias("sub_ix"), *rest)
    put = tagged.where("directive_ix is not null").select("doc_id", "block_ix", "directive_ix").join(expanded.select("doc_id", "directive_ix", "sub_ix", *rest), ["doc_id", "directive_ix"]).select("doc_id", "block_ix", "sub_ix", *rest)
    lost = expanded.select("doc_id", "directive_ix").distinct().join(tagged.where("directive_ix is not null"), ["doc_id", "directive_ix"], "left_anti")
    return plain.unionByName(put), lost
