import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import blocks as B
from paperloom.operators import config as C
from paperloom.operators import numbering as N
from paperloom.operators import pages as P
from paperloom.operators import proposals as O
from paperloom.operators import render as R
from paperloom.operators import sheets as S
from paperloom.operators import widths as W


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- blocks


def test_title_is_lifted_and_jumps_found(spark):
    docs = spark.createDataFrame([(1, "# Title\n\ntext\n\n## A\n\n##### deep\n\n---"), (2, "plain"), (3, "## only\n\n#### deeper")], "doc_id long, text string")
    blocks = B.split_blocks(docs)
    titles, rest = B.lift_title(blocks)
    assert rows(titles, "doc_id") == [(1, "Title"), (2, "Untitled"), (3, "Untitled")]
    got = {r.doc_id: (r.n_heading, r.n_para, r.n_rule, r.n_tokens, r.n_warnings) for r in B.inspect(blocks).collect()}
    assert got == {1: (2, 1, 1, 3, 0), 2: (0, 1, 0, 1, 1), 3: (2, 0, 0, 2, 1)}
    jump = spark.createDataFrame([(1, 0, "heading", 1, "a"), (1, 1, "heading", 3, "b")], "doc_id long, block_ix int, t string, level int, text string")
    assert rows(B.heading_jumps(jump)) == [(1, 2, 1, 3, "b")]


def test_cover_zones(spark):
    kinds = {1: ["para", "rule", "para", "rule", "para"], 2: ["para", "rule", "para"], 3: ["para", "pagebreak", "para"]}
    df = spark.createDataFrame([(d, k, t) for d, ts in kinds.items() for k, t in enumerate(ts)], "doc_id long, block_ix int, t string")
    zones = {(r.doc_id, r.block_ix): r.zone for r in B.cover_zones(df).collect()}
    assert [zones[1, k] for k in range(5)] == ["panel", None, "flowing", None, "foot"]
    assert [zones[2, k] for k in range(3)] == ["panel", None, "flowing"]
    assert [r.part for r in B.split_at_pagebreak(df).where("doc_id = 3").orderBy("block_ix").collect()] == ["page", "rest", "rest"]


def test_divergence(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["a"]), (3, ["q"]), (4, []), (5, ["only"])], "doc_id long, tokens array<string>")
    b = spark.createDataFrame([(1, ["x", "z"]), (2, ["a", "more"]), (3, ["q"]), (4, []), (6, ["new"])], "doc_id long, tokens array<string>")
    assert rows(B.first_divergence(a, b), "doc_id") == [(1, 1, "y", "z"), (2, 1, None, "more"), (5, 0, "only", None), (6, 0, None, "new")]
    blocks = spark.createDataFrame([(1, 1, "para", "c d"), (1, 0, "heading", "a b"), (1, 2, "rule", None), (2, 0, "pagebreak", None)], "doc_id long, block_ix int, t string, text string")
    assert rows(B.doc_tokens(blocks), "doc_id") == [(1, ["a", "b", "c", "d"]), (2, [])]


def scans(df):
    """How many times a plan reads files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_plans_read_their_table_once(spark):
    """Counted on the optimised plan: inventory, renumbering and round trip in one scan, repeats in two (clusters, then runs)."""
    from paperloom.plans import documents, geometry

    d = "/root/testdata/sf0.001"
    for query, most in ((documents.q01_block_counts, 1), (documents.q46_markdown_round_trip, 1), (documents.q03_first_divergence, 2), (geometry.q31_numbering, 1), (geometry.q23_repeated, 2)):
        assert scans(query(spark, d)) <= most, query.__name__


# --- sheets


def sheet(spark, table, numeric=()):
    cells = [(1, r, c, v, (r, c) in numeric) for r, row in enumerate(table) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "k int, row long, col int, text string, is_numeric boolean")


def test_cleaning_in_order(spark):
    cells = sheet(spark, [["", "", ""], ["", "Caption", ""], ["", "Name", "Role"], ["", "", ""], ["", "Ann", "Lead"]])
    c = S.trim_leading_rows(S.drop_empty_columns(cells, ["k"]), ["k"])
    assert c.agg(F.min("row"), F.max("col")).first() == (1, 1)
    parts = S.lift_preamble(c, ["k"])
    assert {r.row for r in parts.where("part = 'preamble'").collect()} == {1}
    assert {r.row for r in parts.where("part = 'table'").collect()} == {2, 3, 4}  # a blank row inside stays


def test_headers(spark):
    cells = sheet(spark, [["Item", "1"], ["Name", "Role"], ["x", ""]], {(0, 1)})
    assert [r.is_header for r in S.header_rows(cells, ["k"]).orderBy("row").collect()] == [False, True, False]


def test_ranges_and_dates(spark):
    df = spark.createDataFrame([("A1:B2",), ("AB10:AC11",), ("A1",), ("1:2",)], "ref string").select(S.parse_range("ref").alias("m"))
    assert [None if r.m is None else tuple(r.m) for r in df.collect()] == [(0, 0, 1, 1), (9, 27, 10, 28), None, None]
    d = spark.createDataFrame([(45107.0, False), (45107.5, False), (43645.0, True), (60.0, False), (1.9999999, False)], "s double, f boolean")
    assert [r[0] for r in d.select(S.serial_to_text("s", "f")).collect()] == ["2023-06-30", "2023-06-30 12:00", "2023-06-30", "1900-02-28", "1899-12-31 23:59"]
    codes = spark.createDataFrame([(14, None), (164, "dd/mm/yyyy"), (164, '"day" 0'), (2, None), (165, "[$-409]0")], "i int, c string")
    assert [r[0] for r in codes.select(S.is_date_format("i", "c")).collect()] == [True, True, False, False, False]


def test_refusals(spark):
    big = spark.createDataFrame([(1, 0, 0, "a"), (1, 300, 0, "b"), (2, 0, 0, ""), (3, 0, 0, "x")], "k int, row long, col int, text string")
    assert {r.k: r.status for r in S.refusals(big, ["k"]).collect()} == {1: "refused", 2: "empty", 3: "ok"}


# --- pages


def boxes(spark, rects):
    return spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(rects)], "page int, rect_ix int, x0 double, y0 double, x1 double, y1 double")


def test_grid_of_boxed_cells(spark):
    xs, ys = (50, 200, 400), (700, 720, 740, 760)
    rects = boxes(spark, [(xs[i], ys[j], xs[i + 1], ys[j + 1]) for i in range(2) for j in range(3)])
    gx, gy = P.find_grids(rects, ["page"])
    assert [r.value for r in gx.orderBy("ix").collect()] == [50, 200, 400]
    assert [r.value for r in gy.orderBy("ix").collect()] == [700, 720, 740, 760]


def test_no_grid(spark):
    for rects in ([(10, 10, 100, 11), (10, 200, 100, 201), (10, 400, 100, 401)], [(10, 10, 20, 20)]):
        gx, _ = P.find_grids(boxes(spark, rects), ["page"])
        assert gx.count() == 0


def test_grid_does_not_depend_on_order(spark):
    rnd = random.Random(2)
    rects = [(50 + 60 * i, 600 + 20 * j, 110 + 60 * i, 620 + 20 * j) for i in range(3) for j in range(4)]
    want = None
    for _ in range(3):
        rnd.shuffle(rects)
        got = [tuple(r) for d in P.find_grids(boxes(spark, rects), ["page"]) for r in d.orderBy("ix").collect()]
        want = want or got
        assert got == want


def test_components_agree_with_brute_force(spark):
    rnd = random.Random(7)
    data = [(p, p * 1000 + k, x := rnd.randrange(40) * 3.0, y := rnd.randrange(30) * 3.0, x + rnd.choice((3, 9, 12)), y + rnd.choice((3, 9, 12))) for p in range(12) for k in range(rnd.choice((1, 5, 40)))]
    df = spark.createDataFrame(data, "page int, rect_ix int, x0 double, y0 double, x1 double, y1 double")
    got = {r.rect_ix: r.component for r in P.components(df, ["page"]).collect()}
    root = {d[1]: d[1] for d in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in data:
        for b in data:
            if a[0] == b[0] and a[1] < b[1] and P.touching(np.array([a[2:]]), np.array([b[2:]]))[0]:
                i, j = find(a[1]), find(b[1])
                root[max(i, j)] = min(i, j)
    assert got == {i: find(i) for i in root}


def test_clusters_are_anchored(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 1.5, 3.0, 3.0, 10.0)], "k int, v double")
    assert rows(P.cluster_means(df, ["k"], "v"), "v") == [(1, 0.0, 0.75), (1, 1.5, 0.75), (1, 3.0, 3.0), (1, 10.0, 10.0)]


def test_anchors_of_many_keys_and_batches(spark):
    rnd = random.Random(6)
    data = [(k, rnd.choice((None, rnd.random() * 40, float(rnd.randrange(30))))) for k in [None, *range(30)] for _ in range(rnd.choice((0, 1, 7, 90, 400)))]
    want = set()
    for k in {k for k, _ in data}:
        a = None
        for v in sorted({v for i, v in data if i == k and v is not None}):
            a = v if a is None or v - a > 2.0 else a
            want.add((k, v, a))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("10000", "13"):
            spark.conf.set(name, size)
            got = P.anchored(spark.createDataFrame(data, "k int, v double"), ["k"], "v", 2.0).collect()
            assert {tuple(r) for r in got if r.v is not None} == want and len(got) == len(data)
            assert all(r.anchor is None for r in got if r.v is None)
    finally:
        spark.conf.set(name, before)


def test_a_key_with_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") * 0.75).alias("value"), F.col("id").alias("rect_ix"))
    got = P.cluster_edges(df, ["k"]).agg(F.count("*"), F.min("n_rects"), F.max("n_rects"), F.max("anchor")).first()
    assert tuple(got) == (333_334, 1, 3, 999_999 * 0.75)


def run(page, ix, text, x, y):
    return (1, page, ix, text, float(x), float(y), 10.0)


RUN = "doc int, page int, run_ix int, text string, x double, y double, size_pt double"


def test_repeated_furniture(spark):
    runs = [run(p, k, t, x, y) for p in (1, 2) for k, (t, x, y) in enumerate([("Letterhead", 50, 800), (f"{p} / 2", 400 + p, 20), (f"body {'ab'[p - 1]}", 50, 400)])]
    got = P.find_repeated(spark.createDataFrame(runs, RUN), ["doc"]).orderBy(F.desc("y_top")).collect()
    assert [r.texts for r in got] == [["Letterhead"], ["1 / 2", "2 / 2"]]
    one = spark.createDataFrame([r for r in runs if r[1] == 1], RUN)
    assert P.find_repeated(one, ["doc"]).count() == 0


def test_table_cells_and_reading_order(spark):
    line = lambda vs: spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(vs)], "page int, ix int, value double")
    runs = [("b", 12, 51), ("a", 5, 52), ("edge", 20, 45), ("low", 3, 15)]
    df = spark.createDataFrame([(1, k, t, float(x), float(y)) for k, (t, x, y) in enumerate(runs)], "page int, run_ix int, text string, x double, y double")
    got = {(r.row, r.col): r.text for r in P.table_cells(df, line((0, 20, 40)), line((0, 20, 40, 60)), ["page"]).collect()}
    assert got == {(0, 0): "a b", (0, 1): "edge", (1, 0): "", (1, 1): "", (2, 0): "low", (2, 1): ""}


def test_heading_levels_break_ties_by_first_seen(spark):
    runs = [(1, k, "t", 0.0, 0.0, s) for k, s in enumerate((10.0, 12.0, 12.0, 10.0, 18.0, 24.0, 30.0, 36.0))]
    df = spark.createDataFrame(runs, "doc int, run_ix int, text string, x double, y double, size_pt double")
    assert {r.half_pt: r.level for r in P.heading_levels(df, ["doc"]).collect()} == {72: 1, 60: 2, 48: 3, 36: 3, 24: 3}


def test_chrome_is_strict(spark):
    df = spark.createDataFrame([(1, 1, 700.0), (1, 1, 701.0), (1, 2, 50.0), (1, 2, 49.0)], "doc int, page int, y double")
    s = P.split_chrome(df, F.lit(700.0), F.lit(50.0))
    assert [r.removed for r in s.orderBy("y").collect()] == [True, False, False, True]


# --- numbering


def counter(items, rules, starts):
    """The sequential counter of lists: a shallower item resets deeper levels unless their rule forbids it."""
    live, out = {}, []
    for num, lvl in items:
        for key in list(live):
            n, d = key
            if n == num and d > lvl:
                r = rules.get((n, d))
                if r is None or (r > 0 and lvl < r):
                    del live[key]
        live[num, lvl] = live.get((num, lvl), starts[num, lvl] - 1) + 1
        out.append(live[num, lvl])
    return out


def test_numbers_equal_a_sequential_counter(spark):
    rnd = random.Random(11)
    data, want = [], {}
    for doc in range(40):
        rules = {(n, d): rnd.choice((None, None, 0, 1, 2)) for n in "12" for d in range(4)}
        starts = {(n, d): rnd.choice((1, 1, 5)) for n in "12" for d in range(4)}
        items = [(rnd.choice("12"), rnd.randrange(4)) for _ in range(30)]
        for k, (i, number) in enumerate(zip(items, counter(items, rules, starts), strict=True)):
            data.append((doc, k, *i, starts[i], rules[i]))
            want[doc, k] = number
    df = spark.createDataFrame(data, "doc_id int, para_ix int, num_id string, ilvl int, start int, lvl_restart int")
    assert {(r.doc_id, r.para_ix): r.number for r in N.item_numbers(df).collect()} == want


def test_islands_and_merging(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate("aabba")], "d int, ix int, t string")
    assert [(r.path, r.t) for r in N.merge_adjacent(df, ["d"], "ix", F.col("t"), "t").orderBy("ix").collect()] == [("a", "aa"), ("b", "bb"), ("a", "a")]


# --- widths


def test_widths_add_up_and_protect_short_columns():
    demand, longest = [7, 9, 30, 8, 5, 20, 6], [7, 12, 60, 8, 6, 30, 7]
    got = W.solve(demand, longest, False, 9978, 8.0)
    assert sum(got) == 9978
    assert all(g >= int((12 + max(4, min(x, 12)) * 4.4) * 20) - 1 for g, x in zip(got, longest, strict=True))


@pytest.mark.parametrize("seed", range(20))
def test_filling_adds_up(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 12)
    demand = [rnd.choice((0, 3, 10, 200)) for _ in range(n)]
    assert sum(W.fill(9000, demand, [rnd.choice((300, 700, 1600)) for _ in range(n)])) == 9000


def test_fill_clamps_the_worst_violator_first():
    # by hand: 6000 in shares of 100:10:10:10 is 4615, 462, 462, 462; the first is furthest beyond (2700), the rest share 3300
    assert W.fill(6000, [100, 10, 10, 10], [500, 500, 500, 500]) == [2700, 1100, 1100, 1100]
    # 1000 in shares of 50:1:1:1 is 943, 19, 19, 19; the first goes to 1000 - 3 * 200 = 400
    assert W.fill(1000, [50, 1, 1, 1], [200, 200, 200, 200]) == [400, 200, 200, 200]
    # two columns have no ceiling; the small one gets its floor
    assert W.fill(1000, [99, 1], [100, 100]) == [900, 100]
    # floors that leave a column less than the ceiling bound it
    assert W.fill(1000, [90, 5, 5], [100, 300, 400]) == [300, 300, 400]


def test_widths_of_many_tables(spark):
    """The array expression against the loop, for tables of one to eleven columns."""
    rnd = random.Random(8)
    cells, want = [], {}
    for k in range(150):
        n = rnd.randrange(1, 12)
        blank = rnd.random() < 0.2
        grid = [["" if blank else "h" * rnd.choice((0, 3, 20)) for _ in range(n)]] + [["x" * rnd.choice((0, 1, 5, 14, 60, 300)) for _ in range(n)] for _ in range(rnd.randrange(1, 5))]
        cells += [(k, r, c, t) for r, row in enumerate(grid, -1) for c, t in enumerate(row)]
        columns = list(zip(*grid, strict=True))
        demand = [max(len(c[0]), float(np.percentile([len(x) for x in c[1:]], 75))) for c in columns]
        want[k] = W.solve(demand, [max(map(len, c)) for c in columns], all(not c[0].strip() for c in columns), 9978, 10.0)
    got = {}
    for r in W.column_widths(spark.createDataFrame(cells, "k int, row_ix int, col_ix int, text string"), ["k"], 9978).orderBy("k", "col_ix").collect():
        got.setdefault(r.k, []).append(r.width)
    assert got == want and all(sum(w) == 9978 for w in got.values())


def test_fill_without_demand_and_with_floors_that_do_not_fit():
    assert W.fill(900, [0, 0, 0], [10, 10, 10]) == [300, 300, 300]
    assert W.fill(100, [1, 3], [90, 90]) == [25, 75]
    assert W.fill(1000, [0, 0, 9], [100, 100, 100]) == [275, 275, 450]
    assert W.fill(1000, [5], [100]) == [1000]


def test_largest_remainder_ties_go_left():
    assert W.largest_remainder([1.5, 1.5, 2.0], 5) == [2, 1, 2]
    assert W.fill(100, [1, 1], [0, 0]) == [50, 50]


def test_key_value_hugs_the_left(spark):
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate([[" ", ""], ["Proposal No.", "12"]], -1) for c, t in enumerate(row)], "k int, row_ix int, col_ix int, text string")
    got = [r.width for r in W.column_widths(cells, ["k"], 9978).orderBy("col_ix").collect()]
    assert got == [int((12 + 12 * 5.5) * 20), 9978 - int((12 + 12 * 5.5) * 20)]


# --- proposals


def team(spark):
    hours = [("Lead", 4500, [4, 16, 0]), ("Dev", 4500, [40, 40, 0])]
    return spark.createDataFrame([(1, k, r, c, w, h) for k, (r, c, hs) in enumerate(hours) for w, h in enumerate(hs)], "p int, role_ix int, role string, rate_cents long, week_ix int, hours long")


def test_budget(spark):
    got = [(r.role, r.cents, r.amount.replace("\u00a0", " ")) for r in O.budget_table(team(spark), ["p"]).orderBy("role_ix").collect()]
    assert got == [("Lead", 90000, "€ 900,00"), ("Dev", 360000, "€ 3 600,00"), ("TOTAL", 450000, "€ 4 500,00")]
    claim = spark.createDataFrame([(1, "all", "budget", 450001)], "p int, item string, covers string, price_cents long")
    assert [(r.claimed_cents, r.computed_cents) for r in O.covers_check(claim, team(spark), ["p"]).collect()] == [(450001, 450000)]


def test_template(spark):
    nodes = O.parse_template("Hi {{name}}{{?city}} of {{city}}{{/?}}{{^city}}!{{/^}}\n\n{{@budget}}\n\n{{section:s}}")
    df = spark.createDataFrame([("Ann", "Rome"), ("Bo", ""), (None, "X")], "n string, c string")
    got = [r[0] for r in df.select(O.fill_template(nodes, {"name": F.col("n"), "city": F.col("c"), "sections.s": F.lit("S")})).collect()]
    assert got == ["Hi Ann of Rome\n\n[[0:budget]]\n\nS", "Hi Bo!\n\n[[0:budget]]\n\nS", None]
    assert [n.value for n in O.directives(nodes)] == ["budget"]


def test_template_reports_all_errors():
    with pytest.raises(O.TemplateError) as e:
        O.parse_template("{{?a}} {{@budget}} x {{1}} {{/^}} {{@nope}}")
    assert len(e.value.errors) >= 5


def test_splice(spark):
    b = spark.createDataFrame([(1, 0, "para", "x"), (1, 1, "para", "[[0:budget]]"), (2, 0, "para", "see [[0:budget]]")], "doc_id long, block_ix int, t string, text string")
    e = spark.createDataFrame([(1, 0, 0, "table", "T"), (2, 0, 0, "table", "T")], "doc_id long, directive_ix int, sub_ix int, t string, text string")
    done, lost = O.splice(b, e)
    assert [(r.block_ix, r.t) for r in done.where("doc_id = 1").orderBy("block_ix").collect()] == [(0, "para"), (1, "table")]
    assert rows(lost) == [(2, 0)]


def test_data_violations(spark):
    good = '{"template":"t","kind":"k","project":"p","date":"d","author":{"name":"n","email":"e"},"team":[{"role":"r","rate":45,"hoursPerWeek":[1,2]}]}'
    bad = '{"template":"","kind":"k","project":"p","date":"d","x":1,"currency":"USD","author":{"name":"n"},"team":[{"role":"r","rate":1.234,"hoursPerWeek":[1]},{"role":"s","rate":1,"hoursPerWeek":[1,2.5]}],"summary":[{"item":"a","price":1,"covers":"budget"},{"item":"b","price":2,"covers":"budget"}]}'
    got = {}
    for r in O.data_violations(spark.createDataFrame([(1, good), (2, bad), (3, "[1]")], "prop_id long, raw string")).collect():
        got.setdefault(r.prop_id, set()).add(r.why)
    assert set(got) == {2, 3}
    assert got[2] == {"template is required", "unknown key x", "currency: only EUR is known", "author.email: expected a non-empty string", "every hoursPerWeek must cover the same weeks", "team[0].rate: more than two decimals", "team[1].hoursPerWeek: expected whole hours", 'summary: 2 lines claim covers:"budget"'}


# --- configuration


def test_names_and_collisions(spark):
    df = spark.createDataFrame([("d/a.md",), ("d/a.docx",), ("d/b.plain.pdf",), ("d/c.txt",), ("d/E.XLSX",)], "path string")
    good, own = C.readable(df, "plain")
    assert {r.path for r in good.collect()} == {"d/a.md", "d/a.docx", "d/E.XLSX"}
    assert {r.path for r in own.collect()} == {"d/b.plain.pdf"}
    t = C.targets(good, F.array(F.lit("pdf")), F.lit("plain"), F.lit(False))
    classes, members = C.collisions(t)
    assert rows(classes, "target") == [("a.plain.pdf", 2, ["d/a.docx", "d/a.md"])]
    assert rows(members.select("path", C.others(F.col("path"))), "path") == [("d/a.docx", "d/a.md"), ("d/a.md", "d/a.docx")]
    assert [r[0] for r in df.select(C.sidecar_path("path")).collect()][:1] == ["d/a.settings.json"]
    p = spark.createDataFrame([("x/o.proposal.json",)], "path string")
    assert p.select(C.proposal_stem("path")).first()[0] == "o"


def test_a_target_of_very_many_sources_stays_linear(spark):
    df = spark.range(100_000).select(F.format_string("in/%06d/x.md", "id").alias("path"), F.lit("x.pdf").alias("target"))
    classes, members = C.collisions(df.unionByName(df.limit(10)))
    one = classes.first()
    assert (one.n_sources, len(one.first_sources), classes.count()) == (100_000, 21, 1)
    told = members.select("path", C.others(F.col("path")).alias("o")).agg(F.count("*"), F.max(F.length("o")), F.min("o")).first()
    assert told[0] == 100_000 and told[1] < 400 and told[2].startswith("in/000000/x.md, in/000001") and told[2].endswith(" …and 99979 more")


def test_messages_name_the_first_files_and_count_all(spark):
    rows_ = [("m", f"f{k:03}") for k in range(30) for _ in range(2)] + [("n", "a"), (None, "b"), ("m", None), ("o", None)]
    got = {r.message: (r.n, r.files) for r in C.group_messages(spark.createDataFrame(rows_, "message string, file string")).collect()}
    assert got["m"] == (60, ", ".join(f"f{k:03}" for k in range(10) for _ in range(2)) + " …and 40 more")
    assert got["n"] == (1, "a") and got[None] == (1, "b") and set(got) == {"m", "n", None}
    # rows beyond the first are dropped before and after the exchange
    plan = C.group_messages(spark.createDataFrame(rows_, "message string, file string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_exit_codes_and_listing(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "refused"), ("b", "failed"), ("b", "refused"), ("c", "ok")], "k string, status string")
    assert {r.k: r.exit_code for r in C.exit_code(df, ["k"]).collect()} == {"a": 3, "b": 1, "c": 0}
    many = spark.range(1).select(C.listed(F.transform(F.sequence(F.lit(1), F.lit(23)), lambda x: x.cast("string"))))
    assert many.first()[0].endswith("20 …and 3 more")


def test_sidecar_violations(spark):
    df = spark.createDataFrame([("a", '{"title":1,"to":["pdf","svg"],"zz":0}'), ("b", "nonsense"), ("c", '{"title":"t","plainNames":true}')], "path string, raw string")
    got = {}
    for r in C.sidecar_violations(df).collect():
        got.setdefault(r.path, set()).add(r.why)
    assert got == {"a": {"title: expected string", "to: unknown format svg", "unknown key zz"}, "b": {"the settings file must hold one JSON object"}}


# --- rendering


def test_cells_and_fences(spark):
    df = spark.createDataFrame([("a|b\nc", "x```y`")], "c string, t string")
    assert tuple(df.select(R.cell("c"), R.fence("t")).first()) == ("a\\|b c", "````")


def test_spans(spark):
    node = lambda t, n, href=None: {"t": t, "href": href, "node": n}
    kind = "spans array<struct<v:string,path:array<struct<t:string,href:string,node:int>>>>"
    spans = [{"v": "a", "path": []}, {"v": "b", "path": [node("strong", 1)]}, {"v": "c", "path": [node("strong", 1), node("em", 2)]}, {"v": "d", "path": [node("strong", 3)]}, {"v": "x", "path": [node("link", 4, "javascript:x")]}, {"v": "y", "path": [node("link", 5, "u")]}]
    df = spark.createDataFrame([(spans,)], kind)
    assert df.select(R.spans_markdown(F.col("spans"))).first()[0] == "a**b*c*****d**x (javascript:)[y](u)"
    assert df.select(R.spans_html(F.col("spans"))).first()[0] == 'a<strong>b<em>c</em></strong><strong>d</strong>x <span class="muted">(javascript:)</span><a href="u">y</a>'
