"""Work of Python readers is dealt out over the cores, and a file that many documents name is read once."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import assembly, config, offers, pages
from paperloom.plans import made
from paperloom.sinks import writers
from paperloom.sources import archive, base, pdf


def test_one_small_file_of_documents_is_read_by_many_tasks(spark):
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = base.rows_by_document(docs, lambda doc_id, text: [{"doc_id": doc_id, "v": text}], "doc_id long, v string")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert rows.count() == 400
    assert all(0 < int(spark.conf.get(k).rstrip("b")) <= most for k, most in base.BATCH.items())


def test_nested_values_count_in_what_a_task_holds():
    assert base.weight({"rects": [{"x0": 1.0, "x1": 2.0}] * 1000}) > 1000 * 3 * base.ITEM
    assert base.weight({"t": "é" * 100, "b": b"123", "n": None}) == base.ITEM * 4 + 103


def test_rows_with_large_nested_values_go_on_early():
    one = {"doc_id": 1, "xs": list(range(50_000))}
    assert base.weight(one) * 2 > base.BYTES > base.weight(one)  # a batch holds two of them at most


def test_an_annex_that_many_proposals_name_is_read_once(spark, monkeypatch):
    book = made.workbook("Caption", ["key", "day", "priority", "status"], [(1, 45000, "high", "O")])
    data = {"template": "t.md", "kind": "k", "project": "P", "date": "d", "author": {"name": "n", "email": "e"}, "team": [{"role": "lead", "rate": 40, "hoursPerWeek": [8]}]}
    annex = lambda k: {"annex": "a.xlsx"} if k % 4 < 2 else {"annex": "b.xlsx"} if k % 4 == 2 else {}
    rows = spark.createDataFrame([(k, "p/x.proposal.json", json.dumps(data | annex(k))) for k in range(12)], "prop_id long, path string, raw string")
    files = spark.createDataFrame([("p/t.md", bytearray(b"# {{project}}\n\n{{?annex}}\n\n{{@annex}}\n\n{{/?}}\n\nend\n")), ("p/a.xlsx", bytearray(book)), ("p/b.xlsx", bytearray(b"broken"))], "path string, content binary")
    seen = []
    decode = archive.decode_workbooks
    monkeypatch.setattr(archive, "decode_workbooks", lambda f: seen.append(f.count()) or decode(f))
    got = offers.assemble(rows, files)
    assert seen == [2]
    tables = {r["doc_id"]: r["rows"] for r in got["blocks"].where("t = 'table'").collect()}
    assert sorted(tables) == [k for k in range(12) if k % 4 < 2] and all(v == tables[0] and len(v) == 1 for v in tables.values())
    refused = {r["prop_id"] for r in got["violations"].where("why like 'annex: %'").collect()}
    assert refused == {2, 6, 10}


def test_every_other_source_of_a_target_is_named(spark):
    rows = spark.createDataFrame([(f"d/{k:02}", "t") for k in range(30)] + [("d/00", "t"), ("d/x", "u")], "path string, target string")
    got = {r["path"]: r for r in config.all_others(rows).collect()}
    assert len(got) == 30 and {r["n_sources"] for r in got.values()} == {30}
    assert all(r["others"] == ", ".join(f"d/{k:02}" for k in range(30) if f"d/{k:02}" != p) for p, r in got.items())


def test_a_plain_sheet_is_one_pack_and_cleaned_where_it_is(spark, monkeypatch):
    """Formats and shared strings are looked up while a workbook is read, and what is done in its pack is what the plan over all cells does."""
    one = list(archive.packed_rows(1, made.workbook("Caption", ["key", "day", "priority", "status"], [(k, 45000 + k, "high", "O") for k in range(9)])))
    assert [r["kind"] for r in one] == ["sheet", "cells"] and one[1]["whole"] and one[1]["n_sheets"] == 1
    assert set(one[1]["num_fmt_id"]) == {0, 14, None} and one[1]["found"].count("high") == 9

    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    number = lambda ref, v, s="": f'<c r="{ref}"{s}><v>{v}</v></c>'
    shared = lambda ref, k: f'<c r="{ref}" t="s"><v>{k}</v></c>'
    table = text("B3", "name") + text("D3", "n") + shared("B4", 1) + number("D4", "1.50") + text("A6", "") + shared("B6", 7) + number("D6", "45000", ' s="1"')
    sheets = {
        "plain": table,
        "caption": text("B1", " ") + text("C2", "Of things") + '<c r="D2"/>' + table,
        "captions": text("B1", "one") + text("B2", "two") + table,
        "lonely": text("A1", "x") + text("A2", " ") + text("A4", "y"),
        "numbers": "".join(number(f"{c}{k}", k) for k in (2, 3, 5) for c in "AC"),
        "sparse head": text("A1", "h") + text("B1", "k") + '<c r="C1"/><c r="D1"/>' + "".join(number(f"{c}2", 1) for c in "ABCD"),
        "empty": text("A1", ""),
        "long": "".join(number(f"A{k}", k) for k in range(1, 202)),
        "wide": "".join(text(f"{c}1", c) for c in [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AA"]),
        "moved": text("B2", "late") + text("A1", "h") + text("B1", "k") + text("A2", "v"),
        "formula": '<c r="A1" t="b"><v>1</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="e"><v>#N/A</v></c>',
    }
    files = []
    for name, cells in sheets.items():
        files.append(made.zipped({"xl/workbook.xml": f'<workbook xmlns:r="{made.OFFICE}"><sheets><sheet name="{name}" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>", "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><t>first</t></si></sst>", "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'}))
    rows = lambda: [tuple(r.get(c.split(" ")[0]) for c in archive.WORKBOOK.replace("\n", " ").split(", ")) for k, b in enumerate(files) for r in archive.packed_rows(k, b)]
    schema = archive.WORKBOOK.replace("\n", " ")
    raw = spark.createDataFrame(rows(), schema)
    said = lambda got: [sorted(map(repr, base.kept(got[k]).collect())) for k in ("blocks", "titles", "dropped", "cells")]
    here = said(archive.decoded_blocks(raw))
    assert raw.where("whole").count() == len(sheets) - 1
    assert here == said(archive.decoded_blocks(raw.withColumn("whole", F.lit(False))))
    assert sum("t='table'" in x for x in here[0]) == len(sheets) - 3 and sum("no shared string for cell B6" in x for x in here[2]) == 3
    plan = archive.whole_sheets(raw.where("whole"), 200)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    monkeypatch.setattr(archive, "HELD", 1)  # the second shared string is found by a join
    late = spark.createDataFrame(rows(), schema)
    assert late.where("kind = 'string'").count() == len(sheets) and late.where("whole").count() < raw.where("whole").count()
    assert said(archive.decoded_blocks(late)) == here


def test_a_word_file_is_opened_once(spark, monkeypatch):
    """One package for all tables of a file: paragraphs with their atoms, definitions that can answer, media, losses and dates."""
    listed = lambda depth, ordered, *items: {"t": "list", "items": list(items), "depth": depth, "ordered": ordered, "start": 3}
    data, _ = writers.package("T", [{"t": "heading", "level": 1, "text": "H"}, listed(0, True, "a", "b"), listed(2, False, "c"), {"t": "pagebreak"}, {"t": "para", "text": "end"}])
    opened = []
    package = archive.Package
    monkeypatch.setattr(archive, "Package", lambda d: opened.append(len(d)) or package(d))
    rows = list(archive.word_rows(1, data))
    monkeypatch.undo()
    assert opened == [len(data)]
    assert ["".join(a["v"] or "" for a in r["atoms"]) for r in rows if r["tag"] == "para"] == ["T", "H", "a", "b", "c", "", "end"]
    assert sorted((r["abstract_id"], r["ilvl"]) for r in rows if r["kind"] == "level") == [("1", 0), ("1", 2), ("2", 0), ("2", 2)]

    seen = []
    made_by = archive.rows_by_document
    monkeypatch.setattr(archive, "rows_by_document", lambda *a: seen.append(a[1].__name__) or made_by(*a))
    got = archive.word_blocks(spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary"))
    blocks = [(r.t, r.items if r.t == "list" else r.text, r.start, r.depth) for r in got["blocks"].orderBy("block_ix").collect()]
    assert blocks == [("para", "T", None, None), ("heading", "H", None, None), ("list", ["a", "b"], 3, 0), ("list", ["c"], None, 2), ("pagebreak", None, None, None), ("para", "end", None, None)]
    assert seen == ["word_rows"] and got["dropped"].count() == 0


def test_a_table_large_in_rows_but_small_in_files_is_not_broadcast(spark):
    """What repeats takes a few bits a row in a file, so its size says little of what the driver would collect."""
    facts = spark.range(1_000_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    repeats = base.kept(spark.range(400_000).select((F.col("id") % 2).alias("k"), F.array(F.lit(700.0)).alias("v")))
    few = base.kept(spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    plan = lambda t: facts.join(t, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(few)
    assert "Broadcast" not in plan(repeats) and "Broadcast" not in plan(repeats.select("k", F.explode("v")))
    size = lambda v, kind: spark.range(1).select(base.held(F.expr(v), T._parse_datatype_string(kind)).alias("n")).head()["n"]
    assert size("'é'", "string") == 10 and size("cast(null as string)", "string") == 8 and size("array(1.0D, 2.0D)", "array<double>") == 32
    assert size("named_struct('a', 1L, 'b', array('xy'))", "struct<a:long,b:array<string>>") == 16 + 8 + 16 + 10 and size("map('a', 1L)", "map<string,long>") == 16 + 9 + 16 + 8


def test_large_pages_meet_their_grids_without_the_driver(spark, monkeypatch):
    """Runs and the lines of grids keep out of broadcasts, without a rule of furniture and behind semi joins too."""
    monkeypatch.setattr(base, "BROADCAST", 0)
    key = ["doc_id", "page"]
    files = spark.createDataFrame([(k, bytearray(made.pdf([[["a", "b"], ["c", "d"]]] * 2))) for k in range(3)], "doc_id long, content binary")
    rects, runs, _ = pdf.geometry(files)
    body, _ = assembly.chrome(runs, None)
    xs, ys = pages.find_grids(rects, key)
    assert xs.count() == 18 and ys.count() == 18
    for joined in (body.join(rects.select(*key), key), pages.table_cells(body, xs, ys, key), assembly.zoned(body, xs, ys), xs.groupBy(*key).count().join(runs, key)):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
