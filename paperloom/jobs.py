"""Entry points of a batch: inspect, build, proposal and doctor.

``python -m paperloom.jobs inspect FOLDER``, ``build FOLDER --to md,docx --out OUT``, ``proposal FOLDER`` and
``doctor``. Exit codes: 0 all well, 1 something failed, 2 wrong use, 3 something was refused.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks as B
from .operators import config as C
from .operators import proposals as P
from .operators import offers as O
from .sinks.writers import render
from .sources import discover as D
from .sources.base import forget, kept

WRITERS = ("md", "html", "docx")


def inspect(spark: SparkSession, folder: str, recursive: bool = False, flags: dict | None = None) -> DataFrame:
    """One row a file: status, what a build with these flags would print of it (title, date, entity), counts by kind
    of block, what was lost; and one a folder that can't be read (failed)."""
    files = D.load(spark, folder, recursive)
    settled = C.resolve(files.select("doc_id", "path"), D.load_sidecars(spark, folder, recursive), flags)
    settled = kept(settled.select("doc_id", F.col("title").alias("own_title"), "date", "entity", "above", "below", "failed"))
    got = D.read_all(files.join(settled.where("failed is null").select("doc_id"), "doc_id", "left_semi"), settled.where("above is not null or below is not null").select("doc_id", "above", "below"))
    counts = B.count_blocks(got["blocks"])
    lost = got["dropped"].groupBy("doc_id").agg(F.count_if(F.col("kind") != "advisory").alias("n_dropped"), F.max(F.when(F.col("kind") == "refused", F.col("message"))).alias("unreadable"))
    out = files.select("doc_id", "path").join(settled, "doc_id").join(got["docs"], "doc_id", "left").join(counts, "doc_id", "left").join(lost, "doc_id", "left")
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("unreadable").isNotNull(), "refused").otherwise("ok")
    out = out.withColumns({"title": F.coalesce("own_title", "title"), "status": status, "reason": F.coalesce("failed", "unreadable")}).drop("own_title", "above", "below", "failed", "unreadable")
    out = out.unionByName(failed_folders(spark, folder, recursive), allowMissingColumns=True)
    return out.withColumns({"n_dropped": F.coalesce("n_dropped", F.lit(0)), **{f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in B.KINDS}})


def told(results: DataFrame) -> DataFrame:
    """(path, line): inspected files in words."""
    words = B.understood(results.withColumnRenamed("doc_id", "_id").withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    lost = F.when(F.col("n_dropped") > 0, F.concat(F.lit("; "), F.col("n_dropped").cast("string"), F.lit(" lost"))).otherwise("")
    line = F.when(F.col("status") == "ok", F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(": "), "line", lost)).otherwise(F.concat("status", F.lit(": "), "reason"))
    return results.select("path", "status", "reason", "title", "n_dropped").join(words, "path").select("path", F.concat("path", F.lit(": "), line).alias("line"))


def failed_folders(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """A failed result (path, status, reason) for each folder that can't be read."""
    return D.unreadable(spark, folder, recursive).select(F.col("folder").alias("path"), F.lit("failed").alias("status"), F.concat(F.lit("folder can't be read: "), "reason").alias("reason"))


def build(spark: SparkSession, folder: str, formats: list[str] | None = None, theme: str | None = None, recursive: bool = False, plain: bool | None = None, out: str | None = None, **flags) -> tuple[DataFrame, DataFrame]:
    """(outputs (path, format, target, content), results: one row an input with status, reason, what was lost, targets).

    Every readable file of the folder, by its reader, with the settings file beside it. Nothing is left out without a row: settings that
    don't resolve fail their input; targets that several inputs share, documents that can't be read or break a
    rule, and formats that have no writer here refuse it. A folder that can't be read is a failed row. Further flags
    are title, date, entity, config and no_config, as `config.resolve` has them.
    """
    files = kept(D.load(spark, folder, recursive))
    settled, wanted = C.plan_build(files.select("doc_id", "path"), D.load_sidecars(spark, folder, recursive), {"formats": formats, "theme": theme, "plain": plain, **flags}, out)
    settled, wanted = kept(settled), kept(wanted)
    ready = files.join(settled.where("status = 'ok'").select("doc_id"), "doc_id", "left_semi")
    got = D.read_all(ready, settled.where("above is not null or below is not null").select("doc_id", "above", "below"))
    dropped = kept(got["dropped"])
    unreadable = dropped.where("kind = 'refused'").groupBy("doc_id").agg(F.min("message").alias("unreadable"))
    blocks = kept(got["blocks"])
    broken = B.violations(blocks).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("broken"))
    unwritable = wanted.where(~F.col("format").isin(*WRITERS)).join(settled.select("path", "doc_id"), "path").groupBy("doc_id").agg(F.concat(F.lit("no writer for "), F.array_join(F.array_sort(F.collect_set("format")), ", ")).alias("unwritable"))
    why = F.coalesce("unreadable", "broken")
    faults = kept(unreadable.join(broken, "doc_id", "full_outer").join(unwritable, "doc_id", "full_outer").withColumn("why", why))

    good = settled.where("status = 'ok'").join(faults.where("why is not null").select("doc_id"), "doc_id", "left_anti")
    titles = got["docs"].join(good.select("doc_id", F.col("title").alias("own_title"), "subtitle", F.col("theme")), "doc_id").withColumn("title", F.coalesce("own_title", "title"))
    rest = blocks.join(good.select("doc_id"), "doc_id", "left_semi")
    targets = wanted.join(good.select("path", "doc_id"), "path")
    outputs = None
    for f in WRITERS:
        made = render(f, titles, rest).join(targets.where(F.col("format") == f).select("doc_id", "path", "format", "target"), "doc_id")
        outputs = made if outputs is None else outputs.unionByName(made)
    outputs = kept(outputs.select("doc_id", "path", "format", "target", "content", "lost"))

    losses = dropped.where("kind not in ('refused', 'advisory')").select("doc_id", "message").unionByName(outputs.select("doc_id", F.explode("lost").alias("message")))
    lost = losses.groupBy("doc_id").agg(F.count("*").alias("n_lost"), F.array_sort(F.collect_set("message")).alias("lost"))
    written = outputs.groupBy("doc_id").agg(F.array_sort(F.collect_list("target")).alias("written"))
    results = settled.join(faults, "doc_id", "left").join(lost, "doc_id", "left").join(written, "doc_id", "left")
    ok = F.col("status") == "ok"
    results = results.withColumns({"reason": F.when(ok, F.coalesce("why", "unwritable")).otherwise(F.col("reason")), "status": F.when(ok & F.coalesce("why", "unwritable").isNotNull(), "refused").otherwise(F.col("status"))})
    results = results.select("path", "status", "reason", "has_sidecar", "n_lost", "lost", "written").unionByName(failed_folders(spark, folder, recursive), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    defaults = {"has_sidecar": F.coalesce("has_sidecar", F.lit(False)), "n_lost": F.coalesce("n_lost", F.lit(0)), "lost": F.coalesce("lost", none), "written": F.coalesce("written", none)}
    return outputs.select("path", "format", "target", "content"), results.withColumns(defaults)


def summary(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a batch in one row: its exit code, how many of each status, how many settings files; what was lost: a row a
    message with how often and in which documents). The one row is a sum of partial sums; nothing is gathered."""
    counts = [F.count_if("has_sidecar").alias("n_sidecars"), F.count_if(F.col("status") == "own output").alias("n_own_outputs")]
    totals = C.exit_code(results, []).crossJoin(results.agg(*counts))  # one row each
    return totals, C.group_messages(results.select(C.stem("path").alias("file"), F.explode("lost").alias("message")))


def proposals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(one row a proposal: weeks, roles, total; violations) of a folder of JSON data files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    raw = files.select(F.xxhash64("path").alias("prop_id"), F.decode("content", "UTF-8").alias("raw"))
    bad = P.data_violations(raw)
    good = raw.join(bad.select("prop_id").distinct(), "prop_id", "left_anti")
    return P.inspect(P.team_hours(good), ["prop_id"]), bad


def propose(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (doc_id, path, stem, title), their blocks, what refuses a proposal (path, why)) of a folder's
    *.proposal.json files, with the template, annex and logo that each names by a path beside it."""
    read = lambda pattern: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = read("*")
    data = read("*.proposal.json").select(F.xxhash64("path").alias("prop_id"), "path", F.decode("content", "UTF-8").alias("raw"))
    made = O.assemble(data, files.select("path", "content"))
    docs = made["docs"].join(data.select(F.col("prop_id").alias("doc_id"), "path"), "doc_id").select("doc_id", "path", C.proposal_stem("path").alias("stem"), "title")
    return docs, made["blocks"], made["violations"].join(data.select("prop_id", "path"), "prop_id").select("path", "why")


def doctor(spark: SparkSession) -> DataFrame:
    """What the environment has, with what to do where something is missing."""
    rows = [("spark", spark.version, int(spark.version.split(".")[0]) >= 4, "use Spark 4 or later")]
    rows += [(m, "", importlib.util.find_spec(m) is not None, f"install {m} on driver and executors") for m in ("pyarrow", "pandas", "numpy")]
    return spark.createDataFrame(rows, "name string, found string, ok boolean, fix string")


def parser() -> argparse.ArgumentParser:
    """The commands and their flags; what isn't known, or lacks a value, is wrong use (exit code 2)."""
    top = argparse.ArgumentParser(prog="paperloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    formats = lambda text: [f.strip() for f in text.split(",") if f.strip()]

    def command(name: str, *flags: str, folder: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, allow_abbrev=False)
        if folder:
            p.add_argument("folder")
        for f in flags:
            if f in ("--recursive", "--plain-names", "--json"):
                p.add_argument(f, action="store_true", default=None)
            elif f == "--to":
                p.add_argument(f, action="extend", type=formats)
            elif f == "--config":
                one = p.add_mutually_exclusive_group()
                one.add_argument(f)
                one.add_argument("--no-config", action="store_true", default=None)
            else:
                p.add_argument(f)
        return p

    command("build", "--to", "--theme", "--out", "--title", "--date", "--entity", "--plain-names", "--recursive", "--config").add_argument("place", nargs="?")
    command("inspect", "--theme", "--json", "--recursive", "--title", "--date", "--entity", "--config")
    command("proposal", "--to", "--theme", "--out")
    command("doctor", folder=False)
    return top


def flags_of(a: argparse.Namespace, spark: SparkSession) -> dict:
    """The flags that decide settings; a named settings file is read."""
    out = {k: getattr(a, k, None) for k in ("theme", "title", "date", "entity", "no_config")}
    if getattr(a, "config", None):
        out["config"] = D.read_text(spark, a.config)
    return {k: v for k, v in out.items() if v is not None}


def main(args: list[str]) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.getOrCreate()
    try:
        return run(spark, a)
    finally:
        forget(spark)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """A command's exit code, its output printed or written."""
    if a.command == "doctor":
        checks = doctor(spark).collect()
        for c in checks:
            print(f"{'ok  ' if c.ok else 'MISS'} {c.name} {c.found}{'' if c.ok else ': ' + c.fix}")
        return 0 if all(c.ok for c in checks) else 1
    if a.command == "inspect":
        result = kept(inspect(spark, a.folder, bool(a.recursive), flags_of(a, spark)))
        if a.json:
            for line in result.toJSON().toLocalIterator():
                print(line)
        else:
            for r in told(result).orderBy("path").toLocalIterator():
                print(r["line"])
        return C.exit_code(result, []).first()["exit_code"]
    if a.command == "proposal":
        return offer(spark, a)
    place = a.out or a.place
    if not place:
        print("say where the outputs go: --out", file=sys.stderr)
        return 2
    flags = flags_of(a, spark)
    outputs, results = build(spark, a.folder, a.to, flags.pop("theme", None), bool(a.recursive), a.plain_names, place, **flags)
    if not results.limit(1).count():
        print(f"no readable input in {a.folder}", file=sys.stderr)
        return 2
    outputs.write.mode("overwrite").parquet(place)
    results = kept(results)
    for line in results.toJSON().toLocalIterator():
        print(line)
    totals, lost = summary(results)
    for line in lost.orderBy("message").toJSON().toLocalIterator():
        print(line)
    return totals.first()["exit_code"]


def offer(spark: SparkSession, a: argparse.Namespace) -> int:
    """Proposals of a folder: printed, and written in the formats asked for that have a writer."""
    docs, blocks, bad = propose(spark, a.folder)
    docs, bad = kept(docs), kept(bad)
    for table in (docs, bad):
        for line in table.toJSON().toLocalIterator():
            print(line)
    unknown = [f for f in a.to or () if f not in WRITERS]
    if unknown:
        print(f"no writer for {', '.join(unknown)}", file=sys.stderr)
        return 3
    if a.out:
        named = docs.withColumns({"subtitle": F.lit(None).cast("string"), "theme": F.lit(a.theme or C.DEFAULT_THEME)})
        outputs = None
        for f in a.to or ("md",):
            made = render(f, named, blocks).join(named.select("doc_id", "path", F.concat_ws(".", "stem", "theme", F.lit(f)).alias("target")), "doc_id").select("path", F.lit(f).alias("format"), "target", "content")
            outputs = made if outputs is None else outputs.unionByName(made)
        outputs.write.mode("overwrite").parquet(a.out)
    return 3 if bad.limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
