"""Settings by precedence, batch targets and what collides, summaries of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

# fixed values: readable endings, output formats, defaults, how many a listing names
READABLE = (".md", ".markdown", ".docx", ".xlsx", ".pdf")
FORMATS = ("pdf", "md", "docx")
DEFAULT_THEME, DEFAULT_TO = "plain", "pdf"
LISTED = 20
SIDECAR_KEYS = ("title", "subtitle", "date", "entity", "theme", "to", "plainNames", "pdfChrome")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), "(\\.[^./\\\\]+)$", 1))


def stem(path) -> Column:
    """The file's name without folder and ending."""
    return F.regexp_replace(F.regexp_extract(col(path), "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]+$", "")


def proposal_stem(path) -> Column:
    return F.regexp_replace(stem(path), "(?i)\\.proposal$", "")


def sidecar_path(path, suffix: str = "settings") -> Column:
    """The path of an input's settings file: its ending replaced by .<suffix>.json."""
    return F.concat(F.regexp_replace(col(path), "\\.[^./]+$", ""), F.lit(f".{suffix}.json"))


def readable(inputs: DataFrame, theme: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(inputs to read, own earlier output): by ending, and by a stem that ends in the theme's name."""
    known = inputs.where(extension("path").isin(*READABLE))
    own = F.endswith(stem("path"), F.lit("." + theme)) if theme else F.lit(False)
    return known.where(~own), known.where(own)


def precedence(flag: Column, sidecar: Column, document: Column, default) -> Column:
    """The first that is set: flag, settings file, document, default."""
    return F.coalesce(flag, sidecar, document, F.lit(default) if not isinstance(default, Column) else default)


def unknown_keys(json, known=SIDECAR_KEYS) -> Column:
    """Keys of a JSON object that aren't known; null if it isn't an object."""
    return F.array_except(F.json_object_keys(col(json)), F.lit(list(known)))


def unknown_formats(formats) -> Column:
    return F.array_except(col(formats), F.lit(list(FORMATS)))


def sidecar_violations(files: DataFrame) -> DataFrame:
    """(path, why) for settings files (path, raw) that aren't an object, have unknown keys or wrong types."""
    v = F.try_parse_json("raw")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    wrong = lambda k, want: F.when(kind(k).isNotNull() & ~F.startswith(kind(k), F.lit(want)), F.lit(f"{k}: expected {want.lower()}"))
    checks = [wrong(k, "STRING") for k in ("title", "subtitle", "date", "entity", "theme")]
    checks += [wrong("to", "ARRAY"), wrong("plainNames", "BOOLEAN"), wrong("pdfChrome", "OBJECT")]
    formats = F.transform(unknown_formats(F.from_json(F.get_json_object("raw", "$.to"), "array<string>")), lambda f: F.concat(F.lit("to: unknown format "), f))
    keys = F.transform(unknown_keys("raw"), lambda k: F.concat(F.lit("unknown key "), k))
    none = F.array().cast("array<string>")
    why = F.when(F.json_object_keys("raw").isNull(), F.array(F.lit("the settings file must hold one JSON object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), F.coalesce(keys, none), F.coalesce(formats, none)))
    return files.select("path", F.explode(why).alias("why"))


def targets(inputs: DataFrame, formats: Column, theme: Column, plain_names: Column) -> DataFrame:
    """inputs (path) by format with ``target``, the output's name."""
    rows = inputs.withColumns({"_theme": theme, "_plain": plain_names}).withColumn("format", F.explode(formats))
    name = F.concat_ws(".", stem("path"), F.when(~F.col("_plain"), F.col("_theme")), F.col("format"))
    return rows.withColumn("target", name).drop("_theme", "_plain")


def first_values(rows: DataFrame, key: list[str], value: str, n: int = LISTED) -> DataFrame:
    """(key..., n_all, firsts): how many rows a key has, and the n least of its values in order.

    Both are bounded before they move: counts are added up and all but n rows of a key dropped within each
    partition, and again behind the exchange. A null key is a key, null values are neither counted nor listed.
    """
    some = rows.where(F.col(value).isNotNull())
    counts = some.groupBy(*key).agg(F.count("*").alias("n_all"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    head = some.select(*key, value).withColumn("_place", place).where(F.col("_place") <= n)
    firsts = head.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias("firsts"))
    other = firsts.select(*[F.col(k).alias(f"_{k}") for k in key], "firsts")
    on = [F.equal_null(F.col(k), F.col(f"_{k}")) for k in key]
    return counts.join(other, on).select(*key, "n_all", "firsts")


def collisions(rows: DataFrame, source: str = "path", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(classes (target, n_sources, first_sources), members (source, target, n_sources, first_sources)) of targets with several sources.

    A class names its first ``LISTED`` + 1 sources, enough for each member to name that many others; so
    the rows are as many as the sources, however many share a target.
    """
    each = rows.select(source, target).distinct()
    classes = first_values(each, [target], source, LISTED + 1).where("n_all > 1").select(target, F.col("n_all").alias("n_sources"), F.col("firsts").alias("first_sources"))
    return classes, each.join(classes, target).select(source, target, "n_sources", "first_sources")


def others(source: Column) -> Column:
    """A member's listing of the other sources of its target."""
    rest = F.slice(F.array_remove("first_sources", source), 1, LISTED)
    return with_rest(rest, F.col("n_sources") - 1)


def all_others(rows: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    """(source, target, n_sources, others) of targets with several sources, every other source named in order.

    A target's sources are one sorted list, no longer than the listing of one of its members, and joined to each of them.
    """
    each = rows.select(source, target).distinct()
    whole = each.groupBy(target).agg(F.sort_array(F.collect_list(source)).alias("sources")).where("size(sources) > 1")
    return each.join(whole, target).select(source, target, F.size("sources").cast("long").alias("n_sources"), F.array_join(F.array_remove("sources", F.col(source)), ", ").alias("others"))


def own_outputs(inputs: DataFrame, made: DataFrame) -> DataFrame:
    """Inputs (path) that are another input's target (path, target), a whole path each."""
    t = made.select(F.col("target").alias("_t"), F.col("path").alias("_src"))
    return inputs.join(t, (F.col("path") == F.col("_t")) & (F.col("path") != F.col("_src")), "left_semi")


SIDECAR = "title string, subtitle string, date string, entity string, theme string, to array<string>, plainNames boolean, pdfChrome struct<dropAbovePt: double, dropBelowPt: double>"


def resolve(inputs: DataFrame, sidecars: DataFrame, flags: dict | None = None, themes: tuple[str, ...] = (DEFAULT_THEME,)) -> DataFrame:
    """inputs(path, ...) with has_sidecar, formats, theme, plain, title, subtitle, date, entity, above, below, and ``failed``, why they don't resolve.

    sidecars(path, raw) are the settings files, of which each input has the one beside it. flags are those of a run: formats,
    theme, plain, title, date, entity, which come before a settings file's; config, the text of one settings
    file for every input; no_config, for none. The last two exclude each other.
    """
    flags = {k: v for k, v in (flags or {}).items() if v is not None}
    if "config" in flags and flags.get("no_config"):
        raise ValueError("a settings file is named, and none is to be used")
    none = lambda kind: F.lit(None).cast(kind)
    if flags.get("no_config") or "config" in flags:
        rows = inputs.withColumns({"sidecar_raw": F.lit(flags.get("config")).cast("string"), "sidecar": sidecar_path("path")})
        faults = sidecar_violations(rows.where("sidecar_raw is not null").select(F.col("sidecar").alias("path"), F.col("sidecar_raw").alias("raw")).distinct())
    else:
        rows = inputs.withColumn("sidecar", sidecar_path("path")).join(sidecars.select(F.col("path").alias("sidecar"), F.col("raw").alias("sidecar_raw")), "sidecar", "left")
        faults = sidecar_violations(sidecars)
    wrong = faults.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("wrong")).withColumnRenamed("path", "sidecar")
    rows = rows.join(wrong, "sidecar", "left").withColumn("c", F.from_json("sidecar_raw", SIDECAR))
    flag = lambda name, kind: F.lit(flags[name]).cast(kind) if name in flags else none(kind)
    rows = rows.select(
        *inputs.columns,
        F.col("sidecar_raw").isNotNull().alias("has_sidecar"),
        "wrong",
        precedence(flag("formats", "array<string>"), F.col("c.to"), none("array<string>"), F.lit([DEFAULT_TO])).alias("formats"),
        precedence(flag("theme", "string"), F.col("c.theme"), none("string"), DEFAULT_THEME).alias("theme"),
        precedence(flag("plain", "boolean"), F.col("c.plainNames"), none("boolean"), False).alias("plain"),
        *[F.coalesce(flag(k, "string"), F.col(f"c.{k}")).alias(k) for k in ("title", "subtitle", "date", "entity")],
        F.col("c.pdfChrome.dropAbovePt").alias("above"),
        F.col("c.pdfChrome.dropBelowPt").alias("below"),
    )
    unknown = unknown_formats("formats")
    failed = F.coalesce(
        F.col("wrong"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown format "), F.array_join(unknown, ", "))),
        F.when(~F.col("theme").isin(*themes), F.concat(F.lit("unknown theme "), F.col("theme"))),
    )
    return rows.withColumn("failed", failed).drop("wrong")


def plan_build(inputs: DataFrame, sidecars: DataFrame, flags: dict | None = None, out: str | None = None, themes: tuple[str, ...] = (DEFAULT_THEME,)) -> tuple[DataFrame, DataFrame]:
    """(one row an input: path, has_sidecar, status, reason, settings; one row a target: path, format, target).

    inputs(path) and their settings files sidecars(path, raw), with the run's flags as `resolve` has them. An input is ``failed`` if
    its settings don't resolve, ``own output`` if another input's target has its name, ``refused`` if a target is
    another input's too, else ``ok``; only ok inputs have targets.
    """
    rows = resolve(inputs, sidecars, flags, themes)
    unsafe = F.col("plain") & F.lit(out is None) & F.arrays_overlap("formats", F.lit(["md", "docx"]))
    rows = rows.withColumn("failed", F.coalesce("failed", F.when(unsafe, "plain names would write md or docx beside the sources, which a rerun would read")))

    base = F.lit(out.rstrip("/") + "/") if out else F.regexp_extract("path", "^(.*/)?", 0)
    named = targets(rows.where("failed is null").select("path", "formats", "theme", "plain"), F.col("formats"), F.col("theme"), F.col("plain"))
    named = named.select("path", "format", F.concat(base, "target").alias("target"))
    own = own_outputs(rows.select("path"), named).withColumn("own", F.lit(True))
    left = named.join(own, "path", "left_anti")
    # of a document's targets that clash (one a format at most) the first by name is told
    told = F.min(F.struct("target", others(F.col("path")).alias("others"))).alias("told")
    clash = collisions(left)[1].groupBy("path").agg(told).select("path", "told.others")
    rows = rows.join(own, "path", "left").join(clash, "path", "left")
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("own"), "own output").when(F.col("others").isNotNull(), "refused").otherwise("ok")
    reason = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("own"), "is the output of another input").when(F.col("others").isNotNull(), F.concat(F.lit("its output would also be that of "), F.col("others")))
    rows = rows.withColumns({"status": status, "reason": reason}).drop("failed", "own", "others")
    return rows, left.join(clash.select("path"), "path", "left_anti")


def with_rest(items: Column, n_all: Column) -> Column:
    """Items, and how many more there are than those."""
    more = n_all - F.size(items)
    return F.concat(F.array_join(items, ", "), F.when(more > 0, F.concat(F.lit(" …and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def listed(items: Column, n: int = LISTED) -> Column:
    """The first n items and how many more there are."""
    return with_rest(F.slice(items, 1, n), F.size(items))


def group_messages(dropped: DataFrame) -> DataFrame:
    """What was lost, by message: how often, and in which documents (the first by name, one for each time)."""
    return first_values(dropped, ["message"], "file").select("message", F.col("n_all").alias("n"), with_rest(F.col("firsts"), F.col("n_all")).alias("files"))


def exit_code(results: DataFrame, key: list[str]) -> DataFrame:
    """1 if anything failed, else 3 if anything was refused, else 0."""
    return results.groupBy(*key).agg(F.when(F.bool_or(F.col("status") == "failed"), 1).when(F.bool_or(F.col("status") == "refused"), 3).otherwise(0).alias("exit_code"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "refused", "failed")])
