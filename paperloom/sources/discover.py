"""Input files of a folder, and the documents they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import PAGE_PT, inline_paint
from ..operators.config import READABLE, extension, readable, sidecar_path, stem
from .base import kept
from .folders import any_case, folders, known, qualified, readable_files

GLOB = any_case(READABLE)


def discover(spark: SparkSession, folder: str, recursive: bool = False, theme: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inputs, own earlier output) of a folder as (path, length, modified), by path, and the folders below it that
    can't be read (folder, reason).

    Only names are listed here: the content column of the same source is read when a reader
    asks for it. A missing folder raises, an empty one gives no rows.
    """
    found = readable_files(spark, folder, recursive, GLOB).select("path", "length", F.col("modificationTime").alias("modified"))
    inputs, own = readable(found, theme)
    return inputs.orderBy("path"), own.orderBy("path"), unreadable(spark, folder, recursive)


def unreadable(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(folder, reason) of the folders below a folder that can't be read."""
    if not recursive or not known(qualified(spark, folder)):
        return spark.createDataFrame([], "folder string, reason string")
    return folders(spark, folder, True).where("reason is not null")


def load(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """files(doc_id, path, ext, content): doc_id is a hash of the path, stable between runs."""
    files = readable_files(spark, folder, recursive, GLOB)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", extension("path").alias("ext"), "content", F.greatest(F.lit(0), F.unix_seconds("modificationTime")).alias("epoch"))


def load_sidecars(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, raw) of the settings files of a folder."""
    files = readable_files(spark, folder, recursive, "*.settings.json")
    return files.select("path", F.decode("content", "UTF-8").alias("raw"))


def read_text(spark: SparkSession, path: str) -> str:
    """One small file's text; a missing file raises."""
    return spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text")).first()["text"]


def shaped(blocks: DataFrame) -> DataFrame:
    """blocks with all columns of the block model, null where a reader has nothing for one."""
    from .markdown import BLOCK_SCHEMA

    have = set(blocks.columns)
    fields = T._parse_datatype_string(BLOCK_SCHEMA).fields
    n_cols = F.when(F.col("t") == "table", F.size("head")) if "head" in have else F.lit(None)
    extra = {"n_cols": n_cols, "n_aligned": n_cols, "align": F.transform("head", lambda _: F.lit("l")) if "head" in have else F.lit(None)}
    value = lambda f: F.col(f.name) if f.name in have else extra.get(f.name, F.lit(None))
    return blocks.select(*[value(f).cast("long" if f.name == "block_ix" else f.dataType).alias(f.name) for f in fields])


def read_all(files: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs (doc_id, title: the document's own, else the file's stem, for Markdown 'Untitled'), blocks of the whole model, cells and
    losses of files of all kinds, each by its reader. A document with a loss of kind 'refused' has no block."""
    from . import archive, markdown, pdf

    md = files.where(F.col("ext").isin(".md", ".markdown")).select("doc_id", F.decode("content", "UTF-8").alias("text"))
    md_blocks, md_lost = markdown.read(md)
    md_titles, md_rest = markdown.with_titles(kept(md_blocks))
    word = archive.word_blocks(files.where("ext = '.docx'"))
    book = archive.workbook_blocks(files.where("ext = '.xlsx'"))
    page = pdf.read(files.where("ext = '.pdf'"), rules)
    lost = lambda d: d.select("doc_id", "kind", "message")
    dropped = lost(md_lost).unionByName(lost(word["dropped"])).unionByName(lost(book["dropped"])).unionByName(lost(page["dropped"]))
    blocks = shaped(md_rest).unionByName(shaped(word["blocks"])).unionByName(shaped(book["blocks"])).unionByName(shaped(page["blocks"]))
    own = md_titles.select("doc_id", "title").unionByName(book["titles"].select("doc_id", "title"))
    titles = files.select("doc_id", stem("path").alias("stem"), "ext").join(own, "doc_id", "left")
    fallback = F.when(F.col("ext").isin(".md", ".markdown"), "Untitled").otherwise(F.col("stem"))
    return {"docs": titles.select("doc_id", F.coalesce("title", fallback).alias("title")), "blocks": blocks, "cells": book["cells"], "dropped": dropped}


def with_sidecars(inputs: DataFrame, sidecars: DataFrame, suffix: str = "settings") -> DataFrame:
    """inputs(path) with the raw settings file (path, raw) beside each, by an equi-join on the derived path."""
    s = sidecars.select(F.col("path").alias("sidecar"), F.col("raw").alias("sidecar_raw"))
    return inputs.withColumn("sidecar", sidecar_path("path", suffix)).join(s, "sidecar", "left")


# fixed values: a theme's defaults
COLORS = {"brandOnLight": "#1A1A1A", "ink": "#1A1A1A", "muted": "#6B6B6B", "rule": "#D8D8D8"}
SIZES = {"bodyPt": 10.0, "leading": 1.45, "h1Pt": 18.0, "h2Pt": 13.0, "h3Pt": 11.0, "smallPt": 8.0}
THEME = """id string, name string, colors map<string, string>, font struct<document: string, embed: string>, page struct<size: string, marginPt: double>,
type map<string, double>, logo struct<svg: string, heightPt: double, png: string>, cornerMark struct<svg: string, heightPt: double, png: string>, letterhead array<string>"""


def load_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Themes of a folder of JSON files, sorted by id, with defaults; what is wrong with one as ``violations``."""
    return themes(spark.read.text(folder, wholetext=True).select(F.col("value").alias("raw"))).orderBy("id")


def themes(files: DataFrame) -> DataFrame:
    """Themes of files(raw): a column for each value, and ``violations``."""
    t = files.select(F.from_json("raw", THEME).alias("t"), F.json_object_keys("raw").alias("keys")).select("t.*", "keys")
    is_hex = lambda c: F.rlike(c, F.lit("^#[0-9A-Fa-f]{6}$"))
    color = {k: F.coalesce(F.try_element_at("colors", F.lit(k)), F.lit(v)) for k, v in COLORS.items()}
    color["title"] = F.coalesce(F.try_element_at("colors", F.lit("title")), color["ink"])
    dark = F.try_element_at("colors", F.lit("brandOnDark"))
    size = {k: F.coalesce(F.try_element_at("type", F.lit(k)), F.lit(v)) for k, v in SIZES.items()}
    size["titlePt"] = F.coalesce(F.try_element_at("type", F.lit("titlePt")), size["h1Pt"])
    page, margin = F.coalesce("page.size", F.lit("A4")), F.coalesce("page.marginPt", F.lit(48.0))
    why = [F.when(F.col("keys").isNull(), "the theme must be one JSON object")]
    why += [F.when(~is_hex(v), f"colors.{k}: expected a six-digit hex colour") for k, v in color.items()]
    why += [F.when(dark.isNotNull() & ~is_hex(dark), "colors.brandOnDark: expected a six-digit hex colour or null")]
    why += [F.when(~(v > 0), f"type.{k}: expected a positive number") for k, v in size.items()]
    why += [F.when(~page.isin(*PAGE_PT), "page.size: expected A4 or Letter"), F.when(~(margin > 0), "page.marginPt: expected a positive number")]
    why += [F.when(margin * 2 >= F.when(page == "Letter", PAGE_PT["Letter"][0]).otherwise(PAGE_PT["A4"][0]) - 72, "page.marginPt: leaves no usable column")]
    why += [F.when(F.coalesce("font.embed", F.lit("arimo")) != "arimo", "font.embed: only arimo is available")]
    for name in ("logo", "cornerMark"):
        mark = F.col(name)
        there = mark.isNotNull()
        why += [F.when(there & ~F.coalesce(F.contains(mark["svg"], F.lit("<svg")), F.lit(False)), f"{name}.svg: expected inline SVG markup")]
        why += [F.when(there & inline_paint(mark["svg"]).isNotNull(), F.concat(F.lit(f"{name}.svg: painted by "), inline_paint(mark["svg"])["where"], F.lit(", not by class")))]
        why += [F.when(mark["png"].isNotNull() & ~F.startswith(mark["png"], F.lit("data:image/png;base64,")), f"{name}.png: expected an inline PNG")]
        why += [F.when(there & ~(F.coalesce(mark["heightPt"], F.lit(1.0)) > 0), f"{name}.heightPt: expected a positive number")]
    name = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k)
    ident = F.coalesce("id", F.lit("unnamed"))
    return t.select(
        ident.alias("id"),
        F.coalesce("name", "id", F.lit("Unnamed")).alias("name"),
        *[v.alias(name(k)) for k, v in color.items()],
        dark.alias("brand_on_dark"),
        F.coalesce("font.document", F.lit("Arial")).alias("font"),
        page.alias("page"),
        margin.alias("margin_pt"),
        *[v.alias(name(k)) for k, v in size.items()],
        *[F.col(n)["svg"].alias(name(n) + "_svg") for n in ("logo", "cornerMark")],
        F.coalesce("letterhead", F.array().cast("array<string>")).alias("letterhead"),
        F.array_compact(F.array(*why)).alias("violations"),
    )


def theme_json(theme: DataFrame) -> DataFrame:
    """(id, json): each theme's values in one fixed form, keys in order of the columns."""
    return theme.select("id", F.to_json(F.struct(*[c for c in theme.columns if c != "violations"])).alias("json"))


def required_token(tokens: DataFrame, name: str) -> DataFrame:
    """(doc_id, value) of one design token, and ``why`` where a source carries none."""
    found = tokens.where(F.col("name") == name).select("doc_id", "value")
    docs = tokens.select("doc_id").distinct()
    return docs.join(found, "doc_id", "left").withColumn("why", F.when(F.coalesce("value", F.lit("")) == "", f"token source carries no {name}"))


def design_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, group, name, value) of design-token JSON (doc_id, raw): two levels, first of arrays."""
    groups = files.select("doc_id", F.explode(F.from_json("raw", "map<string, map<string, string>>")).alias("group", "tokens"))
    value = F.coalesce(F.get_json_object("v", "$.$value[0]"), F.get_json_object("v", "$.$value"), F.get_json_object("v", "$[0]"), F.col("v"))
    return groups.select("doc_id", "group", F.explode("tokens").alias("name", "v")).select("doc_id", "group", "name", value.alias("value"))


def recolour(svgs: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(svg with its colour classes filled, misses): svgs(doc_id, svg) use class="<token>"; a class without a token is a violation."""
    uses = svgs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("svg", F.lit('class="([^"]+)"')))).alias("name"))
    joined = uses.join(tokens.select("doc_id", "name", "value"), ["doc_id", "name"], "left")
    misses = joined.where("value is null").select("doc_id", "name")
    pairs = joined.where("value is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("pairs"))
    filled = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<name:string,value:string>>")), F.col("svg"), lambda acc, p: F.replace(acc, F.concat(F.lit('class="'), p["name"], F.lit('"')), F.concat(F.lit('fill="'), p["value"], F.lit('"'))))
    return svgs.join(pairs, "doc_id", "left").select("doc_id", filled.alias("svg")), misses
