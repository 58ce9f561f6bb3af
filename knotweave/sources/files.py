"""Files as rows: recursive listing with exclusions, decoding, suffix dispatch, the relevance gate."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.operators.substring import containing
from knotweave.plans.store import Adjacency, Clustered, plain
from knotweave.sources.tree import SKIP_DIRS, opened, tree

# Suffixes, their language and their tier (0 is always read).
LANGUAGES = {"nix": ("nix", 0), "py": ("python", 1), "kdl": ("kdl", 1)}


def excluded(path: Column, prefixes: list[str]) -> Column:
    """Whether ``path`` is one of the prefixes or below one, component by component."""
    tests = [(path == p) | path.startswith(p + "/") for p in (x.removeprefix("./").rstrip("/") for x in prefixes)]
    return reduce(Column.__or__, tests, F.lit(False))


def _config_folders(spark: SparkSession, base: str) -> list[str]:
    """Folders named .config, at any depth: Spark leaves hidden folders out of a recursive read, so they are named to it."""
    try:
        opened(base)
    except (pa.ArrowException, OSError):  # a store that only Spark's own readers know
        return _config_folders_by_hadoop(spark, base)
    own = tree(spark, base).where(F.col("folder") & F.col("path").rlike(r"(^|/)\.config$")).select("path")
    return [f"{base}/{r['path']}" for r in own.collect()]  # one name for each such folder, as the read takes names


def _config_folders_by_hadoop(spark: SparkSession, base: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, open_ = [], [path(base)]
    while open_:
        for s in fs.listStatus(open_.pop()):
            name = s.getPath().getName()
            if not s.isDirectory() or name in SKIP_DIRS or (name.startswith(".") and name != ".config"):
                continue
            open_.append(s.getPath())
            if name == ".config":
                found.append(s.getPath().toString())
    return found


def watched(path: Column, parsers: list[str] | None = None) -> Column:
    """Whether a change of ``path`` matters: a file with a parser, not hidden, not in a skipped folder."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffixes = parsers if parsers is not None else list(LANGUAGES)
    skipped = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in SKIP_DIRS)))
    return ~skipped & F.contains(name, F.lit(".")) & F.element_at(F.split(name, r"\."), -1).isin(suffixes) & ~name.startswith(".")


def single(spark: SparkSession, file: str, enabled: list[str] | None = None) -> DataFrame:
    """The listing of one file: no relevance gate, but beyond tier 0 its language must be enabled."""
    raw = spark.read.format("binaryFile").load(file).select(F.element_at(F.split("path", "/"), -1).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    table = F.create_map(*(x for k, (lang, tier) in LANGUAGES.items() for x in (F.lit(k), F.struct(F.lit(lang).alias("lang"), F.lit(tier).alias("tier")))))
    kind = table[F.element_at(F.split("path", r"\."), -1)]
    out = raw.select("path", kind["lang"].alias("lang"), kind["tier"].alias("tier"), "length", "modified", "content")
    return out.where((F.col("tier") == 0) | F.col("lang").isin(enabled if enabled is not None else [lang for lang, _ in LANGUAGES.values()]))


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path (relative), suffix, lang, tier, length, modified, content of the files below ``root`` that have a parser."""
    base = root.rstrip("/")
    roots = [base, *_config_folders(spark, base)]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(roots)
    relative = F.regexp_replace("path", "^(?:[a-z]+:/*)?" + "/*" + re.escape(base.split("://")[-1].strip("/")) + "/", "")
    hidden = r"(^|/)(?!\.config(/|$))\.[^/]+(/|$)"
    skipped = "(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIP_DIRS) + ")/"
    table = F.create_map(*(x for k, (lang, tier) in LANGUAGES.items() for x in (F.lit(k), F.struct(F.lit(lang).alias("lang"), F.lit(tier).alias("tier")))))
    out = raw.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    out = out.where(~F.col("path").rlike(hidden) & ~F.col("path").rlike(skipped) & ~excluded(F.col("path"), exclude or []))
    kind = table[F.element_at(F.split("path", r"\."), -1)]
    return out.select("path", kind["lang"].alias("lang"), kind["tier"].alias("tier"), "length", "modified", "content")


def texts(files: DataFrame) -> DataFrame:
    """path, lang, text and content_hash; bytes that aren't UTF-8 give a null text (to be skipped)."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "lang", "tier", text.alias("text"), F.sha2("content", 256).alias("content_hash"))


def relevant(files: DataFrame, nodes: DataFrame | Clustered, edges: DataFrame | Adjacency, enabled: list[str], parse_unreferenced: bool = False) -> DataFrame:
    """The files to parse: tier 0, and enabled ones that are below .config or that the graph names as files.

    A file is named by a ``file:`` id or a configures/generates target: by the whole of
    it, by its base name, or anywhere inside. The last is a substring join by n-grams.
    """
    always = files.where(F.col("tier") == 0)
    rest = files.where((F.col("tier") > 0) & F.col("lang").isin(enabled))
    if parse_unreferenced or rest.isEmpty():
        return always.union(rest)
    named = plain(nodes).where(F.col("type") == "file").select(F.substr("id", F.lit(6)).alias("f")).union(
        plain(edges).where(F.col("type").isin("configures", "generates")).select(F.regexp_replace("target", "^file:", "").alias("f"))
    )
    base = rest.withColumn("_base", F.element_at(F.split("path", "/"), -1))
    config = base.where(F.col("path").rlike(r"(^|/)\.config/")).select("path")
    whole = named.select("f").union(named.select(F.element_at(F.split("f", "/"), -1))).distinct()
    inside = containing(named.where("f <> ''").distinct().select(F.col("f").alias("key"), F.col("f").alias("text")), rest.select(F.col("path").alias("needle")))
    hits = base.join(inside.select(F.col("needle").alias("path")), "path", "left_semi").select("path").union(base.join(whole.withColumnRenamed("f", "_base"), "_base", "left_semi").select("path"))
    return always.union(rest.join(config.union(hits).distinct(), "path", "left_semi").select(files.columns))
