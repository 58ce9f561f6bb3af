"""Graph health: counts, synthetic and dangling rows, coverage of the disk, and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave.schema import HEALTH_SAMPLES

# Measures that must not grow, and how much the ratio may.
REGRESSION_KEYS = ["dangling_edges", "option_errors", "parse_errors", "unindexed_files", "missing_files"]
RATIO_TOLERANCE = 0.02


def counts_by(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def synthetic(column: str = "metadata"):
    return F.coalesce(F.get_json_object(column, "$.synthetic") == "true", F.lit(False))


def collect_health(nodes: DataFrame, edges: DataFrame, option_values: DataFrame, inputs: DataFrame, disk: DataFrame, states: DataFrame, parse_errors: int) -> DataFrame:
    """One wide row of measures. ``disk`` and ``states`` have a column ``path``."""
    ids = nodes.select("id")
    loose = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").agg(F.count("*").alias(f"dangling_{end}s"))
    known = nodes.where(F.col("path").isNotNull()).select("path").union(states.select("path")).distinct()
    on_disk = disk.select("path").distinct()
    row = nodes.agg(F.count("*").alias("nodes"), F.count_if(synthetic()).alias("synthetic_nodes"))
    for part in (
        edges.agg(F.count("*").alias("edges")), loose("source"), loose("target"),
        option_values.agg(F.count_if(F.col("status") == "error").alias("option_errors")),
        inputs.agg(F.count_if(F.coalesce("rev", F.lit("")) == "").alias("inputs_without_rev")),
        states.agg(F.count_if("dirty").alias("dirty_files")),
        on_disk.agg(F.count("*").alias("disk_files")),
        on_disk.join(known, "path", "left_anti").agg(F.count("*").alias("unindexed_files")),
        known.join(on_disk, "path", "left_anti").agg(F.count("*").alias("missing_files")),
    ):
        row = row.crossJoin(part)  # one row each
    n = F.greatest("nodes", F.lit(1))
    return row.withColumns(
        {"dangling_edges": F.col("dangling_sources") + F.col("dangling_targets"), "synthetic_ratio": F.round(F.col("synthetic_nodes") / n, 4), "parse_errors": F.lit(parse_errors).cast("bigint")}
    )


def samples(nodes: DataFrame, disk: DataFrame, states: DataFrame, limit: int = HEALTH_SAMPLES) -> DataFrame:
    """kind (unindexed, missing), path: the first ``limit`` files by path that are on disk alone, and that are known alone."""
    known = nodes.where(F.col("path").isNotNull()).select("path").union(states.select("path")).distinct()
    on_disk = disk.select("path").distinct()
    first = lambda rows, kind: rows.orderBy("path").limit(limit).select(F.lit(kind).alias("kind"), "path")
    return first(on_disk.join(known, "path", "left_anti"), "unindexed").union(first(known.join(on_disk, "path", "left_anti"), "missing"))


def compare_health(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """measure, was, is of everything that got worse."""
    keys = ", ".join(f"'{k}', cast({k} as double)" for k in [*REGRESSION_KEYS, "synthetic_ratio"])
    tall = lambda df, name: df.selectExpr(f"stack({len(REGRESSION_KEYS) + 1}, {keys}) as (measure, {name})")
    both = tall(now, "is_now").join(tall(baseline, "was"), "measure")
    allowed = F.when(F.col("measure") == "synthetic_ratio", F.col("was") + RATIO_TOLERANCE).otherwise(F.col("was"))
    return both.where(F.col("is_now") > allowed).select("measure", "was", "is_now")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, dangling edges by end: the measures that any (nodes, edges) pair has."""
    ids = nodes.select("id")
    loose = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").agg(F.count("*").alias(f"dangling_{end}s"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(loose("source")).crossJoin(loose("target"))


def option_status(option_values: DataFrame) -> DataFrame:
    return counts_by(option_values, "status")


def status(nodes: DataFrame, edges: DataFrame, states: DataFrame, generation: int, served: int = 0, tokens_saved: int = 0) -> DataFrame:
    """One row: size of the graph, generation, and while files are dirty how many are and how many nodes have a path."""
    row = nodes.agg(F.count("*").alias("total_nodes"), F.count("path").alias("with_path"))
    row = row.crossJoin(edges.agg(F.count("*").alias("total_edges"))).crossJoin(states.agg(F.count_if("dirty").alias("dirty")))  # one row each
    progress = F.when((F.col("dirty") > 0) & (F.col("with_path") > 0), F.struct("dirty", F.col("with_path").alias("total")))
    return row.select(
        F.lit("static").alias("mode"), "total_nodes", "total_edges", progress.alias("sync_progress"), F.lit(served).cast("bigint").alias("queries_served"),
        F.lit(tokens_saved).cast("bigint").alias("tokens_estimated_saved"), F.lit(generation).cast("bigint").alias("generation_id"),
    )
