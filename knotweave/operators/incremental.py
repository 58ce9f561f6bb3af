"""Incremental maintenance: hashes, snapshot differences, update decisions, cascades."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.operators.traverse import BROADCAST_ROWS, Edges, Nodes, _side, nodes_at, walk
from knotweave.operators.substring import containing
from knotweave.plans.session import table as cut
from knotweave.plans.session import written



def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the bytes (our own choice: it stays in the JVM)."""
    return F.sha2(text, 256)


def structure_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, ast_hash: order-free digest of a path's nodes and of the edges that leave them."""
    n = nodes.select("path", F.concat_ws("\u0001", F.lit("n"), "id", "type", "name", F.coalesce("metadata", F.lit(""))).alias("item"))
    e = edges.join(nodes.select(F.col("id").alias("source"), "path"), "source").select("path", F.concat_ws("\u0001", F.lit("e"), "source", "target", "type", F.coalesce("metadata", F.lit(""))).alias("item"))
    # digests of fixed size meet per path, not the items themselves
    items = n.union(e).where(F.col("path").isNotNull()).select("path", F.sha2("item", 256).alias("d"))
    return items.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("ast_hash"))


def merkle(hashes: DataFrame, imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, merkle_hash of every row of ``hashes`` (path, ast_hash): own hash with the sorted Merkle hashes of what it imports (path, target).

    Leaves first; a round looks at the importers of what the round before settled, until
    it settles nothing. Members of cycles, and what hangs on them, take their own
    structure hash as the hash that others see. ``known`` (path, merkle_hash): paths
    outside ``hashes`` whose Merkle hash stands.
    """
    digest = lambda own, parts: F.sha2(F.concat(own, F.array_join(F.array_sort(parts), "")), 256)
    targets = hashes.select(F.col("path").alias("target"))
    if known is not None:
        known = known.join(hashes.select("path"), "path", "left_anti").select("path", "merkle_hash")
        targets = targets.union(known.select("path"))
    deps = cut(imports.select("path", "target").distinct().join(hashes.select("path"), "path", "left_semi").join(targets, "target", "left_semi"))
    # rounds carry what imports something and what is imported; a path that does neither is only hashed
    importers, many = written(deps.select("path").distinct())
    asked, most = written(deps.select(F.col("target").alias("path")).distinct())
    mine = cut(hashes.join(_side(importers, many), "path", "left_semi").select("path", "ast_hash"))
    alone = lambda rows: rows.join(_side(importers, many), "path", "left_anti").select("path", digest(F.col("ast_hash"), F.expr("cast(array() as array<string>)")).alias("merkle_hash"))
    leaves = alone(hashes)
    first = alone(hashes.join(_side(asked, most), "path", "left_semi"))
    fresh, size = written(first if known is None else first.union(known.join(_side(asked, most), "path", "left_semi")))
    stands, seen = fresh, size  # what others see of the paths that are settled
    settled, done = leaves, 0
    for level in count(1):
        if not size:
            break
        # a path is settled in the round after its last import was
        near = deps.join(_side(fresh.select(F.col("path").alias("target")), size), "target", "left_semi").select("path").distinct()
        ready = deps.join(near, "path", "left_semi").join(_side(stands.withColumnRenamed("path", "target"), seen), "target", "left").groupBy("path").agg(F.count_if(F.col("merkle_hash").isNull()).alias("open"), F.collect_list("merkle_hash").alias("parts"))
        closed, n = written(ready.where("open = 0").join(mine, "path").select("path", digest(F.col("ast_hash"), F.col("parts")).alias("merkle_hash")))
        settled, done = closed if not done else settled.union(closed), done + n
        fresh, size = written(closed.join(_side(asked, most), "path", "left_semi"))
        stands, seen = stands.union(fresh), seen + size
        if level % 8 == 0:  # a plan of bounded length, however deep the imports
            stands, settled = cut(stands.coalesce(max(1, seen // BROADCAST_ROWS))), cut(settled.coalesce(max(1, done // BROADCAST_ROWS)))
    if not done:
        settled = leaves.limit(0)
    left, open_ = written(mine.join(settled.select("path"), "path", "left_anti"))
    if not open_:
        return leaves.union(settled)
    stands = stands.withColumnRenamed("merkle_hash", "h").union(left.select("path", "ast_hash")).withColumnRenamed("path", "target")
    cyclic = deps.join(left.select("path"), "path", "left_semi").join(stands, "target").groupBy("path").agg(F.collect_list("h").alias("parts")).join(left, "path").select("path", digest(F.col("ast_hash"), F.col("parts")).alias("merkle_hash"))
    return leaves.union(settled).union(cyclic)


def diff(old: DataFrame, new: DataFrame, key: str, value: list[str]) -> DataFrame:
    """key, status (added, removed, changed): rows that differ between two snapshots."""
    digest = F.struct(*value)
    a, b = old.select(key, digest.alias("was")), new.select(key, digest.alias("is_now"))
    joined = a.join(b, key, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is_now")), "changed")
    return joined.select(key, status.alias("status")).where(F.col("status").isNotNull())


def diff_values(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Value-typed rows (edges): what only one snapshot has."""
    a, b = old.select(columns).distinct(), new.select(columns).distinct()
    return a.exceptAll(b).withColumn("status", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("status", F.lit("added")))


def decide(files: DataFrame, states: DataFrame) -> DataFrame:
    """path, decision for freshly read files (path, content, ast_hash, relevant) against their stored state."""
    known = states.select("path", F.col("content_hash").alias("old_content"), F.col("ast_hash").alias("old_ast"))
    return files.join(known, "path", "left").select(
        "path",
        F.when(F.col("content").isNull(), "read_error").when(~F.col("relevant"), "not_relevant").when(content_hash(F.col("content")) == F.col("old_content"), "unchanged_content")
        .when(F.col("ast_hash") == F.col("old_ast"), "formatting_only").otherwise("ast_changed").alias("decision"),
    )


def cascade(nodes: Nodes, edges: Edges, changed: list[str], max_depth: int | None = None) -> DataFrame:
    """id, depth of all modules that import a changed one, over any number of steps (or ``max_depth``), nearest first; the changed ones aren't part of it."""
    starts = nodes_at(nodes, changed).select("id")
    return walk(nodes, edges.where(F.col("type") == "imports"), starts, max_depth, reverse=True).where(F.col("depth") > 0)


def invalidate(option_values: DataFrame, stems: DataFrame) -> DataFrame:
    """``option_values`` with the rows whose expression holds a stem (stem) set to stale."""
    hit = containing(option_values.select("key", F.col("expr").alias("text")), stems.select(F.col("stem").alias("needle"))).select("key", F.lit(True).alias("hit")).distinct()
    status = F.when(F.col("hit"), "stale").otherwise(F.col("status"))
    return option_values.join(hit, "key", "left").withColumn("status", status).select(option_values.columns)


def invalidate_all(option_values: DataFrame) -> DataFrame:
    return option_values.withColumn("status", F.lit("stale"))


def stem(path: Column) -> Column:
    """The last part of a path without its suffix: what an expression names a file by."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def mark(states: DataFrame, paths: DataFrame, dirty: bool = True) -> DataFrame:
    """``states`` with the flag of the files in ``paths`` (path) set or, with ``dirty=False``, cleared."""
    hit = paths.select("path", F.lit(True).alias("_hit")).distinct()
    return states.join(hit, "path", "left").withColumn("dirty", F.when(F.col("_hit"), F.lit(dirty)).otherwise(F.col("dirty"))).select(states.columns)


def dirty_files(states: DataFrame) -> DataFrame:
    return states.where("dirty").orderBy("path")


def cache_hits(option_values: DataFrame, rev: str | None) -> DataFrame:
    return option_values.where((F.col("status") == "ok") & (F.col("source_rev").isNull() | (F.col("source_rev") == F.lit(rev))))


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
