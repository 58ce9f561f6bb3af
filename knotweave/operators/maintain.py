"""Maintenance of stored graphs: upserts, placeholders, per-file and bulk replacement, pruning, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.operators.health import synthetic
from knotweave.plans.session import table as cut
from knotweave.schema import SHARED_TYPES


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; the columns in ``keep`` stay as they were."""
    if not keep:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    was = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in keep))
    merged = new.join(was, key, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).select(new.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(merged)


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Without the file's nodes and the edges that leave them; edges into them survive and dangle."""
    return delete_files(nodes, edges, nodes.sparkSession.createDataFrame([(path,)], "path string"))


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`delete_file` for all of ``paths`` (path) at once."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    return nodes.join(gone, "id", "left_anti").select(nodes.columns), edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").select(edges.columns)


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` without placeholders (no path, synthetic) that no edge touches."""
    lone = nodes.where(F.col("path").isNull() & synthetic()).select("id")
    for end in ("source", "target"):
        lone = lone.join(edges.select(F.col(end).alias("id")), "id", "left_anti")
    return nodes.join(lone, "id", "left_anti").select(nodes.columns)


def placeholder(target: Column) -> Column:
    """A struct (id, type, name, path, lang, metadata) for a target that isn't known, by its id's prefix."""
    rest = F.regexp_replace(target, "^[^:]*:", "")
    kind = F.regexp_extract(target, "^([^:]*):", 1)
    # Id prefixes and the node types of their placeholders.
    types = {
        "nix": "nix_module", "nix_module": "nix_module", "nix_option": "nix_option", "nix_function": "nix_function", "flake_input": "flake_input",
        "package": "package_ref", "file": "file", "python": "python_module", "py_module": "python_module", "py_func": "py_function", "py_class": "py_class",
        "kdl_bind": "kdl_bind", "kdl_spawn": "kdl_spawn", "kdl_rule": "kdl_rule",
    }
    type_ = F.coalesce(F.create_map(*(F.lit(x) for p in types.items() for x in p))[kind], F.lit("file"))
    path = F.when(kind == "nix", rest).when(kind == "nix_module", F.split(rest, "::").getItem(0))
    lang = F.when(kind.startswith("py") | (kind == "python"), "python").when(kind.startswith("kdl"), "kdl").otherwise("nix")
    name = F.when(kind.isin("nix_function", "py_func", "py_class"), F.element_at(F.split(rest, ":"), -1)).otherwise(rest)
    return F.struct(target.alias("id"), type_.alias("type"), name.alias("name"), path.alias("path"), lang.alias("lang"), F.lit('{"synthetic":true}').alias("metadata"))


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholder rows for all targets without a node."""
    lost = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return lost.select(placeholder(F.col("id")).alias("p")).select("p.*")


def build_all(nodes: DataFrame, edges: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Bulk load: the last row of each id wins, but a placeholder never replaces a real node."""
    n = nodes.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(synthetic().asc(), F.desc(order)))).where("_rn = 1").drop("_rn")
    e = edges.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
    return n, e


def build_file(nodes: DataFrame, edges: DataFrame, path: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace one file's part of the graph, see :func:`build_files`."""
    return build_files(nodes, edges, nodes.sparkSession.createDataFrame([(path,)], "path string"), new_nodes, new_edges)


def build_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the part of the graph that the files in ``paths`` (path) own.

    A node that a file owned and no longer has goes, and with it the edges of other
    files into it, unless one of those is of a shared type. Targets of the new edges,
    and of those kept, that are then missing get placeholders; placeholders that
    nothing touches any more are pruned.
    """
    owned = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    others = edges.join(owned.withColumnRenamed("id", "source"), "source", "left_anti").select(edges.columns)
    dropped = owned.join(new_nodes.select("id"), "id", "left_anti")
    shared = others.where(F.col("type").isin(SHARED_TYPES)).select(F.col("target").alias("id"))
    dead = dropped.join(shared, "id", "left_anti")
    kept = others.join(dead.withColumnRenamed("id", "target"), "target", "left_anti").select(edges.columns)
    all_edges = cut(upsert(kept, new_edges.select(edges.columns), "id"))  # read several times below
    real = cut(upsert(nodes.join(owned, "id", "left_anti").select(nodes.columns), new_nodes.select(nodes.columns), "id"))
    at_stake = new_edges.select("target").union(kept.join(dropped.withColumnRenamed("id", "target"), "target", "left_semi").select("target"))
    return prune_orphans(with_placeholders(real, at_stake), all_edges), all_edges


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and a placeholder for each target that lacks one; columns that placeholders don't have are null."""
    lost = missing_targets(nodes, edges)
    return nodes.unionByName(lost.select([F.col(c) if c in lost.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]))


def purge(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """``rows`` (path) whose file is still listed (path)."""
    return rows.join(listing.select("path"), "path", "left_semi").select(rows.columns)


def vanished(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """path of the ``rows`` (path) whose file is listed no more."""
    return rows.select("path").distinct().join(listing.select("path"), "path", "left_anti")


def package_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """attribute, used_by, and a stable stand-in version and store path of every package in use."""
    used = edges.where((F.col("type") == "uses_package") & F.col("target").startswith("package:"))
    at = used.join(nodes.select(F.col("id").alias("source"), "path"), "source", "left")
    grouped = at.groupBy(F.substr("target", F.lit(len("package:") + 1)).alias("attribute")).agg(F.array_sort(F.collect_set(F.coalesce("path", "source"))).alias("used_by"))
    digest = F.sha2("attribute", 256)
    part = lambda i: (F.conv(F.substring(digest, i, 2), 16, 10).cast("int") % 20).cast("string")
    return grouped.select("attribute", F.concat_ws(".", part(1), part(3), part(5)).alias("version"), F.concat(F.lit("/nix/store/"), F.substring(digest, 1, 32), F.lit("-"), F.col("attribute")).alias("store_path"), "used_by")


def follow_edges(inputs: DataFrame) -> DataFrame:
    """``references`` edges between inputs (name, inputs map) whose both ends exist, without self-loops."""
    pairs = inputs.select("name", F.explode(F.flatten(F.map_values("inputs"))).alias("to")).where(F.col("name") != F.col("to")).distinct()
    known = pairs.join(inputs.select(F.col("name").alias("to")), "to", "left_semi")
    source, target = F.concat(F.lit("flake_input:"), F.col("name")), F.concat(F.lit("flake_input:"), F.col("to"))
    return known.select(F.concat_ws("->", source, F.lit("references"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit("references").alias("type"))


def input_nodes(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """``nodes`` with one node for each input (name, url, rev, type); nodes of inputs that are named in ``inputs`` no more are not added."""
    new = inputs.select(
        F.concat(F.lit("flake_input:"), F.col("name")).alias("id"), F.lit("flake_input").alias("type"), "name", F.lit(None).cast("string").alias("path"), F.lit("nix").alias("lang"),
        F.to_json(F.struct("rev", "type", "url")).alias("metadata"),
    )
    return upsert(nodes, new.select([F.col(c) if c in new.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]), "id")


def refresh_packages(old: DataFrame | None, index: DataFrame, now: Column) -> DataFrame:
    """The package table from :func:`package_index`: a package that was known keeps when it was first seen; unused ones go."""
    new = index.select("attribute", F.col("attribute").alias("name"), "version", "store_path", "used_by", now.alias("first_seen"), now.alias("last_updated"))
    if old is None:
        return new
    was = old.select("attribute", F.col("first_seen").alias("_was"))
    return new.join(was, "attribute", "left").withColumn("first_seen", F.coalesce("_was", "first_seen")).select(new.columns)


def list_packages(packages: DataFrame, query: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` packages by attribute whose attribute or name holds ``query``, in any case of its letters."""
    if query:
        text = F.lit(query.lower())
        packages = packages.where(F.contains(F.lower("attribute"), text) | F.contains(F.lower("name"), text))
    return packages.orderBy("attribute").limit(limit)
