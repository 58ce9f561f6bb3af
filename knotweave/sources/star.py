"""The driver's star schema seen as a typed property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node tables with their key and name columns.
NODE_TABLES = {
    "region": ("region", "r_regionkey", "r_name"),
    "nation": ("nation", "n_nationkey", "n_name"),
    "customer": ("customer", "c_custkey", "c_name"),
    "supplier": ("supplier", "s_suppkey", "s_name"),
    "part": ("part", "p_partkey", "p_name"),
    "order": ("orders", "o_orderkey", None),
}

TABLES = [*(name for name, _, _ in NODE_TABLES.values()), "lineitem"]

# The same graph for DuckDB.
NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'order ' || o_orderkey FROM orders)"""
EDGES_SQL = """raw_edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'references' AS type, 'region:' || n_regionkey AS target, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'references', 'nation:' || c_nationkey, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'references', 'nation:' || s_nationkey, 1.0 FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'requires', 'customer:' || o_custkey, 1.0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'uses_package', 'part:' || l_partkey, 1 + min(l_discount) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'sets', 'supplier:' || l_suppkey, 1.0 FROM lineitem GROUP BY l_partkey, l_suppkey),
edges AS (SELECT source || '->' || type || '->' || target AS id, * FROM raw_edges)"""
GRAPH_SQL = f"{NODES_SQL},\n{EDGES_SQL}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name of all rows of the six node tables."""
    out = None
    for kind, (name, key, label) in NODE_TABLES.items():
        named = F.col(label) if label else F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
        part = table(spark, sf_dir, name).select(node_id(kind, key).alias("id"), F.lit(kind).alias("type"), named.alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, type, weight; each pair of a kind once."""

    def edge(df: DataFrame, source: Column, kind: str, target: Column, weight: Column | None = None) -> DataFrame:
        w = (F.lit(1.0) if weight is None else weight).cast("double")
        return df.select(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"), w.alias("weight"))

    lineitem = table(spark, sf_dir, "lineitem")
    per_part = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_discount").alias("d"))
    per_supplier = lineitem.select("l_partkey", "l_suppkey").distinct()
    parts = [
        edge(table(spark, sf_dir, "nation"), node_id("nation", "n_nationkey"), "references", node_id("region", "n_regionkey")),
        edge(table(spark, sf_dir, "customer"), node_id("customer", "c_custkey"), "references", node_id("nation", "c_nationkey")),
        edge(table(spark, sf_dir, "supplier"), node_id("supplier", "s_suppkey"), "references", node_id("nation", "s_nationkey")),
        edge(table(spark, sf_dir, "orders"), node_id("order", "o_orderkey"), "requires", node_id("customer", "o_custkey")),
        edge(per_part, node_id("order", "l_orderkey"), "uses_package", node_id("part", "l_partkey"), 1 + F.col("d")),
        edge(per_supplier, node_id("part", "l_partkey"), "sets", node_id("supplier", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.concat_ws("->", "source", "type", "target").alias("id"), "source", "target", "type", "weight")
