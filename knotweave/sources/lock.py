"""Lock files: JSON to one row per input, read as variants, so that a value may have either of its forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(follow: Column) -> Column:
    """A follow (variant) as an array: a list of names, or one name."""
    one = F.try_variant_get(follow, "$", "string")
    return F.coalesce(F.try_variant_get(follow, "$", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.expr("cast(array() as array<string>)"))


def parse_lock(files: DataFrame) -> DataFrame:
    """name, url, rev, nar_hash, type, inputs of every input in the lock files (text), by name; malformed ones give none.

    ``root`` is no input. A follow is a name or a list of names; names that aren't in
    the lock, and the input's own, are dropped.
    """
    lock = files.select(F.try_variant_get(F.try_parse_json("text"), "$.nodes", "map<string,variant>").alias("nodes")).where("nodes is not null")
    rows = lock.select(F.explode("nodes").alias("name", "n"), F.map_keys("nodes").alias("known")).where("name <> 'root'")
    part = lambda where, key: F.try_variant_get("n", f"$.{where}.{key}", "string")
    owner = F.concat(part("locked", "type"), F.lit(":"), part("locked", "owner"), F.lit("/"), part("locked", "repo"))
    given = F.coalesce(F.try_variant_get("n", "$.inputs", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    follows = F.transform_values(given, lambda k, v: F.filter(_names(v), lambda x: F.array_contains(F.col("known"), x) & (x != F.col("name")) & (x != "root")))
    return rows.select(
        "name",
        F.coalesce(part("locked", "url"), part("original", "url"), owner, F.lit("")).alias("url"),
        F.coalesce(part("locked", "rev"), F.lit("")).alias("rev"),
        F.coalesce(part("locked", "narHash"), F.lit("")).alias("nar_hash"),
        F.coalesce(part("locked", "type"), F.lit("")).alias("type"),
        F.map_filter(follows, lambda k, v: F.size(v) > 0).alias("inputs"),
    ).orderBy("name")
