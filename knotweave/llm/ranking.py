"""Places in a total order, counted without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.text import checkpointed

#: monotonically_increasing_id keeps a row's place within its partition in so many low bits.
_LOW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """``rows`` with place (long, from 0) in ``order`` and, with ``weight`` (a column of longs), before: the weights of all earlier rows.

    Rows are dealt into ranges of ``order`` and sorted there; only one row a partition
    (how many rows, how much weight) meets in one task. ``order`` should tell rows apart
    (an id last), so that no value, however frequent, fills a range of its own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged).withColumn("_part", F.shiftright("_at", _LOW_BITS))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(weight or F.lit(0)).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "0") for c in ("_n", "_w")))
    out = ranged.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_n0") + F.col("_at").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    if not weight:
        return out.select(*rows.columns, "place")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("before", F.col("_w0") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).select(*rows.columns, "place", "before")
