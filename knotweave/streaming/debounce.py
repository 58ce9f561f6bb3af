"""Debounced batches of events: session windows, batch and streaming alike.

An event opens or extends its key's batch; a batch ends when nothing came for the
gap. On a stream a watermark decides when a batch is final, so the last one is only
sent when a later event (or a heartbeat row) moves the watermark past its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: More items than this in one batch mark a bulk change.
BULK = 50


def batches(events: DataFrame, key: str, ts: str, gap: str, item: str, watermark: str | None = None) -> DataFrame:
    """key, first_ts, last_ts, items (sorted, distinct), bulk for each batch.

    ``key`` must be a column that isn't constant to the optimiser (a root folder, a
    user): Spark refuses session windows without a grouping column on streams.
    """
    source = events.withWatermark(ts, watermark) if watermark else events
    grouped = source.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_sort(F.collect_set(item)).alias("items"))
    return grouped.select(key, "first_ts", "last_ts", "items", (F.size("items") > BULK).alias("bulk"))


def merge_pending(pending: DataFrame, git_batch: DataFrame) -> DataFrame:
    """A batch that comes at once absorbs what is pending: one sorted, distinct list (path)."""
    return pending.select("path").union(git_batch.select("path")).agg(F.array_sort(F.collect_set("path")).alias("items")).withColumn("bulk", F.size("items") > BULK)


def poll_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, event (new, changed, deleted) between two listings (path, mtime)."""
    both = before.select("path", F.col("mtime").alias("was")).join(after.select("path", F.col("mtime").alias("is_now")), "path", "full_outer")
    event = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "deleted").when(F.col("was") != F.col("is_now"), "changed")
    return both.select("path", event.alias("event")).where(F.col("event").isNotNull())


def run_updates(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Send each micro-batch of debounced batches to ``update``; restarts continue from ``checkpoint``."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
