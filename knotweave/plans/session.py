"""Session helpers: the shared folder, and cutting lineage through it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session may do without the setting; on a cluster a machine's own
    folder would lose what its executors need.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(top)
    return top.rstrip("/")


@contextmanager
def compressed(spark: SparkSession, factor: int = 20) -> Iterator[None]:
    """Plans made inside take files for ``factor`` times their size: hashes of rows by the million fit in a few MB of Parquet, and would be broadcast through the driver for that."""
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(float(before), float(factor))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later plans start there, and lost executors don't cost its lineage."""
    shared_top(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a table: computed once, where a checkpoint computes its rows and then once more to write them."""
    spark = df.sparkSession
    path = f"{shared_top(spark)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a table, and how many rows it has; counting them reads no more than the files' ends."""
    back = table(df)
    return back, back.count()
