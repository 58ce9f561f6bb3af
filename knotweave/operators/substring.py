"""Which texts hold which needles: an equi-join on each needle's rarest n-gram, and an exact test of what meets there.

Every text gives its distinct runs of three characters; of a needle only the run that the
fewest texts have is a key, so that a text meets few needles. Needles of one or two
characters are keys as they are, against runs of their length, which are only taken when
there are such needles. Neither side is compared with all of the other, and no part of
a text is spelt out beyond its runs of three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotweave.plans.session import written
from knotweave.plans.store import side

WIDTH = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array())


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """key, needle of all pairs in which the text of ``texts`` (key, text) holds the needle of ``needles`` (needle), each once; empty needles and nulls meet nothing."""
    needles, n = written(needles.where("needle <> ''").select("needle").distinct())
    short = sorted(r[0] for r in needles.select(F.least(F.length("needle"), F.lit(WIDTH)).alias("w")).distinct().collect())  # 1, 2, 3 at most
    spark, out = texts.sparkSession, None
    # texts that lie in one file are dealt out, as their runs and matches are many times their size
    texts, _ = written(texts.where("text is not null").select("key", "text").distinct())
    for width in short:
        mine = needles.where(F.least(F.length("needle"), F.lit(WIDTH)) == width)
        asked, keys = written(mine.select(F.explode(grams(F.col("needle"), width)).alias("gram")).distinct())
        cells = texts.select("key", "text", F.explode(grams(F.col("text"), width)).alias("gram")).join(side(asked, keys), "gram", "left_semi")
        frequency = cells.groupBy("gram").agg(F.count("*").alias("n"))
        # a run that no text has rules its needle out
        counted = mine.select("needle", F.explode(grams(F.col("needle"), width)).alias("gram")).join(frequency, "gram", "left").groupBy("needle")
        rarest = counted.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("needle", F.col("r.gram").alias("gram"))
        rarest, rows = written(rarest)
        met = cells.join(side(rarest, rows), "gram").where(F.contains("text", F.col("needle"))).select("key", "needle")
        out = met if out is None else out.union(met)
    if out is None:
        return spark.createDataFrame([], f"key {texts.schema['key'].dataType.simpleString()}, needle string")
    # a text meets a needle by its one rarest run, so that pairs can only repeat where a key has several texts
    several, n = written(texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key")))
    if not n:
        return out
    at = out["key"].eqNullSafe(side(several, n)["_key"])
    return out.join(side(several, n), at, "left_anti").union(out.join(side(several, n), at, "left_semi").distinct())
