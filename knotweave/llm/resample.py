"""Importance resampling towards a target distribution, by n-gram buckets of a position table.

Every word of every document becomes a row (document, position, word); a window over a
document's positions looks ahead with lead(), so that each row sees the runs of 1, 2, ...
words that start there. Runs are hashed into buckets and the table of bucket numbers is
written to the shared folder once, where it is read twice: to count buckets over the whole
corpus, and to join each bucket's gain (how much likelier it is in the target than in
the corpus) and add up a document's. Documents are drawn by weight plus Gumbel noise,
which a keyed digest of doc_id gives, so that a draw can be repeated.

Texts are shuffled once, to documents dealt by a hash of id and text; rows of words
then stay where they are. What is broadcast is the gains: one row a bucket. Ranks are
counted by ranges of scores, not in one task.

Cases: null and empty texts have no feature, weight 0, and are no candidates for the draw;
a null doc_id is drawn as the word ``null`` would be; rows of one doc_id are rows of their
own, and repeated rows are as often counted and drawn as they stand there; ties in score go
to the smaller doc_id; an empty target or corpus counts nothing; a very long text is one
document's run of rows, which the window spills where it must; other columns are not looked at.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.ranking import numbered
from knotweave.llm.text import checkpointed, shared_dir

#: Words: runs of digits, ASCII letters (small after folding) and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def positions(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """key, nth, doc_id (together one document) and b1, b2, ... of every word: buckets of the runs that start there, null where the text ends first.

    A document without words has one row without buckets.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the key tells rows apart but for repeated ones, which are numbered
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")))
    table = keyed.select("key", "nth", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    along = Window.partitionBy("key", "nth").orderBy("pos")
    ahead = table.withColumns({f"w{i}": F.lead("word", i).over(along) for i in range(1, orders)})
    run = lambda n: F.concat(F.col("word"), *(x for i in range(1, n) for x in (F.lit(" "), F.col(f"w{i}"))))  # noqa: E731  null past the end
    return ahead.select("key", "nth", "doc_id", *((F.crc32(run(n)) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)))


def _counted(table: DataFrame, orders: int, name: str) -> DataFrame:
    each = table.select(F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, gain (long) of every bucket, from the position tables of corpus and target; both smoothed by one in each bucket."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(_counted(corpus, orders, "s"), "bucket", "left").join(_counted(target, orders, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = checkpointed(both)
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda x: F.lit(float(x))
    ratio = (F.col("t").cast("double") + 1) * d(total["s"] + buckets) / ((F.col("s").cast("double") + 1) * d(total["t"] + buckets))
    return both.select(F.col("bucket").cast("int").alias("bucket"), F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, orders: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null where not drawn), all long, of every row of ``docs``.

    ``target``: rows with a text. Of the documents with at least ``min_words`` words the
    ``percent`` in a hundred with the highest scores are drawn.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "positions")
    positions(docs, orders, buckets).write.parquet(folder)
    table = spark.read.parquet(folder)
    gain = gains(table, positions(target.select(F.lit(0).alias("doc_id"), "text"), orders, buckets), orders, buckets)
    gain = checkpointed(gain)  # one row a bucket
    columns = [f"b{n}" for n in range(1, orders + 1)]
    added = table
    for c in columns:
        added = added.join(F.broadcast(gain.select(F.col("bucket").alias(c), F.col("gain").alias(f"g_{c}"))), c, "left")
    total = lambda xs: reduce(Column.__add__, xs)
    each = added.groupBy("key", "nth", "doc_id").agg(
        F.sum(total(F.coalesce(f"g_{c}", F.lit(0)) for c in columns)).alias("weight"), total(F.count(c) for c in columns).alias("n_features"), F.count("b1").alias("n_words")
    )
    scored = checkpointed(each.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "n_words"))
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.where(fit).count() // 100
    placed = numbered(scored.where(fit), [F.desc("score"), F.asc("doc_id")])
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).union(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(out))


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, see :func:`resample`."""
    return docs.join(resample(docs, target, **options).where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
