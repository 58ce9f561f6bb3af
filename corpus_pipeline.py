"""A training corpus from raw documents: five stages, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in
the shared folder and reads them back, which also cuts the lineage. No stage's rows
can be expressed in SQL as a whole, so ORACLE_SQL is None and the tests compare with
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.llm.decontaminate import drop_leaks
from knotweave.llm.language_id import keep_identified
from knotweave.llm.near_dup import near_duplicates
from knotweave.llm.packing import pack_documents
from knotweave.llm.pii import pseudonymise
from knotweave.llm.queries import pii_key, tokenizer_file
from knotweave.llm.text import checkpointed, shared_dir

#: Similarity in percent from which documents are near copies.
NEAR = 80

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language claims go (null, without a letter, or with a low score)."""
    return keep_identified(docs)


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the least doc_id; rows without one come last.

    A row's key in the comparison is its doc_id. Texts without a doc_id, and the
    further texts of a doc_id that has several, get a 62-bit hash from 2**62 on as key;
    rows of one key are copies. Rows with neither doc_id nor text are no copies and stay.
    """
    key, head = _free(docs, "near_key"), _free(docs, "near_head")
    repeated = checkpointed(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        marked = docs.withColumn(head, F.lit(None).cast("long"))
    else:
        heads = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias(head))
        marked = docs.join(checkpointed(heads), "doc_id", "left")
    own = F.col("doc_id").isNotNull() & (F.col(head).isNull() | (F.col(head) == F.xxhash64("text")))
    dealt = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    rows = marked.withColumn(key, F.when(own, F.col("doc_id").cast("long")).when(F.col("doc_id").isNotNull() | F.col("text").isNotNull(), dealt))
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=NEAR)
    copies = checkpointed(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct())
    # only rows whose key may stand twice are looked through for it
    twice = F.col(head).isNotNull() | (F.col("doc_id").isNull() & F.col("text").isNotNull())
    left = rows.where(~twice).union(rows.where(twice).dropDuplicates([key]))
    return left.join(copies, key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those with null or empty text, and all if there is no item, stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms; n_chars follows the text. No row goes; null texts stay null."""
    count = "n_pii"
    while count in docs.columns:
        count += "_"
    out = pseudonymise(docs, pii_key(spark), count=count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts are their end id, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("language", language),
    ("near_dup", near_dup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
