"""The thin ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.llm.decontaminate import find_leaks
from knotweave.llm.hard_negatives import mine
from knotweave.llm.language_id import identify
from knotweave.llm.license_scan import scan_licenses
from knotweave.llm.near_dup import near_duplicates
from knotweave.llm.packing import pack_documents
from knotweave.llm.pii import pseudonymise
from knotweave.llm.quality import score_quality
from knotweave.llm.resample import resample
from knotweave.llm.sharding import shard_documents
from knotweave.llm.substring_dedup import remove_repeats
from knotweave.llm.text import documents, shared_dir
from knotweave.llm.token_files import read_token_files, write_token_files
from knotweave.llm.topk import nearest


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), folds=3, held_out=1)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, held_out=0)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def tokenizer_file(name: str) -> str:
    """Where the installed public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(
        documents(spark, sf_dir), shared_dir(spark, "token-files"), tokenizer_file("byte_bpe_50k.json"), end_id=2
    )
    return read_token_files(spark, files)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_key(spark: SparkSession) -> str:
    """The secret that a deployment sets in its session; the queries fall back on one that is the same everywhere."""
    return spark.conf.get("spark.knotweave.pii.key", "knotweave-demo-key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256.0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=24, law="rows")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), orders=3, buckets=10_000, percent=5, min_words=20, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_packing": op4_packing,
        "op5_near_dup": op5_near_dup,
        "op6_quality": op6_quality,
        "op7_topk": op7_topk,
        "op8_token_files": op8_token_files,
        "op9_decontamination": op9_decontamination,
        "op10_pii": op10_pii,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_sharding": op12_sharding,
        "op13_resample": op13_resample,
    }


# DuckDB's words are the same: [^\x20\x09-\x0D]+ of the whole text.
_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, sha256(array_to_string(w[p:p+34], ' ')) AS k FROM s),
r AS (SELECT doc_id, p FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, p + i AS q FROM r, (SELECT unnest(range(35)) AS i)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.q) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_NEAR_DUP_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_MINE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# CRC-32 byte by byte over its table, which is made from the polynomial.
_CRC_TABLE = """t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(0, 256) r(i)))"""


def _crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST(('0x' || h) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295)"


def _curve_sql(axes: int, bits: int) -> str:
    """CTEs that end in curve(doc_id, size, text_crc32, curve), from q with the steps x0, x1, ..."""
    out, last = [], "q"
    for b in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(axes):
            low = b - 1
            new = f"CASE WHEN x{i} & {b} <> 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0"
            if i:
                new += f", CASE WHEN x{i} & {b} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}"
            out.append(f"h{len(out)} AS (SELECT * REPLACE ({new}) FROM {last})")
            last = f"h{len(out) - 1}"
    for i in range(1, axes):
        out.append(f"g{i} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {last})")
        last = f"g{i}"
    turn = "0"
    for b in (1 << k for k in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x{axes - 1} & {b} <> 0 THEN {b - 1} ELSE 0 END)"
    out.append(f"u AS (SELECT *, {turn} AS turn FROM {last})")
    places = [(k, i) for k in range(bits - 1, -1, -1) for i in range(axes)]
    index = " + ".join(f"(((xor(x{i}, turn) >> {k}) & 1) << {len(places) - 1 - n})" for n, (k, i) in enumerate(places))
    out.append(f"curve AS (SELECT doc_id, size, text_crc32, CAST({index} AS BIGINT) AS curve FROM u)")
    return ",\n".join(out)


def _text_cell_sql(column: str) -> str:
    common = f"(SELECT max(i) FROM m0, range(0, 100) r(i) WHERE left(least_{column}, i) = left(most_{column}, i))"
    return f"coalesce(CAST('0x' || rpad(substr(hex(encode({column})), 2 * {common} + 1, 4), 4, '0') AS BIGINT) + 1, 0)"


_SHARD_SQL = f"""
WITH {_CRC_TABLE},
m AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, t),
m0 AS (SELECT min(lang) AS least_lang, max(lang) AS most_lang, min(source) AS least_source, max(source) AS most_source, min(size) AS least, count(*) AS n FROM m),
k AS (SELECT *, size - (SELECT least FROM m0) + 1 AS v, length(bin(size - (SELECT least FROM m0) + 1)) AS b FROM m),
c AS (SELECT *, {_text_cell_sql("lang")} AS c0, {_text_cell_sql("source")} AS c1, (b - 1) * 256 + CASE WHEN b > 9 THEN v >> (b - 9) ELSE v << (9 - b) END - 256 + 1 AS c2 FROM k),
""" + ",\n".join(
    f"s{i} AS (SELECT c{i}, (coalesce(sum(count(*)) OVER (ORDER BY c{i} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 32) // (SELECT n FROM m0) AS x{i} FROM c GROUP BY c{i})" for i in range(3)
) + f""",
q AS (SELECT doc_id, size, text_crc32, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, CAST(x2 AS BIGINT) AS x2 FROM c JOIN s0 USING (c0) JOIN s1 USING (c1) JOIN s2 USING (c2)),
{_curve_sql(3, 5)},
p AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id) - 1 AS place FROM curve),
z AS (SELECT *, (place * 24) // (SELECT n FROM m0) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
 CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM z
"""


def _runs_sql(table: str, key: str) -> str:
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"(SELECT {key} AS doc_id, regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"
    return " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda p: array_to_string(w[p:p+{n - 1}], ' '))) AS f FROM {words} WHERE len(w) >= {n}" for n in (1, 2, 3))


_RESAMPLE_SQL = f"""
WITH {_CRC_TABLE},
a AS ({_runs_sql("documents", "doc_id")}),
b AS ({_runs_sql("benchmark", "0")}),
h AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM a UNION SELECT f FROM b), t),
s AS (SELECT bucket, count(*) AS s FROM a JOIN h USING (f) GROUP BY bucket),
x AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (f) GROUP BY bucket),
n AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS s, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM x) AS t),
g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(x.t, 0) + 1) * (n.s + 10000) / ((coalesce(s.s, 0) + 1) * (n.t + 10000)))) AS gain
  FROM range(0, 10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN x USING (bucket), n),
w AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM a JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
d AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE n_features >= 57)
SELECT d.*, CAST(CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END AS BIGINT) AS rank FROM d LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op2_substring_dedup": _SUBSTRING_SQL,
        "op5_near_dup": _NEAR_DUP_SQL,
        "op7_topk": _TOPK_SQL,
        "op11_hard_negatives": _MINE_SQL,
        "op12_sharding": _SHARD_SQL,
        "op13_resample": _RESAMPLE_SQL,
    }
