"""What must not grow: rows that rounds carry, tasks that read one file, sorts and aggregates that hold a whole file."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from knotweave.extract.registry import extract
from knotweave.operators import incremental, traverse
from knotweave.operators.substring import containing
from knotweave.plans import session


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merkle_rounds_carry_only_linked_paths(spark, monkeypatch):
    sizes = []

    def recorded(df):
        back, rows = session.written(df)
        sizes.append(rows)
        return back, rows

    monkeypatch.setattr(incremental, "cut", lambda df: recorded(df)[0])
    monkeypatch.setattr(incremental, "written", recorded, raising=False)
    hashes = spark.range(1000).select(F.concat(F.lit("lone"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("ast_hash"))
    hashes = hashes.union(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("x", "4"), ("y", "5")], "path string, ast_hash string"))
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "k"), ("x", "y"), ("y", "x"), ("x", "c"), ("a", "nowhere")], "path string, target string")
    known = spark.createDataFrame([("k", "K"), ("unasked", "U")], "path string, merkle_hash string")
    got = {r["path"]: r["merkle_hash"] for r in incremental.merkle(hashes, imports, known).collect()}
    h = lambda *parts: sha256("".join(parts).encode()).hexdigest()
    c = h("3")
    b = h("2", c)
    assert len(got) == 1005 and got["lone7"] == h(sha256(b"7").hexdigest())
    assert {k: got[k] for k in "abcxy"} == {"a": h("1", *sorted(["K", b])), "b": b, "c": c, "x": h("4", *sorted([c, "5"])), "y": h("5", "4")}
    assert max(sizes) < 20


def test_merkle_without_imports(spark):
    hashes = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, ast_hash string")
    got = incremental.merkle(hashes, spark.createDataFrame([], "path string, target string"))
    assert {tuple(r) for r in got.collect()} == {("a", sha256(b"1").hexdigest()), ("b", sha256(b"2").hexdigest())}


def test_matches_of_single_texts_are_not_aggregated(spark):
    needles = spark.createDataFrame([("abc",), ("b",), ("zz",)], "needle string")
    single = spark.createDataFrame([(1, "abc"), (2, "xabcx"), (3, None), (4, "b")], "key int, text string")
    out = containing(single, needles)
    assert {tuple(r) for r in out.collect()} == {(1, "abc"), (1, "b"), (2, "abc"), (2, "b"), (4, "b")} and out.count() == 5
    assert "Aggregate" not in _plan(out)
    several = spark.createDataFrame([(1, "abc"), (1, "abcd"), (1, "abc"), (None, "abc"), (None, "xabc"), (2, "abc"), (2, "abc")], "key int, text string")
    assert sorted(map(str, (tuple(r) for r in containing(several, needles).collect()))) == sorted(map(str, [(k, n) for k in (1, 2, None) for n in ("abc", "b")]))


def test_files_of_one_partition_are_parsed_by_several_tasks(spark):
    files = spark.range(64).select(F.concat(F.lit("m/"), "id", F.lit(".nix")).alias("path"), F.lit("nix").alias("lang"), F.lit("{ imports = [ ./x.nix ]; }\n").alias("text")).coalesce(1)
    rows = extract(files).where("kind = 'edge'").select("path", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 64 and len({r["task"] for r in rows}) > 1


def test_adjacency_sorts_once(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 2.0), ("e0", "a", "b", 3.0), ("e2", "b", "a", 1.0)], "id string, source string, target string, weight double")
    out = traverse.adjacency(edges)
    assert {tuple(r) for r in out.collect()} == {("a", "b", "e0", 2.0), ("b", "a", "e2", 1.0)}
    assert {tuple(r) for r in traverse.adjacency(edges, reverse=True).collect()} == {("b", "a", "e0", 2.0), ("a", "b", "e2", 1.0)}
    plan = _plan(traverse.adjacency(edges))
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
