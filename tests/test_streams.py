"""File events and keyed state on streams, with restarts, and listings of trees."""

import os

from pyspark.sql import functions as F

from knotweave.operators import incremental
from knotweave.sources.files import listing
from knotweave.sources.tree import files, tree
from knotweave.streaming.source import FileEvents, ListingReader, compared
from knotweave.streaming.states import DECISIONS, EVENTS, decisions


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_tree(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    for name in ("x.nix", "d/y.nix", "d/.config/app/z.py", ".git/no.nix", ".hidden/no.nix", "d/e/f/g/h/deep.nix", "node_modules/m/no.py", "read.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("{ }")
    (root / "empty").mkdir()
    assert rows(files(spark, str(root)), "path", "length") == sorted((p, 3) for p in ("x.nix", "d/y.nix", "d/.config/app/z.py", "d/e/f/g/h/deep.nix", "read.txt"))
    assert rows(files(spark, f"file://{tmp_path}/a+b (c)/d".replace(" ", "%20")), "path") == [(".config/app/z.py",), ("e/f/g/h/deep.nix",), ("y.nix",)]
    assert rows(tree(spark, str(root / "empty"))) == []
    assert rows(listing(spark, str(root)), "path") == [("d/.config/app/z.py",), ("d/e/f/g/h/deep.nix",), ("d/y.nix",), ("x.nix",)]


def test_file_events_neither_lose_nor_repeat_over_restarts(spark, tmp_path):
    root, state, sink = tmp_path / "repo", str(tmp_path / "state"), str(tmp_path / "sink")
    (root / "sub").mkdir(parents=True)
    spark.dataSource.register(FileEvents)

    def run():
        stream = spark.readStream.format("file_events").option("root", str(root)).option("state", state).option("parts", 3).option("suffixes", "nix,py").load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", sink).trigger(once=True).start().awaitTermination()
        return rows(spark.read.parquet(sink), "path", "event") if os.path.isdir(sink) and any(n.endswith(".parquet") for n in os.listdir(sink)) else []

    (root / "a.nix").write_text("1")
    (root / "sub/b.py").write_text("2")
    (root / "other.txt").write_text("no")
    first = run()
    assert first == [("a.nix", "new"), ("sub/b.py", "new")]
    assert run() == first  # nothing changed
    (root / "a.nix").write_text("longer")
    (root / "sub/b.py").unlink()
    (root / "c.nix").write_text("3")
    second = run()
    assert second == sorted([*first, ("a.nix", "changed"), ("sub/b.py", "deleted"), ("c.nix", "new")])
    assert run() == second


def test_a_batch_sent_again_gives_the_same_events(tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a").write_text("x")
    reader = ListingReader({"root": str(tmp_path / "r"), "state": str(tmp_path / "s")})
    start = reader.latestOffset()
    (tmp_path / "r/b").write_text("y")
    end = reader.latestOffset()
    assert start != end == reader.latestOffset()
    (tmp_path / "r/a").unlink()  # later changes don't matter to a batch between two offsets
    events = lambda s, e: sorted(x[:2] for p in reader.partitions(s, e) for x in reader.read(p))
    assert events(start, end) == [("b", "new")] and events(reader.initialOffset(), end) == [("a", "new"), ("b", "new")]
    reader.commit(end)
    last = reader.latestOffset()
    assert events(end, last) == [("a", "deleted")]
    assert list(compared({"p": [1, 1]}, {"p": [1, 2]})) == [("p", "changed", 1, 2)]


def test_keyed_state_decides_as_the_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(events):
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
        decisions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return {r.seq: (r.path, r.decision, r.dirty) for r in spark.read.schema(DECISIONS).parquet(str(tmp_path / "out")).collect()}

    one = run([("a", 1, "new", "c1", "s1", True), ("b", 2, "new", "c2", "s2", True), ("n", 3, "new", "c3", "s3", False), ("e", 4, "new", None, None, True)])
    assert one == {1: ("a", "ast_changed", True), 2: ("b", "ast_changed", True), 3: ("n", "not_relevant", False), 4: ("e", "read_error", False)}
    later = [("a", 5, "changed", "c1", "s1", True), ("b", 6, "changed", "c2x", "s2", True), ("a", 9, "changed", "c9", "s9", True), ("b", 8, "deleted", None, None, True), ("b", 10, "new", "c2x", "s2", True)]
    two = run(later)  # a new query over the same checkpoint
    assert {k: v[1] for k, v in two.items() if k > 4} == {5: "unchanged_content", 6: "formatting_only", 9: "ast_changed", 8: "deleted", 10: "ast_changed"}
    assert run([("b", 7, "changed", "late", "late", True), ("x", 11, "deleted", None, None, True)])[7][1] == "superseded"
    # the same by the batch operator, against the state after the first batch
    text = F.col("content")
    states = spark.createDataFrame([("a", "1", "s1"), ("b", "2", "s2")], "path string, content string, ast_hash string").withColumn("content_hash", incremental.content_hash(text))
    fresh = spark.createDataFrame([("a", "1", "s1", True), ("b", "2x", "s2", True), ("c", "9", "s9", True), ("n", "3", "s3", False), ("e", None, None, True)], "path string, content string, ast_hash string, relevant boolean")
    batch = dict(rows(incremental.decide(fresh, states)))
    assert batch == {"a": two[5][1], "b": two[6][1], "c": one[1][1], "n": one[3][1], "e": one[4][1]}
