"""Two-pass indexing, batches of changes, and the verbs over an index."""

import json

from pyspark.sql import functions as F

from knotweave.engine import GraphEngine
from knotweave.extract.nix import input_urls
from knotweave.extract.python import registered_tools
from knotweave.extract.registry import listed
from knotweave.operators import incremental, indexing, lookup, usage
from knotweave.plans.store import current, write_json
from knotweave.sources.files import listing, texts
from knotweave.streaming.debounce import run_updates

FILES = {
    "top.nix": '{ imports = [ ./mid.nix ];\n  home.file.".local/go.py".source = ./go.py;\n}\n',
    "mid.nix": "{ pkgs, ... }:\n{ imports = [ ./leaf.nix ];\n  home.packages = [ pkgs.ripgrep pkgs.fd ];\n}\n",
    "leaf.nix": "{ services.lamp.enable = true; }\n",
    "go.py": "import os\n\n\ndef go():\n    return os.getcwd()\n",
    "never.py": "x = 1\n",
}
LOCK = {"nodes": {"root": {"inputs": {"a": "a"}}, "a": {"locked": {"rev": "r1", "type": "github", "owner": "o", "repo": "p"}, "inputs": {"b": "b"}}, "b": {"original": {"url": "u:b"}}}}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()} if len(columns) > 1 else {r[0] for r in df.select(*columns).collect()}


def test_index_update_and_verbs(spark, tmp_path):
    repo, store = tmp_path / "repo", str(tmp_path / "store")
    write(repo, FILES)
    listed_now = lambda: listing(spark, str(repo))
    locks = spark.createDataFrame([(json.dumps(LOCK),)], "text string")
    generation, index = indexing.index(listed_now(), ["python"], locks).publish(store)
    assert generation == 1
    assert rows(index.states, "path") == set(FILES) - {"never.py"}  # the second pass knows what the first one's graph asks for
    assert rows(index.nodes.where("path is not null"), "path") >= set(FILES) - {"never.py"}
    assert rows(index.packages, "attribute") == {"pkgs.ripgrep", "pkgs.fd"} and rows(index.inputs, "name") == {"a", "b"}
    ids = rows(index.nodes, "id")
    assert {"flake_input:a", "flake_input:b", "package:pkgs.fd", "nix:leaf.nix"} <= ids and index.edges.where("target not in ('x')").count() == index.edges.count()
    assert ("flake_input:a", "flake_input:b") in rows(index.edges.where("type = 'references'"), "source", "target")
    assert rows(index.edges.select(F.col("target").alias("t")), "t") <= ids
    old = {r.path: r for r in index.states.collect()}
    assert not any(r.dirty for r in old.values()) and all(r.merkle_hash for r in old.values())

    files = texts(listed_now()).join(listed_now().select("path", "length"), "path")
    engine = GraphEngine.of(index, files, generation)
    assert [r.attribute for r in engine.packages("RIP").collect()] == ["pkgs.ripgrep"] and engine.packages(limit=1).first().attribute == "pkgs.fd"
    assert engine.package("pkgs.fd").count() == 1 and engine.package("none").count() == 0
    assert engine.input("a").first().rev == "r1" and [r.name for r in engine.inputs().collect()] == ["a", "b"]
    hit = engine.find("go", lang="python").where("type = 'py_function'").first()
    assert hit.snippet == "\n\ndef go():\n    return os.getcwd()"
    s = engine.status().first()
    assert s.generation_id == 1 and s.total_nodes == len(ids) and s.sync_progress is None and s.queries_served == 7
    r = engine.report().first()
    assert r.queries_by_tool["packages"] == 2 and r.files_served == 1 and r.bytes_not_reread == len(FILES["go.py"]) and r.tokens_estimated_saved == len(FILES["go.py"]) // 4

    for _ in range(2):  # a log outlives its engine; what was logged isn't logged again
        engine.log(str(tmp_path / "log"))
    GraphEngine.of(index, files, generation).log(str(tmp_path / "log"))
    log = usage.logged(spark.read.parquet(str(tmp_path / "log")), index.nodes, files).first()
    assert (log.queries_served, log.queries_by_tool, log.files_served, log.bytes_not_reread) == (sum(engine.served.values()), engine.served, r.files_served, r.bytes_not_reread)

    # one file's imports change, one is only reformatted, one goes
    write(repo, {"leaf.nix": "{ services.lamp.enable = false; services.fan.enable = true; }\n", "mid.nix": FILES["mid.nix"] + "# a word\n"})
    (repo / "go.py").unlink()
    batch = spark.createDataFrame([("leaf.nix",), ("mid.nix",), ("go.py",), ("never.py",), ("top.nix",)], "path string")
    changed = listed_now().join(batch, "path", "left_semi")
    after, decided = indexing.update(index, changed, spark.createDataFrame([("go.py",)], "path string"), ["python"])
    assert rows(decided, "path", "decision") == {("leaf.nix", "ast_changed"), ("mid.nix", "formatting_only"), ("go.py", "deleted"), ("never.py", "not_relevant"), ("top.nix", "unchanged_content")}
    new = {r.path: r for r in after.states.collect()}
    assert set(new) == {"top.nix", "mid.nix", "leaf.nix"} and {p for p, r in new.items() if r.dirty} == {"top.nix", "mid.nix"}
    assert all(new[p].merkle_hash != old[p].merkle_hash for p in new) and new["mid.nix"].content_hash != old["mid.nix"].content_hash and new["mid.nix"].ast_hash == old["mid.nix"].ast_hash
    whole = {r.path: r for r in indexing.index(listed_now(), ["python"], locks).states.collect()}
    assert all((whole[p].merkle_hash, whole[p].content_hash) == (new[p].merkle_hash, new[p].content_hash) for p in new)
    assert "py_func:go.py:go" not in rows(after.nodes, "id") and "nix_option:services.fan.enable" in rows(after.nodes, "id")

    # the same batch as a stream; sent again, it changes nothing
    (tmp_path / "events").mkdir()
    (tmp_path / "events/1.json").write_text(json.dumps({"items": ["leaf.nix", "mid.nix", "go.py"]}))
    stream = spark.readStream.schema("items array<string>").json(str(tmp_path / "events"))
    apply = indexing.consume(store, listed_now, ["python"])
    run_updates(stream, apply, str(tmp_path / "state")).awaitTermination()
    generation, stored = indexing.load(spark, store)
    assert generation == 2 and rows(incremental.dirty_files(stored.states), "path") == {"top.nix", "mid.nix"}
    apply(spark.createDataFrame([(["leaf.nix", "go.py"],)], "items array<string>"), 1)
    assert current(spark, store)[0] == 2
    refreshed = engine.refresh(listed_now, store, ["python"], locks)
    assert refreshed.generation == 3 and rows(refreshed.index.states, "path") == {"top.nix", "mid.nix", "leaf.nix"}
    write_json(refreshed.status(), str(tmp_path / "status"))
    assert spark.read.json(str(tmp_path / "status")).first().generation_id == 3


def test_empty_repository(spark):
    none = spark.createDataFrame([], "path string, lang string, tier int, length long, modified timestamp, content binary")
    index = indexing.index(none, ["python"])
    assert all(f.count() == 0 for f in index.frames().values())
    after, decided = indexing.update(index, none, spark.createDataFrame([("x.nix",)], "path string"), ["python"])
    assert after.states.count() == 0 and rows(decided, "path", "decision") == {("x.nix", "deleted")}


def test_flags_values_and_snippets(spark):
    states = spark.createDataFrame([("a", False), ("b", True)], "path string, dirty boolean")
    assert rows(incremental.mark(states, states.where("path = 'a'")), "path", "dirty") == {("a", True), ("b", True)}
    assert rows(incremental.mark(states, states, dirty=False), "dirty") == {False}
    values = spark.createDataFrame([("k", "config.lamp.on", "ok"), ("m", "other", "ok")], "key string, expr string, status string")
    paths = spark.createDataFrame([("mods/lamp.nix",), ("",)], "path string")
    assert rows(indexing.stale_values(values, paths), "key", "status") == {("k", "stale"), ("m", "ok")}
    assert rows(incremental.invalidate_all(values), "status") == {"stale"}
    text = spark.createDataFrame([("1\n2\n3\n4\n5\n6\n", x) for x in (1, 3, 6, 7, 0, None)] + [("x" * 300, 1), (None, 1), ("", 1)], "text string, line int")
    got = [r[0] for r in text.select(lookup.snippet(F.col("text"), F.col("line"))).collect()]
    assert got == ["1\n2\n3", "1\n2\n3\n4\n5", "4\n5\n6", None, None, None, "x" * 240, None, None]


def test_tool_parts(spark):
    part = lambda tool, **state: json.dumps({"type": "tool", "tool": tool, "state": state})
    log = [
        ("s", 1, 1, part("srv_nav_find", status="completed", input={"query": "q" * 70, "limit": 3}, output="x" * 9, time={"start": 10, "end": 25})),
        ("s", 2, 2, '{"type": "text", "text": "no \\"tool\\""}'), ("s", 3, 3, "not json, a \"tool\""), ("s", 4, 4, part("read", output="y" * 40)),
        ("s", 5, 5, part("srv_nav_open", status="error", output="e" * 400, time={"start": 0, "end": 5})), ("t", 1, 6, None),
    ]
    parts = usage.tool_parts(spark.createDataFrame(log, "session string, ts long, call_id long, data string"))
    assert rows(parts, "call_id", "seq_index", "tool", "out_tokens", "status") == {(1, 0, "srv_nav_find", 2, "completed"), (4, 1, "read", 10, "unknown"), (5, 2, "srv_nav_open", 100, "error")}
    nav = {r.tool: r for r in usage.nav_calls(parts, "srv_", "nav_").collect()}
    assert set(nav) == {"find", "open"} and nav["find"].label == "q" * 57 + "..." and nav["find"].latency_ms == 15.0 and nav["open"].latency_ms is None and len(nav["open"].error) == 300


def test_listed(spark):
    files = spark.createDataFrame([("a.py", "@app.tool()\ndef one(): pass\n@tool()\ndef two(): pass\n"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    assert rows(listed(files, registered_tools), "path", "value") == {("a.py", "one")}
    flake = '{ inputs.a.url = "u:a"; inputs = { b = { url = "u:b"; flake = false; }; c.url = "u:${x}"; d.inputs.e.url = "u:e"; }; outputs = { self }: { url = "no"; }; }'
    assert input_urls(flake) == ["a:u:a", "b:u:b"] and input_urls("{ (") == [] and input_urls("") == []
