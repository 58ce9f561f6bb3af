"""Files, lock files, extraction, debounced streams, and the oracles of the catalogue."""

import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from knotweave.extract import kdl, nix, python
from knotweave.extract.registry import edge_id, extract, graph_rows
from knotweave.plans.catalog import ORACLES, QUERIES
from knotweave.sources.files import listing, relevant, single, texts, watched
from knotweave.sources.lock import parse_lock
from knotweave.streaming import debounce

DATA = "/root/testdata/sf0.001"


def found(parsed):
    return {(t, k) for _, t, k, _ in parsed[1]}


def test_nix_modules():
    a = nix.parse("a.nix", '{ lib, pkgs, ... }: { imports = [ ./b.nix ../c ]; options.s.foo.enable = lib.mkOption { type = lib.types.bool; default = false; }; config = lib.mkIf x { a.b = lib.mkForce 42; home.packages = [ pkgs.rg ]; home.file.".config/foo".source = ./foo; }; }')
    assert found(a) == {("nix:b.nix", "imports"), ("nix:../c/default.nix", "imports"), ("nix_option:s.foo.enable", "declares"), ("nix_option:a.b", "sets"), ("package:pkgs.rg", "uses_package"), ("file:.config/foo", "configures")}
    meta = {t: m for _, t, _, m in a[1]}
    assert meta["nix_option:a.b"]["conditional"] and meta["nix_option:a.b"]["priority"] == "force"
    assert next(m for i, *_, m in a[0] if i == "nix_option:s.foo.enable")["default"] == "False"
    merged = nix.parse("m.nix", '{ config = lib.mkMerge [ { a = 1; } { b.c = "${pkgs}/x"; } ]; }')
    assert {(t, m["conditional"]) for _, t, _, m in merged[1]} == {("nix_option:a", True), ("nix_option:b.c", True)}
    assert nix.parse("c.nix", "# only a comment\n") == ([], [])
    assert [len(x) for x in nix.parse("e.nix", "{ a = ; }")] == [1, 0] and [len(x) for x in nix.parse("f.nix", "f { imports = [ ./x.nix ]; }")] == [1, 0]
    let = nix.parse("i.nix", 'let base = toString ../shelf; in { imports = [ "${base}/lamp" (import ./made.nix) ]; }')
    assert ("nix:../shelf/lamp/default.nix", "imports") in found(let)
    listed = nix.parse("l.nix", "{ x = f { modules = [ crate.nixosModules.lid (g h) ../m ]; }; }")
    assert ("flake_input:crate", "references") in found(listed) and ("nix:../m/default.nix", "imports") in found(listed)
    # the right side of || counts, a default value after the word "or" doesn't
    assert ("nix:two.nix", "imports") in found(nix.parse("o.nix", "{ x = a.b || (import ./two.nix); }"))
    assert found(nix.parse("o.nix", "{ x = a.b or (import ./two.nix); }")) == {("nix_option:x", "sets")}
    long = nix.parse("long.nix", "{ a = ''" + "${b}\n" * 60_000 + "''; }")
    assert len(long[0]) >= 1
    special = nix.parse("s.nix", "{ specialisation.desk.configuration = { }; specialisation = { head = { }; }; _module.args = { lib2 = 1; }; }")
    assert {k for _, k in found(special)} == {"specialises", "passes_args"} and len(special[1]) == 3


def test_python_and_kdl():
    p = python.parse("m.py", "import os\nfrom a.b import c\nfrom . import z\nclass K(B):\n  '''Doc.\n more'''\n  async def f(self, x, *y, k=1, **z): g()\ndef g(): pass\n")
    assert found(p) == {("py_module:os", "python_imports"), ("py_module:a.b", "python_imports"), ("py_class:m.py:K", "declares"), ("py_func:m.py:f", "declares"), ("py_func:m.py:g", "declares"), ("py_func:m.py:g", "calls")}
    assert next(m for i, *_, m in p[0] if i.endswith(":f"))["args"] == ["self", "x", "k", "*y", "**z"] and len(python.parse("x.py", "def (")[0]) == 1
    k = kdl.parse("c.kdl", 'binds {\n  Mod+T { spawn "term"; }\n  Mod+B { spawn "web"; }\n}\nspawn-at-startup "bar"\nwindow-rule {\n}\n')
    kinds = [x[1] for x in k[0]]
    assert (kinds.count("kdl_bind"), kinds.count("kdl_spawn"), kinds.count("kdl_rule")) == (2, 3, 1)
    k = kdl.parse("d.kdl", 'bind "Alt+J" spawn "jot"\nbind "Alt+K" spawn "jot"\nrule "tiled" {\n  spawn "clock"\n  spawn "jot"\n}\nrule "tiled"\n')
    assert found(k) == {("kdl_bind:d.kdl:Alt+J", "binds_key"), ("kdl_bind:d.kdl:Alt+K", "binds_key"), ("kdl_spawn:d.kdl:jot", "spawns"), ("kdl_rule:d.kdl:tiled", "binds_key"), ("kdl_spawn:d.kdl:clock", "spawns")}
    source = "@s.tool()\n@other\ndef one(): pass\n@a.b.c\nclass X:\n  @s.tool(name='x')\n  async def two(self): pass\n"
    meta = {i: m for i, *_, m in python.parse("t.py", source)[0]}
    assert meta["py_func:t.py:one"]["decorators"] == ["tool", "other"] and python.registered_tools(source) == ["one", "two"]


def test_edge_ids():
    assert edge_id("a", "sets", "b", {"line": 3}) == "a->sets->b" and edge_id("a", "sets", "b", {"conditional": True}) != edge_id("a", "sets", "b", {"conditional": False})


def test_files_to_graph(spark, tmp_path):
    tree = {"default.nix": "{ imports = [ ./a.nix ]; }", "a.nix": "{ config.x = 1; }", "tool.py": "import os\n", ".config/w.kdl": 'spawn "x"\n', ".hidden/b.nix": "{ }", "node_modules/c.nix": "{ }", "out/d.nix": "{ }", "n.txt": "no"}
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "bad.nix").write_bytes(b"\xff\xfe{")
    files = listing(spark, str(tmp_path), exclude=["./out/"])
    assert {r.path for r in files.collect()} == {"default.nix", "a.nix", "tool.py", ".config/w.kdl", "bad.nix"}
    read = texts(files)
    assert read.where("text is null").first().path == "bad.nix"
    nodes, edges = graph_rows(extract(read))
    assert {r.id for r in nodes.collect()} >= {"nix:default.nix", "nix:a.nix", "python:tool.py", "kdl:.config/w.kdl"}
    assert ("nix:default.nix", "nix:a.nix", "imports") in {(r.source, r.target, r.type) for r in edges.collect()}
    named = spark.createDataFrame([("file:conf/tool.py", "file")], "id string, type string")
    assert {r.path for r in relevant(files, named.limit(0), edges, ["python", "kdl"]).collect()} == {"default.nix", "a.nix", "bad.nix", ".config/w.kdl"}
    assert "tool.py" in {r.path for r in relevant(files, named, edges, ["python"]).collect()}
    inside = spark.createDataFrame([("file:conf/xtool.py.bak", "file")], "id string, type string")
    assert "tool.py" in {r.path for r in relevant(files, inside, edges, ["python"]).collect()}
    assert "tool.py" not in {r.path for r in relevant(files, spark.createDataFrame([("file:conf/tool.pl", "file")], "id string, type string"), edges, ["python"]).collect()}


def test_config_folders_at_any_depth_and_read_folders(spark, tmp_path):
    for name in ("a/b/c/d/e/f/.config/deep.kdl", "a/.config/x/.config/y.kdl", "build/k.nix", "dist/k.nix", "venv/k.nix", ".mypy_cache/k.nix", ".other/k.nix"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{ }")
    assert {r.path for r in listing(spark, str(tmp_path)).collect()} == {"a/b/c/d/e/f/.config/deep.kdl", "a/.config/x/.config/y.kdl", "build/k.nix", "dist/k.nix", "venv/k.nix"}
    assert [r.path for r in single(spark, str(tmp_path / "build/k.nix")).collect()] == ["k.nix"]
    assert single(spark, str(tmp_path / "a/.config/x/.config/y.kdl"), enabled=["python"]).count() == 0
    paths = spark.createDataFrame([(x,) for x in ("a/b.nix", ".git/c.nix", "a/.hidden.nix", "x.pyc", "noext", "t.py")], "path string")
    assert {r.path for r in paths.where(watched(F.col("path"))).collect()} == {"a/b.nix", "t.py"}


def test_lock(spark):
    lock = {"nodes": {"root": {"inputs": {"a": "a"}}, "a": {"locked": {"type": "github", "owner": "o", "repo": "r", "rev": "1"}, "inputs": {"b": "b", "c": ["a2", "b"], "g": "ghost", "s": "a"}}, "b": {"original": {"url": "u"}}}}
    rows = parse_lock(spark.createDataFrame([(json.dumps(lock),), ("{bad",)], "text string")).collect()
    assert [(r["name"], r.url, r.rev, r.inputs) for r in rows] == [("a", "github:o/r", "1", {"b": ["b"], "c": ["b"]}), ("b", "u", "", {})]


def test_debounce(spark):
    rows = [("r", 0.0, "b"), ("r", 0.3, "a"), ("r", 0.7, "a"), ("r", 5.0, "c"), ("q", 0.1, "z")]
    events = spark.createDataFrame(rows, "root string, at double, path string").select("root", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "path")
    assert sorted((r.root, r["items"]) for r in debounce.batches(events, "root", "ts", "500 milliseconds", "path").collect()) == [("q", ["z"]), ("r", ["a", "b"]), ("r", ["c"])]
    pending, git = spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([(f"f{i}",) for i in range(51)], "path string")
    r = debounce.merge_pending(pending, git).first()
    assert r.bulk and len(r["items"]) == 52
    before, after = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime int"), spark.createDataFrame([("b", 2), ("c", 1)], "path string, mtime int")
    assert {tuple(x) for x in debounce.poll_changes(before, after).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "new")}


def test_debounced_stream(spark, tmp_path):
    src, got = tmp_path / "in", []
    src.mkdir()
    lines = [{"root": "r", "ts": f"2024-01-01 00:00:0{s}", "path": p} for s, p in ((0, "b"), (0, "a"), (4, "c"), (9, "heartbeat"))]
    (src / "1.json").write_text("\n".join(map(json.dumps, lines[:3])))
    time.sleep(0.05)
    (src / "2.json").write_text(json.dumps(lines[3]))
    os.utime(src / "1.json", (1, 1))
    stream = spark.readStream.schema("root string, ts timestamp, path string").option("maxFilesPerTrigger", 1).json(str(src))
    q = debounce.run_updates(debounce.batches(stream, "root", "ts", "500 milliseconds", "path", "1 second"), lambda df, i: got.extend(tuple(r["items"]) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(got) == [("a", "b"), ("c",)]


def rows_of(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.values.tolist()))


SOME = ["gr9_dependencies", "gr1_bfs_width", "gr8_blast_edges", "gr4_observe", "gr11_impact", "ft1_or_fallback", "us2_effectiveness", "inc4_merkle", "hl1_graph_counts", "str3_debounce_batches", "snk14_package_index"]


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and rows_of(ours, columns) == rows_of(theirs, columns)


def test_plugins_as_a_table_function(spark):
    from knotweave.extract.registry import extract
    from knotweave.extract.udtf import register

    files = spark.createDataFrame([("a.nix", "nix", "{ imports = [ ./b.nix ]; }\n"), ("c.py", "python", "def f():\n    return 1\n"), ("bad.py", "python", "def ("), ("n.nix", "nix", None), ("x.txt", "text", "x"), ("e.nix", "nix", "")], "path string, lang string, text string")
    register(spark)
    got = spark.sql("SELECT p.* FROM {files} f, LATERAL parse_file(f.lang, f.path, f.text) p", files=files)
    assert sorted(map(str, got.collect())) == sorted(map(str, extract(files).collect()))
