"""Stored frames and generations: what is read and written, and that it equals the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from knotweave.engine import GraphEngine
from knotweave.operators import indexing, search, traverse
from knotweave.operators.substring import containing
from knotweave.plans import store
from knotweave.plans.session import written


def rows(df, *columns):
    return {tuple(r) for r in df.select(*(columns or df.columns)).collect()}


def scanned(df):
    """Bytes of the files that a plan without a shuffle reads."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("filesSize").value()


def test_lookups_read_what_their_keys_need(spark, tmp_path):
    edges = spark.range(40_000).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("n"), (F.col("id") % 5000).cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), (F.col("id") * 7 % 5000).cast("string"))).alias("target"), F.lit("imports").alias("type"), F.lit(1.0).alias("weight"))
    nodes = edges.select(F.col("source").alias("id")).distinct().select("id", F.lit("t").alias("type"), F.col("id").alias("name"), F.lit(None).cast("string").alias("path"))
    n, e = store.published(spark, *store.publish(nodes, edges, str(tmp_path), buckets=64))
    assert rows(n.frame) == rows(nodes) and rows(e.frame, "id") == rows(edges, "id") and rows(e.into.frame) == rows(e.out.frame)
    whole = scanned(e.frame)
    one, ten = scanned(traverse.edges_at(e, ["n7"])), scanned(traverse.edges_at(e, [f"n{i}" for i in range(10)]))
    assert one < whole / 20 and one < ten < whole / 4
    assert scanned(traverse.edges_at(e, ["n7"], reverse=True)) < whole / 8
    assert rows(traverse.edges_at(e, ["n7", "none", "it's \\ odd"]), "id") == rows(edges.where("source = 'n7'"), "id")
    assert rows(traverse.edges_at(e, ["hub"], reverse=True), "id") == rows(edges.where("target = 'hub'"), "id")
    keys, _ = written(spark.createDataFrame([("n1",), ("n2",), ("none",)], "id string"))
    assert rows(e.out.among(keys), "id") == rows(edges.where("source in ('n1', 'n2')"), "id")
    assert rows(e.out.among(written(nodes.select("id"))[0]), "id") == rows(edges, "id")


@pytest.mark.parametrize("near", [0, 2000])
def test_both_gears_of_a_walk_agree(spark, tmp_path, monkeypatch, near):
    rnd = random.Random(9)
    names = [f"n{i:02d}" for i in range(16)]
    links = [(f"e{i:02d}", rnd.choice(names), rnd.choice([*names, *["gone"] * 5]), rnd.choice(["imports", "sets"]), float(rnd.randint(1, 4))) for i in range(45)]
    edges = spark.createDataFrame(links, "id string, source string, target string, type string, weight double")
    nodes = spark.createDataFrame([(i, "t", i, i) for i in names], "id string, type string, name string, path string")
    want = {}
    for kind, (n, e) in (("plain", (nodes, edges)), ("stored", store.published(spark, *store.publish(nodes, edges, str(tmp_path), buckets=4)))):
        monkeypatch.setattr(traverse, "NEAR", 2000 if kind == "plain" else near)
        got = [rows(traverse.walk(n, e, n.where("id in ('n00', 'n05')").select("id"), 3, width=w, reverse=r, chains=c)) if not c else {(x.id, x.depth, tuple(x.chain)) for x in traverse.walk(n, e, n.where("id = 'n00'").select("id"), 3, width=w, reverse=r, chains=True).collect()} for w, r, c in ((2, False, False), (None, True, False), (2, False, True), (None, False, True))]
        found, edges_ = traverse.hop(n, e, "n00", None, 3, 2)
        reached, inside = traverse.blast_radius(n, e, "n03", 2)
        got += [rows(found), rows(edges_), rows(reached), rows(inside, "id"), rows(traverse.closure(n, e, "n00", 4), "id", "depth")]
        got += [rows(traverse.shortest_path(n, e, "n00", t)) for t in ("n05", "none")]
        assert want.setdefault("rows", got) == got
    assert any(d for *_, d in want["rows"][5])  # some discovery edge dangles


def listing(spark, files):
    lang = {"nix": ("nix", 0), "py": ("python", 1)}
    return spark.createDataFrame([(p, *lang[p.rsplit(".", 1)[1]], bytearray(t.encode())) for p, t in files.items()], "path string, lang string, tier int, content binary")


def repository(n):
    files = {"lib.nix": "{ services.core.enable = true; }\n"}
    for i in range(n):
        files[f"m{i}.nix"] = f"{{ imports = [ ./{'lib' if i % 9 == 0 else f'm{i - 1}'}.nix ];\n  services.s{i}.enable = true;\n  home.packages = [ pkgs.p{i % 7} ];\n}}\n"
    files["own.nix"] = '{ services.alone.enable = true;\n  home.packages = [ pkgs.only ];\n  home.file.".local/go.py".source = ./go.py; }\n'
    files["go.py"] = "def go():\n    return 0\n"
    return files


VALUES = "key string, expr string, value_json string, status string, error string, computed_at timestamp, source_rev string"


def content(frame, name):
    drop = {"last_parsed", "created_at", "updated_at"}
    return rows(frame, *(c for c in frame.columns if c not in drop)) if name != "packages" else rows(frame, "attribute")


def test_batches_equal_whole_updates_and_share_what_did_not_change(spark, tmp_path):
    root, files = str(tmp_path / "store"), repository(120)
    index = indexing.index(listing(spark, files), ["python"])
    values = [("a", "config.m5.on", "1", "ok", None, None, None), ("b", "config.own.on", "1", "ok", None, None, None), ("c", "config.x", "1", "ok", None, None, None)]
    index = indexing.replace(index, values=spark.createDataFrame(values, VALUES))
    index.publish(root, buckets=256)

    def size():
        return sum(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet"))

    lost = files["m4.nix"].replace("./m3.nix", "./lib.nix").replace("s4", "t4")
    batches = [
        ({"own.nix": "{ services.alone.enable = true; services.more.enable = false;\n  home.packages = [ pkgs.p1 ]; }\n"}, []),  # a package and a file name go, an option comes
        ({"m4.nix": lost, "m30.nix": files["m30.nix"] + "# a word\n", "new.nix": "{ imports = [ ./m2.nix ./none.nix ]; }\n", "go.py": "def run():\n    return 1\n"}, ["m70.nix"]),
    ]
    whole, before = index, size()
    for k, (changed, deleted) in enumerate(batches):
        gone = spark.createDataFrame([(p,) for p in deleted], "path string")
        whole, decided = indexing.update(whole, listing(spark, changed), gone, ["python"])
        got = indexing.apply_batch(spark, root, listing(spark, changed), gone, ["python"])
        assert rows(got) == rows(decided)
        generation, now = indexing.load(spark, root)
        assert generation == k + 2
        for name, frame in now.frames().items():
            assert content(frame, name) == content(getattr(whole, name), name), (k, name)
        if k == 0:
            assert size() - before < before / 30  # one file of 122
            assert rows(now.values, "key", "status") == {("a", "ok"), ("b", "stale"), ("c", "ok")}
        if k == 1:
            assert ("a", "stale") in rows(now.values, "key", "status")
    again = indexing.apply_batch(spark, root, listing(spark, {"lib.nix": files["lib.nix"]}), gone, ["python"])
    assert rows(again) == {("lib.nix", "unchanged_content"), ("m70.nix", "deleted")} and store.current(spark, root)[0] == 3  # nothing changed, nothing is published
    kept = indexing.StoredIndex.open(spark, root)
    assert rows(kept.part("postings").frame, "token", "id") == rows(search.postings(kept.part("nodes").frame), "token", "id")
    assert rows(kept.part("edges_in").frame, "id") == rows(kept.part("edges").frame, "id")

    # what no kept manifest names is deleted, what is named stays
    assert store.retain(spark, root, generations=1, older_than=3600) == 0
    assert store.retain(spark, root, generations=1, older_than=0) > 0 and size() < before * 1.05
    assert content(indexing.load(spark, root)[1].nodes, "nodes") == content(whole.nodes, "nodes")
    left = {p: t for p, t in files.items() if p != "m5.nix"} | {"new.nix": ""}
    gone = {r[0] for r in rows(indexing.purge_vanished(spark, root, listing(spark, left), ["python"]), "path")}
    assert gone == {"m5.nix"} and not indexing.load(spark, root)[1].states.where("path = 'm5.nix'").count()
    engine = GraphEngine.of_store(spark, root)
    assert engine.generation == 4 and rows(engine.dependencies("nix:m3.nix", 5), "id") >= {("nix:m2.nix",), ("nix:lib.nix",)}
    assert rows(engine.find("s12"), "id") == {("nix_option:services.s12.enable",)} or engine.find("s12").count() > 0
    assert engine.observe("nix:own.nix").count() > 0 and engine.status().first().generation_id == 4


def test_one_file_of_many_rewrites_little(spark, tmp_path):
    n, root = 20_000, str(tmp_path / "store")
    ids = spark.range(n).select(F.concat(F.lit("f"), "id", F.lit(".nix")).alias("path"), F.concat(F.lit("nix:f"), "id", F.lit(".nix")).alias("id"), F.concat(F.lit("nix:f"), (F.col("id") / 2).cast("long"), F.lit(".nix")).alias("to"))
    empty = indexing.index(listing(spark, {"x.nix": "{ }\n"}), [])
    fill = lambda frame, **given: ids.select(*(given.get(c, F.lit(None)).cast(frame.schema[c].dataType).alias(c) for c in frame.columns))
    nodes = fill(empty.nodes, id=F.col("id"), type=F.lit("nix_module"), name=F.col("path"), path=F.col("path"), lang=F.lit("nix"), metadata=F.lit("{}"))
    edges = fill(empty.edges, id=F.concat_ws("->", "id", F.lit("imports"), "to"), source=F.col("id"), target=F.col("to"), type=F.lit("imports"), metadata=F.lit("{}"), weight=F.lit(1.0))
    states = fill(empty.states, path=F.col("path"), lang=F.lit("nix"), content_hash=F.sha2("id", 256), ast_hash=F.sha2("path", 256), merkle_hash=F.sha2("to", 256), dirty=F.lit(False))
    indexing.replace(empty, nodes=nodes, edges=edges, states=states).publish(root, buckets=48)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet"))
    before = size()
    text = "{ imports = [ ./f6000.nix ];\n  services.one.enable = true;\n}\n"
    decided = indexing.apply_batch(spark, root, listing(spark, {"f12001.nix": text}), spark.createDataFrame([], "path string"), [])
    assert rows(decided) == {("f12001.nix", "ast_changed")}
    assert size() - before < before * 0.04  # 0.6 % with 100,000 files in 256 buckets
    now = indexing.load(spark, root)[1]
    assert now.nodes.count() == n + 1 and rows(now.edges.where("source = 'nix:f12001.nix'"), "target") == {("nix:f6000.nix",), ("nix_option:services.one.enable",)}


def test_postings_find_what_the_columns_hold(spark):
    texts = ["programs.wezterm.extraConfig theme-loader", "stylix.theme.variant", "mkService", "Café crème", "services/foo.nix", "a b a b c", "b a", "", None, "日本 語", "x" * 5000]
    n = spark.createDataFrame([(f"o{i}", t, "kind b") for i, t in enumerate(texts)], "id string, name string, type string")
    posted = search.postings(n).cache()
    for query in ("wezterm theme", "wezterm stylix", "mkservice", "cafe", "services.foo", "a-b", "a.b.a.b", "b-a-b-c", "b.a.c", "foo.nix x", "serv", " ", '"un', "kind", "kind.b", "variant kind", "日本", "none nothing", "o3 crème", "theme.theme"):
        assert rows(search.full_text(n, query), "id") == rows(search.full_text(n, query, posted=posted), "id"), query
        assert [r.id for r in search.find_symbol(n, query, limit=3, offset=1).collect()] == [r.id for r in search.find_symbol(n, query, limit=3, offset=1, posted=posted).collect()]


def test_containing_equals_a_comparison_of_all_pairs(spark):
    rnd = random.Random(1)
    make = lambda k: "".join(rnd.choice("abß.日") for _ in range(k))
    texts = [(i, make(rnd.randint(0, 30))) for i in range(150)] + [(900, None), (901, ""), (902, "aaa" * 400)] + [(1000 + i, "same text") for i in range(80)]
    needles = [make(rnd.randint(0, 5)) for _ in range(60)] + ["", None, "same", "aaaa", "never seen", "t"]
    got = containing(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([(x,) for x in needles], "needle string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(k, x) for k, t in texts for x in needles if t is not None and x and x in t}
    assert containing(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([], "needle string")).count() == 0


def test_a_query_walks_the_tables_without_publishing_the_graph(spark):
    import os

    from knotweave.plans import catalog

    folder = spark.conf.get("spark.checkpoint.dir")
    before = {n for n in os.listdir(folder) if n.startswith("graph-")}
    assert catalog.QUERIES["gr9_dependencies"](spark, "/root/testdata/sf0.001").count() == 29
    assert {n for n in os.listdir(folder) if n.startswith("graph-")} == before


def test_large_frontiers_name_their_kinds_to_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([("a:1->b:1", "a:1", "b:1"), ("b:1->c:1", "b:1", "c:1"), ("plain->c:1", "plain", "c:1")], "id string, source string, target string")
    at = spark.createDataFrame([("a:1",), ("plain",), (None,)], "id string")
    kinds = traverse._kinds(at)
    assert kinds == ["a", "plain"] and rows(traverse._of_kinds(edges, "source", kinds), "id") == {("a:1->b:1",), ("plain->c:1",)}
    monkeypatch.setattr(traverse, "KINDS", 1)  # more kinds than are kept: all edges are candidates
    assert traverse._of_kinds(edges, "source", traverse._kinds(at)).count() == 3


def test_small_files_of_many_rows_are_not_broadcast_while_an_index_is_made(spark):
    from knotweave.plans.session import compressed

    many, _ = written(spark.range(300_000).select(F.concat(F.lit("customer/"), "id", F.lit(".nix")).alias("path"), F.lit("ast_changed").alias("decision")))
    plan = lambda: many.join(many.select("path"), "path", "left_semi")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with compressed(spark):
        assert "BroadcastHashJoin" not in plan()
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0
