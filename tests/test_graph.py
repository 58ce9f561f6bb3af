"""Graph verbs on small fixtures and against plain-Python traversals of random graphs."""

import hashlib
import heapq
import random
from math import inf

import pytest
from pyspark.sql import functions as F

from knotweave.operators import health, incremental, lookup, maintain, search, traverse

KINDS = ["imports", "references", "declares"]


def graph(spark, links, nodes=None):
    """links: (source, target[, type[, weight]])"""
    links = [(*x, "imports", 1.0)[:4] if len(x) == 2 else (*x, 1.0)[:4] for x in links]
    ids = sorted({x for s, t, *_ in links for x in (s, t)}) if nodes is None else nodes
    n = spark.createDataFrame([(i, "nix_module", i, i.removeprefix("nix:"), "nix", "{}") for i in ids], "id string, type string, name string, path string, lang string, metadata string")
    e = spark.createDataFrame([(f"{s}->{k}->{t}#{i:02d}", s, t, k, "{}", float(w)) for i, (s, t, k, w) in enumerate(links)], "id string, source string, target string, type string, metadata string, weight double")
    return n, e


CHAIN = [("nix:a.nix", "nix:b.nix"), ("nix:b.nix", "nix:c.nix"), ("nix:c.nix", "nix:d.nix"), ("nix:b.nix", "nix_option:o", "declares"), ("nix:c.nix", "nix_option:o", "sets")]


def ids(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()} if len(columns) > 1 else {r[0] for r in df.select(*columns).collect()}


def test_chain(spark):
    n, e = graph(spark, CHAIN)
    nodes, edges = traverse.hop(n, e, "nix:a.nix", None, 2, 10)
    assert ids(nodes, "id") == {"nix:b.nix", "nix:c.nix", "nix_option:o"} and edges.count() == 3
    assert ids(traverse.hop(n, e, "nix:b.nix", "imports", 1, 10)[0], "id") == {"nix:c.nix"}
    reached, inside = traverse.blast_radius(n, e, "nix:c.nix", 5)
    assert ids(reached, "id") == {"nix:a.nix", "nix:b.nix"} and ids(inside, "source", "target") == {("nix:a.nix", "nix:b.nix"), ("nix:b.nix", "nix:c.nix")}
    assert ids(traverse.closure(n, e, "nix:a.nix", 3), "id", "depth") == {("nix:b.nix", 1), ("nix:c.nix", 2), ("nix:d.nix", 3), ("nix_option:o", 3)}
    assert ids(traverse.closure(n, e, "nix:d.nix", 3, reverse=True), "id") == {"nix:a.nix", "nix:b.nix", "nix:c.nix"}
    assert traverse.closure(n, e, "nix:none", 3).count() == 0


def test_dangling(spark):
    n, e = graph(spark, CHAIN)
    n = n.where("id <> 'nix:d.nix'")
    assert ids(lookup.observe(n, e, "nix:c.nix"), "neighbour", "dangling") >= {("nix:d.nix", True), ("nix:b.nix", False)}
    assert traverse.bfs(n, e, "nix:c.nix", 3).where("id = 'nix:d.nix'").count() == 0
    assert ids(lookup.dangling(n, e), "missing") == {"target"}
    row = lookup.summarize_module(n, e, "c.nix").first()
    assert (row.incoming, row.outgoing, row.dangling) == (1, 2, 1)


def test_summary_and_option(spark):
    option = graph(spark, [("nix:b.nix", "nix_option:x.y", "declares"), ("nix:c.nix", "nix_option:x.y", "sets")])
    row = lookup.introspect_option(*option, "x.y").first()
    assert (row.declared_in, row.defined_in) == ("b.nix", ["c.nix"])
    assert lookup.summarize_module(*option, "b.nix").first().key_symbols == ["x.y"]
    assert lookup.introspect_option(*option, "none").first().declared_in is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_cycles_and_parallels(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    links = [(rnd.choice(names), rnd.choice(names), rnd.choice(KINDS), rnd.randint(1, 5)) for _ in range(40)]
    n, e = graph(spark, links, names)
    n, e = n.cache(), e.cache()
    rows = sorted((r.id, r.source, r.target, r.weight) for r in e.collect())
    near = {}
    for i, s, t, _ in rows:
        near.setdefault(s, {}).setdefault(t, i)

    def walk(start, depth, width=None):
        seen, level, out = {start}, [start], []
        for d in range(1, depth + 1):
            nxt = []
            for u in level:
                for v in list(near.get(u, {}))[:width]:
                    if v not in seen:
                        seen.add(v)
                        nxt.append(v)
                        out.append((v, d, u))
            level = nxt
        return out

    for width in (None, 2):
        want = walk("n00", 4, width)
        at = n.where("id = 'n00'").select("id")
        got = traverse.walk(n, e, at, 4, width=width, chains=True).where("depth > 0")
        assert {(r.id, r.depth, r.trail[-2]) for r in got.collect()} == set(want)
    best, heap = {}, [(0.0, 0, (), "n00")]
    while heap:
        cost, hops, chain, u = heapq.heappop(heap)
        if u not in best:
            best[u] = (cost, hops, chain)
            for i, s, t, w in rows:
                if s == u and t not in best:
                    heapq.heappush(heap, (cost + w, hops + 1, (*chain, i), t))
    for target in ("n05", "n09"):
        path = traverse.shortest_path(n, e, "n00", target).orderBy("step").collect()
        if target in best and target != "n00":
            assert path[-1].cost == best[target][0] and len(path) == best[target][1] + 1 and path[0].edge_in is None
        else:
            assert not path or target == "n00"


def test_shortest_path_prefers_light_edges(spark):
    n, e = graph(spark, [("A", "D", "imports", 10), ("A", "B"), ("B", "C"), ("C", "D")])
    path = traverse.shortest_path(n, e, "A", "D").orderBy("step").collect()
    assert [r.id for r in path] == ["A", "B", "C", "D"] and path[-1].edge_in.startswith("C->imports->D")
    assert traverse.shortest_path(n, e, "D", "A").count() == 0 and traverse.shortest_path(n, e, "A", "A").count() == 1


def test_search(spark):
    rows = [("o1", "hardware.printer.trayCount paper-feed"), ("o2", "fonts.paper.size"), ("o3", "buildKernel"), ("o4", "Crème"), ("o5", "services/foo.nix")]
    n = spark.createDataFrame(rows, "id string, name string").withColumns({"type": F.lit("t"), "lang": F.lit("nix"), "path": F.col("name")})
    find = lambda q, **k: ids(search.find_symbol(n, q, **k), "id")
    assert find("printer paper") == {"o1"} and find("printer fonts") == {"o1", "o2"} and find("buildkernel") == {"o3"} and find("creme") == {"o4"}
    assert find("services.foo") == {"o5"} and find("serv") == set() and find("  ") == set() and find("(open") == set() and find("nix") == {"o1", "o2", "o3", "o4", "o5"}
    assert find("ERV", fuzzy=True) == {"o5"} and find("o", node_type=["t"], id_prefix="O4") == {"o4"} and find("o", path_contains="foo") == {"o5"}
    assert [r.id for r in search.find_symbol(n, "o", fuzzy=True, limit=1, offset=1).collect()] == [sorted(rows, key=lambda r: r[1])[1][0]]


def option(spark, name, path, synthetic=False):
    return spark.createDataFrame([(name, "nix_option", name, path, "nix", '{"synthetic":true}' if synthetic else "{}")], "id string, type string, name string, path string, lang string, metadata string")


def test_build_file(spark):
    n, e = graph(spark, [("nix:b.nix", "nix_option:x", "declares"), ("nix:a.nix", "nix_option:x", "sets")], ["nix:a.nix", "nix:b.nix"])
    n = n.union(option(spark, "nix_option:x", "b.nix"))
    mine = n.where("id = 'nix:b.nix'")
    nodes, edges = maintain.build_file(n, e, "b.nix", mine, e.where("false"))
    assert ids(nodes, "id") == {"nix:a.nix", "nix:b.nix"} and edges.count() == 0  # the dropped option takes the other file's edge with it
    shared = e.withColumn("type", F.when(F.col("type") == "sets", "references").otherwise(F.col("type")))
    nodes, edges = maintain.build_file(n, shared, "b.nix", mine, e.where("false"))
    assert ids(edges, "type") == {"references"} and "nix_option:x" in ids(nodes, "id")
    more = graph(spark, [("nix:b.nix", "nix:new/x.nix")])[1]
    nodes, _ = maintain.build_file(n, e, "b.nix", mine.union(option(spark, "nix_option:x", "b.nix")), more)
    row = nodes.where("id = 'nix:new/x.nix'").first()
    assert (row.type, row.path) == ("nix_module", "new/x.nix") and "synthetic" in row.metadata


def test_prune_and_build_all(spark):
    _, e = graph(spark, [("nix:a.nix", "used", "sets")])
    n = option(spark, "orphan", None, True).union(option(spark, "used", None, True)).union(option(spark, "real", None)).union(option(spark, "placed", "p", True))
    assert ids(maintain.prune_orphans(n, e), "id") == {"used", "real", "placed"}
    twice = option(spark, "x", "one").withColumn("ord", F.lit(1)).union(option(spark, "x", None, True).withColumn("ord", F.lit(2)))
    nodes, edges = maintain.build_all(twice, e.withColumn("ord", F.lit(1)))
    assert nodes.first().path == "one" and edges.count() == 1


def test_diff_and_cascade(spark):
    n, e = graph(spark, CHAIN[:3])
    assert ids(incremental.cascade(n, e, ["nix:c.nix"]), "id", "depth") == {("nix:b.nix", 1), ("nix:a.nix", 2)}
    assert incremental.cascade(n, e, ["nix:a.nix"]).count() == 0
    new = n.where("id <> 'nix:a.nix'").withColumn("name", F.when(F.col("id") == "nix:b.nix", "new").otherwise(F.col("name")))
    assert ids(incremental.diff(n, new, "id", ["name"]), "id", "status") == {("nix:a.nix", "removed"), ("nix:b.nix", "changed")}
    flipped = e.withColumn("metadata", F.when(F.col("source") == "nix:a.nix", '{"conditional":true}').otherwise(F.col("metadata")))
    assert sorted(r.status for r in incremental.diff_values(e, flipped, ["source", "target", "metadata"]).collect()) == ["added", "removed"]


def test_merkle_with_a_cycle(spark):
    h = spark.createDataFrame([(p, f"h{p}") for p in "abcd"], "path string, ast_hash string")
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "path string, target string")
    one = dict(map(tuple, incremental.merkle(h, imports).collect()))
    changed = h.withColumn("ast_hash", F.when(F.col("path") == "c", "new").otherwise(F.col("ast_hash")))
    two = dict(map(tuple, incremental.merkle(changed, imports).collect()))
    assert set(one) == set("abcd") and all(one[p] != two[p] for p in "abc") and one["d"] == two["d"]


def test_cascade_and_merkle_of_a_long_chain(spark):
    links = [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(104)]
    n, e = graph(spark, links)
    assert ids(incremental.cascade(n, e, ["m104"]), "id", "depth") == {(f"m{i:03d}", 104 - i) for i in range(104)}
    h = n.select(F.col("id").alias("path"), F.col("id").alias("ast_hash"))
    got = dict(map(tuple, incremental.merkle(h, e.select(F.col("source").alias("path"), "target")).collect()))
    want = ""
    for i in reversed(range(105)):
        want = hashlib.sha256(f"m{i:03d}{want}".encode()).hexdigest()
        assert got[f"m{i:03d}"] == want


def test_health(spark):
    n, e = graph(spark, [("nix:a.nix", "nix:ghost")], ["nix:a.nix", "nix:b.nix", "nix:e.nix"])
    n = n.union(option(spark, "o", None, True))
    values = spark.createDataFrame([("error",), ("ok",)], "status string")
    paths = lambda *p: spark.createDataFrame([(x, False) for x in p], "path string, dirty boolean")
    inputs = spark.createDataFrame([("",), ("abc",)], "rev string")
    row = health.collect_health(n, e, values, inputs, paths("a.nix", "b.nix", "d.nix"), paths(), 2)
    r = row.first()
    assert (r.nodes, r.synthetic_nodes, r.synthetic_ratio, r.dangling_edges, r.option_errors, r.inputs_without_rev, r.unindexed_files, r.missing_files) == (4, 1, 0.25, 1, 1, 1, 1, 1)
    base = row.withColumn("dangling_edges", F.lit(0))
    assert ids(health.compare_health(row, base), "measure", "was", "is_now") == {("dangling_edges", 0.0, 1.0)}


def test_impact_members_edges_and_values(spark):
    links = [("nix:a.nix", "nix:b.nix"), ("nix:a.nix", "file:out/x.conf", "generates"), ("nix:a.nix::f", "nix:b.nix", "references"), ("nix:c.nix", "nix:a.nix"), ("nix_option:o.p", "nix:b.nix", "references"), ("nix:b.nix", "nix:ghost")]
    n, e = graph(spark, links, ["nix:a.nix", "nix:a.nix::f", "nix:b.nix", "nix:c.nix", "nix_option:o.p", "file:out/x.conf"])
    n = n.withColumn("type", F.when(F.col("id").startswith("nix_option:"), "nix_option").when(F.col("id").startswith("file:"), "file").otherwise("nix_module"))
    kinds = (["nix_module"], ["nix_option"], ["file"])
    e = e.union(graph(spark, [("file:out/x.conf", "nix:b.nix", "references")], [])[1].withColumn("id", F.lit("back")))
    assert ids(lookup.impact_members(n, e, "nix:b.nix", 3, *kinds), "kind", "name") == {("module", "a.nix"), ("module", "c.nix"), ("option", "o.p"), ("file", "file:out/x.conf"), ("file", "out/x.conf")}
    assert tuple(lookup.impact(n, e, "nix:b.nix", 3, *kinds).first())[1:] == (2, 1, 2, "medium")
    assert ids(lookup.module_edges(n, e, "b.nix"), "direction", "source", "target", "dangling") >= {("out", "nix:b.nix", "nix:ghost", True), ("in", "nix:a.nix", "nix:b.nix", False), ("in", "nix_option:o.p", "nix:b.nix", False)}
    made = [("k1", "config.o.p", "1", "ok", None, 1), ("k2", "config.o.p", None, "error", " first \nsecond", 2), ("k3", "config.o", "7", "ok", "", 3)]
    values = spark.createDataFrame(made, "key string, expr string, value_json string, status string, error string, computed_at long")
    assert [tuple(r) for r in lookup.option_value(values, "o.p").collect()] == [(None, "error: first")] and lookup.option_value(values, "none").count() == 0
    assert tuple(lookup.option_value(values, "o").first()) == ("7", "ok")


def test_deep_observe_adds_dangling_ends(spark):
    n, e = graph(spark, [*CHAIN, ("nix:b.nix", "nix:lost.nix"), ("nix:gone.nix", "nix:a.nix"), ("nix:b.nix", "nix:lost.nix", "sets")])
    n = n.where("id not in ('nix:lost.nix', 'nix:gone.nix', 'nix:d.nix')")
    got = [tuple(r) for r in lookup.observe_deep(n, e, "nix:a.nix", 1).collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [("nix:b.nix", 1, False), ("nix:gone.nix", None, True), ("nix:lost.nix", None, True)]
    assert [r[0] for r in lookup.observe_deep(n, e, "nix:a.nix", 1, limit=2).collect()] == ["nix:b.nix", "nix:gone.nix"]
    assert {r[0] for r in lookup.observe_deep(n, e, "nix:a.nix", 2).collect()} == {"nix:b.nix", "nix:c.nix", "nix_option:o", "nix:gone.nix", "nix:lost.nix", "nix:d.nix"}


def test_engine_keeps_pairs(spark):
    from knotweave.engine import GraphEngine

    engine = GraphEngine(*graph(spark, CHAIN))
    for call in (lambda: engine.hop("nix:a.nix", depth=2), lambda: engine.blast_radius("nix:c.nix")):
        one, two = call(), call()
        assert one[0] is two[0] and one[1] is two[1] and one[1].count() > 0
    assert engine.served == {"hop": 2, "blast_radius": 2}


def test_engine_contract(spark):
    from knotweave.engine import GraphEngine

    engine = GraphEngine(*graph(spark, CHAIN))
    for call in (lambda: engine.observe("nix:a.nix", 21), lambda: engine.hop("nix:a.nix", depth=11, width=10), lambda: engine.hop("nix:a.nix", depth=11, width=5), lambda: engine.dependencies("nix:a.nix", 11), lambda: engine.blast_radius("nix:a.nix", 11)):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: engine.observe("none"), lambda: engine.dependencies("none"), lambda: engine.summarize("none")):
        with pytest.raises(KeyError):
            call()
    assert engine.dependencies("nix:a.nix") is engine.dependencies("nix:a.nix") and engine.served == {"dependencies": 2}
    assert engine.impact("nix:none").first().risk == "low"
    after = engine.publish(engine.nodes.where("id <> 'nix:b.nix'"), engine.edges)
    assert after.generation == 1 and after.dependencies("nix:a.nix").count() == 0


@pytest.mark.parametrize("delta", [0.5, 2.0, None])
def test_delta_stepping_equals_a_plain_search(spark, monkeypatch, delta):
    rnd = random.Random(31)
    names = [f"k{i:02d}" for i in range(22)]
    links = [(f"l{i:03d}", rnd.choice(names), rnd.choice([*names, "nowhere"]), "imports", float(rnd.choice([0, 0, 1, 1, 2, 3, 7]))) for i in range(70)]
    links += [("l900", "k00", "k07", "imports", None), ("l901", "k00", "k01", "imports", 1.0), ("l000b", "k00", "k01", "imports", 1.0)]
    e = spark.createDataFrame(links, "id string, source string, target string, type string, weight double")
    n = spark.createDataFrame([(i, "t", i, i) for i in [*names, "alone"]], "id string, type string, name string, path string")
    best, heap = {}, [(0.0, 0, (), ("k00",))]
    while heap:
        cost, hops, chain, trail = heapq.heappop(heap)
        if trail[-1] not in best:
            best[trail[-1]] = cost, hops, chain, trail
            for i, s, t, _, w in links:
                if s == trail[-1] and t in names and w is not None:
                    heapq.heappush(heap, (cost + w, hops + 1, (*chain, i), (*trail, t)))
    got = {r.id: (r.cost, r.hops) for r in traverse.distances(n, e, "k00", delta=delta).collect()}
    assert got == {i: b[:2] for i, b in best.items()} and len(got) > 10
    monkeypatch.setattr(traverse, "NEAR", 0)
    far = max(best, key=best.get)
    for goal in (far, "k00", "alone"):
        path = traverse.shortest_path(n, e, "k00", goal, delta).orderBy("step").collect()
        want = best.get(goal, (0, 0, (), ()))
        assert tuple(r.id for r in path) == want[3] and tuple(r.edge_in for r in path[1:]) == want[2] and all(r.cost == want[0] for r in path)
    assert not traverse.distances(n, e, "not there", delta=delta).count() and not traverse.distances(n, e.limit(0), "alone", "k00").where("id <> 'alone'").count()


def test_dangling_edges_are_found_without_shuffling_the_edges(spark):
    n, e = graph(spark, [*CHAIN, ("nix:gone.nix", "nix:a.nix")], ["nix:a.nix", "nix:b.nix", "nix:c.nix", "nix_option:o"])
    blank = e.limit(1).select(F.lit("blank").alias("id"), F.lit(None).cast("string").alias("source"), F.lit("nix:a.nix").alias("target"), "type", "metadata", "weight")
    e = e.union(blank)
    found = lookup.dangling(n, e)
    assert ids(found, "id", "missing") == {("nix:c.nix->imports->nix:d.nix#02", "target"), ("nix:gone.nix->imports->nix:a.nix#05", "source"), ("blank", "source")}
    kept = traverse.live(n, e)
    assert ids(kept, "source", "target") == {(s, t) for s, t, *_ in CHAIN if t != "nix:d.nix"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (lookup.dangling(n, e), traverse.live(n, e)):
            assert "SortMergeJoin" not in made._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_are_found_from_the_target_where_the_source_leads_too_far(spark, monkeypatch):
    def no(*_):
        raise AssertionError("the whole graph was searched")

    rnd = random.Random(47)
    names = [f"k{i:02d}" for i in range(9)]
    wide = [f"w{i:02d}" for i in range(40)]
    ends = [*names, *wide[:3], "nowhere"]
    links = [(f"l{i:03d}", rnd.choice(ends), rnd.choice(names), "imports", rnd.choice([0.0, 0.1, 0.1, 0.2, 0.3, 1.0, None])) for i in range(45)]
    links += [(f"x{w}", "k00", w, "imports", 0.1) for w in wide] + [("l000b", "k00", "k01", "imports", 0.1), ("l000a", "k00", "k01", "imports", 0.1)]
    e = spark.createDataFrame(links, "id string, source string, target string, type string, weight double")
    n = spark.createDataFrame([(i, "t", i, i) for i in [*names, *wide, "alone"]], "id string, type string, name string, path string")
    best = {"k00": (0.0, 0, (), ("k00",))}
    for _ in range(60):
        for i, s, t, _, w in links:
            if s in best and t in (*names, *wide) and w is not None:
                cost, hops, chain, trail = best[s]
                best[t] = min((cost + w, hops + 1, (*chain, i), (*trail, t)), best.get(t, (inf,)))
    monkeypatch.setattr(traverse, "NEAR", 20)
    monkeypatch.setattr(traverse, "distances", no)
    assert len(best) > 45
    for goal in ["k02", max(names, key=lambda i: best[i][1]), "alone", "w39"]:
        path = traverse.shortest_path(n, e, "k00", goal).orderBy("step").collect()
        want = best.get(goal, (0, 0, (), ()))
        assert tuple(r.id for r in path) == want[3] and tuple(r.edge_in for r in path[1:]) == want[2] and all(r.cost == round(want[0], 6) for r in path), goal
    monkeypatch.setattr(traverse, "FANOUT", 0)
    with pytest.raises(AssertionError, match="whole graph"):
        traverse.shortest_path(n, e, "k00", "k08")


def test_distances_ask_for_the_edges_once_a_round(spark, monkeypatch):
    e = spark.createDataFrame([("a", "k0", "k1", 1.0), ("b", "k1", "k2", 1.0), ("c", "k2", "k3", None), ("d", "k0", "k2", 3.0), ("e", "k0", "k3", 9.0), ("f", "k0", "k3", None)], "id string, source string, target string, weight double")
    n = spark.createDataFrame([(f"k{i}",) for i in range(4)], "id string")
    asked, from_ = [], traverse._edges_from
    monkeypatch.setattr(traverse, "_edges_from", lambda *a: asked.append(a) or from_(*a))
    got = {tuple(r) for r in traverse.distances(n, e, "k0").collect()}
    assert got == {("k0", 0.0, 0), ("k1", 1.0, 1), ("k2", 2.0, 2), ("k3", 9.0, 1)}
    assert len(asked) <= 4  # for k0; k1 and k2; k2, which fell; k3
