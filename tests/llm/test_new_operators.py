"""Hard negatives, sharding and resampling against plain computations, with the awkward inputs in each."""

import collections
import hashlib
import itertools
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotweave.llm import hard_negatives, resample, sharding
from knotweave.llm.ranking import numbered

# ---- 11 ------------------------------------------------------------------------

VECTORS = "vec_id long, label long, embedding array<float>"


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """Plain hard negatives of (vec_id, label, whole vector) rows."""
    out = set()
    for a in sorted({r[0] for r in rows if is_anchor(r[0])}):
        label, x = min((r[1], tuple(r[2])) for r in rows if r[0] == a)
        scored = {(-sum(p * q for p, q in zip(x, y, strict=True)), i, lab == label) for i, lab, y in rows if i != a and len(y) == len(x)}
        for p, pos, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted((s, i) for s, i, same in scored if not same and low * -p <= 100 * -s <= high * -p)
            out |= {(a, pos, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives])}
    return out


def test_hard_negatives(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, int(i % 4), [float(v) for v in rnd.normal(size=5).astype(np.float32)]) for i in range(240)]
    rows += [(300 + i, i % 3, rows[7][2]) for i in range(120)]  # a third of all rows are one vector
    rows += [rows[3]] * 3 + [(20, 2, [1.0] * 5), (20, 2, [2.0] * 5), (40, 1, [1.0, 2.0]), (41, 1, [2.0, 2.0]), (42, 0, [1.0, 0.5])]
    bad = [(None, 1, [1.0] * 5), (60, None, [1.0] * 5), (80, 1, None), (100, 1, []), (120, 1, [1.0, None, 0.0, 0.0, 0.0]), (140, 1, [float("nan")] * 5), (160, 1, [float("-inf")] * 5)]
    frame = spark.createDataFrame(rows + [(1000 + r[0] if r[0] else r[0], *r[1:]) for r in bad], VECTORS).withColumns({c: F.lit("clash") for c in ("x", "block", "qid", "score", "rank")}).repartition(5)
    got = [tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 20 == 0).collect()]
    whole = [(i, lab, [math.floor(256 * v) for v in np.float32(x).astype(np.float64)]) for i, lab, x in rows]
    want = mined(whole, lambda i: i % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_hard_negatives_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    every = F.col("vec_id") == 0
    assert hard_negatives.mine(make([]), every).count() == 0
    assert hard_negatives.mine(make([(0, 1, [1.0])]), every).count() == 0
    # a positive of score 0 takes negatives of score 0, one below takes none
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [-1.0, 0.0]), (3, 2, [0.0, 2.0]), (4, 2, [-0.5, 0.0])]
    assert [tuple(r) for r in hard_negatives.mine(make(rows), every).collect()] == [(0, 1, 1, 3, 0, 0)]
    # sums beyond 2^53 are exact
    big = [(0, 1, [float(2**22)] * 3), (1, 1, [float(2**23)] * 3), (2, 2, [float(2**22)] * 2 + [float(2**22) - 1])]
    x = [[int(256 * v) for v in r[2]] for r in big]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    assert [tuple(r) for r in hard_negatives.mine(make(big), every).collect()] == [(0, 1, 1, 2, dot(x[0], x[1]), dot(x[0], x[2]))]


def test_annuli_read_little_of_clustered_vectors_and_are_exact():
    rnd = np.random.default_rng(5)
    middles = rnd.normal(size=(40, 12)) * 900
    clustered = np.floor(middles[rnd.integers(0, 40, 4000)] + rnd.normal(size=(4000, 12)) * 20)
    dense = np.floor(rnd.normal(size=(4000, 12)) * 300)
    for x, most in ((clustered, 0.35), (dense, 1.0)):
        q, labels = x[:300], rnd.integers(0, 3, 4000)
        keys, pivot, dist = hard_negatives._fit(x)
        top = (q @ x.T).max(axis=1).astype(np.int64)
        lo, hi = np.stack([top * 0 - 10**12, top // 3], axis=1), np.stack([top, top * 2 // 3], axis=1)
        for same in (True, False):
            got, read = hard_negatives.annuli(keys, x, np.arange(4000), labels, pivot, dist, q, np.arange(300), labels[:300], lo, hi, 6, same)
            assert 0 < read <= most
            by = collections.defaultdict(list)
            for i, w, j, s in got.tolist():
                by[i, w].append((s, j))
            s = (q @ x.T).astype(np.int64)
            for i, w in itertools.product(range(300), range(2)):
                fit = [(int(s[i, j]), j) for j in np.flatnonzero(((labels == labels[i]) == same) & (np.arange(4000) != i) & (s[i] >= lo[i, w]) & (s[i] <= hi[i, w]))]
                assert by[i, w] == sorted(fit, key=lambda p: (-p[0], p[1]))[:6]
    assert hard_negatives.share_read(clustered, clustered[:50]) < 0.3


def test_search_prunes_blocks_of_clustered_vectors(spark):
    rnd = np.random.default_rng(8)
    x = np.floor(np.repeat(np.eye(8) * 3000, 60, axis=0) + rnd.normal(size=(480, 8)) * 9)
    rows = spark.createDataFrame([(i, 0, [float(v) for v in x[i]]) for i in range(480)], "vec_id long, label long, x array<double>")
    store = hard_negatives.build_store(rows, pivots=8)
    ask = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "label", "x", F.size("x").alias("dim"), F.array(F.lit(8_000_000).cast("long")).alias("lo"), F.array(F.lit(1 << 60)).alias("hi"))
    routes = hard_negatives._routes(store, ask)
    assert routes.count() < 48 * store.rows.select("block").distinct().count()
    got = {(r.qid, r.rank): (r.vec_id, r.score) for r in hard_negatives.search(store, ask, 3, same=True).collect()}
    s = x @ x.T
    for i in range(0, 480, 10):
        others = [j for j in np.lexsort((np.arange(480), -s[i])) if j != i][:3]
        assert [got[i, r + 1] for r in range(3)] == [(j, s[i, j]) for j in others]


# ---- 12 ------------------------------------------------------------------------


def hilbert(axes, bits):
    """Index of a point on the curve, by its recursive definition in any number of dimensions (Skilling), on integers."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) * bool(x[-1] & q)
        q >>= 1
    return sum((((x[i] ^ t) >> k) & 1) << (k * n + n - 1 - i) for k in range(bits) for i in range(n))


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_every_cell_by_single_steps(spark, axes, bits):
    cells = list(itertools.product(range(1 << bits), repeat=axes))
    rows = spark.createDataFrame(cells, ", ".join(f"a{i} int" for i in range(axes)))
    got = sorted((r.curve, tuple(r)[:axes]) for r in sharding.curve_index(rows, [f"a{i}" for i in range(axes)], bits).collect())
    assert [c for c, _ in got] == list(range(len(cells)))
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(got))
    assert all(hilbert(cell, bits) == c for c, cell in got)


DOCS = "doc_id long, text string, lang string, source string, size string, place int, shard int, count long"


def corpus(n=300):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randint(0, 60) + "x" * rnd.randint(0, 900), rnd.choice(["de", "en", None]), rnd.choice(["web/a", "web/b", "web/c", "wiki"]), "s", 1, 2, 3) for i in range(n)]
    rows += [(n + i, "the same text", "en", "web/a", None, None, None, None) for i in range(n // 2)]  # a third is one text
    return rows + [rows[5]] * 4 + [(None, None, None, None, None, None, None, None)] * 2 + [(9000, "", "", "", "", 0, 0, 0), (9001, "long " * 60_000, "en", "wiki", "", 0, 0, 0)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(spark, law):
    rows = corpus()
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(6), shards=7, law=law).collect()
    assert sorted(((r.doc_id or -1, r.size, r.text_crc32) for r in got)) == sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        by[r.shard].append(r)
        assert r.law == law and r.grown_shard is None
    assert all([r.slot for r in rs] == list(range(len(rs))) for rs in by.values())
    order = [(r.curve, r.text_crc32, r.doc_id if r.doc_id is not None else -1) for s in sorted(by) for r in by[s]]
    assert order == sorted(order)
    if law == "rows":
        assert {len(rs) for rs in by.values()} == {len(rows) // 7, len(rows) // 7 + 1}
    else:
        sizes, most = [sum(r.size for r in by[s]) for s in range(7)], max(r.size for r in got)
        assert max(abs(s - sum(sizes) / 7) for s in sizes) <= most


def test_sharding_of_few_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    one = sharding.shard_documents(spark.createDataFrame([(None, None, None, None, None, None, None, None)], DOCS)).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in one] == [(None, 8, 0, 0, 0)]
    three = sharding.shard_documents(spark.createDataFrame([(i, "a", "x", "y", "", 0, 0, 0) for i in range(3)], DOCS), shards=24).collect()
    assert sorted(r.slot for r in three) == [0, 0, 0]


def test_shard_files_rule_out_filters_on_any_dimension(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(1, 2000), rnd.choice(["de", "en", "fr", "es"]), f"src{rnd.randint(0, 7)}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    back = sharding.write_shards(docs, str(tmp_path / "s"), shards=16, files=64)
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(rows)
    ends = back.groupBy(F.input_file_name()).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max))).collect()
    for column, value in (("lang", "en"), ("source", "src3")):
        open_ = sum(r[f"min_{column}"] <= value <= r[f"max_{column}"] for r in ends)
        assert open_ < 0.6 * len(ends)  # rows in random order leave all files open
    repeated = spark.createDataFrame([rows[0]] * 5 + [rows[1]], docs.schema)
    again = sharding.write_shards(repeated, str(tmp_path / "r"), shards=2)
    assert sorted(map(tuple, again.select(docs.columns).collect())) == sorted([rows[0]] * 5 + [rows[1]])


def test_places_of_a_hot_value(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 9).alias("v"), F.lit(2).cast("long").alias("w"))
    got = numbered(rows.repartition(7), [F.desc("v"), F.asc("id")], "w").collect()
    want = sorted(((r.v, r.id) for r in got), key=lambda p: (-p[0], p[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert all(r.before == 2 * r.place for r in got) and sorted(r.place for r in got) == list(range(1000))


# ---- 13 ------------------------------------------------------------------------


def resampled(rows, target, buckets, percent, seed, least=20):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(b for x in xs for b in features(x)[1]) for xs in ([r[1] for r in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, text in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resample(spark):
    rnd = random.Random(6)
    pool = [f"w{i}" for i in range(60)] + ["Ünï", "ß", "THE", "Of", "5", "日本"]
    make = lambda k: rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(k))
    rows = [(i, make(rnd.randint(0, 60))) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(80)]  # copies
    rows += [(900, None), (901, ""), (902, " .,! "), (903, make(30_000)), (904, "One"), (905, "one TWO"), (None, make(25)), (906, "a" * 100_000)] + [rows[8]] * 3
    target = [make(50) for _ in range(20)] + [None, "", "w1 w2 w3"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "nth", "pos", "word", "score", "b1")}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, percent in ((10_000, 5), (50, 40)):
        got = [tuple(r) for r in resample.resample(docs, aim, buckets=buckets, percent=percent).collect()]
        want = resampled(rows, target, buckets, percent, 42)
        # repeated rows share all but the rank, so that ranks are compared as sets for each row
        assert sorted(got, key=str) == want
    drawn = {r[0] for r in resampled(rows, target, 10_000, 5, 42) if r[4]}
    assert {r.doc_id for r in resample.draw(docs, aim).collect()} == drawn - {None}


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30)], docs.schema)
    assert resample.resample(docs, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, docs, percent=100).collect()] == resampled([(1, "a b " * 30)], [], 10_000, 100, 42)
