"""Hard negatives by an exact search over one-dimensional distance keys.

An inner product becomes a distance: a candidate x gets one more component,
sqrt(M^2 - |x|^2) with M the greatest norm, a query q gets 0 there, and then
|q - x|^2 = M^2 + |q|^2 - 2 q.x. Candidates are stored sorted by (pivot, distance): the pivot
is the nearest of a few centres, the distance is to it. The store is a table of blocks, each
a run of that order, with a directory of the distances that a block holds of each pivot. By
the triangle inequality a run of keys [a, b] of a pivot at distance D from the query holds
only distances from max(a - D, D - b, 0) to D + b, so a bound on the distance selects an
interval of keys for each pivot, an annulus around it.

A search keeps a window of allowed scores for each query, whose lower end rises to the
k-th best score found. First each query scans the block whose keys are likeliest to hold
its answer; then all blocks that the risen bound leaves, and only those. Within a block
annuli are read nearest first, in steps that double, until the bound rules out the rest.
What is found is exact at any sharpness of the bounds: they only decide what is read.
``share_read`` reports how much. Centres come from a bounded sample (SAMPLE rows, by hash of
vec_id), which affects speed alone.

Positives are a search of the anchor's label without a window; negatives a search of the
other labels with one window for each positive, all windows of an anchor in one scan.

Cases: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite
component take no part; vectors of different lengths never meet; rows with the anchor's
vec_id don't count; a vec_id found several times with one score counts once; of an anchor's
rows the least (label, vector) asks; ties go to the smaller vec_id; fewer than k give
fewer rows; a positive with a negative score has no window (its ends cross), one of 0 only
takes 0; scores beyond a long raise an error; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.text import checkpointed, shared_dir

#: Centres, and the rows of the sample that they are fitted to.
PIVOTS, SAMPLE = 64, 2048
#: Components of a block of candidates or queries (what one task holds), rows of an annulus, queries that step together.
COMPONENTS, ANNULUS, TOGETHER = 1 << 20, 256, 256
#: Rows of a directory up to which it is broadcast.
DIRECTORY_ROWS = 100_000

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most ``n`` centres of the (augmented) rows: Lloyd's rounds from rows that lie far from each other."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    c = sample[chosen]
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] + (c**2).sum(1) - 2 * sample @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n_near = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n_near > 0, sums / np.maximum(n_near, 1), c)
    return c


@dataclass(frozen=True)
class Keys:
    """Pivots (centres with the added component last) and the square of the greatest norm."""

    pivots: np.ndarray
    top: float

    def fitted(self, dim: int) -> np.ndarray:
        """The pivots for vectors of ``dim`` components, cut off or filled up with zeros: any points will do."""
        out = np.zeros((len(self.pivots), dim + 1))
        n = min(dim, self.pivots.shape[1] - 1)
        out[:, :n], out[:, -1] = self.pivots[:, :n], self.pivots[:, -1]
        return out

    def distances(self, x: np.ndarray, candidates: bool) -> np.ndarray:
        """Distance of each row of ``x``, augmented as a candidate or as a query, to each pivot."""
        p = self.fitted(x.shape[1])
        norm = (x * x).sum(1)
        dot = x @ p[:, :-1].T
        if candidates:
            dot = dot + np.sqrt(np.maximum(self.top - norm, 0))[:, None] * p[:, -1]
        full = np.full(len(x), self.top) if candidates else norm
        return np.sqrt(np.maximum(full[:, None] + (p * p).sum(1) - 2 * dot, 0))

    def slack(self, square: np.ndarray) -> np.ndarray:
        """What rounding may add to a score's bound, for queries of these squared norms."""
        return 1e-7 * (self.top + square) + 1e-6


def annuli(keys: Keys, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, pivot: np.ndarray, dist: np.ndarray, q: np.ndarray, own: np.ndarray, q_label: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
    """(query, window, vec_id, score) of the k best of a block in each query's windows [lo, hi], and the share of the block that the queries read.

    A window keeps the smaller vec_ids of equal scores, and equal (vec_id, score) once.
    """
    order = np.lexsort((dist, pivot))
    x, ids, labels, pivot, dist = x[order], ids[order], labels[order], pivot[order], dist[order]
    runs = np.flatnonzero(np.diff(pivot, prepend=-1))
    starts = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(runs, [*runs[1:], len(x)], strict=True)])
    ends = np.append(starts[1:], len(x))
    near, far, at = dist[starts], dist[ends - 1], pivot[starts]
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**52
    if not exact:
        whole = np.vectorize(int, otypes=[object])
        x_whole, q_whole, lo, hi = whole(x), whole(q), lo.astype(object), hi.astype(object)
    out, read = [], 0
    for first in range(0, len(q), TOGETHER):
        rows = slice(first, first + TOGETHER)
        low, high = lo[rows].copy(), hi[rows]
        square = (q[rows] ** 2).sum(1)[:, None]
        d = keys.distances(q[rows], candidates=False)[:, at]
        nearest = np.maximum(np.maximum(near - d, d - far), 0)
        upper = (keys.top + square - nearest**2) / 2 + keys.slack(square)
        lower = (keys.top + square - (d + far) ** 2) / 2 - keys.slack(square)
        rank = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
        found = np.zeros((0, 3), np.int64)  # query and window as one number, score, vec_id
        a, b = 0, 4
        while a < len(starts):
            can = np.zeros(rank.shape, np.bool_)
            for w in range(low.shape[1]):
                can |= ((upper >= low[:, w : w + 1]) & (lower <= high[:, w : w + 1])).astype(np.bool_)
            can &= rank >= a
            if not can.any():
                break
            can &= rank < b
            hits = [found]
            for j in np.flatnonzero(can.any(0)).tolist():
                who = np.flatnonzero(can[:, j])
                part = slice(starts[j], ends[j])
                read += len(who) * int(ends[j] - starts[j])
                s = q[rows][who] @ x[part].T if exact else q_whole[rows][who] @ x_whole[part].T
                ok = ((labels[part] == q_label[rows][who][:, None]) == same) & (ids[part] != own[rows][who][:, None])
                for w in range(low.shape[1]):
                    i, c = np.nonzero(ok & (s >= low[who, w][:, None]).astype(np.bool_) & (s <= high[who, w][:, None]).astype(np.bool_))
                    if len(i):
                        hits.append(np.stack([who[i] * low.shape[1] + w, s[i, c].astype(np.int64), ids[part][c]], axis=1))
            found = best(np.concatenate(hits), k)
            which, n = np.unique(found[:, 0], return_counts=True)
            if len(which):
                last = found[np.cumsum(n) - 1, 1]
                which, last = which[n == k], last[n == k]  # k found: nothing below the last of them is wanted
                low[which // low.shape[1], which % low.shape[1]] = last
            a, b = b, b + 2 * (b - a)
        out.append(np.column_stack([found[:, 0] // lo.shape[1] + first, found[:, 0] % lo.shape[1], found[:, 2], found[:, 1]]))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64), read / max(1, len(q) * len(x))


def best(hits: np.ndarray, k: int) -> np.ndarray:
    """Of rows (group, score, id) the ``k`` best of each group, highest scores and then smallest ids first, equal rows once."""
    hits = hits[np.lexsort((hits[:, 2], -hits[:, 1], hits[:, 0]))]
    if len(hits):
        hits = hits[np.append(True, (np.diff(hits, axis=0) != 0).any(1))]
    new = np.append(True, np.diff(hits[:, 0]) != 0) if len(hits) else np.zeros(0, np.bool_)
    begins = np.flatnonzero(new)
    place = np.arange(len(hits)) - np.repeat(begins, np.diff(np.append(begins, len(hits))))
    return hits[place < k]


def share_read(x: np.ndarray, q: np.ndarray, k: int = 5, pivots: int = PIVOTS) -> float:
    """Of the candidates ``x``, the share that queries ``q`` read for their k best, all in one block."""
    keys, pivot, dist = _fit(x, pivots)
    free = np.full((len(q), 1), _LEAST), np.full((len(q), 1), _MOST)
    zeros = np.zeros(len(x), np.int64)
    return annuli(keys, x, np.arange(len(x)), zeros, pivot, dist, q, np.full(len(q), -1), np.zeros(len(q), np.int64), *free, k, True)[1]


def _fit(x: np.ndarray, pivots: int = PIVOTS) -> tuple[Keys, np.ndarray, np.ndarray]:
    norm = (x * x).sum(1)
    top = float(norm.max(initial=0))
    keys = Keys(centres(np.column_stack([x[:SAMPLE], np.sqrt(top - norm[:SAMPLE])]), pivots), top)
    d = keys.distances(x, candidates=True)
    return keys, d.argmin(1), d.min(1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass(frozen=True)
class Store:
    """``rows`` (block, dim, pivot, dist, vec_id, label, x) in the order of their keys, ``directory`` (block, dim, pivot, near, far)."""

    rows: DataFrame
    directory: DataFrame
    entries: int
    keys: Keys


def build_store(vectors: DataFrame, pivots: int = PIVOTS) -> Store:
    """The store of ``vectors`` (vec_id, label, x: array of whole numbers as doubles), written to the shared folder."""
    spark = vectors.sparkSession
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    facts = vectors.agg(F.sum(F.size("x")).alias("components"), F.max(square).alias("top"), F.max(F.size("x")).alias("width")).first()
    top, width = float(facts["top"] or 0), facts["width"] or 1
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()
    sample = np.zeros((len(drawn), width))
    for i, row in enumerate(drawn):
        sample[i, : len(row["x"])] = row["x"]
    keys = Keys(centres(np.column_stack([sample, np.sqrt(np.maximum(top - (sample**2).sum(1), 0))]), pivots), top)

    def keyed(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                d = keys.distances(_matrix(b["x"].take(pa.array(of)), dim), candidates=True)
                pivot[of], dist[of] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(dist)], [*b.schema.names, "pivot", "dist"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * -(-(facts["components"] or 0) // COMPONENTS))
    plain = vectors.select("vec_id", "label", "x", F.size("x").alias("dim"))
    schema = "vec_id long, label long, x array<double>, dim int, pivot int, dist double"
    order = ["dim", "pivot", "dist", "vec_id"]  # the id parts equal vectors
    folder = shared_dir(spark, "distance-keys")
    plain.mapInArrow(keyed, schema).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    directory = checkpointed(rows.groupBy("block", "dim", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far")))
    return Store(rows, directory, directory.count(), keys)


def _routes(store: Store, queries: DataFrame) -> DataFrame:
    """qid, block, upper (the most that a score can be there) of all blocks that can hold a score in one of the query's windows."""
    keys = store.keys

    def measured(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                q = _matrix(b["x"].take(pa.array(of)), dim)
                d = keys.distances(q, candidates=False)
                n, p = d.shape
                square = (q * q).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b["qid"].to_numpy()[of], p)), pa.array(np.full(n * p, dim, np.int32)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(d.ravel()), pa.array(np.repeat(keys.top + square, p)), pa.array(np.repeat(keys.slack(square), p))],
                    ["qid", "dim", "pivot", "d", "full", "slack"],
                )

    distances = queries.select("qid", "dim", "x").mapInArrow(measured, "qid long, dim int, pivot int, d double, full double, slack double")
    directory = F.broadcast(store.directory) if store.entries <= DIRECTORY_ROWS else store.directory
    nearest = F.greatest(F.col("near") - F.col("d"), F.col("d") - F.col("far"), F.lit(0.0))
    upper = (F.col("full") - nearest * nearest) / 2 + F.col("slack")
    lower = (F.col("full") - F.pow(F.col("d") + F.col("far"), F.lit(2.0))) / 2 - F.col("slack")
    bounds = distances.join(directory, ["dim", "pivot"]).groupBy("qid", "block").agg(F.max(upper).alias("upper"), F.min(lower).alias("lower"))
    open_ = F.exists(F.arrays_zip("lo", "hi"), lambda w: (F.col("upper") >= w["lo"]) & (F.col("lower") <= w["hi"]))
    return bounds.join(queries.select("qid", "lo", "hi"), "qid").where(open_).select("qid", "block", "upper")


def _scan(store: Store, queries: DataFrame, routes: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """qid, w, vec_id, score: the k best of each block in each window of the queries that are sent there."""
    keys = store.keys

    def meet(candidates, asking):
        found = np.zeros((0, 4), np.int64)
        if candidates.num_rows and asking.num_rows:
            width = len(asking["lo"][0].as_py())
            dims, q_dims = candidates["dim"].to_numpy(), asking["dim"].to_numpy()
            windows = lambda c, of: asking[c].combine_chunks().flatten().to_numpy().reshape(-1, width)[of]
            for dim in np.intersect1d(dims, q_dims).tolist():
                of, q_of = np.flatnonzero(dims == dim), np.flatnonzero(q_dims == dim)
                take = lambda c, of=of: candidates[c].to_numpy()[of]
                x, q = _matrix(candidates["x"].take(pa.array(of)), dim), _matrix(asking["x"].take(pa.array(q_of)), dim)
                ids = asking["qid"].to_numpy()[q_of]
                got, _ = annuli(keys, x, take("vec_id"), take("label"), take("pivot"), take("dist"), q, ids, asking["label"].to_numpy()[q_of], windows("lo", q_of), windows("hi", q_of), k, same)
                got[:, 0] = ids[got[:, 0]]
                found = np.concatenate([found, got])
        return pa.table({"qid": found[:, 0], "w": found[:, 1].astype(np.int32), "vec_id": found[:, 2], "score": found[:, 3]})

    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
    sent = routes.select("qid", "block", part.alias("part")).join(queries, "qid")
    wanted = routes.select("block", part.alias("to")).distinct()  # a block goes only where it is asked for
    left = store.rows.join(wanted, "block").select("block", "to", "dim", "pivot", "dist", "vec_id", "label", "x")
    return left.groupBy("block", "to").cogroup(sent.groupBy("block", "part")).applyInArrow(meet, "qid long, w int, vec_id long, score long")


def search(store: Store, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, w, rank (from 1), vec_id, score: for each window w the k best rows of the query's label (or, not ``same``, of others).

    ``queries``: qid (the vec_id that doesn't count), label, x, lo and hi (arrays of as many
    longs for all queries).
    """
    queries = checkpointed(queries.withColumn("dim", F.size("x")))
    components = queries.agg(F.sum("dim")).first()[0] or 0
    parts = max(1, -(-components // COMPONENTS))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("upper"), "block"))
    routes = checkpointed(_routes(store, queries).withColumn("place", place))
    early = checkpointed(_scan(store, queries, routes.where("place = 1"), parts, k, same))
    # where k were found, nothing below the last of them is wanted any more
    risen = early.groupBy("qid", "w").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
    risen = risen.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "last"))).alias("risen"))
    bounded = queries.join(risen, "qid", "left").withColumn("lo", F.transform("lo", lambda v, i: F.greatest(v, F.coalesce(F.element_at("risen", i), v)))).drop("risen")
    bounded = checkpointed(bounded)
    open_ = F.exists("lo", lambda v: F.col("upper") >= v)
    rest = routes.where("place > 1").join(bounded.select("qid", "lo"), "qid").where(open_).select("qid", "block")
    found = early.union(_scan(store, bounded, rest, parts, k, same)).distinct()
    order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "w", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, x of the rows that take part; x = floor(scale * component)."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fine)
    return good.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(F.lit(scale) * v).cast("double")).alias("x"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, label, embedding).

    For each of the anchor's best rows of its label, the best rows of other labels whose
    score is between ``low`` and ``high`` hundredths of the positive's.
    """
    store = build_store(usable(vectors, scale))
    least = F.min(F.struct("label", "x")).alias("a")
    anchors = checkpointed(store.rows.where(is_anchor).groupBy(F.col("vec_id").alias("qid")).agg(least).select("qid", "a.label", "a.x"))
    free = {"lo": F.array(F.lit(_LEAST)), "hi": F.array(F.lit(_MOST))}
    friends = checkpointed(search(store, anchors.withColumns(free), positives, same=True))
    # 100 * score in [low * p, high * p]: whole ends, rounded inwards
    hundredths = lambda n: F.col("score").cast("decimal(20,0)") * n / 100
    ends = friends.select("qid", (F.col("rank") - 1).alias("w"), F.ceil(hundredths(low)).cast("long").alias("lo"), F.floor(hundredths(high)).cast("long").alias("hi"))
    listed = ends.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("lo", "hi")))).alias("ends"))
    at = F.sequence(F.lit(0), F.lit(positives - 1))
    end = lambda name, none: F.transform(at, lambda i: F.coalesce(F.element_at("ends", i)[name], F.lit(none)))
    asking = anchors.join(listed, "qid").select("qid", "label", "x", end("lo", _MOST).alias("lo"), end("hi", _LEAST).alias("hi"))
    foes = search(store, asking, negatives, same=False)
    pairs = friends.select("qid", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return foes.join(pairs, ["qid", "w"]).select(F.col("qid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
