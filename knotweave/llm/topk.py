"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks. A block keeps one list per dimension, sorted by
that component; a query reads the lists from the end that its sign favours, in
sequential batches of growing depth. Components that have been read are known; for the
others a candidate's upper bound takes the list's frontier value and its lower bound
the list's far end. After each batch the stop is tested: reading ends as soon as hardly
anyone outside the k best lower bounds has an upper bound that reaches them; those who
can still qualify are resolved to their final scores. The test is cheap: a fixed sample
of candidates is bounded first, and only queries for which the sample leaves few open get
the bounds of all. A query that can't stop reads its lists to the end, where bounds
are scores: one matrix product. The blocks' results meet in one ranking of k rows per
query and block.

How much is read depends on the vectors: few strong components let a query stop early,
while for dense random directions nobody can be ruled out before the lists' ends.
``share_read`` reports it.

Scores are exact: components are whole numbers and sums stay below 2^53 in double
(larger ones are summed as Python integers).

Cases: vectors that are null or empty, hold null or non-finite components, or have a
null vec_id take no part; vectors of different lengths don't meet; ties go to the
smaller vec_id; rows of one vec_id never meet, each counts as a candidate, and as a query
the least of their vectors asks; fewer than k candidates give fewer rows; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components of the candidates and queries in a block (what one task holds), and queries that step together.
COMPONENTS, TOGETHER = 1 << 20, 512
#: Shares of a list that have been read after each batch, and candidates of the first stop test.
DEPTHS, PROBE = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1), 64


class SortedLists:
    """One list per dimension over a block of candidates (whole numbers as doubles)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)

    def bounds(self, depth: int, q: np.ndarray, rows: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (query x candidate of ``rows``) after ``depth`` entries of each list.

        A positive weight reads from the top, a negative one from the bottom.
        """
        n = len(self.x)
        x, rank = self.x[rows], self.rank[rows]
        if depth >= n:
            score = q @ x.T
            return score, score
        weight = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        seen = np.concatenate([rank >= n - depth, rank < depth], axis=1)
        both = np.concatenate([x, x], axis=1)
        far = np.concatenate([self.sorted[0], self.sorted[-1]])
        frontier = np.concatenate([self.sorted[n - depth], self.sorted[depth - 1]])
        low = weight @ np.where(seen, both, far).T
        return low, low + weight @ np.where(seen, 0, frontier - far).T


def top_k(x: np.ndarray, x_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of query, vec_id, score) of the k best of a block for each query, and the share of the lists that each query read."""
    n = len(x)
    lists = SortedLists(x)
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**52
    slack = 0 if exact else 1e-9
    probe = np.unique(np.linspace(0, n - 1, PROBE).astype(np.int64))
    share_read = np.ones(len(q))
    who, ids, scores = [], [], []

    def settle(i: int, can: np.ndarray) -> None:
        """Resolve the final scores of those who can still qualify."""
        if exact:
            s = x[can] @ q[i]
        else:
            s = np.array([sum(int(a) * int(b) for a, b in zip(row, q[i], strict=True)) for row in x[can]], object)
        best = sorted(zip((-s).tolist(), x_ids[can].tolist(), strict=True))[:k]
        who.extend([i] * len(best))
        ids.extend(b for _, b in best)
        scores.extend(int(-a) for a, _ in best)

    def qualify(open_: np.ndarray, depth: int, rows: slice | np.ndarray, kth: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Who of ``rows`` can qualify, and each query's k-th lower bound (given, or that of the rows)."""
        low, high = lists.bounds(depth, q[open_], rows)
        own = q_ids[open_][:, None] == x_ids[rows][None, :]
        low = np.where(own, -np.inf, low)
        m = low.shape[1]
        best = np.partition(low, m - k, axis=1)[:, m - k] if m > k else np.full(len(open_), -np.inf)
        kth = best if kth is None else np.maximum(best, kth)
        return (high >= (kth - np.abs(np.where(np.isfinite(kth), kth, 0)) * slack)[:, None]) & ~own, kth

    for at in range(0, len(q), TOGETHER):
        open_ = np.arange(at, min(at + TOGETHER, len(q)))
        for share in DEPTHS:
            depth = max(1, int(np.ceil(n * share)))
            if depth < n:
                # the sample's own k best can only be worse than the block's, so the few it leaves open may be too many, never too few
                few = qualify(open_, depth, probe, None)[0].sum(axis=1) <= k + 1
                maybe = open_[few]
                can = qualify(maybe, depth, slice(None), None)[0] if len(maybe) else np.zeros((0, n), np.bool_)
                done = can.sum(axis=1) <= 4 * k
            else:
                maybe, done = open_, np.ones(len(open_), np.bool_)
                can = qualify(maybe, depth, slice(None), None)[0] if len(maybe) else np.zeros((0, n), np.bool_)
            for i, row in zip(maybe[done].tolist(), can[done], strict=True):
                share_read[i] = depth / n
                settle(i, np.flatnonzero(row))
            open_ = np.setdiff1d(open_, maybe[done])
            if not len(open_) or depth >= n:
                break
    return np.array(who, np.int64), np.array(ids, np.int64), np.array(scores, np.int64), share_read


def share_read(x: np.ndarray, q: np.ndarray, k: int = 5) -> float:
    """The mean share of their lists that queries ``q`` read before they stop, among candidates ``x``."""
    return float(top_k(x, np.arange(len(x)), q, np.full(len(q), -1), k)[3].mean())


def _matrix(column: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    return np.floor(scale * column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates (every other row) of each query row."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    counts = good.agg(F.sum(F.size("embedding")).alias("n"), F.sum(F.when(F.col("q"), F.size("embedding"))).alias("q")).first()
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(counts["n"] or 0) // COMPONENTS))
    q_blocks = max(1, -(-(counts["q"] or 0) // COMPONENTS))
    dealt = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # each block of candidates meets each block of queries exactly once
    left = good.select("vec_id", "embedding", F.size("embedding").alias("dim"), dealt("c", n_blocks).alias("cb"), every(q_blocks).alias("qb"))
    right = good.where("q").select("vec_id", "embedding", F.size("embedding").alias("dim"), every(n_blocks).alias("cb"), dealt("q", q_blocks).alias("qb"))

    def meet(candidates, queries):
        who = ids = scores = np.zeros(0, np.int64)
        if candidates.num_rows and queries.num_rows:
            dim = queries["dim"][0].as_py()
            q_ids, q = queries["vec_id"].to_numpy(), _matrix(queries["embedding"], dim, scale)
            order = np.lexsort((*q.T[::-1], q_ids))
            one = order[np.diff(q_ids[order], prepend=q_ids[order[0]] - 1) != 0]  # of a query's rows the least vector asks
            q_ids, q = q_ids[one], q[one]
            i, ids, scores, _ = top_k(_matrix(candidates["embedding"], dim, scale), candidates["vec_id"].to_numpy(), q, q_ids, k)
            who = q_ids[i]
        return pa.table({"query_id": pa.array(who), "vec_id": pa.array(ids), "score": pa.array(scores)})

    key = ["dim", "cb", "qb"]
    part = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
