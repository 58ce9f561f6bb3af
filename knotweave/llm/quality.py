"""Quality scores from a generalised additive model with pairwise interactions.

The features of a whole text are plain statistics of its bytes, words and lines.
Each is cut into quantile bins; shallow trees over the bins are boosted in cycles,
one feature after the other, on the logistic loss, and the trees of a feature add
up to one lookup table. Then the pairs whose residual a 2 x 2 cut explains best get
a table each, boosted the same way. A score is the logistic of a sum of table
entries: a few vectorised lookups and additions per batch.

Cases: null and empty texts have all-zero features and get the score that these
have; without any labelled row every score is 0.5; null doc_ids train nothing and
are not held out; a document with several label rows teaches once per row, and so does
each of a doc_id's repeated rows, within the sample's bound; a very long text is one
slice of its batch; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave.llm.text import blobs, join_words, mix64, slices, small, word_hashes

#: Bound of the training sample (labelled rows, chosen by a hash of doc_id).
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 4

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "marks", "bangs", "bars", "stops", "high_bytes",
    "distinct_words", "commonest_word", "same_as_last", "distinct_pairs", "marked_words", "log_lines", "line_bytes", "distinct_lines", "capital_words",
]

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_STOP = b".,"
_MARK = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP and b not in b"!|'\"-")
_HIGH = bytes(range(128, 256))


def _shares(texts: list[bytes], size: np.ndarray) -> np.ndarray:
    kinds = (_UPPER, _DIGIT, _MARK, b"!", b"|", _STOP, _HIGH)
    left = np.array([[len(t.translate(None, kind)) for kind in kinds] for t in texts], np.float64).reshape(len(texts), len(kinds))
    return (size[:, None] - left) / np.maximum(size, 1)[:, None]


_ENDS_MARKED = np.isin(np.arange(256), list(_MARK + b"!|"))


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES for each text; counts of words and pairs of words are array sums over all texts at once."""
    texts = [t or b"" for t in texts]
    buf, at = join_words(texts)
    word, begin, end = word_hashes(buf)
    raw = np.frombuffer(buf, np.uint8)
    n_docs = len(texts)
    first = np.append(np.searchsorted(begin, at), len(word))
    m = np.diff(first)
    doc = np.repeat(np.arange(n_docs), m)
    some = np.flatnonzero(m)
    per_doc = lambda at, weight=None: np.bincount(at, weight, n_docs)

    def distinct(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many different values each text has, and how often its commonest stands."""
        _, place, count = np.unique(mix64(value ^ mix64(owner.astype(np.uint64))), return_index=True, return_counts=True)
        most = np.zeros(n_docs)
        np.maximum.at(most, owner[place], count)
        return per_doc(owner[place]), most

    inside = np.flatnonzero(doc[1:] == doc[:-1])  # words with a word after them in their text
    words, commonest = distinct(word, doc)
    pairs, _ = distinct(word[inside] * np.uint64(0x9E3779B97F4A7C15) + word[inside + 1], doc[inside])
    again = per_doc(doc[inside[word[inside] == word[inside + 1]]])
    marked = per_doc(doc[_ENDS_MARKED[raw[end - 1]]]) if len(word) else per_doc(doc)
    capital = per_doc(doc[(raw[begin] >= 65) & (raw[begin] <= 90)]) if len(word) else per_doc(doc)
    longest = np.zeros(n_docs)
    if len(some):
        longest[some] = np.maximum.reduceat(end - begin, first[:-1][some])
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    n_lines, n_unlike = (np.array([f(x) for x in lines], np.float64) for f in (len, lambda x: len(set(x))))
    n = np.fromiter(map(len, texts), np.float64, n_docs)
    share = _shares(texts, n)
    k, l1 = np.maximum(m, 1), np.maximum(n_lines, 1)
    out = np.column_stack([
        np.log1p(n), np.log1p(m), (n - m) / k, longest, share, words / k, commonest / k, again / k, (pairs + 1) / k, marked / k,
        np.log1p(n_lines), n / l1, n_unlike / l1, capital / k,
    ])
    out[m == 0] = 0
    return out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.edges:
            b = self.bins(x)
            for table, at in zip(self.tables, b, strict=True):
                out += table[at]
            for i, j, table in self.pairs:
                out += table[coarse(b[i], len(self.edges[i])), coarse(b[j], len(self.edges[j]))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def coarse(bins: np.ndarray, n_edges: int) -> np.ndarray:
    return bins * PAIR_BINS // (n_edges + 1)


def tree_on_bins(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton values of a tree with few leaves over ordered bins, grown by the best next split."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = value(a, k) + value(k, b) - value(a, b)
                best = max(best, (float(gain.max()), int(k[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four: its gain and its Newton values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, table = 0.0, np.zeros_like(g)
    rows, cols = g.shape
    for i in range(1, rows):
        for j in range(1, cols):
            parts = [(0, i, 0, j), (0, i, j, cols), (i, rows, 0, j), (i, rows, j, cols)]
            sums = [(c[b, d] - c[a, d] - c[b, e] + c[a, e]) for a, b, e, d in parts for c in (cg, ch)]
            values = [sums[2 * k] / (sums[2 * k + 1] + 1.0) for k in range(4)]
            gain = sum(sums[2 * k] * values[k] for k in range(4))
            if gain > best:
                best, table = gain, np.zeros_like(g)
                for (a, b, e, d), v in zip(parts, values, strict=True):
                    table[a:b, e:d] = v
    return best, table


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = AdditiveModel(float(np.log(p / (1 - p))))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, i], quantiles)) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    raw = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for i, at in enumerate(bins):  # the cycle: each feature corrects what the others leave
            q = 1 / (1 + np.exp(-raw))
            size = len(model.tables[i])
            step = RATE * tree_on_bins(np.bincount(at, y - q, size), np.bincount(at, q * (1 - q), size))
            model.tables[i] += step
            raw += step[at]
    q = 1 / (1 + np.exp(-raw))
    small = [coarse(b, len(e)) for b, e in zip(bins, model.edges, strict=True)]

    def grids(i: int, j: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = small[i] * PAIR_BINS + small[j]
        return tuple(np.bincount(at, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - q, q * (1 - q)))

    n = x.shape[1]
    gains = sorted(((quadrants(*grids(i, j, q))[0], -i, -j) for i in range(n) for j in range(i + 1, n)), reverse=True)
    chosen = [(-i, -j) for gain, i, j in gains[:PAIRS] if gain > 0]
    tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in chosen]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(chosen):
            q = 1 / (1 + np.exp(-raw))
            step = RATE * quadrants(*grids(i, j, q))[1]
            tables[k] += step
            raw += step[small[i], small[j]]
    model.pairs = [(i, j, t) for (i, j), t in zip(chosen, tables, strict=True)]
    return model


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    parts = [features(texts[i:j]) for i, j in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


SCHEMA = "doc_id long, held_out boolean, score double"


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A score in [0, 1] for every row of ``docs``; learned from ``labels`` (doc_id, quality) outside the held-out fold."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held_out
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~fold)
    # rows in the order of a hash of doc_id: a sample by chance, the same every time, bounded whatever repeats
    draw = F.xxhash64("doc_id")
    sampled = known.orderBy(draw, "doc_id", "quality").limit(sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = [x.astype("<f8").tobytes() for x in _matrix(blobs(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], names=["doc_id", "quality", "x"])

    # the sample's side has at most sample_rows rows of two numbers, so it is small enough to broadcast
    met = text.join(F.broadcast(sampled), "doc_id").select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality double, x binary")
    rows = met.orderBy(draw, "doc_id", "x", "quality").limit(sample_rows).collect()
    model = AdditiveModel(0.0)
    if rows:
        rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"]), r["quality"]))
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f8").reshape(len(rows), len(FEATURES))
        model = fit(x, np.array([r["quality"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            score = model.score(_matrix(blobs(b.column(1)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score)], names=["doc_id", "held_out", "score"])

    return text.select("doc_id", "text", F.coalesce(fold, F.lit(False)).alias("held_out")).mapInArrow(run, SCHEMA)
