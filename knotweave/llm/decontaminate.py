"""Benchmark decontamination: a BM25 index of the test items, searched with every passage by block-max WAND.

The (small, size-checked) benchmark is indexed: each item, or each piece of at most
``UNIT`` words of a longer one, has a BM25 impact for each of its terms, divided by
the sum of its impacts, so that 1.0 means that a passage holds all of it. A posting
list is sorted by unit and cut into blocks at multiples of ``BLOCK`` units; a block's
greatest impact is kept, only where the list has postings. Every document is read as
passages of ``PASSAGE`` words, half overlapping; so each unit lies wholly in some passage.

Block-max WAND takes two steps. The bounds of many passages' blocks (sums of their
terms' block maxima) are added up at once as arrays; a block below the threshold is
skipped by all cursors. Cursors over the whole posting lists then jump from one block
that is left to the next, and inside it move to the first unit that the lists' maxima
allow; every unit at or above the threshold is returned (no top-k).

A retrieved pair counts as a leak if the surrounding words hold enough of the item, as
runs of ``GRAM`` words: of its question and of its answer where the item marks them (the
answer follows "answer:" or the last question mark), else of the retrieved unit as one
whole, so that an excerpt of a long item counts too.

The documents are never shuffled; the index travels to the executors in shards of a
checked size (one, and so one scan, up to ``SHARD_BYTES`` of items), and a benchmark of
any size is searched shard by shard. Unit count, mean length and document frequencies
are those of all items in every shard, so the split changes no score.

Cases: null or empty texts and items match nothing; an item of fewer than ``GRAM``
words must stand word by word; equal items are all reported; repeated rows give
repeated results; the best passage of a document and item counts (ties: the first); a
very long text is read as passages like any other; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave.llm.text import WORDS, blobs, checkpointed, doc_text, gram_hashes, join_words, slices, small, word_hashes
from knotweave.llm.tokens import release_encoders

UNIT, PASSAGE, GRAM, BLOCK = 64, 128, 5, 8
#: Sums of block maxima that one step may hold.
CELLS = 1 << 22
K1, B = 1.2, 0.75
#: Share of a unit's BM25 mass that a passage must hold, and of question and answer runs.
THRESHOLD, OVERLAP = 0.6, 0.5
#: Bytes of item text in one shard of the index.
SHARD_BYTES = 16 << 20


def hashes(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(WORDS))[0]


def question_and_answer(text: str) -> tuple[str, str] | None:
    """Question and answer of an item that marks them; None for any other text."""
    m = re.search(r"(?is)^(.*?)\banswer\s*:(.*\w.*)$", text) or re.search(r"(?s)^(.*\?)(.*\w.*)$", text)
    return (m[1], m[2]) if m and re.search(r"\w", m[1]) else None


def runs(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM words; of fewer words, the whole as one run."""
    return np.unique(gram_hashes(words, min(GRAM, len(words)))) if len(words) else np.zeros(0, np.uint64)


@dataclass
class Part:
    """What has to stand in a document: the runs of a question, an answer or a unit."""

    runs: np.ndarray
    width: int  # words of a run

    def share(self, words: np.ndarray) -> float:
        return float(np.isin(self.runs, gram_hashes(words, self.width)).mean()) if len(self.runs) else 1.0


def part(words: np.ndarray) -> Part:
    return Part(runs(words), min(GRAM, len(words)))


@dataclass
class Item:
    item_id: int | None
    n_words: int
    parts: list[Part]  # question and answer, where the item marks them


@dataclass
class Unit:
    n_words: int
    whole: Part


@dataclass
class Index:
    """Posting lists of units with impacts, sorted by unit, and their blocks."""

    items: list[Item] = field(default_factory=list)
    units: list[Unit | None] = field(default_factory=list)  # None: the item's parts are verified
    unit_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    unit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    impact: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    list_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n_blocks: int = 0
    block_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each list
    block_key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # list * n_blocks + block
    block_start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # its first posting
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))


def unit_words(words: np.ndarray) -> Iterator[np.ndarray]:
    """The pieces of an item that are indexed: at most UNIT words each, half overlapping."""
    for k in range(0, len(words), UNIT // 2):
        yield words[k : k + UNIT]
        if k + UNIT >= len(words):
            break


@dataclass
class Statistics:
    """What BM25 needs to know of all units of the benchmark."""

    units: int
    words: int
    df: dict[int, int]  # units that hold a term


def statistics(units: list[np.ndarray]) -> Statistics:
    return Statistics(len(units), sum(map(len, units)), Counter(t for u in units for t in set(u.tolist())))


def build_index(rows: list[tuple[int | None, str]], stats: Statistics | None = None) -> Index:
    """The index of ``rows``; ``stats`` are those of the whole benchmark where ``rows`` are a part of it."""
    items, units, owner = [], [], []
    for item_id, text in rows:
        words = hashes((text or "").encode())
        if not len(words):
            continue
        items.append(Item(item_id, len(words), [part(hashes(x.encode())) for x in question_and_answer(text) or ()]))
        for u in unit_words(words):
            units.append(u)
            owner.append(len(items) - 1)
    if not units:
        return Index()
    stats = stats or statistics(units)
    held = [np.unique(u, return_counts=True) for u in units]
    sizes = [len(t) for t, _ in held]
    term, n = np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])
    unit = np.repeat(np.arange(len(units)), sizes)
    order = np.lexsort((unit, term))
    term, n, unit = term[order], n[order], unit[order]
    terms, first = np.unique(term, return_index=True)
    first = np.append(first, len(term))
    df = np.repeat(np.array([stats.df[t] for t in terms.tolist()]), np.diff(first))
    words = np.array([len(u) for u in units])[unit]
    weight = np.log1p((stats.units - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * words / (stats.words / stats.units)))
    impact = weight / np.bincount(unit, weight)[unit]
    n_blocks = -(-len(units) // BLOCK)
    key = np.repeat(np.arange(len(terms)), np.diff(first)) * n_blocks + unit // BLOCK
    block_key, start = np.unique(key, return_index=True)
    verified = [None if items[k].parts else Unit(len(u), part(u)) for u, k in zip(units, owner, strict=True)]
    return Index(
        items, verified, np.array(owner), terms, first, unit.astype(np.int32), impact, np.maximum.reduceat(impact, first[:-1]),
        n_blocks, np.searchsorted(block_key, np.arange(len(terms) + 1) * n_blocks), block_key, np.append(start, len(term)), np.maximum.reduceat(impact, start),
    )


#: Sums of many small numbers may differ in their last digits by the order of adding.
_SLACK = 1e-9


def open_blocks(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block) of all blocks whose maxima can reach the threshold; ``passage`` is sorted, with a row for each of its terms."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sizes = np.diff(index.block_first)[term]
    new = np.flatnonzero(np.diff(passage, prepend=-1))  # first row of each passage
    edges = np.append(np.arange(0, len(new), max(1, CELLS // max(1, index.n_blocks))), len(new))
    row = np.append(new, len(passage))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a, b = int(row[i]), int(row[j])
        n = sizes[a:b]
        entry = np.repeat(index.block_first[term[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat(np.arange(j - i), np.diff(row[i : j + 1]))
        cell = np.repeat(place, n) * index.n_blocks + index.block_key[entry] % index.n_blocks
        bound = np.bincount(cell, index.block_max[entry], (j - i) * index.n_blocks)
        hit = np.flatnonzero(bound >= threshold - _SLACK)
        out.append((passage[row[i + hit // index.n_blocks]], hit % index.n_blocks))
    return np.concatenate([p for p, _ in out]), np.concatenate([k for _, k in out])


def block_max_wand(index: Index, terms: np.ndarray, blocks: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (unit, score) with score >= threshold for a passage's distinct ``terms``; ``blocks`` are those not to be skipped."""
    out = []
    for block in blocks:
        # every cursor jumps over what lies between, to the block's first posting in its list
        key = terms * index.n_blocks + block
        at = np.minimum(np.searchsorted(index.block_key, key), len(index.block_key) - 1)
        at = at[index.block_key[at] == key]
        start, end, top = index.block_start[at], index.block_start[at + 1], index.block_max[at].tolist()
        lists = [(index.unit[i:j].tolist(), index.impact[i:j].tolist()) for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        cursor = [0] * len(lists)
        alive = sorted(range(len(lists)), key=lambda k: lists[k][0][0])
        while alive:
            # pivot: the first unit at which the maxima of the lists up to it can reach the threshold
            bound, p = 0.0, -1
            for p, k in enumerate(alive):
                bound += top[k]
                if bound >= threshold - _SLACK:
                    break
            else:
                break
            unit = lists[alive[p]][0][cursor[alive[p]]]
            while p + 1 < len(alive) and lists[alive[p + 1]][0][cursor[alive[p + 1]]] == unit:
                p += 1
            ready = lists[alive[0]][0][cursor[alive[0]]] == unit
            score = 0.0
            for k in alive[: p + 1]:
                units, impacts = lists[k]
                i = cursor[k]
                while i < len(units) and units[i] < unit:
                    i += 1
                if ready:
                    score += impacts[i]
                    i += 1
                cursor[k] = i
            if ready and score >= threshold - _SLACK:
                out.append((unit, score))
            alive = sorted((k for k in alive if cursor[k] < len(lists[k][0])), key=lambda k: lists[k][0][cursor[k]])
    return out


def search(index: Index, texts: list[bytes | None], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of every leak in ``texts``; both shares are the unit's where the item marks no answer."""
    buf, at = join_words([t.translate(WORDS) if t else t for t in texts])
    words, start, _ = word_hashes(buf)
    if not len(words) or not len(index.terms):
        return []
    first = np.append(np.searchsorted(start, at), len(words))
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    pos = np.flatnonzero(index.terms[term] == words)
    if not len(pos):
        return []
    doc = np.searchsorted(first, pos, "right") - 1
    # half passages: passage h of a document covers its halves h and h + 1
    half = PASSAGE // 2
    halves = np.maximum(1, -(-np.diff(first) // half))
    base = np.concatenate([[0], np.cumsum(halves)])
    h = base[doc] + (pos - first[doc]) // half
    n_terms = len(index.terms)
    one = np.unique(h * n_terms + term[pos])
    h1, t1 = one // n_terms, one % n_terms
    before = h1[h1 > base[np.searchsorted(base, h1, "right") - 1]] - 1  # also in the passage that starts one half earlier
    t_before = t1[h1 > base[np.searchsorted(base, h1, "right") - 1]]
    both = np.unique(np.concatenate([h1 * n_terms + t1, before * n_terms + t_before]))
    passage, t = both // n_terms, both % n_terms
    bound = np.bincount(passage, index.list_max[t], int(base[-1]))
    can = bound[passage] >= threshold - _SLACK  # else all blocks of all lists are skipped
    passage, t = passage[can], t[can]
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    where, block = open_blocks(index, passage, t, threshold)
    edge = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        p = int(where[i])
        lo, hi = np.searchsorted(passage, [p, p + 1])
        hits = block_max_wand(index, t[lo:hi], block[i:j].tolist(), threshold)
        d = int(np.searchsorted(base, p, "right")) - 1
        from_ = int(first[d]) + (p - int(base[d])) * half
        for unit, score in hits:
            k = int(index.unit_item[unit])
            item = index.items[k]
            own = index.units[unit]
            around = own.n_words if own else item.n_words
            near = words[max(int(first[d]), from_ - around) : min(int(first[d + 1]), from_ + PASSAGE + around)]
            share = [own.whole.share(near)] * 2 if own else [x.share(near) for x in item.parts]
            if min(share) >= overlap and score > found.get((d, k), (0.0,))[0]:
                found[d, k] = (score, *share)
    return [(d, k, *x) for (d, k), x in sorted(found.items())]


def _shard_statistics(items: DataFrame) -> DataFrame:
    """shard, term, df, units, words of all items (shard, text): a shard's terms with their document frequency
    in the whole benchmark; a null term's row has the benchmark's unit count and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for shard, text in zip(b.column(0).to_pylist(), blobs(b.column(1)), strict=True):
                one = statistics(list(unit_words(hashes(text or b""))))
                terms = np.fromiter(one.df, np.uint64, len(one.df)).view(np.int64).tolist()
                n = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * (n + 1), pa.int32()), pa.array([*terms, None], pa.int64()), pa.array([*one.df.values(), one.units], pa.int64()), pa.array([0] * n + [one.words], pa.int64())],
                    names=["shard", "term", "units", "words"],
                )

    counted = checkpointed(items.mapInArrow(run, "shard int, term long, units long, words long").groupBy("shard", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words")))
    total = counted.groupBy("term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))
    return checkpointed(counted.select("shard", F.col("term").alias("t")).join(total, F.col("t").eqNullSafe(F.col("term"))).select("shard", "term", "units", "words"))


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator:
    """Broadcast indexes over all items (item_id, text), each of at most about ``shard_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // shard_bytes))
    if shards > 1:
        items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
        counted = _shard_statistics(items.select("shard", "text"))
    for k in range(shards):
        mine, stats = items, None
        if shards > 1:
            mine = items.where(F.col("shard") == k)
            got = counted.where(F.col("shard") == k).collect()
            total = next((r for r in got if r["term"] is None), None)
            stats = total and Statistics(total["units"], total["words"], {r["term"] % (1 << 64): r["units"] for r in got if r["term"] is not None})
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(rows, stats))


SCHEMA = "doc_id long, item_id long, score double, question_share double, answer_share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row and benchmark item (item_id, text) that leaks into it."""
    out = None
    for shared in _shards(benchmark, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release_encoders()
            index = shared.value
            for b in small(batches):
                texts, names = blobs(b.column(1)), b.column(0).to_pylist()
                got = [(names[i + d], index.items[k].item_id, *x) for i, j in slices(texts) for d, k, *x in search(index, texts[i:j], threshold, overlap)]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                columns = list(zip(*got, strict=True)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        part = doc_text(docs).mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, into which no benchmark item leaks."""
    for shared in _shards(benchmark, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release_encoders()
            for b in small(batches):
                texts = blobs(b.column(b.schema.get_field_index("text")))
                clean = np.ones(len(texts), np.bool_)
                for i, j in slices(texts):
                    clean[[i + hit[0] for hit in search(shared.value, texts[i:j], threshold, overlap)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
