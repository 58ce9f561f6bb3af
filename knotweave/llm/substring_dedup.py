"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``width`` consecutive words of one document. Every word covered by a
window whose word sequence starts anywhere else too is removed. That needs the
internal nodes of depth >= ``width`` (the maximal repeats) of the suffix tree of
all documents, which is far too large for one machine; so it is built in parts:

1. *Suffixes that stand alone go first.* Each window has an anchor, the run of
   ``ANCHOR`` words in it with the least hash. Equal windows have equal anchors,
   and one anchor serves a dozen windows, so counting anchors (about 7 % of the
   positions) shows which windows can't repeat.
2. *Variable-length prefixes split the other suffixes into groups.* A suffix's
   prefix reaches to the end of its anchor; all prefixes that end in one anchor go
   to the same part. Where an anchor is so frequent that its group could outgrow
   memory, the prefix is extended to all ``width`` words. Neighbouring suffixes
   with one anchor travel as one segment of words, and a block of documents sends
   each different segment once, so any number of copies is one row a block.
3. *Each part builds its subtrees*: words become exact numbers, suffixes are ranked
   by prefix doubling, and the longest common prefixes of neighbours in that order
   are the depths of the internal nodes. A suffix under a node of depth >= ``width``
   is a repeat; repeats that run over several segments come out as a chain of
   overlapping nodes. The blocks that sent a segment get its deep suffixes back and
   cut the covered words out.

Words are compared as words: hashes choose anchors, parts and what to look at, and
never decide equality. Nothing goes to the driver but the total size. Every block and
part is bounded, whichever key is hot: rows are dealt to blocks one by one, so repeated
rows spread. Which block a row is in is written to the shared folder with it, so that an
answer meets the words that were asked about although the input may come in another
order when it is read again, or a block is computed again after an executor is lost.
What is written is shuffled once (the three uses share that exchange).

Cases: null and empty texts have no words and are kept empty (""); documents of
fewer than ``width`` words are kept as they are; each row counts as a document, so
repeated rows repeat each other's windows; null doc_ids are allowed; a very long text
is one slice of its block; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.text import GramSums, blobs, doc_text, gram_hashes, join_words, slices, word_hashes
from knotweave.plans.session import table as written

#: Words of an anchor; suffixes that a prefix group may hold before its prefix is extended.
ANCHOR, GROUP_LIMIT = 8, 1 << 18
#: Bytes of text in a block, and how many windows a segment may have (bits of its answer).
BLOCK_BYTES, SEGMENT = 16 << 20, 60


class Windows:
    """All windows of one slice of documents, over texts whose words are joined by one space."""

    def __init__(self, texts: list[bytes | None], width: int):
        self.buf, at = join_words([b" ".join(t.split()) if t else b"" for t in texts])
        self.words, self.begin, self.end = word_hashes(self.buf)
        self.first = np.append(np.searchsorted(self.begin, at), len(self.words))  # first word of each document
        self.width = width
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        self.start = np.arange(int(n.sum())) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word at which it starts) of each window's anchor: the leftmost least one."""
        value = gram_hashes(self.words, ANCHOR)
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        reach = self.width - ANCHOR + 1
        at, span = np.arange(len(value)), 1
        least = lambda x, y: np.where(value[y] < value[x], y, x)
        while 2 * span <= reach:  # the least of 1, 2, 4, ... positions
            at = least(at[: len(at) - span], at[span:])
            span *= 2
        found = least(at[self.start], at[self.start + reach - span])
        return value[found], found

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, number of windows) of each run of neighbouring windows with one anchor."""
        value, at = self.anchors()
        if not len(at):
            return value, at, at
        turn = (self.start - at + self.width) // SEGMENT
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(turn, prepend=-1) != 0))
        return value[first], first, np.diff(np.append(first, len(at)))

    def text(self, word: int, n: int) -> bytes:
        return self.buf[self.begin[word] : self.end[word + n - 1]]


def exact_words(buf: bytes) -> np.ndarray:
    """A number for each word of ``buf``; two words have the same number if, and only if, they are equal."""
    value, begin, end = word_hashes(buf)
    _, first, number = np.unique(value, return_index=True, return_inverse=True)
    size, twin = end - begin, first[number]
    raw = np.frombuffer(buf, np.uint8)
    same = bool((size == size[twin]).all())
    step = 1 << 18
    for k in range(0, len(value) if same else 0, step):  # every word against the first of its number, byte by byte
        n = size[k : k + step]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = same and bool((raw[np.repeat(begin[k : k + step], n) + at] == raw[np.repeat(begin[twin[k : k + step]], n) + at]).all())
    if same:
        return number.astype(np.int64)
    known: dict[bytes, int] = {}  # different words with one hash
    return np.array([known.setdefault(w, len(known)) for w in buf.split()], np.int64)


class Subtrees:
    """The suffix trees of a part: ``words`` (numbers) of segments with ``sizes`` words each, one after another."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, width: int):
        n = len(words)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words up to the segment's end
        self.suffix = np.flatnonzero(self.left >= width)
        levels, rank, k = [words], words, 1  # ranks by the first 1, 2, 4, ... words, an ended suffix first
        while k < (int(sizes.max()) if len(sizes) else 0):
            after = np.zeros(n, np.int64)
            goes_on = np.flatnonzero(self.left > k)
            after[goes_on] = rank[goes_on + k] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank.astype(np.int32))
            k *= 2
        self.order = self.suffix[np.argsort(rank[self.suffix], kind="stable")]
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(len(a), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            same = levels[j][np.minimum(a + common, n - 1)] == levels[j][np.minimum(b + common, n - 1)]
            common += same.astype(np.int64) << j
        #: Depths of the internal nodes between neighbours in the order of the suffixes.
        self.depth = np.minimum(common, np.minimum(self.left[a], self.left[b]))

    def deep(self, width: int) -> np.ndarray:
        """The suffixes (as positions) below an internal node of at least ``width`` words."""
        under = np.zeros(len(self.order), np.bool_)
        node = self.depth >= width
        under[:-1] |= node
        under[1:] |= node
        return self.order[under]

    def nodes(self, width: int) -> list[tuple[int, int]]:
        """(position, depth) of the internal nodes of at least ``width`` words; each node at least once."""
        at = np.flatnonzero(self.depth >= width)
        return list(zip(self.order[at].tolist(), self.depth[at].tolist(), strict=True))


def repeated_windows(segments: list[bytes], often: np.ndarray, width: int) -> np.ndarray:
    """For each of the different ``segments`` a mask of its windows that stand elsewhere too; all of those that came ``often``."""
    sizes = np.fromiter((s.count(b" ") + 1 for s in segments), np.int64, len(segments))
    tree = Subtrees(exact_words(b"\n".join(segments)), sizes, width)
    first = np.cumsum(sizes) - sizes
    deep = tree.deep(width)
    owner = np.searchsorted(first, deep, "right") - 1
    mask = np.zeros(len(segments), np.int64)
    np.bitwise_or.at(mask, owner, np.int64(1) << (deep - first[owner]))
    return np.where(often, (np.int64(1) << (sizes - width + 1)) - 1, mask)


def _in_order(table: pa.Table) -> tuple[list, list[bytes | None]]:
    names, texts = table["doc_id"].to_pylist(), blobs(table["text"])
    order = sorted(range(len(texts)), key=lambda i: (names[i] is not None, names[i] or 0, texts[i] or b""))
    return [names[i] for i in order], [texts[i] for i in order]


def remove_repeats(docs: DataFrame, width: int = 35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if width < ANCHOR:
        raise ValueError(f"width must be at least {ANCHOR}")
    spark = docs.sparkSession
    text = doc_text(docs)
    total = text.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    blocked = written(text.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n))))

    def count_anchors(table):
        found = [np.zeros(0, np.uint64)]
        _, texts = _in_order(table)
        for a, b in slices(texts):
            found.append(Windows(texts[a:b], width).segments()[0])
        h, c = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"block": pa.array(np.full(len(h), table["block"][0].as_py())), "anchor": pa.array(h.view(np.int64)), "n": pa.array(c)})

    def send_segments(left, right):
        anchors = right["anchor"].to_numpy().view(np.uint64)
        by_value = np.argsort(anchors)
        anchors, often = anchors[by_value], right["n"].to_numpy()[by_value]
        rows: dict[bytes, list] = {}
        _, texts = _in_order(left) if left.num_rows and len(anchors) else ([], [])
        base = 0
        for a, b in slices(texts):
            w = Windows(texts[a:b], width)
            value, first, count = w.segments()
            place = np.minimum(np.searchsorted(anchors, value), len(anchors) - 1)
            can = np.flatnonzero(anchors[place] == value)
            for hot in (False, True):
                mine = can[(often[place[can]] > GROUP_LIMIT) == hot]
                if not len(mine):
                    continue
                windows = count[mine]
                if hot:  # each window alone, dealt by all of its words
                    at = np.repeat(w.start[first[mine]] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
                    key, windows = GramSums(w.words).hashes(at, at + width), np.ones(len(at), np.int64)
                else:
                    at, key = w.start[first[mine]], value[mine]
                part = (key % np.uint64(2 * n)).astype(np.int64)
                for p, s, m in zip(part.tolist(), at.tolist(), windows.tolist(), strict=True):
                    words = w.text(s, m + width - 1)
                    if row := rows.get(words):
                        row[4] = True
                    else:
                        rows[words] = [p, base + s, m, hot, False]
            base += len(w.words)
        columns = list(zip(*rows.values(), strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        block = pa.array([left["block"][0].as_py()] * len(rows) if rows else [], pa.int64())
        return pa.table([arrays[0], block, *arrays[1:], pa.array(list(rows), pa.binary())], names=[x.split()[0] for x in SENT.split(", ")])

    def walk_subtrees(table):
        raw = table["words"].to_pylist()
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(w, len(known)) for w in raw), np.int64, len(raw))
        del raw
        many = table["many"].to_numpy(zero_copy_only=False)
        mask = repeated_windows(list(known), np.bincount(which, 1 + many, len(known)) > 1, width)[which]
        keep = pa.array(mask != 0)
        return table.select(["block", "start", "windows", "alone"]).append_column("mask", pa.array(mask)).filter(keep)

    def cut_out(left, right):
        names, texts = _in_order(left)
        order = np.argsort(right["start"].to_numpy(), kind="stable")
        start, windows, mask = (right[c].to_numpy()[order].astype(np.int64) for c in ("start", "windows", "mask"))
        alone = right["alone"].to_numpy(zero_copy_only=False)[order].astype(np.bool_)
        masks: dict[bytes, int] = {}
        seen = {False: np.zeros(0, np.uint64), True: np.zeros(0, np.uint64)}  # hashes of answered segments, of single windows
        n_words, n_removed, kept = [], [], []
        base = 0
        for a, b in slices(texts):
            w = Windows(texts[a:b], width)
            sums = GramSums(w.words)
            here = slice(*np.searchsorted(start, [base, base + len(w.words)]))
            s, m = start[here] - base, windows[here]
            for x, y, bits in zip(s.tolist(), m.tolist(), mask[here].tolist(), strict=True):
                masks[w.text(x, y + width - 1)] = bits
            value = sums.hashes(s, s + m + width - 1)
            _, first, count = w.segments()
            hit = [np.zeros(0, np.int64)]
            for single in (False, True):
                mine = value[alone[here] == single]
                seen[single] = np.union1d(seen[single], mine) if len(mine) else seen[single]
                if not len(seen[single]) or not len(w.start):
                    continue
                at, size = (w.start, np.ones(len(w.start), np.int64)) if single else (w.start[first], count)
                for k in np.flatnonzero(np.isin(sums.hashes(at, at + size + width - 1), seen[single])).tolist():
                    if bits := masks.get(w.text(at[k], int(size[k]) + width - 1)):
                        hit.append(at[k] + np.array([i for i in range(bits.bit_length()) if bits >> i & 1]))
            deep = np.concatenate(hit)
            covered = np.bincount(deep, minlength=len(w.words) + 1) - np.bincount(deep + width, minlength=len(w.words) + 1)
            gone = np.cumsum(covered)[:-1] > 0
            n_gone = np.concatenate([[0], np.cumsum(gone)])[w.first]
            for i in range(a, b):
                f, t = int(w.first[i - a]), int(w.first[i - a + 1])
                removed = int(n_gone[i - a + 1] - n_gone[i - a])
                if not removed:
                    words = w.text(f, t - f) if t > f else b""
                else:
                    all_words = (texts[i] or b"").split()
                    words = b" ".join([all_words[k] for k in np.flatnonzero(~gone[f:t]).tolist()])
                n_words.append(t - f)
                n_removed.append(removed)
                kept.append(words)
            base += len(w.words)
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table({"doc_id": pa.array(names, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": kept})

    counted = blocked.groupBy("block").applyInArrow(count_anchors, "block long, anchor long, n long")
    often = counted.withColumn("n", F.sum("n").over(Window.partitionBy("anchor"))).where("n > 1")
    sent = blocked.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(send_segments, SENT)
    deep = sent.groupBy("part").applyInArrow(walk_subtrees, "block long, start long, windows int, alone boolean, mask long")
    return blocked.groupBy("block").cogroup(deep.groupBy("block")).applyInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_text string")


#: A segment on its way: its part, its block and place there (word), its windows, whether it is a window alone, whether its block has it repeatedly.
SENT = "part long, block long, start long, windows int, alone boolean, many boolean, words binary"
