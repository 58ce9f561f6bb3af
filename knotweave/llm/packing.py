"""Harmonic packing of token ids into fixed-size training sequences.

A document is cut into whole sequences first; what is left of it (most documents are
nothing else) falls into the reciprocal-capacity class k of its length, from
C/(k+1) up to C/k, and a bin of class k always takes exactly k of them. That leaves a gap at the
bin's end, below C/(k+1). Gaps are topped up: by the best fit among coming rests that
go in whole, and by cutting a rest over the largest gaps only while more than
``HELD`` sequences' worth of gaps wait (or where the document was cut anyway). Gaps of
at most ``SPARE`` tokens stay as padding. So most documents lie in one piece, and
padding stays below 1 %. Workers fill their bins independently and nothing is
shuffled. What is unfinished at a task's end is laid out one after another, cut at
the sequences' ends; the last sequences have powers of two as lengths and no padding.

Cases: a null or empty text is its end id alone (one piece of length 1); repeated
rows are packed once each; a very long text gives whole sequences and one rest; other
columns are not looked at; an empty table gives no rows. Memory: one slice of texts,
the open bins (below C tokens for each of some 2 * sqrt(C) classes) and the sequences
that wait for their gaps. A task's result depends on its input split only, so a task
run again after a lost executor gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from knotweave.llm.text import blobs, doc_text, release_memory, slices
from knotweave.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

#: sequence_id = task << 40 | number in the task.
_TASK = 40
#: Tokens that may stay unused at a sequence's end, and sequences' worth of gaps that may wait.
SPARE, HELD = 16, 4

#: doc_id, start in the document, ids, ids of the document
Piece = tuple[int | None, int, np.ndarray, int]


class Bins:
    """The bins of one task: open ones by class, and full ones that wait for their gap to be topped up."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.task, self.made = capacity, task, 0
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.waiting: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int]] = []  # (tokens, number of the sequence), sorted
        self.missing = 0  # tokens of all gaps
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._write(self._number(), [(doc_id, at, ids[at : at + self.capacity], len(ids))])
        if whole < len(ids):
            rest = (doc_id, whole, ids[whole:].copy(), len(ids))
            if not self._whole_in_gap(rest):
                self._divide(rest) if self.missing > (len(rest[2]) if whole else HELD * self.capacity) else self._classify(rest)

    def _number(self) -> int:
        self.made += 1
        return self.made - 1

    def _write(self, number: int, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.task << _TASK | number, offset))
            offset += len(ids)

    def _classify(self, piece: Piece) -> None:
        k = self.capacity // len(piece[2])
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            number = self._number()
            self.waiting[number] = bin_
            self._gap(number, self.capacity - sum(len(p[2]) for p in bin_))

    def _gap(self, number: int, size: int) -> None:
        if size > SPARE:
            insort(self.gaps, (size, number))
            self.missing += size
        else:
            self._write(number, self.waiting.pop(number))

    def _into(self, i: int, piece: Piece) -> None:
        size, number = self.gaps.pop(i)
        self.missing -= size
        self.waiting[number].append(piece)
        self._gap(number, size - len(piece[2]))

    def _whole_in_gap(self, piece: Piece) -> bool:
        i = bisect_left(self.gaps, (len(piece[2]), -1))
        if i == len(self.gaps):
            return False
        self._into(i, piece)
        return True

    def _divide(self, piece: Piece) -> None:
        """Cut a piece that no gap holds over the largest gaps."""
        while self.gaps and not self._whole_in_gap(piece):
            doc_id, start, ids, total = piece
            size = self.gaps[-1][0]
            self._into(len(self.gaps) - 1, (doc_id, start, ids[:size], total))
            piece = (doc_id, start + size, ids[size:], total)
            if not self.gaps:
                self._classify(piece)
                return

    def close(self) -> None:
        """Lay out what is unfinished, cut where a sequence ends; powers of two in descending size come last."""
        left = [p for pieces in self.waiting.values() for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, n = left.pop()
                pieces.append((doc_id, start, ids[:size], n))
                if len(ids) > size:
                    left.append((doc_id, start + size, ids[size:], n))
                size -= len(pieces[-1][2])
            self._write(self._number(), pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, drop_space: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode = encoder(tokenizer_path, drop_space).encode
        bins = Bins(capacity, TaskContext.get().partitionId())
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), blobs(batch.column(1))
            for a, b in slices(texts, 2 << 20):
                ids, counts = encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                with_end = np.full(len(ids) + b - a, end_id, "<u4")
                with_end[np.delete(np.arange(len(with_end)), ends - 1)] = ids
                for doc_id, i, j in zip(doc_ids[a:b], (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                    bins.add(doc_id, with_end[i:j])
                yield bins.take()
        bins.close()
        yield bins.take()

    return doc_text(docs).mapInArrow(run, SCHEMA)
