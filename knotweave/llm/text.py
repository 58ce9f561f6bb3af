"""Shared text and hashing helpers of the llm operators (plain numpy, no Spark state).

White-space words are ``[^\\x20\\x09-\\x0D]+`` throughout, which is exactly what
``bytes.split()`` yields on UTF-8 text.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.plans.session import cut, shared_top

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Bytes outside [0-9A-Za-z] and non-ASCII become spaces, A-Z lower case: the words of notices and benchmark items.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

#: Odd multipliers of the polynomial hashes (arbitrary fixed values).
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, byte start and byte end of every white-space word of ``buf``.

    Equal words have equal hashes wherever they stand. Everything is array
    arithmetic over the bytes, so the cost does not depend on how many
    distinct words there are.
    """
    a = np.frombuffer(buf, np.uint8)
    n = len(a)
    space = np.ones(n + 2, np.bool_)
    space[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, n), out=total[1:])
    raw = (total[end] - total[start]) * powers(inverse(_BYTE_BASE), n)[start]
    # the length takes part, and the avalanche makes every bit usable on its own
    return mix64(raw + mix64((end - start).astype(np.uint64))), start, end


def gram_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = _GRAM_BASE[which]
    for i in range(width):
        out *= base
        out += words[i : i + n]
    return mix64(out)


class GramSums:
    """Prefix sums of a word sequence: the hash of any run of its words at once, whatever the run's length."""

    def __init__(self, words: np.ndarray, which: int = 0):
        base = _GRAM_BASE[which]
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=self.total[1:])
        self.back = powers(inverse(base), len(words) + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` to before ``end``; equal runs have equal hashes in any sequence."""
        raw = (self.total[end] - self.total[start]) * self.back[start]
        return mix64(raw + mix64((end - start).astype(np.uint64)))


def join_words(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """The texts in one buffer, where no word spans two of them, and the byte at which each starts."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    return b"\n".join(t or b"" for t in texts), np.cumsum(sizes) - sizes


def blobs(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes (a longer text stands alone)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of a part stays small beside it."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def release_memory() -> None:
    """Give what a reused worker has freed back to the machine; large arrays leave gaps that the allocator keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder of one use in the shared folder."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


#: A DataFrame written to the shared folder and read back from there, so that lost executors don't cost its lineage.
checkpointed = cut


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """The two columns that every operator on texts needs; others are pruned at the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
