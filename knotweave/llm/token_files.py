"""Token ids in bit-packed binary files with block offsets, and reading them back.

File format ``KWT1`` (little-endian): a header (magic, bits per id, ids per block,
numbers of documents, ids and blocks), the documents' null flags and ids, the id
offset of each document, the byte offset of each block, then the blocks. Each id
takes the minimum of bits that the vocabulary needs; every block starts on a byte,
so any range of ids is read by seeking to its blocks and unpacking them as arrays.

Writing: documents are dealt to files by ranges of (doc_id, salt), encoded where they
lie, and only the ids are shuffled. The ranges' bounds come from a sample of some
``SAMPLE`` rows a file, drawn with a chance in proportion to their bytes, so files hold
about equally many bytes. The salt follows the text, and in its last bits the row, so
that rows of one doc_id (or of none), even equal ones, spread over files. Each file is written under a temporary name and renamed, so a
task that runs again leaves the same file. The driver gets the sample and one row (path
and counts) per file; fewer, larger files make both smaller.

Cases: a null or empty text is its end id alone; null doc_ids come first; rows of one
doc_id follow each other in the order of their texts' hashes; ids beyond the
vocabulary's bits are an error; a very long text makes its file that much longer; other
columns are not looked at; an empty table writes no file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.llm.text import blobs, doc_text, release_memory, slices
from knotweave.llm.tokens import encoder

_MAGIC = b"KWT1"
_HEADER = struct.Struct("<4sHHIQQQ")  # magic, bits, 0, ids a block, documents, ids, blocks
BLOCK_IDS = 4096
#: Target bytes of text per file, unless the session asks for more partitions.
FILE_BYTES = 32 << 20
#: Expected rows of the sample for each file.
SAMPLE = 40


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian bit packing."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack_bits(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    out = io.BytesIO()
    out.write(_HEADER.pack(_MAGIC, bits, 0, block_ids, len(doc_ids), len(ids), len(blocks)))
    out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    out.write(np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes())
    for b in blocks:
        out.write(b)
    return out.getvalue()


class TokenFile:
    """Random access to one open ``KWT1`` file (any seekable binary handle)."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.bits, _, self.block_ids, self.n_docs, self.n_ids, n_blocks = _HEADER.unpack(handle.read(_HEADER.size))
        if magic != _MAGIC:
            raise ValueError("not a KWT1 file")
        null = np.frombuffer(handle.read(self.n_docs), np.uint8)
        names = np.frombuffer(handle.read(8 * self.n_docs), "<i8")
        self.doc_ids = [None if n else int(x) for n, x in zip(null, names, strict=True)]
        self.offsets = np.frombuffer(handle.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(handle.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = _HEADER.size + 9 * self.n_docs + 8 * (self.n_docs + 1) + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids + 1
        self.handle.seek(int(self.payload + self.blocks[a]))
        raw = self.handle.read(int(self.blocks[b] - self.blocks[a]))
        out = []
        for k in range(a, b):
            count = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack_bits(raw[int(self.blocks[k] - self.blocks[a]) : int(self.blocks[k + 1] - self.blocks[a])], self.bits, count))
        return np.concatenate(out)[start - a * self.block_ids : stop - a * self.block_ids]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def vocabulary_of(tokenizer_path: str) -> int:
    """One more than the greatest id of a tokenizer's file."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())


_NULL = -(1 << 63)  # the place of null doc_ids in the order


def part_of(doc_id: np.ndarray, salt: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted ``bounds`` (doc_id, salt) are at or below each (doc_id, salt)."""
    lo, hi = np.searchsorted(bounds[:, 0], doc_id, "left"), np.searchsorted(bounds[:, 0], doc_id, "right")
    out = lo.copy()
    for i in np.flatnonzero(lo < hi).tolist():  # a bound's own doc_id
        out[i] += np.searchsorted(bounds[lo[i] : hi[i], 1], salt[i], "right")
    return out


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None, drop_space: bool = False, file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Write all ids in ascending doc_id order; (path, documents, ids) of each file, in order.

    ``vocabulary``: the number of ids (the tokenizer's own if not given).
    """
    spark = docs.sparkSession
    vocabulary = max(vocabulary or vocabulary_of(tokenizer_path), end_id + 1)
    row_bits = F.lit((1 << 20) - 1)
    salt = F.xxhash64("text").bitwiseAND(F.bitwise_not(row_bits)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(row_bits))
    text = doc_text(docs).withColumn("salt", salt)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = text.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(least, -(-total // file_bytes), 1)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    chance = (F.pmod(F.xxhash64("doc_id", "salt", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)) < size * (SAMPLE * n / max(1, total))
    drawn = text.where(chance).select(F.coalesce("doc_id", F.lit(_NULL)).alias("d"), "salt").sort("d", "salt").toArrow() if n > 1 and total else None
    bounds = np.column_stack([drawn["d"].to_numpy(), drawn["salt"].to_numpy()]) if drawn else np.zeros((0, 2), np.int64)
    bounds = bounds[np.unique(np.arange(1, n) * len(bounds) // n)] if len(bounds) else bounds
    shared = spark.sparkContext.broadcast(bounds)
    bits = bits_for(vocabulary)
    small = "<u2" if bits <= 16 else "<u4"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode = encoder(tokenizer_path, drop_space).encode
        for batch in batches:
            texts = blobs(batch.column(1))
            part = part_of(batch.column(0).fill_null(_NULL).to_numpy(), batch.column(2).to_numpy(), shared.value).astype(np.int32)
            for a, b in slices(texts, 2 << 20):
                ids, counts = encode(texts[a:b])
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"id {int(ids.max())} is beyond a vocabulary of {vocabulary}")
                ends = np.cumsum(counts)
                raw = ids.astype(small)
                ids_of = [raw[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(ids_of, pa.binary())], names=["part", "doc_id", "salt", "ids"])

    def write(key, table):
        names, packed = table["doc_id"].to_pylist(), table["ids"].to_pylist()
        order = np.lexsort((table["salt"].to_numpy(), table["doc_id"].combine_chunks().fill_null(_NULL).to_numpy())).tolist()
        end = np.array([end_id], small).tobytes()
        ids = np.frombuffer(b"".join(x for i in order for x in (packed[i], end)), small).astype(np.uint32)
        counts = np.array([len(packed[i]) // int(small[2]) + 1 for i in order], np.int64)
        fs, at = _filesystem(out_dir)
        path = f"{at}/part-{key[0].as_py():08d}.kwt"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as handle:
            handle.write(encode_file([names[i] for i in order], counts, ids, bits))
        fs.move(draft, path)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([len(names)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})

    rows = text.mapInArrow(tokens, "part int, doc_id long, salt long, ids binary").groupBy("part").applyInArrow(write, "part int, docs long, ids long").collect()
    return [(f"{out_dir}/part-{r['part']:08d}.kwt", r["docs"], r["ids"]) for r in sorted(rows)]


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document from the files: ids before it, number of ids, crc32 of its ids as unsigned 32-bit."""
    before, rows = 0, []
    for path, _, ids in files:
        rows.append((path, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as handle:
                    f = TokenFile(handle)
                    crc = []
                    step = 1 << 20
                    at_doc = 0
                    while at_doc < f.n_docs:  # as many documents as make about a million ids
                        to = max(at_doc + 1, int(np.searchsorted(f.offsets, f.offsets[at_doc] + step, "right")) - 1)
                        raw = memoryview(f.ids(int(f.offsets[at_doc]), int(f.offsets[to])).astype("<u4").tobytes())
                        edge = ((f.offsets[at_doc : to + 1] - f.offsets[at_doc]) * 4).tolist()
                        crc += [zlib.crc32(raw[i:j]) for i, j in zip(edge, edge[1:], strict=False)]
                        at_doc = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids, pa.int64()), pa.array(f.offsets[:-1] + base), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())],
                        names=[x.split()[0] for x in READ_SCHEMA.split(", ")],
                    )

    names = spark.createDataFrame(rows, "path string, base long")
    return names.repartition(max(1, len(rows))).mapInArrow(read, READ_SCHEMA)
