"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the number of
distinct byte n-grams (all lengths in ``NGRAMS``) that both hold, divided by the
geometric mean of their own numbers. A bounded, documented sample of labelled rows
gives landmarks; the Nyström map takes a text to its kernel values with them times
K^(-1/2), and one ridge regression per language (one versus rest) is solved in that
space. Scoring: presence rows of a batch of whole texts, one matrix product with
the landmarks' presence rows and one with the weights.

Cases: a text that is null or holds no letter is ``und`` with score 0.0; so is
everything if no row is labelled (the pipeline's stage then goes by the letter alone);
every label is learned, however many there are, from fewer rows each; ties between
languages go to the first in alphabetical order; repeated rows give repeated results,
and as labelled rows they teach within the sample's bound; null doc_ids train nothing
and are not held out; a very long text is scored as one row; other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.text import LOWER, blobs, doc_text, slices, small
from knotweave.llm.tokens import release_encoders

#: Lengths of the n-grams (bytes of UTF-8) and the number of cells that they are hashed to.
NGRAMS, CELLS = (1, 2, 3), 1 << 14
#: The bounds of the training sample: rows and landmarks for each language.
SAMPLE_ROWS, LANDMARKS = 300, 48
#: Languages from which on these shrink, so that the whole sample keeps its size; every language keeps a row.
FULL_LANGUAGES = 64
RIDGE = 1e-2

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def presence(texts: list[bytes | None]) -> np.ndarray:
    """A 0/1 row for each text: which hashed n-grams it holds. Letters A-Z count as lower case."""
    rows = [(t or b"").translate(LOWER) for t in texts]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros(len(rows) * CELLS, np.uint8)
    a = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(len(rows), dtype=np.int64) * CELLS, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(a))  # bytes up to the text's end
    gram = np.zeros(len(a), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(257) + a[n - 1 :] + np.uint32(1)
        if n in NGRAMS:
            cell = ((gram * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
            keep = left[:m] >= n
            out[(base[:m] + cell)[keep]] = 1
    return out.reshape(len(rows), CELLS)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if len(text.translate(None, _LETTERS)) != len(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, one row each
    weights: np.ndarray  # landmark x language, K^(-1/2) included

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        z = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return z.T.copy(), np.sqrt(z.sum(axis=1))


def kernel(rows: np.ndarray, z: np.ndarray, z_norm: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
    return (x @ z) / norm[:, None] / np.maximum(z_norm, 1)


def each(bound: int, languages: int) -> int:
    """What is left of a bound for each language where there are many; at least 1."""
    return max(1, min(bound, bound * FULL_LANGUAGES // languages))


def fit(labels: list[str], packed: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Fit on rows in a fixed order; the first ``landmarks`` of each language (fewer of each of many) become landmarks.

    Languages without a landmark of their own, beyond ``landmarks * FULL_LANGUAGES`` of them, are told apart by the others'.
    """
    languages = sorted(set(labels))
    y = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(y == x)[: each(landmarks, len(languages))] for x in languages])[: landmarks * FULL_LANGUAGES]
    model = KernelModel(languages, packed[chosen], np.zeros((len(chosen), len(languages))))
    z, z_norm = model.open()
    k_mm = kernel(np.unpackbits(packed[chosen], axis=1), z, z_norm).astype(np.float64)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([kernel(np.unpackbits(packed[i : i + 128], axis=1), z, z_norm) @ root for i in range(0, len(packed), 128)])
    target = np.where(y[:, None] == np.array(languages), 1.0, -1.0)
    # each language weighs the same, however many rows the sample has of it
    _, place, size = np.unique(y, return_inverse=True, return_counts=True)
    weight = 1.0 / size[place]
    gram = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]) * weight.sum() / len(y)
    model.weights = root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return model


def training_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """About ``rows`` rows of each language (fewer of each of many), chosen by a hash of doc_id; features are made on the executors.

    The driver gets a few hundred packed presence rows (CELLS / 8 bytes each) per language.
    """
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((0, CELLS // 8), np.uint8)
    rows, unit = each(rows, len(sizes)), 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(unit))
    # a few rows need a wider margin than many, lest a language draws none
    margin = 1.5 * rows + 20
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(unit, int(margin * unit / r["count"]) + 1)))))
    chosen = labelled.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).select("doc_id", "text", "lang", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in small(batches):
            texts = blobs(b.column(1))
            packed = [np.packbits(row).tobytes() for i in range(0, len(texts), 256) for row in presence(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(packed, pa.binary())], names=["doc_id", "lang", "draw", "bits"])

    # the margins, and rows that repeat a doc_id, stay on the executors
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "bits"))
    kept = chosen.mapInArrow(run, "doc_id long, lang string, draw long, bits binary").withColumn("k", first).where(F.col("k") <= rows).drop("k").collect()
    kept.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["bits"]))
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), CELLS // 8)
    return [r["lang"] for r in kept], bits


def predict(model: KernelModel | None, opened: tuple[np.ndarray, np.ndarray] | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language (``und`` where there is none) and score of whole texts, scored in batches."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for i, j in slices([texts[k] for k in known]):
        for k in range(i, j, 256):
            part = known[k : min(k + 256, j)]
            f = kernel(presence([texts[x] for x in part]), *opened) @ model.weights
            for x, c, v in zip(part, f.argmax(axis=1).tolist(), f.max(axis=1).tolist(), strict=True):
                lang[x], score[x] = model.languages[c], min(1.0, max(0.0, (v + 1) / 2))
    return lang, score


def _held_out(folds: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))


def train(docs: DataFrame, folds: int = 3, held_out: int = 1) -> KernelModel | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) outside the held-out fold; None if none is labelled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(folds, held_out))
    labels, packed = training_sample(labelled)
    return fit(labels, packed) if labels else None


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Predict the language of every row of ``docs`` (doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` teach nothing.
    """
    model = train(docs, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        opened = model.open() if model else None
        for b in small(batches):
            lang, score = predict(model, opened, blobs(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return doc_text(docs).withColumn("held_out", _held_out(folds, held_out)).mapInArrow(run, SCHEMA)


#: A text is rejected below this score: no language's machine (one versus the rest) clearly claims it.
#: A machine says 0 (score 0.5) to a text that shares nothing with what it learned.
CLAIMED = 0.52


def keep_identified(docs: DataFrame, min_score: float = CLAIMED, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text some language claims (those that are ``und`` go too).

    ``languages``: keep these only. Where no row is labelled there is no model, and
    every text with a letter stays.
    """
    model = train(docs)
    wanted = None if languages is None else frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        opened = model.open() if model else None
        for b in small(batches):
            texts = blobs(b.column(b.schema.get_field_index("text")))
            if model:
                keep = [x != "und" and v >= min_score and (wanted is None or x in wanted) for x, v in zip(*predict(model, opened, texts), strict=True)]
            else:
                keep = [has_letter(t) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
