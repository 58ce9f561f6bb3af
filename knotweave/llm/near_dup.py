"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates, exact checks.

1. A document's set is its distinct shingles of ``SHINGLE`` words. Documents with
   equal sets form a class; one member (the class's least doc_id) stands for it.
2. Each class gets one-permutation MinHash values: one hash pass into bins, and
   optimal densification (an empty bin copies the bin that a universal hash sequence
   of its own index reaches first). Some bins make a band; equal bands share a
   bucket. Bands are as many as make a pair at the threshold s missed with about
   1e-6: (1 - s^rows)^bands, for 0.85 8 rows and 44 bands.
3. Round one: in every bucket each member is a candidate with the bucket's least
   member only (a star), so pairs grow with members, not with their square.
   Candidates are confirmed on full sets: 100 * common >= 85 * union. A hub's set is
   sent once to each group of at most about ``GROUP`` of its candidates.
4. Components of the confirmed links. A bucket whose members are all in one
   component can't add anything. The members of all other buckets are compared
   across components: every pair that may reach the threshold by an exact filter
   (early shared shingles, rarest first) is confirmed too. So no link that a bucket
   holds and that could join two components stays unseen.
5. Components again; every document takes its class's component.

Bands, links and components stay in DataFrames; counts are pre-aggregated before
each shuffle. Hubs with many candidates and shingles with many members are split into
salted groups; the other joins are plain sort-merge joins whose hot keys Spark splits.

Cases: fewer than ``SHINGLE`` words: the whole sequence is the one shingle; null
text or no words: an empty set, linked with nothing; equal doc_ids: rows of one
doc_id are one vertex (any of its texts links it); null doc_ids are linked with
nothing and get a null component; repeated rows are sketched each but compared once; a
very long text is one set like any other; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.text import LOWER, blobs, checkpointed, doc_text, gram_hashes, join_words, mix64, slices, small, word_hashes
from knotweave.llm.tokens import release_encoders

SHINGLE = 5
#: Candidates of one hub, or members of one shingle's list, that meet in one group.
GROUP = 256


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) that miss a pair at the threshold with a probability of about 1e-6."""
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    return rows, int(np.ceil(np.log(1e-6) / np.log(1 - (percent / 100) ** rows)))


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes (sorted) of each text, letters A-Z lower-cased."""
    out = []
    for a, b in slices(texts):
        part = [(t or b"").translate(LOWER) for t in texts[a:b]]
        buf, at = join_words(part)
        words, start, _ = word_hashes(buf)
        first = np.append(np.searchsorted(start, at), len(words))
        grams = gram_hashes(words, width)
        for i, j in zip(first.tolist(), first[1:].tolist(), strict=False):
            if j - i >= width:
                out.append(np.unique(grams[i : j - width + 1]))
            elif j > i:  # the sequence as one shingle; its length keeps it apart from the others
                out.append(gram_hashes(words[i:j], j - i) + np.uint64(j - i))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=4096)
def _probe(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in this attempt (one universal hash of bin and attempt)."""
    return (mix64(np.arange(bins, dtype=np.uint64) + np.uint64(bins * (attempt + 1))) % np.uint64(bins)).astype(np.int64)


def one_permutation(grams: np.ndarray, bins: int) -> np.ndarray:
    """``bins`` MinHash values from one hash of each shingle, densified."""
    h = mix64(grams ^ np.uint64(0x5851F42D4C957F2D))
    cell = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, np.bool_)
    value[cell[first]], full[cell[first]] = h[first], True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        to = _probe(bins, attempt)[empty]
        hit = full[to]
        value[empty[hit]] = value[to[hit]]
        empty = empty[~hit]
        attempt += 1
    return value


def bands(grams: np.ndarray, rows: int, n: int) -> np.ndarray:
    """One 64-bit bucket key for each of ``n`` bands of ``rows`` bins; the band's number takes part."""
    v = one_permutation(grams, rows * n).reshape(n, rows)
    key = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
    return key


def _sketches(docs: DataFrame, rows: int, n_bands: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in small(batches):
            sets = shingle_sets(blobs(b.column(1)))
            size = np.array([len(s) for s in sets], np.int64)
            sums = [(int(mix64(s).sum(dtype=np.uint64)), int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))) for s in sets]
            print_ = [a.to_bytes(8, "little") + c.to_bytes(8, "little") + n.to_bytes(4, "little") for (a, c), n in zip(sums, size.tolist(), strict=True)]
            keys = np.concatenate([bands(s, rows, n_bands) if len(s) else np.zeros(0, np.uint64) for s in sets]) if sets else np.zeros(0, np.uint64)
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), pa.array(print_, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64)))],
                names=["doc_id", "n_shingles", "print", "bands"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids`` (id), shingled anew where needed only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in small(batches):
            sets = shingle_sets(blobs(b.column(1)))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["id", "set"])

    text = doc_text(docs).withColumnRenamed("doc_id", "id")
    return text.join(ids, "id", "left_semi").mapInArrow(run, "id long, set array<long>")


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets pass: 100 * common >= percent * union for any texts of both ids.

    Each document goes to the groups it has a part in, once as the hub (a) of each group
    and once for each of its hubs; it is shingled on the way, so sets are shuffled once.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    hubs = size.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(True).alias("is_hub"))
    others = pairs.join(size, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "groups").cast("int").alias("salt"), F.lit(False).alias("is_hub"))
    parts = hubs.union(others)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in small(batches):
            texts = blobs(b.column(4))
            new = [i for i, t in enumerate(texts) if not i or t != texts[i - 1]]  # a document's rows come one after another
            sets = [x.tobytes() for x in shingle_sets([texts[i] for i in new])]
            which = np.searchsorted(new, np.arange(len(texts)), "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([sets[k] for k in which.tolist()], pa.binary())], names=["id", "hub", "salt", "is_hub", "set"])

    def check(table: pa.Table) -> pa.Table:
        ids, is_hub = table["id"].to_pylist(), table["is_hub"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        found = set()
        for hub in {x.tobytes(): x for x, h in zip(sets, is_hub, strict=True) if h}.values():
            for i, x, h in zip(ids, sets, is_hub, strict=True):
                if not h and i not in found:
                    at = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
                    common = int((hub[at] == x).sum()) if len(hub) else 0
                    if common and common * 100 >= (len(x) + len(hub) - common) * percent:
                        found.add(i)
        return pa.table({"a": pa.array([table["hub"][0].as_py()] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    text = doc_text(docs).withColumnRenamed("doc_id", "id")
    placed = parts.join(text, "id").select("id", "hub", "salt", "is_hub", "text").mapInArrow(shingled, "id long, hub long, salt int, is_hub boolean, set binary")
    return placed.groupBy("hub", "salt").applyInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the undirected ``links`` (a, b).

    Labels fall to the least label of the neighbourhood, then each vertex takes its
    label's label (pointer jumping), until nothing falls; every round is written to
    the shared folder. Stars need two rounds, chains a logarithm of their length.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        fallen = label.join(near, "id").select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        far = fallen.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        after = checkpointed(fallen.join(far, "c").select("id", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("old")).alias("fell")))
        label = after.select("id", "component")
        if not after.where("fell").limit(1).count():
            return label


def _across(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``members`` (id, c) in different components c that may reach ``percent``.

    Sets are put in one order, rarest shingle first. Two sets that reach the threshold
    share a shingle so early in both that what follows it can still make up the
    overlap (prefix and positional filter); that excludes no pair that passes. Of
    each shingle's list, members outside its commonest component meet the others.
    """
    # repeated rows of one doc_id: each different set of it once
    sets = checkpointed(_sets_of(docs, members.select("id")).withColumn("u", F.xxhash64("set")).dropDuplicates(["id", "u"]))
    grams = sets.select("id", "u", F.size("set").alias("n"), F.explode("set").alias("g"))
    common = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(common, "g")
    doc = Window.partitionBy("id", "u")
    # shingles of one set only come first in the order and need no row
    place = F.col("n") - F.count("*").over(doc) + F.row_number().over(doc.orderBy("df", "g")) - 1
    early = shared.withColumn("p", place).where((F.col("n") - F.col("p")) * 100 >= F.col("n") * percent)
    at = checkpointed(early.select("g", "id", "n", "p").join(members, "id"))
    mixed = at.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    main = at.join(mixed, "g", "left_semi").groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.ceil(F.sum("k") / GROUP).cast("int").alias("groups"))
    listed = at.join(main, "g")
    # a long list is dealt to groups; each member outside its commonest component meets all of them
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")
    stray = listed.where("c <> main").select("g", every, F.col("id").alias("sid"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("c").alias("sc"))
    reach = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    left, right = listed.withColumn("salt", F.pmod(F.xxhash64("id"), "groups").cast("int")).alias("l"), stray.alias("r")
    met = left.join(right, (F.col("l.g") == F.col("r.g")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("c") != F.col("sc")) & reach)
    return met.select(F.least("id", "sid").alias("a"), F.greatest("id", "sid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set) and component_id of every row of ``docs``."""
    sketch = checkpointed(_sketches(docs, *banding(percent)))
    # equal sets, pre-aggregated before the shuffle: a class of any size is one row per task there
    full = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    member = checkpointed(full.select("doc_id", "print", "n_shingles").join(classes, "print").select("doc_id", "class_id", "n_shingles", "members"))
    # rows of one doc_id with different sets: the doc_id joins the classes
    same_doc = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.count("*").alias("n"))
    split = same_doc.where("n > 1 AND a < b").select("doc_id")
    bridges = member.join(split, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).where("a <> b")
    heads = full.join(classes.select(F.col("class_id").alias("doc_id"), "print"), ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
    keys = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("k")).where("k > 1").select("key", "hub")
    shared = checkpointed(keys.join(stars, "key"))  # only buckets of two or more are kept
    hub_size = heads.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("m"))
    star = shared.where("id <> hub").select("hub", "id", "n").distinct().join(hub_size, "hub")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # else the sizes alone rule it out
    tried = checkpointed(star.where(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = checkpointed(_confirm(docs, tried, percent).union(bridges))
    group = components(links)
    # buckets that still hold several components
    at = checkpointed(shared.select("key", "id", "n").join(group, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c")))
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_ = at.join(mixed, "key", "left_semi").groupBy("id").agg(F.min("c").alias("c"))
    more = checkpointed(_across(docs, checkpointed(open_), percent).join(tried, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = checkpointed(links.union(_confirm(docs, more, percent)))
        group = components(links)
    head = member.join(group.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", "class_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    alone = sketch.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), "n_shingles", F.col("doc_id").alias("component_id"))
    return head.union(alone)
