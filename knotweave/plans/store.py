"""Frames in hash buckets, and generations of them that share what didn't change.

A frame is stored by a key: rows are dealt into buckets by a checksum of the key and
sorted by it within a bucket. A lookup of known keys names their buckets (partitions)
and their values (row groups and pages) to the scan, so that what is read grows with the
keys and not with the frame. Edges are stored twice, by source and by target.

Below a root every write goes to a new folder, ``<copy>/_batch=<id>/_bucket=<n>``. A manifest
lists which batch holds the live version of each bucket, and a pointer file names the
manifest. A change rewrites the buckets that it touches; the next manifest takes all others
over from the one before, so that old generations stay readable until :func:`retain`
deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from knotweave.operators.search import postings, with_slots
from knotweave.plans.session import shared_top

POINTER = "CURRENT"
#: Buckets of a frame unless a store is made with another number; many more pay on large graphs.
BUCKETS = 64
#: Rows of a counted frame up to which it is broadcast.
BROADCAST_ROWS = 100_000

# Each frame's copies and the key of each; owned and postings are derived from nodes.
COPIES = {
    "nodes": {"nodes": "id", "owned": "path", "postings": "slot"}, "edges": {"edges": "source", "edges_in": "target"}, "states": {"states": "path"}, "inputs": {"inputs": "name"},
    "packages": {"packages": "attribute"}, "errors": {"errors": "path"}, "values": {"values": "key"},
}


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % buckets).cast("int")


def one_of(column: str, values: list[str]) -> Column:
    """``column IN (values)`` as one expression: building it value by value costs more than reading the rows."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"{column} IN ({', '.join(quoted)})") if values else F.lit(False)


@dataclass(frozen=True)
class Clustered:
    """A stored frame: ``rows`` with the partition columns _batch and _bucket, sorted by ``key`` within a bucket."""

    rows: DataFrame
    key: str
    buckets: int

    @property
    def frame(self) -> DataFrame:
        return self.rows.drop("_batch", "_bucket")

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("_batch", "_bucket")]

    def where(self, condition: Column | str) -> Clustered:
        return Clustered(self.rows.where(condition), self.key, self.buckets)

    def __getattr__(self, name: str):
        """Whatever else is asked for is asked of the frame."""
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.frame, name)

    def _part(self, numbers: list[int]) -> DataFrame:
        return self.rows.where(F.expr(f"_bucket IN ({', '.join(map(str, numbers))})") if numbers else F.lit(False))

    def at(self, values: Iterable[str]) -> DataFrame:
        """The rows of a few known keys; buckets and values are both told to the scan."""
        known = sorted(set(values))
        return self._part(sorted({zlib.crc32(v.encode()) % self.buckets for v in known})).where(one_of(self.key, known)).select(self.columns)

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys`` (one column, computed): of their buckets only, unless most are asked for."""
        name = keys.columns[0]
        numbers = [r[0] for r in keys.select(bucket_of(F.col(name), self.buckets)).distinct().limit(self.buckets // 2 + 1).collect()]
        rows = self.rows if len(numbers) > self.buckets // 2 else self._part(numbers)
        return rows.join(side(keys.select(F.col(name).alias(self.key)), keys.count()), self.key, "left_semi").select(self.columns)


@dataclass(frozen=True)
class Adjacency:
    """Edges by source and by target."""

    out: Clustered
    into: Clustered

    @property
    def frame(self) -> DataFrame:
        return self.out.frame

    @property
    def columns(self) -> list[str]:
        return self.out.columns

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.out.frame, name)

    def where(self, condition: Column | str) -> Adjacency:
        return Adjacency(self.out.where(condition), self.into.where(condition))


def side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plain(rows: DataFrame | Clustered | Adjacency) -> DataFrame:
    return rows.frame if isinstance(rows, Clustered | Adjacency) else rows


# ---- files of the store ---------------------------------------------------------


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since the last change) of what lies in a folder; nothing if there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return []
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(at)]


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below ``path``: it differs when a table has been written anew."""
    fs, at = _file(spark, path)
    found = fs.listFiles(at, True)
    out = []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _write(rows: DataFrame, key: str, buckets: int, folder: str) -> list[int]:
    """Write rows below ``folder`` in buckets; the numbers of those that got any. A frequent key is split by id."""
    dealt = rows.withColumn("_bucket", bucket_of(F.col(key), buckets))
    order = ["_bucket", key, *(["id"] if "id" in rows.columns and key != "id" else [])]
    dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("_bucket").parquet(folder)
    return sorted(int(n.split("=")[1]) for n, _ in _names(rows.sparkSession, folder) if "=" in n)


def _copy(copy: str, rows: DataFrame) -> DataFrame:
    if copy == "owned":
        return rows.where("path is not null").select("path", "id")
    return with_slots(postings(rows)) if copy == "postings" else rows


def write_frames(root: str, frames: dict[str, DataFrame], buckets: int = BUCKETS, without: tuple[str, ...] = ()) -> dict:
    """Write all of ``frames`` below ``root``, but not the copies ``without``; the manifest of a generation that consists of them."""
    manifest = {"buckets": buckets, "frames": {}}
    for name, rows in frames.items():
        for copy, key in COPIES[name].items():
            if copy in without:
                continue
            batch, part = uuid.uuid4().hex, _copy(copy, rows)
            numbers = _write(part, key, buckets, f"{root}/{copy}/_batch={batch}")
            manifest["frames"][copy] = {"key": key, "schema": part.schema.jsonValue(), "live": {batch: numbers}}
    return manifest


def replace_rows(spark: SparkSession, root: str, manifest: dict, name: str, before: DataFrame, after: DataFrame, keys: list[str]) -> dict:
    """The manifest after rows ``before`` of a frame have become ``after``: for each copy, the buckets in which they differ are written anew.

    ``keys`` tell the frame's rows apart. All rows of a key must be in ``before``.
    """
    frames = dict(manifest["frames"])
    for copy, key in COPIES[name].items():
        if copy not in frames:
            continue
        entry, old, new = frames[copy], _copy(copy, before), _copy(copy, after)
        number = bucket_of(F.col(key), manifest["buckets"])
        # rows are compared by a digest of all columns: some types can't be compared as they are
        signed = lambda rows, n: rows.select(number.alias("_bucket"), F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("d"), F.lit(n).alias("n"))  # noqa: E731, B023
        odd = signed(old, -1).union(signed(new, 1)).groupBy("_bucket", "d").agg(F.sum("n").alias("n")).where("n <> 0")
        touched = sorted(r[0] for r in odd.select("_bucket").distinct().collect())  # at most all buckets' numbers
        if not touched:
            continue
        own = {"owned": ["path", "id"], "postings": ["token", "column", "id"]}.get(copy, keys)
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in own]
        stay = clustered(spark, root, manifest, copy)._part(touched).alias("l").join(old.select(own).distinct().alias("r"), same, "left_anti").select(old.columns)
        fresh = new.where(number.isin(touched)).select(old.columns)
        batch = uuid.uuid4().hex
        numbers = _write(stay.union(fresh), key, manifest["buckets"], f"{root}/{copy}/_batch={batch}")
        live = {k: [n for n in v if n not in touched] for k, v in entry["live"].items()}
        frames[copy] = entry | {"live": {k: v for k, v in live.items() if v} | ({batch: numbers} if numbers else {})}
    return manifest | {"frames": frames}


def clustered(spark: SparkSession, root: str, manifest: dict, copy: str) -> Clustered:
    entry = manifest["frames"][copy]
    schema = StructType.fromJson(entry["schema"])
    schema = StructType([*schema.fields, StructField("_batch", StringType()), StructField("_bucket", IntegerType())])
    paths = [f"{root}/{copy}/_batch={batch}/_bucket={n}" for batch, numbers in entry["live"].items() for n in numbers]
    rows = spark.read.schema(schema).option("basePath", f"{root}/{copy}").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return Clustered(rows, entry["key"], manifest["buckets"])


# ---- generations ----------------------------------------------------------------


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(generation, manifest file) that ``root`` points to; None if nothing is published there."""
    fs, at = _file(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    row = spark.read.schema("generation int, folder string").json(at.toString()).first()
    return row["generation"], row["folder"]


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def commit(spark: SparkSession, root: str, manifest: dict) -> int:
    """Make ``manifest`` the next generation of ``root``: the pointer is written beside the old one and renamed over it."""
    before = current(spark, root)
    generation = before[0] + 1 if before else 1
    path = f"{root}/manifests/{generation:08d}-{uuid.uuid4().hex}.json"
    _put(spark, path, json.dumps(manifest))
    draft = f"{root}/{POINTER}-{uuid.uuid4().hex}"
    _put(spark, draft, json.dumps({"generation": generation, "folder": path}) + "\n")
    (_, at), (_, to) = _file(spark, draft), _file(spark, f"{root}/{POINTER}")
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to, how)
    return generation


def retain(spark: SparkSession, root: str, generations: int = 2, older_than: float = 3600.0) -> int:
    """Keep the last ``generations`` manifests of ``root`` and delete the buckets that none of them names; how many folders went.

    Folders younger than ``older_than`` seconds stay: a write that isn't committed yet may own them.
    """
    files = sorted((n for n, _ in _names(spark, f"{root}/manifests") if n.endswith(".json")), reverse=True)
    kept = files[:generations]
    live: dict[str, set[tuple[str, int]]] = {}
    for n in kept:
        for copy, entry in manifest_of(spark, f"{root}/manifests/{n}")["frames"].items():
            live.setdefault(copy, set()).update((b, x) for b, numbers in entry["live"].items() for x in numbers)
    gone = 0
    for copy, used in live.items():
        for folder, age in _names(spark, f"{root}/{copy}"):
            batch = folder.removeprefix("_batch=")
            if age < older_than or batch == folder:
                continue
            whole = not any(b == batch for b, _ in used)
            dead = [folder] if whole else [f"{folder}/{n}" for n, _ in _names(spark, f"{root}/{copy}/{folder}") if "=" in n and (batch, int(n.split("=")[1])) not in used]
            for d in dead:
                fs, at = _file(spark, f"{root}/{copy}/{d}")
                fs.delete(at, True)
                gone += 1
    for n in files[generations:]:
        fs, at = _file(spark, f"{root}/manifests/{n}")
        fs.delete(at, False)
    return gone


# ---- graphs ----------------------------------------------------------------------


def publish(nodes: DataFrame, edges: DataFrame, root: str | None = None, buckets: int = BUCKETS) -> tuple[str, dict]:
    """Write a graph below ``root`` (a new folder of the shared one if not given): the root and the manifest, for :func:`published`."""
    root = root or f"{shared_top(nodes.sparkSession)}/graph-{uuid.uuid4().hex}"
    return root, write_frames(root, {"nodes": nodes, "edges": edges}, buckets, without=("owned", "postings"))


def published(spark: SparkSession, root: str, manifest: dict) -> tuple[Clustered, Adjacency]:
    part = lambda copy: clustered(spark, root, manifest, copy)
    return part("nodes"), Adjacency(part("edges"), part("edges_in"))


def write_json(frame: DataFrame, folder: str) -> None:
    """An answer as JSON lines; nulls are written too, so that every row has the same keys."""
    frame.write.option("ignoreNullFields", "false").json(folder)


