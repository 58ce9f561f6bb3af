"""The graph of a repository from its files: a whole index in two passes, and updates by batches of changed files.

Both take and return frames. A batch of any size is one plan: files are parsed where
they lie, and what they own is replaced by joins on path and id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.extract.registry import extract, graph_rows
from knotweave.operators import incremental, maintain
from knotweave.operators.health import synthetic
from knotweave.plans.session import compressed
from knotweave.plans.session import table as cut
from knotweave.plans.store import BUCKETS, Adjacency, Clustered, clustered, commit, current, manifest_of, replace_rows, write_frames
from knotweave.sources.files import relevant, texts
from knotweave.schema import OPTION_VALUES
from knotweave.sources.lock import parse_lock

_INPUTS = "name string, url string, rev string, nar_hash string, type string, inputs map<string,array<string>>"
_STATES = ["path", "lang", "content_hash", "ast_hash", "merkle_hash", "dirty", "last_parsed", "detail_level"]


@dataclass(frozen=True)
class Index:
    """What is stored of a repository."""

    nodes: DataFrame
    edges: DataFrame
    states: DataFrame
    inputs: DataFrame
    packages: DataFrame
    errors: DataFrame
    values: DataFrame

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def publish(self, root: str, buckets: int = BUCKETS) -> tuple[int, Index]:
        """Write all frames below ``root`` as its next generation; the number, and the index as it is read back."""
        spark = self.nodes.sparkSession
        manifest = write_frames(root, self.frames(), buckets)
        return commit(spark, root, manifest), StoredIndex(spark, root, 0, manifest).index()


@dataclass(frozen=True)
class StoredIndex:
    """A published generation: its frames in buckets, of which lookups and batches read what they need."""

    spark: SparkSession
    root: str
    generation: int
    manifest: dict

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> StoredIndex:
        at = current(spark, root)
        if at is None:
            raise FileNotFoundError(root)
        return cls(spark, root, at[0], manifest_of(spark, at[1]))

    def part(self, copy: str) -> Clustered:
        return clustered(self.spark, self.root, self.manifest, copy)

    @property
    def edges(self) -> Adjacency:
        return Adjacency(self.part("edges"), self.part("edges_in"))

    def index(self) -> Index:
        return Index(**{f.name: self.part(f.name).frame for f in fields(Index)})


def load(spark: SparkSession, root: str) -> tuple[int, Index]:
    """The generation that ``root`` points to."""
    store = StoredIndex.open(spark, root)
    return store.generation, store.index()


def _parsed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and errors of the files; they are parsed once and written to the shared folder."""
    rows = cut(extract(files))
    nodes, edges = graph_rows(rows)
    rank = F.struct("ord", F.coalesce("path", F.lit("")), "metadata", "name")  # one order for equal ids of several files
    return nodes.withColumn("ord", rank), edges.withColumn("ord", F.struct("ord", "source", "metadata")), rows.where("kind = 'error'").select("path", "error")


def _imports(edges: DataFrame) -> DataFrame:
    """path, target of imports between modules, as paths."""
    both = edges.where((F.col("type") == "imports") & F.col("source").startswith("nix:") & F.col("target").startswith("nix:"))
    return both.select(F.substr("source", F.lit(5)).alias("path"), F.substr("target", F.lit(5)).alias("target"))


def _hashes(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, lang, content_hash, ast_hash of parsed files; one without nodes has the hash of nothing."""
    found = incremental.structure_hash(nodes, edges)
    return files.where("text is not null").select("path", "lang", "content_hash").join(found, "path", "left").withColumn("ast_hash", F.coalesce("ast_hash", F.sha2(F.lit(""), 256)))


def _states(hashes: DataFrame, merkle: DataFrame) -> DataFrame:
    return hashes.join(merkle, "path", "left").select(
        "path", "lang", "content_hash", "ast_hash", "merkle_hash", F.lit(False).alias("dirty"), F.current_timestamp().alias("last_parsed"), F.lit("full").alias("detail_level")
    )


def index(files: DataFrame, enabled: list[str], locks: DataFrame | None = None, old: Index | None = None, parse_unreferenced: bool = False) -> Index:
    """The whole index of ``files`` (as of a listing: path, lang, tier, content).

    The first pass parses tier 0, the second those of the other files that the first
    pass's graph asks for. Whatever ``old`` had of files that are gone is not taken
    over; of its packages, the time they were first seen is. ``locks`` (text): lock
    files, whose inputs become nodes and edges. An empty listing gives empty frames.
    """
    with compressed(files.sparkSession):
        return _index(files, enabled, locks, old, parse_unreferenced)


def _index(files: DataFrame, enabled: list[str], locks: DataFrame | None, old: Index | None, parse_unreferenced: bool) -> Index:
    spark = files.sparkSession
    read = texts(files)
    first = read.where("tier = 0")
    nodes, edges, errors = _parsed(first)
    more = cut(relevant(read.where("tier > 0"), nodes, edges, enabled, parse_unreferenced))
    nodes2, edges2, errors2 = _parsed(more)
    nodes, edges = maintain.build_all(nodes.union(nodes2), edges.union(edges2))
    nodes, edges = cut(nodes.drop("ord")), cut(edges.drop("ord"))
    inputs = parse_lock(locks) if locks is not None else spark.createDataFrame([], _INPUTS)
    if locks is not None:
        inputs = cut(inputs.dropDuplicates(["name"]))
        links = maintain.follow_edges(inputs).select("id", "source", "target", "type", F.lit("{}").alias("metadata"), F.lit(1.0).alias("weight"))
        edges = maintain.upsert(edges, links.select(edges.columns), "id")
        edges = cut(edges)
        nodes = cut(maintain.input_nodes(nodes, inputs))
    hashes = cut(_hashes(first.union(more), nodes, edges))
    states = _states(hashes, incremental.merkle(hashes.select("path", "ast_hash"), _imports(edges)))
    packages = maintain.refresh_packages(old.packages if old else None, maintain.package_index(nodes, edges), F.current_timestamp())
    values = old.values if old else spark.createDataFrame([], OPTION_VALUES)
    return Index(cut(maintain.with_placeholders(nodes, edges)), edges, cut(states), inputs, cut(packages), errors.union(errors2), values)


def update(index: Index, changed: DataFrame, deleted: DataFrame, enabled: list[str], parse_unreferenced: bool = False, named: tuple | None = None, parsed: tuple | None = None) -> tuple[Index, DataFrame]:
    """The index after a batch, and path, decision of its files.

    ``changed``: rows of a listing (path, lang, tier, content); ``deleted``: path.
    Unchanged and merely reformatted files leave the graph alone; a file that nothing
    asks for any more is treated as deleted if it was indexed. Modules that import
    what changed, over any number of steps, get new Merkle hashes and become dirty, and
    option values whose expression names one of either by its stem become stale.
    Decisions are taken against the graph as it was before the batch. ``named``: nodes
    and edges that name files, if not the index's; ``parsed``: texts, nodes, edges and
    errors of the changed files, if they are there already.
    """
    with compressed(changed.sparkSession):
        return _update(index, changed, deleted, enabled, parse_unreferenced, named, parsed)


def _update(index: Index, changed: DataFrame, deleted: DataFrame, enabled: list[str], parse_unreferenced: bool, named: tuple | None, parsed: tuple | None) -> tuple[Index, DataFrame]:
    states = index.states
    if parsed is None:
        read = cut(texts(changed))
        nodes, edges, errors = _parsed(read)
    else:
        read, nodes, edges, errors = parsed
    wanted = relevant(read, *(named or (index.nodes, index.edges)), enabled, parse_unreferenced).select("path", F.lit(True).alias("relevant"))
    hashes = cut(_hashes(read, nodes, edges))
    fresh = read.join(hashes.select("path", "ast_hash"), "path", "left").join(wanted, "path", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    decided = incremental.decide(fresh.select("path", F.col("text").alias("content"), "ast_hash", "relevant"), states)
    known = deleted.select("path").distinct()
    decided = decided.join(known, "path", "left_anti").union(known.select("path", F.lit("deleted").alias("decision")))
    indexed = states.select("path", F.lit(True).alias("_indexed"))
    lost = (F.col("decision") == "not_relevant") & F.col("_indexed")
    decided = cut(decided.join(indexed, "path", "left").select("path", F.when(lost, "deleted").otherwise(F.col("decision")).alias("decision")))
    of = lambda what: decided.where(F.col("decision") == what).select("path")
    gone, rebuilt, same = of("deleted"), of("ast_changed"), of("formatting_only")

    # frames that several joins read are written once, else their plans would multiply
    n, e = maintain.delete_files(index.nodes, index.edges, gone)
    e = cut(e)
    n = cut(maintain.prune_orphans(n, e))
    mine_n = nodes.join(rebuilt, "path", "left_semi").drop("ord").select(index.nodes.columns)
    from_ = nodes.join(rebuilt, "path", "left_semi").select(F.col("id").alias("source"))
    mine_e = edges.join(from_, "source", "left_semi").drop("ord").select(index.edges.columns)
    n, e = (cut(x) for x in maintain.build_files(n, e, rebuilt, cut(mine_n), cut(mine_e)))

    touched = gone.union(rebuilt)
    importers = cut(_importers(_imports(e), touched))
    stay = states.join(gone.union(rebuilt), "path", "left_anti").select(_STATES)
    now = hashes.join(rebuilt, "path", "left_semi")
    reformatted = hashes.join(same, "path", "left_semi").select("path", F.col("content_hash").alias("_new"))
    stay = stay.join(reformatted, "path", "left").withColumn("content_hash", F.coalesce("_new", "content_hash")).withColumn("last_parsed", F.when(F.col("_new").isNotNull(), F.current_timestamp()).otherwise(F.col("last_parsed"))).select(_STATES)
    open_ = now.select("path", "ast_hash").union(stay.join(importers, "path", "left_semi").select("path", "ast_hash"))
    merkle = cut(incremental.merkle(open_, _imports(e), stay.select("path", "merkle_hash")))
    stay = stay.join(merkle.select("path", F.col("merkle_hash").alias("_merkle")), "path", "left").withColumn("merkle_hash", F.coalesce("_merkle", "merkle_hash")).select(_STATES)
    stay = incremental.mark(stay, importers)
    out = cut(stay.union(_states(now, merkle).select(_STATES)))
    left = index.errors.join(touched, "path", "left_anti").union(errors.join(rebuilt, "path", "left_semi").select("path", "error"))
    values = cut(stale_values(index.values, touched.union(importers)))
    return replace(index, nodes=n, edges=e, states=out, errors=left, values=values), decided


def neighbourhood(store: StoredIndex, read: DataFrame, deleted: DataFrame, nodes: DataFrame, edges: DataFrame) -> Index:
    """The part of a stored index that a batch can change or has to look at; ``read``, ``nodes``, ``edges``: its files' texts and what they own now.

    That is: the files' nodes and what leaves them; edges into nodes that they lose; the
    ends of all those, and for each placeholder among them one edge of another file that
    keeps it; the files that import them over any number of steps, with their states,
    imports and the states of what they import. All of it is read by key.
    """
    own = lambda rows, name="id": rows.select(F.col(name).alias("id"))
    module = lambda path: F.concat(F.lit("nix:"), path)
    out, into = store.part("edges"), store.part("edges_in")
    paths = cut(read.select("path").union(deleted.select("path")).distinct())
    owned = cut(own(store.part("owned").among(paths)).distinct())
    new = cut(own(nodes).distinct())
    mine = cut(owned.union(new).distinct())
    leaving = cut(out.among(mine))
    entering = cut(into.among(cut(owned.join(new, "id", "left_anti"))))
    ends = cut(mine.union(own(leaving, "target")).union(own(edges, "target")).distinct())
    near = cut(store.part("nodes").among(ends))
    lone = cut(own(near.where(F.col("path").isNull() & synthetic())))
    witness = lambda side, end: side.among(lone).join(owned.withColumnRenamed("id", "source"), "source", "left_anti").groupBy(end).agg(F.min(F.struct("id", *(c for c in out.columns if c != "id"))).alias("e")).select("e.*")
    kept = witness(into, "target").unionByName(witness(out, "source"))

    found = fresh = cut(paths.select(module(F.col("path")).alias("id")))
    while True:
        asked = into.where("type = 'imports'").among(fresh).where(F.col("source").startswith("nix:"))
        fresh = cut(own(asked, "source").distinct().join(found, "id", "left_anti"))
        if fresh.isEmpty():
            break
        found = cut(found.union(fresh))
    imports = cut(out.where("type = 'imports'").among(found))
    known = imports.select("target").union(edges.where("type = 'imports'").select("target")).where(F.col("target").startswith("nix:"))
    stated = cut(found.union(own(known, "target")).select(F.substr("id", F.lit(5)).alias("path")).union(paths).distinct())
    all_edges = cut(leaving.unionByName(entering).unionByName(kept.select(out.columns)).unionByName(imports).dropDuplicates(["id"]))
    whole = store.index()
    return Index(near, all_edges, cut(store.part("states").among(stated)), whole.inputs, whole.packages, cut(store.part("errors").among(paths)), whole.values)


def apply_batch(spark: SparkSession, root: str, changed: DataFrame, deleted: DataFrame, enabled: list[str], parse_unreferenced: bool = False) -> DataFrame:
    """:func:`update` of the generation below ``root`` as its next one; path, decision of the batch's files.

    The batch's neighbourhood is read by key, and of each frame only the buckets in which
    rows changed are written; a batch that changes nothing publishes nothing.
    """
    with compressed(spark):
        return _apply_batch(spark, root, changed, deleted, enabled, parse_unreferenced)


def _apply_batch(spark: SparkSession, root: str, changed: DataFrame, deleted: DataFrame, enabled: list[str], parse_unreferenced: bool) -> DataFrame:
    store = StoredIndex.open(spark, root)
    read = cut(texts(changed))
    nodes, edges, errors = _parsed(read)
    part = neighbourhood(store, read, deleted, nodes, edges)
    after, decided = update(part, changed, deleted, enabled, parse_unreferenced, (store.part("nodes"), store.edges), (read, nodes, edges, errors))
    manifest = store.manifest
    for name, keys in (("nodes", ["id"]), ("edges", ["id"]), ("states", ["path"]), ("errors", ["path", "error"]), ("values", ["key"])):
        manifest = replace_rows(spark, root, manifest, name, getattr(part, name), cut(getattr(after, name)), keys)
    if manifest["frames"] != store.manifest["frames"]:
        commit(spark, root, manifest)
    return decided


def purge_vanished(spark: SparkSession, root: str, files: DataFrame, enabled: list[str]) -> DataFrame:
    """Everything of stored files that the listing ``files`` lacks goes, as one batch; path, decision of those."""
    gone = cut(maintain.vanished(StoredIndex.open(spark, root).part("states").frame, files))
    return apply_batch(spark, root, files.limit(0), gone, enabled)


def _importers(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """path of everything that imports one of ``paths``, over any number of steps, without those themselves.

    A file may be gone while others still import it, so ends need not be nodes.
    """
    found = cut(paths.select("path").distinct())
    levels = found
    while not found.isEmpty():
        found = cut(imports.join(found.withColumnRenamed("path", "target"), "target", "left_semi").select("path").distinct().join(levels, "path", "left_anti"))
        levels = cut(levels.union(found))
    return levels.join(paths, "path", "left_anti")


def stale_values(option_values: DataFrame, paths: DataFrame) -> DataFrame:
    """``option_values`` with those stale whose expression names one of the files (path) by its stem."""
    stems = paths.select(incremental.stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    return incremental.invalidate(option_values, stems)


def consume(root: str, listing: Callable[[], DataFrame], enabled: list[str]) -> Callable[[DataFrame, int], None]:
    """An ``update`` for ``run_updates``: each batch (items: paths) is applied to the generation stored below ``root``.

    ``listing`` is called for each batch, so that it sees the files as they are; a path
    that it lacks is a deleted file. A
    batch that changes nothing publishes nothing. A batch that is sent again after a
    restart finds its files unchanged.
    """

    def apply(batch: DataFrame, _: int) -> None:
        paths = cut(batch.select(F.explode("items").alias("path")).distinct())
        if paths.isEmpty():
            return
        spark = batch.sparkSession
        files = listing()
        changed = files.join(paths, "path", "left_semi")
        known = StoredIndex.open(spark, root).part("states").among(paths).select("path")
        apply_batch(spark, root, changed, paths.join(files.select("path"), "path", "left_anti").join(known, "path", "left_semi"), enabled)

    return apply
