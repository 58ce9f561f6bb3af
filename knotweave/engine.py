"""The verbs of the engine over one (nodes, edges) pair, with their budgets and error contract."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.operators import health, indexing, lookup, maintain, search, traverse, usage
from knotweave.plans.session import cut
from knotweave.schema import MAX_CLOSURE_DEPTH, MAX_HOP_DEPTH, MAX_HOP_VOLUME, MAX_OBSERVE_DEPTH


def _budget(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass
class GraphEngine:
    """Immutable snapshot of a graph; ``generation`` names it, and results are kept for it.

    ``index`` is what an indexed repository has besides its graph, ``files`` (path,
    length, text) its texts for snippets and the report. Both may be absent.
    """

    nodes: traverse.Nodes
    edges: traverse.Edges
    generation: int = 0
    max_cached: int = 128
    served: dict[str, int] = field(default_factory=dict)
    index: indexing.Index | None = None
    files: DataFrame | None = None
    posted: DataFrame | None = None
    _cache: dict[tuple, DataFrame] = field(default_factory=dict)
    _named: list[DataFrame] = field(default_factory=list)
    _logged: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, index: indexing.Index, files: DataFrame | None = None, generation: int = 0) -> GraphEngine:
        return cls(index.nodes, index.edges, generation, index=index, files=files)

    @classmethod
    def of_store(cls, spark: SparkSession, root: str, files: DataFrame | None = None) -> GraphEngine:
        """The engine over the generation that ``root`` points to; its verbs read by key."""
        store = indexing.StoredIndex.open(spark, root)
        return cls(store.part("nodes"), store.edges, store.generation, index=store.index(), files=files, posted=store.part("postings"))

    def _count(self, verb: str) -> None:
        self.served[verb] = self.served.get(verb, 0) + 1

    def _kept(self, verb: str, args: tuple, make: Callable[[], DataFrame], counted: bool = True) -> DataFrame:
        if counted:
            self._count(verb)
        key = (verb, self.generation, *args)
        if key not in self._cache:
            if len(self._cache) >= self.max_cached:  # first in, first out
                self._cache.pop(next(iter(self._cache))).unpersist()
            self._cache[key] = make().persist()
            self._note(self._cache[key])
        return self._cache[key]

    def _kept_pair(self, verb: str, args: tuple, make: Callable[[], Sequence[DataFrame]]) -> Sequence[DataFrame]:
        """Nodes, and edges that are planned when asked for; both are kept."""
        pair: list[Sequence[DataFrame]] = []

        def both() -> Sequence[DataFrame]:
            if not pair:
                pair.append(make())
            return pair[0]

        def edges() -> DataFrame:
            return self._kept(f"{verb}_edges", args, lambda: both()[1], counted=False)

        return traverse.Lazy(self._kept(verb, args, lambda: both()[0]), edges)

    def _note(self, answer: DataFrame) -> None:
        """Remember which nodes an answer named."""
        node = next((c for c in ("neighbour", "id") if c in answer.columns), None)
        if node:
            self._named.append(answer.select(F.col(node).alias("id")))
        if len(self._named) > 32:  # one stored list instead of many plans
            self._named[:] = [cut(self._all_named())]

    def _all_named(self) -> DataFrame:
        out = self.nodes.select("id").limit(0)
        for part in self._named:
            out = out.union(part)
        return out.distinct()

    def publish(self, nodes: DataFrame, edges: DataFrame) -> GraphEngine:
        """The next generation; results of this one are let go."""
        for df in self._cache.values():
            df.unpersist()
        return GraphEngine(nodes, edges, self.generation + 1, self.max_cached, self.served, self.index, self.files)

    def _need(self, node: str) -> None:
        if traverse.nodes_at(self.nodes, [node]).isEmpty():
            raise KeyError(node)

    def observe(self, node: str, depth: int = 1) -> DataFrame:
        _budget(depth <= MAX_OBSERVE_DEPTH, f"depth {depth} exceeds {MAX_OBSERVE_DEPTH}")
        self._need(node)
        if depth != 1:
            return self._kept("observe", (node, depth), lambda: lookup.observe_deep(self.nodes, self.edges, node, depth))
        return self._kept("observe", (node, depth), lambda: self._with_snippets(lookup.observe(self.nodes, self.edges, node), "neighbour"))

    def hop(self, node: str, relation: str | None = None, depth: int = 1, width: int = 10) -> Sequence[DataFrame]:
        _budget(depth * width <= MAX_HOP_VOLUME, f"width * depth exceeds {MAX_HOP_VOLUME}")
        _budget(depth <= MAX_HOP_DEPTH, f"depth {depth} exceeds {MAX_HOP_DEPTH}")
        return self._kept_pair("hop", (node, relation, depth, width), lambda: traverse.hop(self.nodes, self.edges, node, relation, depth, width))

    def path(self, source: str, target: str) -> DataFrame:
        return self._kept("path", (source, target), lambda: traverse.shortest_path(self.nodes, self.edges, source, target))

    def blast_radius(self, node: str, max_depth: int = 5) -> Sequence[DataFrame]:
        _budget(max_depth <= MAX_CLOSURE_DEPTH, f"max_depth {max_depth} exceeds {MAX_CLOSURE_DEPTH}")
        return self._kept_pair("blast_radius", (node, max_depth), lambda: traverse.blast_radius(self.nodes, self.edges, node, max_depth))

    def dependencies(self, node: str, max_depth: int = 5, reverse: bool = False) -> DataFrame:
        _budget(max_depth <= MAX_CLOSURE_DEPTH, f"max_depth {max_depth} exceeds {MAX_CLOSURE_DEPTH}")
        self._need(node)
        verb = "dependents" if reverse else "dependencies"
        return self._kept(verb, (node, max_depth), lambda: traverse.closure(self.nodes, self.edges, node, max_depth, reverse).orderBy("depth", "id"))

    def dependents(self, node: str, max_depth: int = 5) -> DataFrame:
        return self.dependencies(node, max_depth, reverse=True)

    def impact(self, node: str, max_depth: int = 5) -> DataFrame:
        kinds = (["nix_module"], ["nix_option"], ["file"])
        return self._kept("impact", (node, max_depth), lambda: lookup.impact(self.nodes, self.edges, node, max_depth, *kinds))

    def summarize(self, path: str) -> DataFrame:
        self._need(f"nix:{path}")
        return self._kept("summarize", (path,), lambda: lookup.summarize_module(self.nodes, self.edges, path))

    def module_edges(self, path: str) -> DataFrame:
        self._need(f"nix:{path}")
        return self._kept("module_edges", (path,), lambda: lookup.module_edges(self.nodes, self.edges, path).orderBy("direction", "id"))

    def option(self, option: str, include_value: bool = False) -> DataFrame:
        """One row about an option; with ``include_value`` also its stored value (null where there is none)."""

        def make() -> DataFrame:
            found = lookup.introspect_option(self.nodes, self.edges, option)
            if include_value:
                found = found.join(F.broadcast(lookup.option_value(self._indexed().values, option)), F.lit(True), "left")  # one row each
            named = self._with_snippets(found.withColumn("id", F.lit(f"nix_option:{option}")), "id")
            return named.drop("id")

        return self._kept("option", (option, include_value), make)

    def find(self, query: str, **filters: object) -> DataFrame:
        return self._kept("find", (query, *sorted((k, repr(v)) for k, v in filters.items())), lambda: self._with_snippets(search.find_symbol(self.nodes, query, posted=self.posted, **filters), "id"))

    def _with_snippets(self, found: DataFrame, node: str) -> DataFrame:
        if self.files is None or "line" not in self.nodes.columns:
            return found
        return lookup.with_snippets(found, self.nodes, self.files, node)

    def _indexed(self) -> indexing.Index:
        if self.index is None:
            raise LookupError("this graph comes without an index")
        return self.index

    def status(self) -> DataFrame:
        """One row, never kept: size, generation, dirty files, and what was served."""
        row = health.status(self.nodes, self.edges, self._indexed().states, self.generation, sum(self.served.values()))
        self._count("status")
        return row.drop("tokens_estimated_saved").crossJoin(self._saved().select("tokens_estimated_saved"))  # one row each

    def _saved(self) -> DataFrame:
        paths = self.nodes.select("id", F.coalesce("path", F.when(F.col("type") == "file", F.col("name"))).alias("path")).join(self._all_named(), "id", "left_semi")
        sizes = self.files if self.files is not None else self.nodes.select("path", F.lit(0).alias("length")).limit(0)
        return usage.benefit(paths, sizes)

    def log(self, folder: str) -> None:
        """Append what was served since the last call to a durable log, which :func:`usage.logged` reports on."""
        new = {v: n - self._logged.get(v, 0) for v, n in self.served.items() if n > self._logged.get(v, 0)}
        spark = self.edges.sparkSession
        usage.log_rows(spark, spark.sparkContext.applicationId, new, self._all_named()).write.mode("append").parquet(folder)
        self._logged.update(self.served)

    def report(self) -> DataFrame:
        """One row: queries served, by verb too, and the files that need not be read again."""
        tools = [F.lit(x) for k in sorted(self.served) for x in (k, self.served[k])]
        by_tool = F.create_map(*tools) if tools else F.expr("cast(map() as map<string,int>)")
        return self._saved().select(F.lit(sum(self.served.values())).cast("bigint").alias("queries_served"), by_tool.alias("queries_by_tool"), "*", F.lit(self.generation).cast("bigint").alias("generation_id"))

    def refresh(self, listing: Callable[[], DataFrame], root: str, enabled: list[str], locks: DataFrame | None = None) -> GraphEngine:
        """Index the files anew, publish that below ``root``, and serve it."""
        generation, index = indexing.index(listing(), enabled, locks, self.index).publish(root)
        for df in self._cache.values():
            df.unpersist()
        return GraphEngine(index.nodes, index.edges, generation, self.max_cached, self.served, index, self.files)

    def packages(self, query: str | None = None, limit: int = 50) -> DataFrame:
        return self._kept("packages", (query, limit), lambda: maintain.list_packages(self._indexed().packages, query, limit))

    def package(self, attribute: str) -> DataFrame:
        """The package's row; none for an unknown one."""
        return self._kept("package", (attribute,), lambda: self._indexed().packages.where(F.col("attribute") == attribute))

    def inputs(self) -> DataFrame:
        return self._kept("inputs", (), lambda: self._indexed().inputs.orderBy("name"))

    def input(self, name: str) -> DataFrame:
        return self._kept("input", (name,), lambda: self._indexed().inputs.where(F.col("name") == name))
