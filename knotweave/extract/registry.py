"""Plugins by language, and the stage that runs them over files.

A plugin is a function (path, text) -> (nodes, edges) of plain tuples:
nodes (id, type, name, lang, metadata), edges (source, target, type, metadata).
One that fails gives a bare ``file`` node and an error row, never a failed job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Node = tuple[str, str, str, str, dict]
Edge = tuple[str, str, str, dict]
Parser = Callable[[str, str], tuple[list[Node], list[Edge]]]

_PARSERS: dict[str, Parser] = {}


def register(lang: str) -> Callable[[Parser], Parser]:
    """The first plugin of a language stays."""

    def add(fn: Parser) -> Parser:
        _PARSERS.setdefault(lang, fn)
        return fn

    return add


def parsers() -> dict[str, Parser]:
    from knotweave.extract import kdl, nix, python  # noqa: F401  they register themselves

    return _PARSERS


def edge_id(source: str, kind: str, target: str, metadata: dict) -> str:
    """source->type->target, with a digest of the metadata other than the line (canonical JSON) where there is any."""
    rest = {k: v for k, v in metadata.items() if k != "line"}
    base = f"{source}->{kind}->{target}"
    return f"{base}:{hashlib.sha256(json.dumps(rest, sort_keys=True).encode()).hexdigest()[:8]}" if rest else base


def parse_safely(lang: str, path: str, text: str) -> tuple[list[Node], list[Edge], str | None]:
    try:
        nodes, edges = parsers()[lang](path, text)
        return nodes, edges, None
    except Exception as e:  # isolation: one file's failure is a row, not a failed job
        return [(f"file:{path}", "file", path, lang, {"parse_error": True})], [], f"{type(e).__name__}: {e}"[:300]


SCHEMA = "kind string, path string, id string, type string, name string, lang string, source string, target string, metadata string, line int, ord long, error string"


def parsed_rows(lang: str, path: str, text: str) -> list[tuple]:
    """The rows (see SCHEMA) of one file."""
    nodes, edges, error = parse_safely(lang, path, text)
    rows: list[tuple] = []
    for i, (id_, kind, name, node_lang, meta) in enumerate(nodes):
        rows.append(("node", path, id_, kind, name, node_lang, None, None, json.dumps(meta, sort_keys=True), meta.get("line"), i, None))
    for i, (source, target, kind, meta) in enumerate(edges):
        rows.append(("edge", path, edge_id(source, kind, target, meta), kind, None, lang, source, target, json.dumps(meta, sort_keys=True), meta.get("line"), i, None))
    if error:
        rows.append(("error", path, None, None, None, lang, None, None, None, None, 0, error))
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Rows of kind node, edge or error for files (path, lang, text); files without text are skipped.

    Files are dealt out before they are parsed, a few tasks for each core: texts by the million fit
    in one file of a listing, which one task would parse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = [r for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in parsed_rows(lang, path, text)]
            types = [pa.string()] * 9 + [pa.int32(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    known = sorted(parsers())
    spark = files.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.where(F.col("text").isNotNull() & F.col("lang").isin(known)).select("path", "lang", "text").repartition(tasks, "path").mapInArrow(run, SCHEMA)


def graph_rows(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of :func:`extract`, the first of each id within a file."""
    from pyspark.sql import Window

    first = Window.partitionBy("path", "kind", "id").orderBy("ord")
    one = extracted.where("kind <> 'error'").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    nodes = one.where("kind = 'node'").select("id", "type", "name", F.when(F.col("type") != "package_ref", F.col("path")).alias("path"), "lang", "metadata", "line", "ord")
    edges = one.where("kind = 'edge'").select("id", "source", "target", "type", "metadata", F.lit(1.0).alias("weight"), "ord")
    return nodes, edges


def listed(files: DataFrame, helper: Callable[[str], list[str]]) -> DataFrame:
    """path, value: what a helper lists for each text (registered tools, urls of inputs); a text that it can't read gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str]] = []
            for path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out += [(path, x) for x in helper(text)]
                except (SyntaxError, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["path", "value"])

    return files.where(F.col("text").isNotNull()).select("path", "text").mapInArrow(run, "path string, value string")
