"""Folder trees by the store's own listing calls, folder by folder in tasks, level by level.

A level's folders are rows; tasks list them and give their files and subfolders, which are
the next level's rows. There is one job for each level of the tree, however many folders it has.
Folders that are never read are not entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.plans.session import table

# Folders that are never read (the engine's own among them).
SKIP_DIRS = [".git", ".venv", ".knotweave", ".direnv", "__pycache__", "result", ".mypy_cache", ".pytest_cache", "target", "node_modules"]

ENTRIES = "path string, folder boolean, length long, modified long"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the root's path in it."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def entries(store: fs.FileSystem, root: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """path (relative to the root), whether it is a folder, bytes, nanoseconds of the last change of what lies in ``folder``; nothing if that is gone."""
    at = f"{root}/{folder}" if folder else root
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        name, is_folder = info.base_name, info.type == fs.FileType.Directory
        if is_folder and (name in SKIP_DIRS or (name.startswith(".") and name != ".config")):
            continue
        yield (f"{folder}/{name}" if folder else name), is_folder, info.size or 0, info.mtime_ns or 0


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, length, modified of everything below ``root``."""
    root = root.rstrip("/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for b in batches:
            rows = [e for folder in b.column(0).to_pylist() for e in entries(store, base, folder)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "length", "modified"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = table(level.repartition(parts).mapInArrow(listed, ENTRIES))
        out = found if out is None else out.union(found)
        level = found.where("folder").select("path")
        if level.isEmpty():
            return out


def files(spark: SparkSession, root: str) -> DataFrame:
    return tree(spark, root).where(~F.col("folder")).drop("folder")
