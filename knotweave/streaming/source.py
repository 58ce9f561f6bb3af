"""A stream of file events: new, changed and deleted files below a folder, by comparing listings.

An offset names a stored listing by a digest of what it holds, so that a folder that did
not change has the same offset, and a batch sent again after a restart compares the same two
listings and gives the same events. Listings are kept in parts by a checksum of the
path; a task compares one part of two listings. The first batch reports all files as new.

    spark.dataSource.register(FileEvents)
    spark.readStream.format("file_events").option("root", ...).option("state", ...).load()

``state`` is a folder that the driver and all executors share. Listings that no batch can
ask for any more are deleted as batches are committed.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from knotweave.sources.tree import entries, opened

NOTHING = {"listing": ""}


class _Part(InputPartition):
    def __init__(self, start: str, end: str, part: int):
        super().__init__((start, end, part))
        self.start, self.end, self.part = start, end, part


def compared(before: dict[str, list[int]], after: dict[str, list[int]]) -> Iterator[tuple[str, str, int | None, int | None]]:
    """path, event, length, modified of what differs between two listings (path to length and time)."""
    for path in sorted(before.keys() | after.keys()):
        was, now = before.get(path), after.get(path)
        if was != now:
            yield (path, "deleted", None, None) if now is None else (path, "new" if was is None else "changed", now[0], now[1])


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["root"].rstrip("/"), options["state"].rstrip("/")
        self.parts = int(options.get("parts", "8"))
        self.suffixes = tuple(f".{s}" for s in options.get("suffixes", "").split(",") if s)

    def _folder(self, listing: str) -> tuple[fs.FileSystem, str]:
        store, base = opened(self.state)
        return store, f"{base}/listing-{listing}"

    def _listed(self) -> dict[str, list[int]]:
        store, base = opened(self.root)
        found, open_ = {}, [""]
        while open_:
            for path, is_folder, length, modified in entries(store, base, open_.pop()):
                if is_folder:
                    open_.append(path)
                elif not self.suffixes or path.endswith(self.suffixes):
                    found[path] = [length, modified]
        return found

    def initialOffset(self) -> dict:  # noqa: N802  as Spark calls it
        return NOTHING

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._listed()
        if not found:
            return NOTHING
        shards: list[dict] = [{} for _ in range(self.parts)]
        for path, facts in sorted(found.items()):
            shards[zlib.crc32(path.encode()) % self.parts][path] = facts
        texts = [json.dumps(s) for s in shards]
        name = hashlib.sha256("\n".join(texts).encode()).hexdigest()[:32]
        store, folder = self._folder(name)
        store.create_dir(folder, recursive=True)
        for i, text in enumerate(texts):
            with store.open_output_stream(f"{folder}/{i}.json") as out:
                out.write(text.encode())
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(start["listing"], end["listing"], i) for i in range(self.parts)]

    def _shard(self, listing: str, part: int) -> dict[str, list[int]]:
        if not listing:
            return {}
        store, folder = self._folder(listing)
        with store.open_input_stream(f"{folder}/{part}.json") as text:
            return json.loads(text.read())

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from compared(self._shard(partition.start, partition.part), self._shard(partition.end, partition.part))

    def commit(self, end: dict) -> None:
        """Batches up to ``end`` won't be asked for again: of what lies there, its listing alone is still compared with."""
        store, base = opened(self.state)
        # the listing of a batch that is being planned may be newer than ``end``
        ours, _ = self._folder(end["listing"]), None
        kept = store.get_file_info(ours[1]).mtime_ns if end["listing"] else None
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if kept and info.base_name.startswith("listing-") and info.base_name != f"listing-{end['listing']}" and info.mtime_ns is not None and info.mtime_ns < kept:
                store.delete_dir(info.path)


class FileEvents(DataSource):
    """Options: root, state, parts (8), suffixes (comma-separated; all files if empty)."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "path string, event string, length long, modified long"

    def streamReader(self, schema) -> ListingReader:  # noqa: N802, ANN001
        return ListingReader(dict(self.options))
