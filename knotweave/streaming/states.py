"""What each file needs, decided on the stream with one state for each path.

A path's state holds the hashes of what was last seen of it and whether it is dirty.
Events of a path are taken in the order of ``seq``. A deletion is remembered for ``ttl``
(always, if none is given): until then an event from before it, that comes late, is
``superseded`` and doesn't bring the file back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "path string, seq long, event string, content_hash string, ast_hash string, relevant boolean"
DECISIONS = "path string, seq long, decision string, dirty boolean"
_STATE = "content_hash string, ast_hash string, dirty boolean"


def decided(state: tuple[str | None, str | None, bool] | None, event: str, content: str | None, ast: str | None, relevant: bool) -> tuple[str, tuple | None]:
    """The decision on an event, and the state after it (None: there is none any more)."""
    if event == "deleted":
        return "deleted", None
    if content is None:
        return "read_error", state
    if not relevant:
        return ("deleted" if state else "not_relevant"), None
    if state and state[0] == content:
        return "unchanged_content", state
    if state and state[1] == ast:
        return "formatting_only", (content, ast, state[2])
    return "ast_changed", (content, ast, True)


class Decider(StatefulProcessor):
    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _STATE)
        self.gone = handle.getValueState("gone", "seq long", self.ttl) if self.ttl else handle.getValueState("gone", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        state = tuple(self.seen.get()) if self.seen.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        text = lambda v: v if isinstance(v, str) else None  # noqa: E731  pandas has its own nulls
        gone = self.gone.get()[0] if self.gone.exists() else None
        for r in events.itertuples():
            if gone is not None and r.seq < gone:
                out.append((key[0], r.seq, "superseded", bool(state and state[2])))
                continue
            what, state = decided(state, r.event, text(r.content_hash), text(r.ast_hash), bool(r.relevant) if r.relevant is not None else False)
            out.append((key[0], r.seq, what, bool(state and state[2])))
            if r.event == "deleted":
                gone = int(r.seq)
                self.gone.update((gone,))
        if state is None:
            self.seen.clear()
        else:
            self.seen.update(state)
        yield pd.DataFrame(out, columns=["path", "seq", "decision", "dirty"])

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state of this kind lives in RocksDB stores."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def decisions(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """path, seq, decision, dirty of a stream of events (see EVENTS); ``ttl``: milliseconds that a deletion is remembered.

    With ``ttl`` Spark looks at the clock in every batch and so never runs out of batches:
    such a stream needs a trigger that goes on, not one that ends when all is read.
    """
    with_rocksdb(events.sparkSession)
    mode = "ProcessingTime" if ttl else "None"
    return events.groupBy("path").transformWithStateInPandas(statefulProcessor=Decider(ttl), outputStructType=DECISIONS, outputMode="Append", timeMode=mode)
