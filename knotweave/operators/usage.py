"""Usage of tools by session: counts, nearest-rank percentiles, look-ahead windows, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Arguments that label a call (the first that is there counts), and characters of an error that are kept.
ARG_KEYS = ["query", "node_id", "source", "target", "option_path", "path", "attribute"]
MAX_ERROR_CHARS = 300

_PART = "type string, tool string, state struct<status:string, input:map<string,string>, output:string, error:string, time:struct<start:double, end:double>>"


def tool_parts(parts: DataFrame) -> DataFrame:
    """session, ts, call_id, tool, args, status, latency_ms, out_tokens, error, seq_index of the log rows (session, ts, call_id, data) that are tool parts.

    ``data`` is JSON; rows of other kinds, and what isn't JSON, are left out.
    ``seq_index`` counts all tool parts of a session; names of tools are as they stand.
    """
    p = parts.where(F.contains("data", F.lit('"tool"'))).withColumn("p", F.from_json("data", _PART)).where("p.type = 'tool'")
    state = F.col("p.state")
    start, end = state["time"]["start"], state["time"]["end"]
    error = F.coalesce(state["error"], F.when(state["status"] == "error", state["output"]))
    w = Window.partitionBy("session").orderBy("ts", "call_id")
    return p.select(
        "session", "ts", "call_id", F.coalesce("p.tool", F.lit("")).alias("tool"), F.coalesce(state["input"], F.expr("cast(map() as map<string,string>)")).alias("args"),
        F.coalesce(F.nullif(state["status"], F.lit("")), F.lit("unknown")).alias("status"), F.when((start != 0) & (end != 0), end - start).alias("latency_ms"),
        F.coalesce(F.floor(F.length(state["output"]) / 4), F.lit(0)).cast("bigint").alias("out_tokens"), F.substring(error, 1, MAX_ERROR_CHARS).alias("error"),
        (F.row_number().over(w) - 1).cast("bigint").alias("seq_index"),
    )


def nav_calls(parts: DataFrame, prefix: str, short_prefix: str = "") -> DataFrame:
    """The tool parts of one server: those whose tool starts with ``prefix``, without it and ``short_prefix``, and a label from their arguments."""
    bare = F.substr("tool", F.lit(len(prefix) + 1))
    if short_prefix:
        bare = F.when(bare.startswith(short_prefix), F.substr(bare, F.lit(len(short_prefix) + 1))).otherwise(bare)
    arg = F.coalesce(*(F.nullif(F.col("args")[k], F.lit("")) for k in ARG_KEYS))
    return parts.where(F.col("tool").startswith(prefix)).withColumn("tool", bare).withColumn("label", label(arg))


def benefit(served: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: the distinct files (path) that answers named, their bytes (sizes: path, length), and a quarter of those as tokens saved."""
    paths = served.where(F.col("path").isNotNull()).select("path").distinct().join(sizes.select("path", "length"), "path", "left")
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    return paths.agg(F.count("*").alias("files_served"), total.alias("bytes_not_reread"), F.floor(total / 4).cast("bigint").alias("tokens_estimated_saved"))


def with_sequence(calls: DataFrame, fallback: list[str], followup: list[str], reach: int = 5) -> DataFrame:
    """seq_index in the session, whether one of the next ``reach`` calls falls back, and their tokens.

    The window runs over all calls of a session; filters come after it.
    """
    w = Window.partitionBy("session").orderBy("ts", "call_id")
    ahead = w.rowsBetween(1, reach)
    return calls.withColumns(
        {
            "seq_index": (F.row_number().over(w) - 1).cast("bigint"),
            "fell_back": F.coalesce(F.max(F.col("tool").isin(fallback)).over(ahead), F.lit(False)),
            "followup_tokens": F.coalesce(F.sum(F.when(F.col("tool").isin(followup), F.col("out_tokens"))).over(ahead), F.lit(0)).cast("bigint"),
        }
    )


def tool_report(calls: DataFrame) -> DataFrame:
    """Calls, tokens, errors and latencies (nearest rank) of each tool."""
    q = lambda p: F.expr(f"coalesce(percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms), 0.0D)")
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.sum("out_tokens").cast("bigint").alias("tokens"), F.count_if(F.col("status") == "error").alias("errors"),
        q(0.5).alias("p50"), q(0.95).alias("p95"), F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_ms"),
    )


def sessions(calls: DataFrame) -> DataFrame:
    return calls.agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def label(column: Column) -> Column:
    """A label of at most 60 characters."""
    return F.when(F.length(column) > 60, F.concat(F.substring(column, 1, 57), F.lit("..."))).otherwise(column)


def top_labels(calls: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k commonest labels of each tool; ties: first seen, then the label."""
    counts = calls.where(F.col(column).isNotNull()).groupBy("tool", label(F.col(column)).alias("label")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    w = Window.partitionBy("tool").orderBy(F.desc("n"), "first_ts", "label")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("tool", "label", "n", "rank")


def effectiveness(sequenced: DataFrame, nav: list[str]) -> DataFrame:
    """Rates over the navigation calls of a frame from :func:`with_sequence`."""
    c = sequenced.where(F.col("tool").isin(nav)).agg(
        F.count("*").alias("nav_calls"), F.count_if("fell_back").alias("fallback_calls"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).cast("bigint").alias("nav_tokens"), F.coalesce(F.sum("followup_tokens"), F.lit(0)).cast("bigint").alias("followup_tokens"),
    )
    return c.withColumns(
        {
            "fallback_rate": F.round(F.col("fallback_calls") / F.greatest("nav_calls", F.lit(1)), 3),
            "followup_ratio": F.round(F.col("followup_tokens") / F.greatest("nav_tokens", F.lit(1)), 3),
        }
    )


def unused(registered: DataFrame, calls: DataFrame) -> DataFrame:
    """Registered tools (tool) that no call used."""
    return registered.select("tool").distinct().join(calls.select("tool"), "tool", "left_anti")


def since(calls: DataFrame, sequences: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """The calls (session, ts, ...) from ``ts`` on, and the sequences (session, ...) of the sessions that have such calls."""
    recent = calls.where(F.col("ts") >= ts)
    return recent, sequences.join(recent.select("session").distinct(), "session", "left_semi")


LOG = "session string, at timestamp, verb string, calls bigint, id string"


def log_rows(spark: SparkSession, session: str, calls: dict[str, int], named: DataFrame) -> DataFrame:
    """Rows of a query log: one for each verb with its calls, one for each node (id) that an answer named."""
    verbs = spark.createDataFrame([(v, n) for v, n in sorted(calls.items())], "verb string, calls bigint")
    now = F.current_timestamp().alias("at")
    none = lambda kind: F.lit(None).cast(kind)
    counted = verbs.select(F.lit(session).alias("session"), now, "verb", "calls", none("string").alias("id"))
    return counted.union(named.select(F.lit(session), now, none("string"), none("bigint"), "id"))


def logged(log: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """One row for a whole log, of any number of sessions: queries served, by verb too, and the files that need not be read again."""
    verbs = log.where("verb is not null").groupBy("verb").agg(F.sum("calls").alias("n"))
    by = verbs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries_served"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("verb", "n")))).alias("queries_by_tool"))
    path = F.coalesce("path", F.when(F.col("type") == "file", F.col("name"))).alias("path")
    served = nodes.join(log.where("id is not null").select("id").distinct(), "id", "left_semi").select(path)
    return by.crossJoin(benefit(served, files))  # one row each
