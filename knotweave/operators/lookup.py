"""Verbs that read one neighbourhood: observe, summarise a module, introspect an option, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.operators.traverse import Edges, Nodes, blast_radius, closure, edges_at, ends_without_node, gather, nodes_among, nodes_at, walk
from knotweave.plans.session import written
from knotweave.plans.store import plain, side
from knotweave.schema import EVIDENCE_LIMIT, KEY_SYMBOLS, OBSERVE_LIMIT


def incident(edges: Edges, node: str) -> DataFrame:
    """Edges at ``node`` with the other end; two equi-filters instead of one disjunction. A self-loop comes once."""
    out = edges_at(edges, [node]).select("id", "type", F.col("target").alias("other"), F.lit("out").alias("direction"))
    back = edges_at(edges, [node], reverse=True).where(F.col("source") != node).select("id", "type", F.col("source").alias("other"), F.lit("in").alias("direction"))
    return out.union(back)


def observe(nodes: Nodes, edges: Edges, node: str, limit: int = OBSERVE_LIMIT) -> DataFrame:
    """The first ``limit`` incident edges by id and their other ends; ends without a node are flagged dangling."""
    spark = edges.sparkSession
    first = incident(edges, node).orderBy("id").limit(limit).collect()
    near = spark.createDataFrame(first, "id string, type string, other string, direction string")
    known = nodes_at(nodes, {r["other"] for r in first}).select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.lit(True).alias("known"))
    return near.join(known, "other", "left").select(F.col("id").alias("edge_id"), "direction", F.col("other").alias("neighbour"), "other_type", F.col("known").isNull().alias("dangling"))


def observe_deep(nodes: Nodes, edges: Edges, node: str, depth: int, width: int = 20, limit: int = OBSERVE_LIMIT) -> DataFrame:
    """Everything within ``depth`` either way, the first ``limit`` by node id, each with its lowest incident edge.

    Where that leaves room, ends without a node that touch the node or anything within
    reach follow, flagged dangling: those of the node's own edges first, then by the id
    of what they touch and the edge's id, each once. They may lie one step further out.
    """
    spark = edges.sparkSession
    at = nodes_at(nodes, [node]).select("id")
    both = [walk(nodes, edges, at, depth, width=width), walk(nodes, edges, at, depth, reverse=True)]
    reached = both[0].union(both[1]).where(F.col("id") != node).groupBy("id").agg(F.min("depth").alias("depth"))
    first = reached.orderBy("id").limit(limit).collect()  # an answer's few rows
    ids = sorted(r["id"] for r in first)
    touching = lambda ids: edges_at(edges, ids).select(F.col("source").alias("node"), "id", F.col("target").alias("other")).union(edges_at(edges, ids, reverse=True).select(F.col("target").alias("node"), "id", F.col("source").alias("other")))
    lowest = {r["node"]: r["edge_id"] for r in touching(ids).groupBy("node").agg(F.min("id").alias("edge_id")).collect()} if ids else {}
    answer = [(r["id"], r["depth"], lowest[r["id"]], False) for r in first]
    if len(answer) < limit:  # then everything within reach is in ``ids``
        loose = touching([node, *ids]).where(~F.col("other").isin([node, *ids]))
        loose = loose.join(plain(nodes).select(F.col("id").alias("other")), "other", "left_anti") if gather(loose.select("other"), 20_000) is None else _unknown(nodes, loose)
        order = F.struct(F.col("node") != node, "node", "id")
        more = loose.groupBy("other").agg(F.min(order).alias("o")).orderBy("o").limit(limit - len(answer)).collect()
        answer += [(r["other"], None, r["o"]["id"], True) for r in more]
    return spark.createDataFrame(answer, "id string, depth bigint, edge_id string, dangling boolean")


def _unknown(nodes: Nodes, loose: DataFrame) -> DataFrame:
    """The few rows of ``loose`` whose other end is no node."""
    others = {r["other"] for r in loose.select("other").distinct().collect()}
    known = [r["id"] for r in nodes_at(nodes, others).select("id").collect()] if others else []
    return loose.where(~F.col("other").isin(known)) if known else loose


def summarize_module(nodes: DataFrame, edges: DataFrame, path: str, module_prefix: str = "nix:", option_prefix: str = "nix_option:", limit: int = KEY_SYMBOLS) -> DataFrame:
    """One row: counts of incoming and outgoing edges, dangling ends, and the first key symbols of the module at ``path``."""
    mine = nodes.where(F.col("path") == path).select(F.col("id").alias("source"))
    out = edges.join(mine, "source", "left_semi")
    into = edges.where(F.col("target") == module_prefix + path)
    known = nodes.select("id")
    loose = out.select(F.col("target").alias("id")).union(into.select(F.col("source").alias("id"))).distinct().join(known, "id", "left_anti")
    kept = ((F.col("type") == "declares") & F.col("target").startswith(option_prefix)) | F.col("type").isin("uses_package", "configures") | F.col("target").startswith("nix_function:")
    symbol = F.when(F.col("target").startswith(option_prefix), F.substr("target", F.lit(len(option_prefix) + 1))).otherwise(F.col("target"))
    symbols = out.where(kept).select(symbol.alias("s")).distinct().orderBy("s").limit(limit).agg(F.array_sort(F.collect_list("s")).alias("key_symbols"))
    return (
        symbols.crossJoin(out.agg(F.count("*").alias("outgoing")))
        .crossJoin(into.agg(F.count("*").alias("incoming")))
        .crossJoin(loose.agg(F.count("*").alias("dangling")))
        .select(F.lit(path).alias("path"), "incoming", "outgoing", "dangling", "key_symbols")
    )  # four one-row frames


def module_edges(nodes: Nodes, edges: Edges, path: str, module_prefix: str = "nix:") -> DataFrame:
    """direction, id, source, target, type, dangling of the edges that leave the nodes of the file at ``path`` and of those that enter its module.

    An outgoing edge dangles if its target is no node, an incoming one if its source isn't.
    """
    columns = ["id", "source", "target", "type"]
    mine = nodes.where(F.col("path") == path).select(F.col("id").alias("source"))
    few = gather(mine.distinct(), 1_000)
    out = plain(edges).join(mine, "source", "left_semi") if few is None else edges_at(edges, [r["source"] for r in few])
    both = out.select(F.lit("out").alias("direction"), *columns).union(edges_at(edges, [module_prefix + path], reverse=True).select(F.lit("in"), *columns))
    other = F.when(F.col("direction") == "out", F.col("target")).otherwise(F.col("source"))
    both, rows = written(both.withColumn("other", other))
    known = nodes_among(nodes, both.select(F.col("other").alias("id")), rows).select(F.col("id").alias("other"), F.lit(False).alias("loose"))
    return both.join(side(known, rows), "other", "left").select("direction", *columns, F.col("loose").isNull().alias("dangling"))


def option_value(values: DataFrame, option: str) -> DataFrame:
    """At most one row: value, value_status of the option's stored value, the last computed; an error's first line goes with the status."""
    mine = values.where(F.col("expr") == f"config.{option}")
    detail = F.substring(F.trim(F.split(F.trim("error"), "\n").getItem(0)), 1, 300)
    status = F.when(F.coalesce(detail, F.lit("")) != "", F.concat_ws(": ", "status", detail)).otherwise(F.col("status"))
    return mine.orderBy(F.desc("computed_at"), "key").limit(1).select(F.col("value_json").alias("value"), status.alias("value_status"))


def introspect_option(nodes: DataFrame, edges: DataFrame, option: str) -> DataFrame:
    """One row: where an option is declared (last by edge id), set, and conditionally set. An unknown option isn't an error."""
    target = f"nix_option:{option}"
    path = F.coalesce(F.col("path"), F.regexp_replace("source", "^nix:", ""))
    at = edges.where(F.col("target") == target).join(nodes.select(F.col("id").alias("source"), "path"), "source", "left").withColumn("at", path)
    conditional = F.coalesce(F.get_json_object("metadata", "$.conditional") == "true", F.lit(False))
    sets = F.col("type") == "sets"
    facts = at.agg(
        F.max_by(F.when(F.col("type") == "declares", F.col("at")), F.when(F.col("type") == "declares", F.col("id"))).alias("declared_in"),
        F.array_sort(F.collect_set(F.when(sets, F.col("at")))).alias("defined_in"),
        F.array_sort(F.collect_set(F.when(sets & conditional, F.col("at")))).alias("conditional_sets"),
    )
    get = lambda k: F.nullif(F.get_json_object("metadata", f"$.{k}"), F.lit("")).alias(k)
    meta = nodes.where(F.col("id") == target).select(get("opt_type"), get("default"), get("example"), get("description"))
    return facts.join(F.broadcast(meta.limit(1)), F.lit(True), "left").select(F.lit(option).alias("option"), "*")


def risk(total: Column) -> Column:
    return F.when(total < 5, "low").when(total < 15, "medium").otherwise("high")


def impact_members(nodes: Nodes, edges: Edges, node: str, max_depth: int, module_types: list[str], option_types: list[str], file_types: list[str]) -> DataFrame:
    """kind (module, option, file), name of everything that changing ``node`` affects, each once: paths of modules, names of options and files.

    Files are also those that an affected node configures or generates.
    """
    reached, inside = blast_radius(nodes, edges, node, max_depth)
    typed = reached.join(plain(nodes).select("id", "type", "name"), "id")
    kind = F.when(F.col("type").isin(module_types), "module").when(F.col("type").isin(option_types), "option").when(F.col("type").isin(file_types), "file")
    path = F.split(F.regexp_replace("id", "^nix:", ""), "::").getItem(0)
    name = F.when(kind == "module", path).when(kind == "option", F.regexp_replace("id", "^nix_option:", "")).otherwise(F.col("name"))
    made = inside.where(F.col("type").isin("configures", "generates") & F.col("target").startswith("file:"))
    return typed.select(kind.alias("kind"), name.alias("name")).where("kind is not null").union(made.select(F.lit("file"), F.regexp_replace("target", "^file:", ""))).distinct()


def impact(nodes: Nodes, edges: Edges, node: str, max_depth: int, module_types: list[str], option_types: list[str], file_types: list[str]) -> DataFrame:
    """One row: how many members of each kind changing ``node`` affects, and the risk."""
    members = impact_members(nodes, edges, node, max_depth, module_types, option_types, file_types)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = members.agg(n("module").alias("modules"), n("option").alias("options"), n("file").alias("files"))
    return counts.select(F.lit(node).alias("node"), "modules", "options", "files", risk(F.col("modules") + F.col("options") + F.col("files")).alias("risk"))


def impact_evidence(nodes: Nodes, edges: Edges, node: str, max_depth: int, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """The dependents that the blast radius confirms, with the chain that leads to each; the first ``limit`` by depth and id."""
    reached = blast_radius(nodes, edges, node, max_depth)[0]
    found = closure(nodes, edges, node, max_depth, reverse=True).join(reached.select("id"), "id", "left_semi")
    return found.orderBy("depth", "id").limit(limit).select("id", "depth", F.array_join("trail", ">").alias("trail"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without a source or target node, and which end lacks it; an end that is null lacks it."""
    lost, n = ends_without_node(nodes, edges)

    def without(end: str) -> DataFrame:
        known = edges.join(side(lost.withColumnRenamed("id", end), n), end, "left_semi").select("id")
        return known.union(edges.where(F.col(end).isNull()).select("id")).select("id", F.lit(end).alias("missing"))

    return without("target").union(without("source"))


def top_ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def snippet(text: Column, line: Column, context: int = 2, limit: int = 240) -> Column:
    """The lines around ``line`` (from 1) of a text, at most ``limit`` characters; null where the line is unknown or past the end."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")
    first = F.greatest(line - context, F.lit(1))
    part = F.slice(lines, first, F.least(line + context, F.size(lines)) - first + 1)
    return F.when((text != "") & (line >= 1) & (line <= F.size(lines)), F.substring(F.array_join(part, "\n"), 1, limit))


def with_snippets(found: DataFrame, nodes: DataFrame, texts: DataFrame, node: str = "id") -> DataFrame:
    """``found`` and a column snippet: the source (texts: path, text) around the line of the node that column ``node`` names."""
    at = nodes.select(F.col("id").alias(node), "path", F.col("line").alias("_line")).where("path is not null and _line is not null")
    near = at.join(found.select(node).distinct(), node, "left_semi").join(texts.select("path", "text"), "path")
    return found.join(near.select(node, snippet(F.col("text"), F.col("_line")).alias("snippet")).dropDuplicates([node]), node, "left").select(*found.columns, "snippet")
