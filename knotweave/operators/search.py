"""Symbol search: token phrases per column (full text) and LIKE filters, both paged in a fixed order.

Full text reads either the columns themselves or their postings: a row for each token,
column and node with the token's places, which a store keeps by token. A phrase is then a
join of its tokens' rows on node and column in which places follow one another, and only
the rows of the asked tokens are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters of Latin scripts and the letters that full-text search takes them for.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeeggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

#: Parts of a token's postings in a store.
SPREAD = 32
#: Found ids up to which the nodes are asked for them by value.
_FEW = 1_000


def normalised(column: Column) -> Column:
    """`` t1 t2 `` of a column: letters and digits only, folded, between single spaces."""
    folded = F.regexp_replace(F.translate(F.lower(F.coalesce(column, F.lit(""))), ACCENTED, PLAIN), r"\p{M}+", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def query_phrases(query: str) -> list[str]:
    """Blank-separated parts of a query, each a phrase of adjacent tokens; '' for one without letters or digits."""
    import re
    import unicodedata

    table = str.maketrans(ACCENTED, PLAIN)

    def fold(x: str) -> str:
        """As :func:`normalised` does it: listed letters are translated, combining marks dropped."""
        plain = "".join(c for c in x.lower().translate(table) if not unicodedata.category(c).startswith("M"))
        return " ".join(re.findall(r"[^\W_]+", plain))

    return [fold(x) for x in query.split()]


TEXT_COLUMNS = ("id", "name", "type", "lang")


def postings(nodes: DataFrame, columns: tuple[str, ...] | list[str] = TEXT_COLUMNS) -> DataFrame:
    """token, column, id, places (sorted) of every token of the text columns of ``nodes``."""
    texts = [F.struct(F.lit(c).alias("column"), normalised(F.col(c)).alias("text")) for c in columns if c in nodes.columns]
    each = nodes.select("id", F.explode(F.array(*texts)).alias("t")).where(F.trim("t.text") != "")
    tokens = each.select("id", "t.column", F.posexplode(F.split(F.trim("t.text"), " ")).alias("place", "token"))
    return tokens.groupBy("token", "column", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))


def with_slots(posted: DataFrame) -> DataFrame:
    """Postings with the key by which a store keeps them: a token's rows are spread by id, so that a change of one node doesn't rewrite all of a frequent token."""
    return posted.withColumn("slot", F.concat_ws("#", "token", (F.crc32("id") % SPREAD).cast("string")))


def _phrase_ids(found: DataFrame, phrase: str) -> DataFrame:
    """id of the nodes with the phrase in one of their columns; ``found``: the postings of all tokens asked for."""
    ends = None
    for token in phrase.split(" "):
        rows = found.where(F.col("token") == token).select("id", "column", "places")
        if ends is None:
            ends = rows.withColumnRenamed("places", "ends")
        else:
            after = F.array_intersect(F.transform("ends", lambda i: i + 1), "places")
            ends = ends.join(rows, ["id", "column"]).select("id", "column", after.alias("ends")).where(F.size("ends") > 0)
    return ends.select("id").distinct()


def posted_ids(posted: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """id of the nodes that :func:`full_text` finds, by postings: a frame, or a store's copy by token."""
    phrases = query_phrases(query)
    named = sorted({t for p in phrases for t in p.split(" ") if t})
    at = posted.at(f"{t}#{i}" for t in named for i in range(SPREAD)) if hasattr(posted, "at") else posted.where(F.col("token").isin(named))
    found = at if columns is None else at.where(F.col("column").isin(columns))
    none = found.select("id").limit(0)
    hits = [_phrase_ids(found, p) if p else none for p in phrases]
    if not hits:
        return none
    every = reduce(lambda a, b: a.join(b, "id", "left_semi"), hits)
    if len(hits) == 1 or not every.isEmpty():
        return every
    return reduce(DataFrame.union, hits).distinct()


def full_text(nodes: DataFrame, query: str, columns: list[str] | None = None, posted: DataFrame | None = None) -> DataFrame:
    """Rows all of whose query parts stand as a phrase in some column; if none, rows with any part (two parts or more). ``posted``: the nodes' postings."""
    if posted is not None:
        ids = posted_ids(posted, query, columns)
        few = ids.limit(_FEW + 1).collect()
        if len(few) <= _FEW and hasattr(nodes, "at"):
            return nodes.at(r["id"] for r in few)
        return nodes.select("*").join(ids, "id", "left_semi")
    columns = columns or [c for c in TEXT_COLUMNS if c in nodes.columns]
    phrases = query_phrases(query)
    if not phrases:
        return nodes.where(F.lit(False))

    def hit(phrase: str) -> Column:
        if not phrase:
            return F.lit(False)
        return reduce(Column.__or__, (F.contains(normalised(F.col(c)), F.lit(f" {phrase} ")) for c in columns))

    every = nodes.where(reduce(Column.__and__, map(hit, phrases)))
    if len(phrases) == 1:
        return every
    # the fallback is decided by a one-row look, so that each case is one plain scan
    return every if not every.isEmpty() else nodes.where(reduce(Column.__or__, map(hit, phrases)))


def _like(column: str, pattern: str) -> Column:
    """LIKE that folds ASCII letters only and knows no escape character."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.coalesce(F.translate(F.col(column), upper, lower).like(folded), F.lit(False))


def like_search(nodes: DataFrame, query: str, lang: str | None = None, types: list[str] | None = None, path_contains: str | None = None, id_prefix: str | None = None) -> DataFrame:
    out = nodes.where(_like("id", f"%{query}%") | _like("name", f"%{query}%"))
    if lang is not None:
        out = out.where(F.col("lang") == lang)
    if types:
        out = out.where(F.col("type").isin(types))
    if path_contains is not None:
        out = out.where(_like("path", f"%{path_contains}%"))
    if id_prefix is not None:
        out = out.where(_like("id", f"{id_prefix}%"))
    return out


def find_symbol(nodes: DataFrame, query: str, lang: str | None = None, node_type: str | list[str] | None = None, path_contains: str | None = None, id_prefix: str | None = None, fuzzy: bool = False, limit: int = 10, offset: int = 0, posted: DataFrame | None = None) -> DataFrame:
    """Any structural filter (or ``fuzzy``) takes LIKE ordered by name, else full text ordered by id."""
    types = [node_type] if isinstance(node_type, str) else node_type
    if fuzzy or lang or types or path_contains or id_prefix:
        return like_search(nodes, query, lang, types, path_contains, id_prefix).orderBy("name", "id").offset(offset).limit(limit)
    if posted is None:
        return full_text(nodes, query).orderBy("id").offset(offset).limit(limit)
    page = posted_ids(posted, query).orderBy("id").offset(offset).limit(limit)  # a page of ids first, then their rows
    ids = [r["id"] for r in page.collect()]
    rows = nodes.at(ids) if hasattr(nodes, "at") else nodes.where(F.col("id").isin(ids))
    return rows.orderBy("id")
