"""Shards cut from a Hilbert curve through several metadata dimensions; DataFrame functions only.

Each dimension is quantised to 2^bits steps that hold about equally many rows: values
are first laid on a grid of at most 65,537 cells that keeps their order (strings by the two
bytes after what all of them begin with, numbers on a logarithmic or an even scale), the
cells are counted over all rows, and a cell's step follows from the rows before it. The
steps are the axes of a Hilbert curve (Skilling's transform). Rows are ordered by
curve index, then by the text's checksum and doc_id, and the order is cut into runs: a
shard covers a compact region of all dimensions, so that the minima and maxima of a
file rule it out for most filters on any of them, and equal texts of a cell lie side
by side.

Law ``rows``: sizes of shards differ by one row at most. Law ``bytes``: a row goes where the
middle of its bytes falls, so that a shard's bytes miss the mean by one row at most.

Only ids, sizes, checksums and steps are sorted, never the texts; the order is counted by
range partitions, which a group of copies cannot fill as doc_id is part of it.

Cases: a null text counts as empty, a null in a dimension comes before all values; null
and repeated doc_ids are rows like others; rows that agree in doc_id, text and steps may
change places, which no column shows; fewer rows than shards leave shards empty; an
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.llm.ranking import numbered
from knotweave.llm.text import checkpointed

#: Metadata columns and their scales. ``size`` is the row's own size in bytes.
DIMENSIONS = {"lang": "text", "source": "text", "size": "log"}
#: Cells of an even grid, and cells to a doubling on a logarithmic one.
EVEN_CELLS, CELLS_A_DOUBLING = 1 << 12, 1 << 8


def curve_index(rows: DataFrame, axes: list[str], bits: int, name: str = "curve") -> DataFrame:
    """``rows`` with the Hilbert index (long) of the point whose coordinates (0 to 2^bits - 1) are in ``axes``; bits times axes must not exceed 62."""
    x = [f"_x{i}" for i in range(len(axes))]
    col = F.col
    out = rows.withColumns({v: col(a).cast("long") for v, a in zip(x, axes, strict=True)})
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = F.lit(q - 1)
        for v in x:
            on = col(v).bitwiseAND(F.lit(q)) != 0
            turned = col(x[0]).bitwiseXOR(col(v)).bitwiseAND(low)  # what the two axes exchange
            first = F.when(on, col(x[0]).bitwiseXOR(low)).otherwise(col(x[0]).bitwiseXOR(turned))
            out = out.withColumns({x[0]: first} if v == x[0] else {x[0]: first, v: F.when(on, col(v)).otherwise(col(v).bitwiseXOR(turned))})
    for a, b in zip(x, x[1:], strict=False):  # Gray code
        out = out.withColumn(b, col(b).bitwiseXOR(col(a)))
    last = F.lit(0).cast("long")
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        last = last.bitwiseXOR(F.when(col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    out = out.withColumn("_turn", last)
    index = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for v in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(col(v).bitwiseXOR(col("_turn")), k).bitwiseAND(F.lit(1)))
    return out.withColumn(name, index).drop(*x, "_turn")


def _cell(column: Column, scale: str, least, most) -> Column:
    """The grid cell (long from 1; 0 for null) of a value between ``least`` and ``most``; it grows with the value."""
    if least is None:
        return F.lit(0).cast("long")
    if scale == "text":
        common = len(os.path.commonprefix([least.encode(), most.encode()]))
        two = F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), common + 1, 2)), 4, "0")
        cell = F.conv(two, 16, 10).cast("long")
    elif scale == "log":
        # the number of bits and the nine first of them, in whole numbers so that all machines agree
        v = column.cast("long") - F.lit(int(least)) + 1
        bits = F.length(F.bin(v))
        nine = F.when(bits > 9, F.call_function("shiftright", v, bits - 9)).otherwise(F.call_function("shiftleft", v, 9 - bits))
        cell = (bits - 1) * CELLS_A_DOUBLING + nine - CELLS_A_DOUBLING
    elif scale == "even":
        cell = F.floor((column.cast("double") - F.lit(float(least))) * ((EVEN_CELLS - 1) / max(float(most) - float(least), 1e-300)))
    else:
        raise ValueError(f"unknown scale {scale}")
    return F.coalesce(cell + 1, F.lit(0)).cast("long")


def quantised(rows: DataFrame, dimensions: dict[str, str], bits: int) -> DataFrame:
    """``rows`` (written to the shared folder) with _step0, _step1, ... of the dimensions."""
    ends = rows.agg(*(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(dimensions) for f in (F.min, F.max)), F.count("*").alias("n")).first()
    cells = {f"_cell{i}": _cell(F.col(c), scale, ends[f"min{i}"], ends[f"max{i}"]) for i, (c, scale) in enumerate(dimensions.items())}
    out = rows.withColumns(cells)
    each = out.select(F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(c).alias("cell")) for i, c in enumerate(cells)))).alias("e")).groupBy("e.axis", "e.cell").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("axis").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most a grid's cells for each axis, whatever the input
    steps = checkpointed(each.select("axis", "cell", F.floor(before * F.lit(1 << bits) / F.lit(max(ends["n"], 1))).alias("step")))
    for i, c in enumerate(cells):
        out = out.join(F.broadcast(steps.where(F.col("axis") == i).select(F.col("cell").alias(c), F.col("step").alias(f"_step{i}"))), c)
    return out.drop(*cells)


def _placed(docs: DataFrame, shards: int, dimensions: dict[str, str], bits: int, law: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [c for c in dimensions if c != "size"]
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(F.col(c).alias(c) for c in own)
    )
    meta = checkpointed(meta)  # the texts are read once
    steps = [f"_step{i}" for i in range(len(dimensions))]
    curve = curve_index(quantised(meta, dimensions, bits), steps, bits)
    order = [F.col(c).asc() for c in ("curve", "text_crc32", "doc_id")]
    if law == "rows":
        placed = numbered(curve, order)
        n = placed.count()
        shard = F.floor(F.expr(f"(place * {shards}) div {max(n, 1)}"))
    elif law == "bytes":
        placed = numbered(curve, order, "size")
        total = meta.agg(F.sum("size")).first()[0] or 1
        shard = F.least(F.floor((F.col("before") + F.col("size") / 2) * shards / total), F.lit(shards - 1))
    else:
        raise ValueError(f"unknown law {law}")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("_first")).drop(*steps)


def shard_documents(docs: DataFrame, shards: int = 24, dimensions: dict[str, str] | None = None, bits: int = 5, law: str = "rows") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard (from 0), slot (from 0 in its shard), grown_shard (null), curve of every row."""
    placed = _placed(docs, shards, dimensions or DIMENSIONS, bits, law)
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, dimensions: dict[str, str] | None = None, bits: int = 5, law: str = "rows", files: int | None = None) -> DataFrame:
    """Write the rows of ``docs``, all columns, below ``folder`` as ``shard=N`` folders in the order of their slots; the frame as read back.

    ``files``: how many runs the whole order is written in (one a shard if not given);
    each is a file, or a file in either of two neighbouring shards.
    """
    dimensions = dimensions or DIMENSIONS
    own = [c for c in dimensions if c != "size"]
    placed = _placed(docs, shards, dimensions, bits, law)
    # a placement belongs to any row of its id, checksum and dimensions: those that agree are counted through
    keys = ["_id", "_crc", *(f"_d{i}" for i in range(len(own))), "_nth"]
    nth = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(F.lit(0)))

    def keyed(rows: DataFrame, crc: Column) -> DataFrame:
        return rows.withColumns({"_id": F.col("doc_id").cast("long"), "_crc": crc} | {f"_d{i}": F.col(c) for i, c in enumerate(own)}).withColumn("_nth", nth)

    where = keyed(placed, F.col("text_crc32")).select(*keys, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = keyed(docs, F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("r")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    joined = rows.join(where.alias("w"), same).select(*(F.col(f"r.{c}") for c in docs.columns), "_shard", "_slot")
    runs = joined.repartitionByRange(files or shards, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    runs.withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
