"""Column names and checks shared by all operators.

Ranges are rows of (row_id, seqname, from, to, strand, metadata...): 0-based,
half-open, strand one of + - *. Tracks are rows of (seqname, bin, value) with NaN
for missing. A genome is (idx, seqname, length). Sequences are (seqname, sequence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ["row_id", "seqname", "from", "to", "strand"]
NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def ranges(df: DataFrame, check: bool = False) -> DataFrame:
    """df with the core columns in order: strand defaults to *, row_id to a number by position."""
    for c in ("seqname", "from", "to"):
        if c not in df.columns:
            raise ValueError(f"ranges need a column {c}")
    if "strand" not in df.columns:
        df = df.withColumn("strand", F.lit("*"))
    if "row_id" not in df.columns:
        df = with_row_id(df)
    if check:
        sound = (F.col("from") <= F.col("to")) & F.col("strand").isin("+", "-", "*")
        df = df.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("a range needs from <= to and a strand of + - *")).cast("boolean")))
    meta = [c for c in df.columns if c not in CORE]
    return df.select(F.col("row_id").cast("long").alias("row_id"), F.col("seqname").cast("string").alias("seqname"), F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.col("strand").cast("string").alias("strand"), *[F.col(f"`{c}`") for c in meta])


def with_row_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Number rows: from 0 by the given order, or by unique rising numbers as they come."""
    if order:
        return df.withColumn("row_id", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return df.withColumn("row_id", F.monotonically_increasing_id())


def numbered(scan: DataFrame, lines: bool = False) -> DataFrame:
    """Rows of a file scan (and row-wise steps on it) with row_id, their position from 0 over the files in the order of their paths.

    A scan deals the pieces of its files to partitions by size, so the order of the
    partitions says nothing: pieces are known by file and offset. Rows count up within
    a piece; what lies before it comes from the pieces' sizes, a row each. Both reads of
    a scan have the same pieces; after a shuffle that would not hold, so this is for
    scans only. lines: also ``file``, ``file_no`` and ``n``, the number of the file and
    the row's position in it, from 0.
    """
    piece = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    marked = scan.select("*", *piece, F.monotonically_increasing_id().alias("_at"))
    sizes = marked.groupBy("file", "_start").agg(F.count("*").alias("_size"), F.min("_at").alias("_low"))
    earlier = Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = {"_first": F.sum("_size").over(earlier), "_above": F.sum("_size").over(own), "file_no": F.dense_rank().over(Window.orderBy("file")) - 1}
    starts = sizes.select("file", "_start", "_low", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in before.items()])
    placed = marked.join(F.broadcast(starts), ["file", "_start"])
    within = F.col("_at") - F.col("_low")
    named = placed.withColumns({"row_id": F.col("_first") + within, "n": F.col("_above") + within})
    return named.select(*scan.columns, "row_id", *(["file", "file_no", "n"] if lines else []))


def running(df: DataFrame, at: str, order: list[Column], value: str, name: str, bits: int = 16, largest: bool = False, before: bool = False) -> DataFrame:
    """df with ``name``: the running sum (largest: maximum) of a column along each sequence, by ``order``.

    ``at`` is the coordinate that ``order`` begins with. It is cut into chunks of
    2^bits: totals by chunk are combined before the shuffle and run over the chunks of
    a sequence, a small table; rows run within their chunk and add what lies before
    it. So no task takes a whole sequence. before: without the row itself (null, or 0,
    where nothing is before).
    """
    combine = F.max if largest else F.sum
    cell = df.withColumn("_cell", F.shiftright(F.col(at).cast("long"), bits))
    totals = cell.groupBy("seqname", "_cell").agg(combine(value).alias("_total"))
    earlier = Window.partitionBy("seqname").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("seqname", "_cell", combine("_total").over(earlier).alias("_offset"))
    within = Window.partitionBy("seqname", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = combine(value).over(within)
    both = F.greatest("_offset", own) if largest else F.coalesce("_offset", F.lit(0)) + F.coalesce(own, F.lit(0))
    return cell.join(offsets, ["seqname", "_cell"]).withColumn(name, both).drop("_cell", "_offset")


def running_all(df: DataFrame, at: str, order: list[Column], values: list[str], bits: int = 16, largest: bool = False) -> DataFrame:
    """df with its value columns replaced by their running sums (largest: maxima), as ``running`` makes one."""
    combine = F.max if largest else F.sum
    cell = df.withColumn("_cell", F.shiftright(F.col(at).cast("long"), bits))
    totals = cell.groupBy("seqname", "_cell").agg(*[combine(v).alias(v) for v in values])
    earlier = Window.partitionBy("seqname").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("seqname", "_cell", *[combine(v).over(earlier).alias(f"_o_{v}") for v in values])
    within = Window.partitionBy("seqname", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = {v: combine(v).over(within) for v in values}
    if largest:
        both = {v: F.greatest(f"_o_{v}", c) for v, c in own.items()}
    else:
        both = {v: F.coalesce(f"_o_{v}", F.lit(0)) + F.coalesce(c, F.lit(0)) for v, c in own.items()}
    joined = cell.join(offsets, ["seqname", "_cell"])
    return joined.withColumns(both).drop("_cell", *[f"_o_{v}" for v in values])


def meta_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CORE]


def natural_order() -> list[Column]:
    """chr2 before chr10: by the name's length, then the name."""
    return [F.length("seqname"), F.col("seqname")]
