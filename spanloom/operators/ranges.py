"""Row selection, metadata and arithmetic on ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CORE, meta_columns, natural_order, ranges


def make_ranges(spark: SparkSession, rows: list[tuple], meta: str = "") -> DataFrame:
    """Ranges from (seqname, from, to, strand, *meta) tuples; row_id is the position."""
    schema = "row_id long, seqname string, `from` long, `to` long, strand string" + (f", {meta}" if meta else "")
    return ranges(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), check=True)


def intersection_of(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> tuple[Column, Column]:
    """The common part of two ranges; empty at the larger start if they are disjoint."""
    low = F.greatest(a_from, b_from)
    return low, F.greatest(low, F.least(a_to, b_to))


def add_meta(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a metadata column; a replaced one moves to the end."""
    return df.withColumn("_new", value).drop(name).withColumnRenamed("_new", name)


def delete_meta(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename_meta(df: DataFrame, old: str, new: str) -> DataFrame:
    return df if old == new else df.drop(new).withColumnRenamed(old, new)


def get_meta(df: DataFrame, name: str, regex: bool = False) -> DataFrame:
    """row_id and the column of that exact name (regex: all columns that match it whole)."""
    return df.select("row_id", df.colRegex(f"`^(?:{name})$`")) if regex else df.select("row_id", F.col(f"`{name}`"))


def subset(df: DataFrame, indices: list[int]) -> DataFrame:
    """The rows of the given ids in the given order, repeats allowed; pos is the new position."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "pos long, row_id long")
    return df.join(wanted, "row_id").orderBy("pos")


def remove(df: DataFrame, indices: list[int]) -> DataFrame:
    gone = df.sparkSession.createDataFrame([(i,) for i in set(indices)], "row_id long")
    return df.join(gone, "row_id", "left_anti")


def slice_rows(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows from position start up to stop; row_id is the position, as readers and constructors number it."""
    return df.where((F.col("row_id") >= max(0, start)) & (F.col("row_id") < stop))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, then of b; metadata of both, null where a side has none; row ids of b go on after a's."""
    shift = a.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("_n"))
    moved = b.crossJoin(F.broadcast(shift)).withColumn("row_id", F.col("row_id") + F.col("_n")).drop("_n")  # one row
    return a.unionByName(moved, allowMissingColumns=True)


def sort(df: DataFrame, by: str | None = None, reverse: bool = False) -> DataFrame:
    """Natural chromosome order, from, to - or a scalar metadata column; ties by row_id."""
    if by is not None:
        kind = dict(df.dtypes).get(by)
        if kind is None or kind.startswith(("array", "struct")):
            raise ValueError(f"no scalar column {by}")
        keys = [F.col(f"`{by}`")]
    else:
        keys = [*natural_order(), F.col("from"), F.col("to")]
    return df.orderBy(*[k.desc() if reverse else k.asc() for k in keys], "row_id")


def filter_genome(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows on known sequences that end within them. A genome is a small table; Spark broadcasts it by its size."""
    return df.join(genome.select("seqname", "length"), "seqname").where(F.col("to") <= F.col("length")).drop("length").select(df.columns)


def filter_strand(df: DataFrame, strand: str) -> DataFrame:
    return df.where(F.col("strand") == strand)


def set_lengths(df: DataFrame, n: int) -> DataFrame:
    """Resize from the 5' end by strand; * stays as it is."""
    n = max(0, n)
    start = F.when(F.col("strand") == "-", F.col("to") - n).otherwise(F.col("from"))
    stop = F.when(F.col("strand") == "+", F.col("from") + n).otherwise(F.col("to"))
    return df.withColumns({"from": start, "to": stop})


def resize_centre(df: DataFrame, size: int) -> DataFrame:
    centre = F.expr("(`from` + `to`) div 2")
    return df.withColumns({"from": centre - size // 2, "to": centre + size // 2})


def max_size(df: DataFrame, size: int) -> DataFrame:
    return df.where(F.col("to") - F.col("from") <= size)


def name_in(df: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    return df.where(F.col(column).isin(*names))


def merge_rows(df: DataFrame, target: Column) -> DataFrame:
    """Group rows by a target index: scalar metadata become lists in row order."""
    meta = meta_columns(df)
    if any(t.startswith(("array", "struct")) for c, t in df.dtypes if c in meta):
        raise ValueError("list and range columns cannot be merged")
    listed = [F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(f"`{c}`").alias("x")))), lambda v: v["x"]).alias(c) for c in meta]
    return df.groupBy(target.alias("idx")).agg(*(listed or [F.count("*").alias("n")]))


def reduce_list(df: DataFrame, column: str, name: str, f: Callable[[Column], Column]) -> DataFrame:
    """A scalar column from a list column by a Column function, such as F.array_max."""
    return add_meta(df, name, f(F.col(f"`{column}`")))


def by_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with a row_id that rises along an order (with gaps, as a sorted table's partitions count on their own)."""
    plain = df.drop("row_id") if "row_id" in df.columns else df
    return plain.orderBy(*order).withColumn("row_id", F.monotonically_increasing_id())


def permute(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")


def random_ranges(genome: DataFrame, n: int, width: int, strand: bool = False, seed: int = 0) -> DataFrame:
    """n ranges of a width, sequences weighted by length, all inside their sequence."""
    w = Window.orderBy("seqname")
    fits = genome.where(F.col("length") >= width)
    weights = fits.withColumn("hi", F.sum("length").over(w)).withColumn("lo", F.col("hi") - F.col("length"))
    total = fits.agg(F.sum("length")).first()[0]
    if not total:
        raise ValueError("no sequence is long enough")
    draws = genome.sparkSession.range(n).select(F.col("id").alias("row_id"), (F.rand(seed) * total).cast("long").alias("_p"), F.rand(seed + 1).alias("_u"), F.rand(seed + 2).alias("_s"))
    placed = draws.join(weights, (F.col("_p") >= F.col("lo")) & (F.col("_p") < F.col("hi")))  # a genome's rows
    start = F.floor(F.col("_u") * (F.col("length") - width + 1)).cast("long")
    side = F.when(F.col("_s") < 0.5, "+").otherwise("-") if strand else F.lit("*")
    return placed.select("row_id", "seqname", start.alias("from"), (start + width).alias("to"), side.alias("strand"))


def draw_ranges(genome: DataFrame, n: int, width: int, exclude: DataFrame | None = None, seed: int = 0, rounds: int = 20) -> DataFrame:
    """n random ranges off an exclude set, by rejection."""
    from .joins import anti

    if exclude is None:
        return random_ranges(genome, n, width, seed=seed)
    more = n
    for i in range(rounds):
        drawn = anti(random_ranges(genome, more, width, seed=seed + i), exclude)
        if drawn.count() >= n:
            return drawn.orderBy("row_id").limit(n)
        more *= 2
    raise ValueError("the exclude set leaves too little room")


def head_tail(df: DataFrame, n: int = 10) -> DataFrame:
    """The first and last n/2 rows by row_id, as a printer shows them."""
    ends = df.orderBy("row_id").limit(n // 2).unionByName(df.orderBy(F.desc("row_id")).limit(n - n // 2))
    return ends.dropDuplicates(["row_id"]).orderBy("row_id")


def genome_lookup(genome: DataFrame, name: str) -> int | None:
    row = genome.where(F.col("seqname") == name).select("length").first()
    return None if row is None else row[0]


def genome_total(genome: DataFrame) -> DataFrame:
    return genome.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"))


def add_sequence(genome: DataFrame, name: str, length: int) -> DataFrame:
    if genome_lookup(genome, name) is not None:
        raise ValueError(f"sequence {name} is already there")
    row = genome.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).cast("int").alias("idx")).select("idx", F.lit(name).alias("seqname"), F.lit(length).cast("long").alias("length"))
    return genome.unionByName(row)


def genomes_equal(a: DataFrame, b: DataFrame) -> bool:
    x, y = (g.select("seqname", "length") for g in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def core(df: DataFrame) -> DataFrame:
    return df.select(*CORE)
