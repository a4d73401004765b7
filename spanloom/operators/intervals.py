"""Interval sets: union, runs, labels, promoters, differential segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import meta_columns, running, running_all
from .joins import anti


def merge(*sets: DataFrame) -> DataFrame:
    """The union of intervals: overlapping ranges become one, touching ones stay apart; strand and metadata go.

    A range begins an island if nothing before it reaches it. Both the reach and the
    island's start are running maxima, which run by chunks of a sequence.
    """
    rows = reduce(DataFrame.unionByName, [s.select("seqname", "from", "to") for s in sets]).where(F.col("from") < F.col("to"))
    order = [F.col("from"), F.col("to")]
    reach = running(rows, "from", order, "to", "_reach", largest=True, before=True)
    new = F.when(F.col("_reach").isNull() | (F.col("from") >= F.col("_reach")), F.col("from"))
    # of equal ranges the one that begins the island comes first
    order.append(F.col("_new").asc_nulls_last())
    starts = running(reach.withColumn("_new", new), "from", order, "_new", "_start", largest=True)
    out = starts.groupBy("seqname", "_start").agg(F.max("to").alias("to"))
    return out.select("seqname", F.col("_start").alias("from"), "to", F.lit("*").alias("strand"))


def islands(df: DataFrame, keep: Column, value: str | None = None, chunk: int = 65536) -> DataFrame:
    """Rows of the bins that satisfy a condition, with ``run``: the first bin of their run of neighbours (of equal values).

    A bin's predecessor stands in its own chunk, but for a chunk's first bin, whose
    predecessor is copied in; the run's start is a running maximum by chunks.
    """
    rows = df.where(keep).withColumn("_own", F.lit(True))
    edge = rows.where(F.col("bin") % chunk == chunk - 1).withColumn("_own", F.lit(False))
    cells = rows.withColumn("_chunk", F.expr(f"bin div {chunk}")).unionByName(edge.withColumn("_chunk", F.expr(f"bin div {chunk}") + 1))
    w = Window.partitionBy("seqname", "_chunk").orderBy("bin")
    last = F.lag("bin").over(w)
    breaks = last.isNull() | (F.col("bin") != last + 1)
    if value:
        breaks = breaks | (F.col(value) != F.lag(value).over(w)) | F.isnan(value)
    found = cells.withColumn("_new", F.when(breaks, F.col("bin"))).where("_own").drop("_own", "_chunk")
    return running(found, "bin", [F.col("bin")], "_new", "run", largest=True).drop("_new")


def runs_to_ranges(track: DataFrame, bin_size: int) -> DataFrame:
    """Run-length ranges of equal values; every NaN bin is a row of its own."""
    runs = islands(track, F.lit(True), "value")
    out = runs.groupBy("seqname", "run").agg(F.max("bin").alias("b"), F.first("value").alias("value"))
    return out.select("seqname", (F.col("run") * bin_size).alias("from"), ((F.col("b") + 1) * bin_size).alias("to"), F.lit("*").alias("strand"), "value")


def labels(regions: DataFrame, *sets: DataFrame) -> DataFrame:
    """regions with ``labels``: the sorted numbers of the sets that overlap them.

    A region overlaps a set if, of the set's ranges that begin before its end, one
    reaches beyond its start: a running maximum for each set, all in one pass, and no
    pairs. Ranges with one start are combined to the one that reaches farthest before
    they are shuffled.
    """
    reach = [f"_reach{i}" for i in range(len(sets))]
    none = F.lit(None).cast("long")
    starts = []
    for i, s in enumerate(sets):
        own = s.where(F.col("from") < F.col("to")).select("seqname", F.col("from").alias("_at"), *[(F.col("to").cast("long") if j == i else none).alias(r) for j, r in enumerate(reach)])
        starts.append(own)
    points = reduce(DataFrame.unionByName, starts).groupBy("seqname", "_at").agg(*[F.max(r).alias(r) for r in reach])
    asked = regions.where(F.col("from") < F.col("to")).select("row_id", "seqname", (F.col("to") - 1).alias("_at"), F.col("from").alias("_from"))
    both = points.unionByName(asked, allowMissingColumns=True)
    # of one place the starts come first, as they count for a region that ends there
    passed = running_all(both, "_at", [F.col("_at"), F.col("_from").asc_nulls_first()], reach, largest=True).where(F.col("_from").isNotNull())
    hit = [F.coalesce(F.max(F.col(r) > F.col("_from")), F.lit(False)) for r in reach]
    found = passed.groupBy("row_id").agg(F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)])).alias("labels"))
    return regions.join(found, "row_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def label_statistics(labelled: DataFrame) -> DataFrame:
    """Share of regions that are in n of the sets."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return labelled.groupBy(F.size("labels").alias("n")).agg((F.count("*") / total).alias("share"))


def segmentation_difference(sets: list[DataFrame], states: list[str]) -> DataFrame:
    """Merged regions of a state over several segmentations, with the sets they occur in."""
    out = []
    for state in states:
        own = [s.where(F.col("name") == state) for s in sets]
        merged = merge(*own).withColumn("row_id", F.xxhash64("seqname", "from", "to")).withColumn("name", F.lit(state))
        out.append(labels(merged, *own))
    return reduce(DataFrame.unionByName, out)


def differential_score(labelled: DataFrame, positive: list[int], n_sets: int) -> DataFrame:
    """ln((pos+1)/n) - ln((neg+1)/(N-n)), -inf where a region is in all sets."""
    chosen = F.array(*[F.lit(p) for p in positive])
    pos = F.size(F.array_intersect("labels", chosen))
    neg = F.size(F.array_except("labels", chosen))
    score = F.log((pos + 1) / F.lit(float(len(positive)))) - F.log((neg + 1) / F.lit(float(n_sets - len(positive))))
    return labelled.withColumn("score", F.when(F.size("labels") == n_sets, F.lit(float("-inf"))).otherwise(score))


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One row per (seqname, from, to): the first row's strand, metadata as lists in row order."""
    meta = meta_columns(df)
    listed = [F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(f"`{c}`").alias("x")))), lambda v: v["x"]).alias(c) for c in meta]
    return df.groupBy("seqname", "from", "to").agg(F.min("row_id").alias("row_id"), F.min_by("strand", "row_id").alias("strand"), *listed).select("row_id", "seqname", "from", "to", "strand", *meta)


def promoters(genes: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Regions around transcription starts, duplicates merged; genes need a strand of + or -."""
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    bad = F.raise_error(F.lit("a gene needs a strand")).cast("long")
    start = F.when(plus, F.col("from") - upstream).when(minus, F.col("to") - 1 - downstream).otherwise(bad)
    stop = F.when(plus, F.col("from") + downstream + 1).when(minus, F.col("to") - 1 + upstream + 1).otherwise(bad)
    return merge_duplicates(genes.withColumns({"from": start, "to": stop}).drop("cds"))


def merge_by(df: DataFrame, attribute: str) -> DataFrame:
    """One range per attribute value and sequence: hull, and the strand if there is one only; empty values are skipped."""
    one = F.when(F.count_distinct("strand") == 1, F.min("strand")).otherwise("*")
    return df.where(F.col(attribute) != "").groupBy(F.col(attribute).alias("name"), "seqname").agg(F.min("from").alias("from"), F.max("to").alias("to"), one.alias("strand"))


def without(df: DataFrame, exclude: DataFrame) -> DataFrame:
    """Rows that overlap nothing of ``exclude``, for ranges without row ids."""
    keyed = df.withColumn("row_id", F.struct("seqname", "from", "to"))
    return anti(keyed, exclude).drop("row_id")


def joint_peaks(zipped: DataFrame, thresholds: list[float], bin_size: int, exclude: DataFrame | None = None) -> DataFrame:
    """Maximal runs where every track is above its threshold, with the values at the largest sum; largest first.

    zipped has ``values``, one per track, as zip_tracks makes it. Peaks that overlap
    ``exclude`` go.
    """
    n = len(thresholds)
    over = F.size("values") == n
    for i, t in enumerate(thresholds):
        v = F.get("values", F.lit(i))
        over = over & ~F.isnan(v) & (v > t)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    runs = islands(zipped.withColumn("sum", total), over)
    top = F.max_by(F.struct("values", "sum"), F.struct("sum", (-F.col("bin")).alias("b")))
    peaks = runs.groupBy("seqname", "run").agg(F.max("bin").alias("b"), top.alias("t"))
    found = peaks.select("seqname", (F.col("run") * bin_size).alias("from"), ((F.col("b") + 1) * bin_size).alias("to"), F.col("t.values").alias("values"), F.col("t.sum").alias("sum"))
    return (without(found, exclude) if exclude is not None else found).orderBy(F.desc("sum"))


def region_threshold(regions: DataFrame, track: DataFrame, bin_size: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Regions whose mean over the track is neither below low nor above high; those without a mean stay."""
    bins = regions.select("row_id", "seqname", F.explode(F.expr(f"case when `to` div {bin_size} > `from` div {bin_size} then sequence(`from` div {bin_size}, `to` div {bin_size} - 1) else array() end")).alias("bin"))
    means = bins.join(track, ["seqname", "bin"]).groupBy("row_id").agg(F.avg("value").alias("mean"))
    out = F.lit(False)
    if low is not None:
        out = out | (F.col("mean") < low)
    if high is not None:
        out = out | (F.col("mean") > high)
    gone = means.where(~F.isnan("mean") & out)
    return regions.join(gone, "row_id", "left_anti")
