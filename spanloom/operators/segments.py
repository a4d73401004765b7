"""Statistics of bigWig data by region, and differential segmentations scored with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bigwig
from .intervals import labels, merge
from .joins import overlap_join
from .stats import bin_statistic


def region_values(spark: SparkSession, regions: DataFrame, path: str, statistic: str = "mean") -> DataFrame:
    """row_id, value: the statistic of a file's records over each region, weighted by bases; regions without data lack a row."""
    rows = bigwig.read_bigwig(spark, path).where(~F.isnan("value"))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    hits = overlap_join(regions, rows.drop("value"))
    bases = F.least("q_to", "s_to") - F.greatest("q_from", "s_from")
    # the record's value travels by its place: (sequence, from, to) is a record's own
    met = hits.join(rows.select("seqname", F.col("from").alias("s_from"), F.col("to").alias("s_to"), "value"), ["seqname", "s_from", "s_to"])
    v, w = F.col("value"), bases.cast("double")
    moments = met.groupBy(F.col("q_id").alias("row_id")).agg(F.sum(w).alias("n"), F.sum(v * w).alias("sum"), F.sum(v * v * w).alias("sum_sq"), F.min(v).alias("min"), F.max(v).alias("max"))
    return moments.select("row_id", bin_statistic(statistic).alias("value"))


def filter_by_file(spark: SparkSession, regions: DataFrame, path: str, low: float | None = None, high: float | None = None, statistic: str = "mean") -> DataFrame:
    """Regions whose value is neither below low nor above high; those without data stay."""
    out = F.lit(False)
    if low is not None:
        out = out | (F.col("value") < low)
    if high is not None:
        out = out | (F.col("value") > high)
    gone = region_values(spark, regions, path, statistic).where(out)
    return regions.join(gone, "row_id", "left_anti")


def differential_regions(sets: list[DataFrame], states: list[str]) -> DataFrame:
    """The merged regions of some states over several segmentations, with name and the sets they occur in."""
    own = [s.where(F.col("name").isin(*states)) for s in sets]
    merged = merge(*own).withColumn("row_id", F.xxhash64("seqname", "from", "to"))
    return labels(merged, *own).withColumn("name", F.lit(",".join(states)))


def score_by_files(spark: SparkSession, labelled: DataFrame, paths: list[str]) -> DataFrame:
    """labelled with ``score``: ln((p + 1) / n) - ln((q + 1) / (N - n)); -inf where a region is in all sets.

    p sums the largest values of the files whose sets the region is in (n of them), q those of the others.
    """
    each = [region_values(spark, labelled, p, "max").withColumn("set", F.lit(i)) for i, p in enumerate(paths)]
    tops = reduce(DataFrame.unionByName, each)
    both = labelled.select("row_id", "labels").join(tops, "row_id")
    own = F.array_contains("labels", F.col("set"))
    sums = both.groupBy("row_id").agg(F.sum(F.when(own, F.col("value")).otherwise(0.0)).alias("p"), F.sum(F.when(own, 0.0).otherwise(F.col("value"))).alias("q"))
    n, every = F.size("labels"), len(paths)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.log((zero(F.col("p")) + 1) / n) - F.log((zero(F.col("q")) + 1) / (F.lit(every) - n))
    scored = F.when(n == every, F.lit(float("-inf"))).otherwise(score)
    return labelled.join(sums, "row_id", "left").withColumn("score", scored).drop("p", "q")
