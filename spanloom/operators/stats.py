"""Statistics of tracks: bins, summaries, histograms, quantiles, cross-correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tracks import bins_of


def bin_statistic(name: str, n: str = "n", total: str = "sum", squares: str = "sum_sq", low: str = "min", high: str = "max") -> Column:
    """A bin's statistic from its moments; unknown names give an error."""
    mean = F.col(total) / F.col(n)
    known = {
        "mean": lambda: mean,
        "max": lambda: F.col(high),
        "min": lambda: F.col(low),
        "discrete mean": lambda: F.floor(mean + 0.5).cast("double"),
        "discrete max": lambda: F.floor(high).cast("double"),
        "discrete min": lambda: F.floor(low).cast("double"),
        "variance": lambda: F.col(squares) / F.col(n) - mean * mean,
    }
    if name not in known:
        raise ValueError(f"no statistic {name}")
    return known[name]()


def rebin(track: DataFrame, factor: int, statistic: str = "mean") -> DataFrame:
    """A coarser track: the statistic of ``factor`` bins each; NaN is skipped."""
    rows = track.where(~F.isnan("value")).groupBy("seqname", F.expr(f"bin div {factor}").alias("bin"))
    moments = rows.agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), F.min("value").alias("min"), F.max("value").alias("max"))
    return moments.select("seqname", "bin", bin_statistic(statistic).alias("value"))


def summary(track: DataFrame) -> DataFrame:
    """n, min, max and mean of what is not NaN; of nothing: 0, inf, -inf, 0."""
    inf = float("inf")
    return track.where(~F.isnan("value")).agg(F.count("*").alias("n"), F.coalesce(F.min("value"), F.lit(inf)).alias("min"), F.coalesce(F.max("value"), F.lit(-inf)).alias("max"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))


def histogram(track: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """x (left edge), y: values in [low, high) by bin; bins = 0: exact values; NaN is skipped."""
    values = track.where(~F.isnan("value"))
    if bins == 0:
        return values.groupBy(F.col("value").alias("x")).agg(F.count("*").alias("y"))
    spark = track.sparkSession
    if not low < high:
        return spark.createDataFrame([], "x double, y long")
    c = bins / (high - low)
    found = values.select(F.floor((F.col("value") - low) * c).alias("j")).where((F.col("j") >= 0) & (F.col("j") < bins)).groupBy("j").agg(F.count("*").alias("n"))
    return spark.range(bins).join(found, F.col("id") == F.col("j"), "left").select((F.lit(low) + F.col("id") / F.lit(c)).alias("x"), F.coalesce("n", F.lit(0)).alias("y"))


def cumulative(hist: DataFrame) -> DataFrame:
    """The histogram with running sums. A histogram is as small as its bins."""
    return hist.withColumn("y", F.sum("y").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))


def distribution(track: DataFrame) -> DataFrame:
    """Distinct values with their cumulative count and share."""
    counts = histogram(track, 0, 0, 0)
    run = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cum", F.sum("y").over(run)).withColumn("p", F.col("cum") / F.sum("y").over(Window.partitionBy()))


def counts_to_quantiles(track: DataFrame) -> DataFrame:
    """Values become the share of values that are not larger; NaN stays."""
    cdf = distribution(track).select(F.col("x").alias("value"), F.col("p"))
    return track.join(cdf, "value", "left").select("seqname", "bin", F.when(F.isnan("value"), F.col("value")).otherwise(F.col("p")).alias("value"))


def _quantile_map(own: DataFrame, ref: DataFrame) -> DataFrame:
    """x -> y: the first reference value whose share reaches that of x; the smallest maps to the smallest."""
    number = F.row_number().over(Window.orderBy("x"))
    a = own.withColumn("r", number).select("p", F.lit(0).alias("o"), "x", "r", F.lit(None).cast("double").alias("ref"))
    b = ref.withColumn("r", number).where("r > 1").select("p", F.lit(1).alias("o"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("int").alias("r"), F.col("x").alias("ref"))
    ahead = Window.orderBy("p", "o", "ref").rowsBetween(0, Window.unboundedFollowing)
    least = ref.agg(F.min("x").alias("least"))
    joined = a.unionByName(b).withColumn("y", F.first("ref", ignorenulls=True).over(ahead)).where("x is not null").crossJoin(F.broadcast(least))  # one row
    return joined.select("x", F.when(F.col("r") == 1, F.col("least")).otherwise(F.coalesce("y", F.lit(0.0))).alias("y"))


def quantile_normalize(track: DataFrame, reference: DataFrame) -> DataFrame:
    """The track with the reference's distribution; NaN stays."""
    return quantile_normalize_to_counts(track, histogram(reference, 0, 0, 0))


def quantile_normalize_to_counts(track: DataFrame, counts: DataFrame) -> DataFrame:
    """The same with an explicit histogram (x, y)."""
    run = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ref = counts.withColumn("p", F.sum("y").over(run) / F.sum("y").over(Window.partitionBy())).select("x", "p")
    table = _quantile_map(distribution(track).select("x", "p"), ref)
    return track.join(table, track["value"] == table["x"], "left").select("seqname", "bin", F.when(F.isnan("value"), F.col("value")).otherwise(F.col("y")).alias("value"))


def cross_correlation(a: DataFrame, b: DataFrame, genome: DataFrame, bin_size: int, low: int, high: int, normalize: bool = True) -> DataFrame:
    """lag (in bases), value for lags from low up to high in steps of a bin.

    Sparse tracks are enough: the lag join pairs only bins that are not 0, and the
    means' share is added from sums over the bins that a lag leaves out, which are
    prefixes and suffixes of the sequences. Bins that a track lacks are 0.
    """
    sizes = bins_of(genome, bin_size).where("n_bins > 0").join(b.select("seqname").distinct(), "seqname", "left_semi").join(a.select("seqname").distinct(), "seqname", "left_semi")
    a = a.join(sizes, "seqname").where("bin < n_bins and value <> 0")
    b = b.join(sizes, "seqname").where("bin < n_bins and value <> 0")
    n = sizes.agg(F.sum("n_bins").alias("n")).first()["n"]
    if not n:
        return genome.sparkSession.createDataFrame([], "lag long, value double")
    moment = lambda t: t.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).first()
    (s1, q1), (s2, q2) = moment(a), moment(b)
    m1, m2 = s1 / n, s2 / n
    scale = ((q1 / n - m1 * m1) * (q2 / n - m2 * m2)) ** 0.5 if normalize else 1.0
    lags = list(range(low // bin_size, -(-high // bin_size)))
    if not lags:
        return genome.sparkSession.createDataFrame([], "lag long, value double")
    lag = genome.sparkSession.range(lags[0], lags[-1] + 1).withColumnRenamed("id", "lag")
    every = F.explode(F.sequence(F.lit(lags[0]).cast("long"), F.lit(lags[-1]).cast("long")))
    moved = a.select("seqname", F.col("bin").alias("at"), "value", every.alias("lag")).withColumn("bin", F.col("at") + F.col("lag"))
    ab = moved.join(b.select("seqname", "bin", F.col("value").alias("v")), ["seqname", "bin"]).groupBy("lag").agg(F.sum(F.col("value") * F.col("v")).alias("ab"))
    # bins i of a with i + lag inside, bins j of b with j - lag inside, and their number
    a_in = a.select("bin", "n_bins", "value", every.alias("lag")).where("bin + lag between 0 and n_bins - 1").groupBy("lag").agg(F.sum("value").alias("sa"))
    b_in = b.select("bin", "n_bins", "value", every.alias("lag")).where("bin - lag between 0 and n_bins - 1").groupBy("lag").agg(F.sum("value").alias("sb"))
    pairs = sizes.select("n_bins", every.alias("lag")).groupBy("lag").agg(F.sum(F.greatest(F.lit(0), F.col("n_bins") - F.abs("lag"))).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = lag.join(ab, "lag", "left").join(a_in, "lag", "left").join(b_in, "lag", "left").join(pairs, "lag", "left")
    cov = (zero("ab") - zero("sa") * m2 - zero("sb") * m1 + F.col("m") * (m1 * m2)) / n
    return joined.select((F.col("lag") * bin_size).alias("lag"), (cov / scale).alias("value"))


def auto_correlation(a: DataFrame, genome: DataFrame, bin_size: int, low: int, high: int, normalize: bool = True) -> DataFrame:
    return cross_correlation(a, a, genome, bin_size, low, high, normalize)


def read_cross_correlation(reads: DataFrame, genome: DataFrame, max_delay: int, bin_size: int = 1) -> DataFrame:
    """Cross-correlation of the 5' ends of forward and reverse reads."""
    from .tracks import coverage

    ends = lambda strand, at: reads.where(F.col("strand") == strand).select("seqname", F.col(at).alias("from"), (F.col(at) + 1).alias("to"))
    forward, reverse = coverage(ends("+", "from"), genome, bin_size), coverage(ends("-", "to"), genome, bin_size)
    return cross_correlation(forward, reverse, genome, bin_size, 0, max_delay)


def fragment_length(correlation: DataFrame, low: int, high: int) -> int:
    """The lag of the highest strict local maximum in [low, high); an error if the last lag is higher still."""
    w = Window.orderBy("lag")  # a row for each lag
    beside = correlation.withColumns({"b": F.lag("value").over(w), "n": F.lead("value").over(w)})
    peak = (F.col("value") > F.col("b")) & (F.col("value") > F.col("n")) & (F.col("value") > 0) & (F.col("lag") >= low) & (F.col("lag") < high)
    key = F.when(peak, F.struct("value", (-F.col("lag")).alias("l"), "lag"))
    best = beside.agg(F.max(key).alias("top"), F.max_by("value", "lag").alias("last")).first()
    if best["top"] is None:
        raise ValueError("no local maximum")
    if best["top"]["value"] < best["last"]:
        raise ValueError("the longest delay is too small: the correlation still rises there")
    return best["top"]["lag"]


def bbi_summary(records: DataFrame, bin_size: int) -> DataFrame:
    """Partial aggregates (valid, min, max, sum, sum_sq) of value records by output bin, for the pre-aggregated levels."""
    rows = records.where(~F.isnan("value"))
    return rows.groupBy("seqname", F.expr(f"`from` div {bin_size}").alias("bin")).agg(F.count("*").alias("valid"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"))


def query_slice(track: DataFrame, seqname: str, start: int, stop: int, track_bin: int, bin_size: int, statistic: str = "mean", overlap: int = 0, init: float = float("nan")) -> DataFrame:
    """bin, value of [start, stop) at a coarser bin size; ``overlap`` bins on either side join the statistic."""
    n = (stop - start) // bin_size
    spark = track.sparkSession
    rows = track.where((F.col("seqname") == seqname) & ~F.isnan("value")).where((F.col("bin") * track_bin >= start) & (F.col("bin") * track_bin < stop))
    own = rows.select(F.expr(f"(bin * {track_bin} - {start}) div {bin_size}").alias("j"), "value")
    spread = own.select(F.explode(F.sequence(F.col("j") - overlap, F.col("j") + overlap)).alias("j"), "value")
    moments = spread.groupBy("j").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), F.min("value").alias("min"), F.max("value").alias("max"))
    return spark.range(n).join(moments, F.col("id") == F.col("j"), "left").select(F.col("id").alias("bin"), F.coalesce(bin_statistic(statistic), F.lit(init)).alias("value"))
