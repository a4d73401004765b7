"""Binned numeric tracks: coverage, element-wise and windowed maths, normalisation.

A track is (seqname, bin, value), sparse or dense; bins are floor(length / size), the
last partial bin is dropped. Windows over bins run in chunks of CHUNK bins with the
neighbours they need copied in, so that a chromosome is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def bins_of(genome: DataFrame, bin_size: int) -> DataFrame:
    """seqname, n_bins; sequences shorter than a bin have none."""
    return genome.select("seqname", F.expr(f"length div {bin_size}").alias("n_bins"))


def dense_bins(genome: DataFrame, bin_size: int) -> DataFrame:
    """Every bin of the genome."""
    some = bins_of(genome, bin_size).where("n_bins > 0")
    # ranges of bins first, so that a long sequence is spread before it is unfolded
    chunks = some.select("seqname", "n_bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1, F.lit(CHUNK).cast("long"))).alias("a"))
    spread = chunks.repartition("seqname", "a")
    return spread.select("seqname", F.explode(F.sequence("a", F.least(F.col("a") + CHUNK, F.col("n_bins")) - 1)).alias("bin"))


def densify(track: DataFrame, genome: DataFrame, bin_size: int, init: float = 0.0) -> DataFrame:
    return dense_bins(genome, bin_size).join(track, ["seqname", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(float(init))))


def coverage(reads: DataFrame, genome: DataFrame, bin_size: int, method: str = "simple") -> DataFrame:
    """Reads per bin (sparse): simple counts, overlap bases, or mean overlap (bases over bin size)."""
    if method not in ("", "default", "simple", "overlap", "mean overlap"):
        raise ValueError(f"no coverage method {method}")
    known = reads.join(bins_of(genome, bin_size), "seqname").where((F.col("from") >= 0) & (F.expr(f"`from` div {bin_size}") < F.col("n_bins")))
    last = F.least(F.expr(f"(`to` - 1) div {bin_size}"), F.col("n_bins") - 1)
    first = F.expr(f"`from` div {bin_size}")
    cells = known.withColumn("_last", last).withColumn("_first", first).where("_first <= _last").withColumn("bin", F.explode(F.sequence("_first", "_last")))
    shared = F.greatest(F.lit(0), F.least(F.col("to"), (F.col("bin") + 1) * bin_size) - F.greatest(F.col("from"), F.col("bin") * bin_size))
    amount = {"overlap": F.sum(shared).cast("double"), "mean overlap": F.sum(shared) / F.lit(float(bin_size))}.get(method, F.count("*").cast("double"))
    return cells.groupBy("seqname", "bin").agg(amount.alias("value"))


def accepted(reads: DataFrame, genome: DataFrame, bin_size: int) -> DataFrame:
    """n: the reads that coverage accepts - those that start on a known sequence's bins."""
    return reads.join(bins_of(genome, bin_size), "seqname").where((F.col("from") >= 0) & (F.expr(f"`from` div {bin_size}") < F.col("n_bins"))).agg(F.count("*").alias("n"))


def map_track(track: DataFrame, f: Callable[[Column, Column, Column], Column], bin_size: int) -> DataFrame:
    """Element-wise f(seqname, position, value)."""
    return track.withColumn("value", f(F.col("seqname"), F.col("bin") * bin_size, F.col("value")))


def with_halo(track: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Rows with ``chunk``, and copies for the chunks whose windows reach them; ``own`` marks the originals."""
    near = F.sequence(F.expr(f"greatest(0, bin - {after}) div {chunk}"), F.expr(f"(bin + {before}) div {chunk}"))
    both = track.withColumn("chunk", F.explode(near))
    return both.withColumn("own", F.col("chunk") == F.expr(f"bin div {chunk}"))


def window_map(track: DataFrame, width: int, f: Callable[[Column], Column], n_bins: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """f over the centred windows of a dense track: an array of ``width`` values, NaN out of range."""
    if width <= 0:
        raise ValueError("a window has at least one bin")
    left, right = width // 2, width - 1 - width // 2
    halo = with_halo(track, left, right, chunk)
    w = Window.partitionBy("seqname", "chunk").orderBy("bin").rangeBetween(-left, right)
    found = halo.withColumn("_w", F.collect_list(F.struct("bin", "value")).over(w)).where("own")
    cells = F.map_from_entries("_w")
    values = F.transform(F.sequence(F.col("bin") - left, F.col("bin") + right), lambda b: F.coalesce(F.element_at("_m", b), F.lit(float("nan"))))
    return found.withColumn("_m", cells).withColumn("value", f(values)).select("seqname", "bin", "value")


def zip_tracks(tracks: list[DataFrame]) -> DataFrame:
    """seqname, bin, values: one value of each track that has the bin, in order."""
    each = [t.select("seqname", "bin", F.lit(i).alias("i"), "value") for i, t in enumerate(tracks)]
    every = each[0]
    for t in each[1:]:
        every = every.unionByName(t)
    listed = every.groupBy("seqname", "bin").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
    return listed.select("seqname", "bin", F.transform("x", lambda v: v["value"]).alias("values"))


def map_list(tracks: list[DataFrame], f: Callable[[Column], Column]) -> DataFrame:
    return zip_tracks(tracks).select("seqname", "bin", f(F.col("values")).alias("value"))


def window_map_list(tracks: list[DataFrame], width: int, f: Callable[[Column], Column]) -> DataFrame:
    """f over an array of windows, one per track that has the bin."""
    each = [window_map(t, width, lambda a: a).withColumn("i", F.lit(i)) for i, t in enumerate(tracks)]
    every = each[0]
    for t in each[1:]:
        every = every.unionByName(t)
    listed = every.groupBy("seqname", "bin").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
    return listed.select("seqname", "bin", f(F.transform("x", lambda v: v["value"])).alias("value"))


def map_python(track: DataFrame, spec: str) -> DataFrame:
    """Element-wise ``module:function`` f(seqname, position-array, value-array) over Arrow batches - the plug-in point."""
    import importlib

    module, _, name = spec.partition(":")

    @F.pandas_udf("double")
    def call(seqname: pd.Series, bin: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series(getattr(importlib.import_module(module), name)(seqname, bin, value))

    return track.withColumn("value", call("seqname", "bin", "value"))


def map_python_list(tracks: list[DataFrame], spec: str, bin_size: int) -> DataFrame:
    """``module:function`` f(seqname, position, *values) over the bins that every track has, called per bin in Arrow batches."""
    import importlib

    module, _, name = spec.partition(":")

    @F.pandas_udf("double")
    def call(seqname: pd.Series, position: pd.Series, values: pd.Series) -> pd.Series:
        f = getattr(importlib.import_module(module), name)
        return pd.Series([f(s, p, *v) for s, p, v in zip(seqname, position, values, strict=True)], dtype="float64")

    zipped = zip_tracks(tracks).where(F.size("values") == len(tracks))
    return zipped.select("seqname", "bin", call("seqname", F.col("bin") * bin_size, "values").alias("value"))


def reduce_track(track: DataFrame, start: Column, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Left fold over each sequence's bins in order. The fold is sequential by nature: a sequence is one row."""
    listed = track.groupBy("seqname").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("x"))
    return listed.select("seqname", F.aggregate(F.transform("x", lambda v: v["value"]), start, f).alias("value"))


def smooth(track: DataFrame, min_count: float, sizes: list[int], genome: DataFrame, bin_size: int, chunk: int = CHUNK) -> DataFrame:
    """Adaptive smoothing of a dense track: the mean of the smallest window with at least min_count, else of the largest.

    Windows shift inside at the borders. Sums slide over fixed frames within chunks
    that are widened by the largest window; a border window has the sum of the first
    or last window inside, whose centre lies in the same widened chunk.
    """
    sizes = sorted(sizes)
    reach = max(sizes)
    halo = with_halo(track, reach, reach, chunk).join(bins_of(genome, bin_size), "seqname")
    halo = halo.withColumn("value", F.coalesce("value", F.lit(0.0)))
    run = Window.partitionBy("seqname", "chunk").orderBy("bin")
    out = None
    for w in reversed(sizes):
        # centred windows begin at bin - w/2: the frame is fixed, as the engine can slide it
        total = F.sum("value").over(run.rangeBetween(-(w // 2), w - 1 - w // 2))
        halo = halo.withColumn(f"_c{w}", total)
        low = F.col(f"_c{w}")
        inner = (F.col("bin") >= w // 2) & (F.col("bin") - w // 2 + w <= F.col("n_bins"))
        # the first and the last window that lie inside stand for those beyond
        every = Window.partitionBy("seqname", "chunk")
        head = F.max(F.when(F.col("bin") == F.least(F.lit(w // 2), F.col("n_bins") - 1), low)).over(every)
        tail = F.max(F.when(F.col("bin") == F.col("n_bins") - w + w // 2, low)).over(every)
        shifted = F.when(inner, low).when(F.col("n_bins") < w, F.sum("value").over(run.rangeBetween(-w, w))).when(F.col("bin") < w // 2, head).otherwise(tail)
        halo = halo.withColumn(f"_s{w}", shifted)
        mean = F.col(f"_s{w}") / F.lit(float(w))
        out = mean if out is None else F.when(F.col(f"_s{w}") >= min_count, mean).otherwise(out)
    return halo.withColumn("value", out).where("own").select("seqname", "bin", "value")


def normalize(treatment: DataFrame, control: DataFrame, c1: float, c2: float, log: bool = False) -> DataFrame:
    """(t + c1) / (c + c2) * c2 / c1; sequences that the control lacks stay as they are."""
    if c1 <= 0 or c2 <= 0:
        raise ValueError("pseudocounts must be positive")
    seqs = control.select("seqname").distinct().withColumn("known", F.lit(True))
    both = treatment.join(control.withColumnRenamed("value", "c"), ["seqname", "bin"], "left").join(seqs, "seqname", "left")
    ratio = (F.col("value") + c1) / (F.coalesce("c", F.lit(0.0)) + c2) * F.lit(c2 / c1)
    return both.withColumn("value", F.when(F.col("known"), F.log(ratio) if log else ratio).otherwise(F.col("value"))).select("seqname", "bin", "value")


def scale_reads(track: DataFrame, n: int, bin_size: int, method: str) -> DataFrame:
    """rpkm: 1e6 / (n * bin size), cpm: 1e6 / n."""
    factor = {"rpkm": 1e6 / (n * bin_size) if n else 0.0, "cpm": 1e6 / n if n else 0.0}[method]
    return track.withColumn("value", F.col("value") * F.lit(factor))


def get_slice(track: DataFrame, seqname: str, start: int, stop: int, bin_size: int) -> DataFrame:
    return track.where((F.col("seqname") == seqname) & (F.col("bin") >= max(0, start // bin_size)) & (F.col("bin") < stop // bin_size))


def extract_regions(track: DataFrame, regions: DataFrame, bin_size: int) -> DataFrame:
    """A dense track's values within regions, NaN elsewhere."""
    some = regions.where(F.expr(f"`to` div {bin_size} > `from` div {bin_size}"))
    bins = some.select("seqname", F.explode(F.expr(f"sequence(`from` div {bin_size}, `to` div {bin_size} - 1)")).alias("bin")).distinct().withColumn("in", F.lit(True))
    return track.join(bins, ["seqname", "bin"], "left").withColumn("value", F.when(F.col("in"), F.col("value")).otherwise(F.lit(float("nan")))).drop("in")


def extract_sequences(track: DataFrame, names: list[str]) -> DataFrame:
    return track.where(F.col("seqname").isin(*names))


def track_to_ranges_column(regions: DataFrame, track: DataFrame, name: str, bin_size: int, reverse_negative: bool = False) -> DataFrame:
    """regions with an array column of the track's bins (0 where it has none), reversed on the - strand if asked."""
    if reverse_negative:
        regions = regions.where(F.when(F.col("strand") == "*", F.raise_error(F.lit("a strand is needed"))).otherwise(F.lit("")).isNotNull())
    cells = regions.where(F.expr(f"(`to` - `from`) div {bin_size} > 0")).select("row_id", "seqname", F.posexplode(F.expr(f"transform(sequence(0L, (`to` - `from`) div {bin_size} - 1), i -> (`from` + i * {bin_size}) div {bin_size})")).alias("i", "bin"))
    found = cells.join(track, ["seqname", "bin"], "left").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("x"))
    values = F.coalesce(F.transform("x", lambda v: v["v"]), F.array().cast("array<double>"))
    if reverse_negative:
        values = F.when(F.col("strand") == "-", F.reverse(values)).otherwise(values)
    return regions.join(found, "row_id", "left").withColumn(name, values).withColumn("binSize", F.lit(bin_size)).drop("x")


def segmentation_track(segments: DataFrame, bin_size: int, default_state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranges with names as a track of state numbers, by first appearance; returns track and the states."""
    first = segments.groupBy("name").agg(F.min("row_id").alias("at"))
    rank = F.dense_rank().over(Window.orderBy(F.col("name") != F.lit(default_state) if default_state else F.lit(0), "at"))
    states = first.select("name", (rank - 1).alias("state"))
    bins = segments.join(states, "name").where(F.expr(f"`to` div {bin_size} > `from` div {bin_size}"))
    cells = bins.select("row_id", "seqname", F.explode(F.expr(f"sequence(`from` div {bin_size}, `to` div {bin_size} - 1)")).alias("bin"), "state")
    return cells.groupBy("seqname", "bin").agg(F.max_by("state", "row_id").cast("double").alias("value")), states


def bam_coverage(treatment: DataFrame, genome: DataFrame, control: DataFrame | None = None, bin_size: int = 10, method: str = "simple", fragment: int = 0, normalize_by: str = "", pseudocounts: tuple[float, float] = (0.0, 0.0), log: bool = False, smooth_control: tuple[float, list[int]] | None = None, remove: list[str] = (), zero: list[str] = (), **filters) -> DataFrame:
    """Reads to a normalised dense track: filter, extend, count, scale, combine with a control, drop or zero sequences."""
    from .reads import extend_reads, filter_reads

    def one(reads: DataFrame, pseudo: float) -> tuple[DataFrame, float]:
        ready = extend_reads(filter_reads(reads, **filters), fragment)
        track = densify(coverage(ready, genome, bin_size, method), genome, bin_size)
        if normalize_by:
            n = accepted(ready, genome, bin_size).first()["n"]
            track = scale_reads(track, n, bin_size, normalize_by)
            pseudo *= {"rpkm": 1e6 / (n * bin_size) if n else 0.0, "cpm": 1e6 / n if n else 0.0}[normalize_by]
        return track, pseudo

    track, c1 = one(treatment, pseudocounts[0])
    if control is not None:
        other, c2 = one(control, pseudocounts[1])
        if smooth_control:
            other = smooth(other, smooth_control[0], smooth_control[1], genome, bin_size)
        track = normalize(track, other, c1, c2, log)
    else:
        track = track.withColumn("value", F.col("value") + c1)
        if log:
            track = track.withColumn("value", F.log("value"))
    if remove:
        track = track.where(~F.col("seqname").isin(*remove))
    if zero:
        track = track.withColumn("value", F.when(F.col("seqname").isin(*zero), 0.0).otherwise(F.col("value")))
    return track
