"""The tools. Each takes a session and its parsed arguments; results go to a file, or line by line to standard output.

Lines are written as they arrive from the tasks, so a result of any size passes
through the driver without being held there.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, kmers, pwm
from ..operators import coverage, intervals, joins, ranges, segments, stats, tracks
from ..operators import reads as rd
from ..session import local_session, ship_package
from ..sources import bam, bigwig, text

TOOLS: dict[str, tuple[Callable, list]] = {}
STATISTICS = ["mean", "max", "min", "discrete mean", "discrete max", "discrete min", "variance"]


def arg(*names: str, **options) -> tuple[tuple, dict]:
    return names, options


def tool(name: str, *arguments):
    def add(f):
        TOOLS[name] = (f, list(arguments))
        return f

    return add


INPUT, OUTPUT = arg("input"), arg("output", nargs="?")
BINS = [arg("--bin-size", type=int, default=0), arg("--bin-summary", choices=STATISTICS, default="mean")]
OVERLAP, INIT = arg("--bin-overlap", type=int, default=0), arg("--initial-value", type=float, default=float("nan"))
VARIANTS = [arg(f"--{x}", action="store_true") for x in ("complement", "reverse", "revcomp", "binary")]
ALPHABETS = {"nucleotide": dna.NUCLEOTIDES, "gapped-nucleotide": dna.GAPPED, "ambiguous-nucleotide": dna.AMBIGUOUS}
KMERS = [arg("low", type=int), arg("high", type=int)]
KMER_OPTIONS = [arg("--alphabet", choices=list(ALPHABETS), default="nucleotide"), arg("--max-ambiguous", default="-1"), arg("--regions"), *VARIANTS]


def emit(lines: DataFrame, path: str | None, order: list | None = None) -> None:
    """The column ``line``, in order, into one file or to standard output."""
    rows = (lines.orderBy(*order) if order else lines).select("line").toLocalIterator()
    if path is None:
        for r in rows:
            print(r["line"])
        return
    with open(path, "w") as out:
        for r in rows:
            out.write(r["line"] + "\n")


def emit_table(df: DataFrame, path: str | None, strand: bool = True, scientific: bool = False) -> None:
    emit(text.table_lines(df, True, strand, scientific), path, ["row_id"])


def emit_bed(df: DataFrame, path: str | None, columns: int) -> None:
    emit(df.select("row_id", text.bed_line(df, columns).alias("line")), path, ["row_id"])


def whole_or_regions(spark: SparkSession, fasta: str, regions: str | None, columns: int = 3) -> DataFrame:
    """Regions with their ``bases``; without a regions file, every sequence whole."""
    found = text.read_fasta(spark, fasta)
    if regions:
        return joins.slice_sequences(text.read_bed(spark, regions, columns), found, strict=True)
    size = F.length("sequence").cast("long")
    return found.select(F.col("idx").alias("row_id"), "seqname", F.lit(0).cast("long").alias("from"), size.alias("to"), F.lit("*").alias("strand"), F.col("sequence").alias("bases"))


# ---- alignments ----


@tool("bam-genome", INPUT)
def bam_genome(spark, a):
    for r in bam.read_genome(spark, a.input).orderBy("idx").collect():
        print(f"{r['seqname']}\t{r['length']}")


def checked_bins(spark: SparkSession, path: str) -> DataFrame:
    """row_id, name, bin, expected: each record's stored index bin and the one its place has."""
    rows = bam.read_bam(spark, path, ["name"]).withColumn("row_id", F.monotonically_increasing_id())
    stop = F.col("pos") + F.when(rd.flag("flag", "unmapped"), 1).otherwise(F.col("length"))
    return rows.select("row_id", "name", "bin", rd.bam_bin(F.col("pos"), stop).alias("expected"))


@tool("bam-check-bin", INPUT, arg("--verbose", "-v", action="store_true"))
def bam_check_bin(spark, a):
    rows = checked_bins(spark, a.input)
    good = F.concat(F.lit("record "), "name", F.lit(" has correct bin "), F.col("bin").cast("string"))
    bad = F.concat(F.lit("record "), "name", F.lit(" has invalid bin: expected "), F.col("expected").cast("string"), F.lit(" but it is "), F.col("bin").cast("string"))
    ok = F.col("bin") == F.col("expected")
    emit((rows if a.verbose else rows.where(~ok)).select("row_id", F.when(ok, good).otherwise(bad).alias("line")), None, ["row_id"])


@tool("bam-view", INPUT, arg("--no-read-name", action="store_true"), arg("--no-cigar", action="store_true"), arg("--sequence", action="store_true"), arg("--auxiliary", action="store_true"))
def bam_view(spark, a):
    some = {"name": not a.no_read_name, "cigar": not a.no_cigar, "sequence": a.sequence, "tags": a.auxiliary}
    rows = bam.read_bam(spark, a.input, [c for c, on in some.items() if on])
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    place = F.when(F.col("pos") >= 0, F.col("pos").cast("string")).otherwise("*")
    bits = F.lpad(F.bin("flag"), 11, "0")
    cells = [F.format_string("%10s %15s %5d:%s %4d", F.coalesce("seqname", F.lit("*")), place, "flag", bits, "mapq")]
    head = f"{'Seqname':>10} {'Position':>15} {'Flag':>17} {'MapQ':>4}"
    if some["cigar"]:
        cells.append(F.lpad(dash(F.col("cigar")), 20, " "))
        head += f" {'Cigar':>20}"
    if some["name"]:
        cells.append(F.lpad(dash(F.col("name")), 40, " "))
        head += f" {'ReadName':>40}"
    if some["sequence"]:
        cells.append(dash(F.col("sequence")))
        head += " Sequence"
    if some["tags"]:
        cells.append(dash(F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat_ws(":", x["key"], x["value"])), " ")))
        head += " Auxiliary"
    print(head)
    emit(rows.select(F.concat_ws(" ", *cells).alias("line")), None)


def _files(spec: str) -> list[tuple[str, int | None]]:
    """FILE[:LENGTH],... as pairs."""
    out: list[tuple[str, int | None]] = []
    for part in spec.split(","):
        name, _, length = part.rpartition(":")
        out.append((name, int(length)) if name and length.isdigit() else (part, None))
    return out


def _pair(value: str | None, kind: type = float, separator: str = ",", default=None):
    return tuple(kind(x) if x else None for x in value.split(separator)) if value else default


@tool(
    "bam-to-bigwig", arg("treatment"), arg("rest", nargs="+", help="[control] result.bw"),
    *[arg(f"--{x}") for x in ("shift-reads", "filter-strand", "filter-read-lengths", "filter-chromosomes", "pseudocounts", "smoothen-window-sizes", "fragment-length-range")],
    *[arg(f"--{x}", action="store_true") for x in ("paired-as-single-end", "paired-end-strand-specific", "filter-duplicates", "filter-paired-end", "filter-single-end")],
    *[arg(f"--{x}", action="store_true") for x in ("remove-filtered-chromosomes", "smoothen-control", "log-scale", "estimate-fragment-length", "save-fraglen", "save-crosscorrelation", "verbose")],
    arg("--filter-mapq", type=int, default=0), arg("--bin-size", type=int, default=10), arg("--binning-method", default="simple"),
    arg("--normalize-track", default="", choices=["", "rpkm", "cpm"]), arg("--smoothen-min-counts", type=float, default=20.0),
    arg("--fragment-length", type=int), arg("--fragment-length-bin-size", type=int, default=10),
)
def bam_to_bigwig(spark, a):
    if len(a.rest) > 2:
        raise SystemExit("expected: treatment [control] result.bw")
    def tell(path: str, step: str, n: int) -> None:
        print(f"{path}: {n} reads after the filter by {step}", file=sys.stderr)

    s = coverage.Settings(
        bin_size=a.bin_size, method=a.binning_method, normalize_by=a.normalize_track, log=a.log_scale,
        pseudocounts=_pair(a.pseudocounts, default=(0.0, 0.0)), paired_as_single=a.paired_as_single_end,
        strand_specific=a.paired_end_strand_specific, paired=True if a.filter_paired_end else False if a.filter_single_end else None,
        strand=a.filter_strand, mapq=a.filter_mapq, duplicates=not a.filter_duplicates,
        lengths=tuple(x or 0 for x in _pair(a.filter_read_lengths, int, ":", (0, 0))), shift=_pair(a.shift_reads, int, ",", (0, 0)),
        smooth_control=(a.smoothen_min_counts, list(_pair(a.smoothen_window_sizes, int, ",", (10, 20, 50, 100, 200)))) if a.smoothen_control else None,
        filtered=(a.filter_chromosomes or "").split(",") if a.filter_chromosomes else [], remove_filtered=a.remove_filtered_chromosomes,
        estimate=a.estimate_fragment_length, feasible=_pair(a.fragment_length_range, int, ":", (None, None)),
        estimate_bin=a.fragment_length_bin_size, watch=tell if a.verbose else None,
    )
    named = lambda spec: [(p, n if n is not None else a.fragment_length) for p, n in _files(spec)]
    control = named(a.rest[0]) if len(a.rest) == 2 else []
    track, genome, found = coverage.bam_track(spark, named(a.treatment), control, s)
    bigwig.write_bigwig(track, genome, a.rest[-1], a.bin_size)
    for path, (length, correlation) in found.items():
        base = path.removesuffix(".bam")
        if a.save_fraglen:
            Path(f"{base}.fraglen.txt").write_text(f"{length}\n")
        if a.save_crosscorrelation:
            emit(correlation.select("lag", F.format_string("%d %f", "lag", "value").alias("line")), f"{base}.fraglen.table", ["lag"])


# ---- bigWig files ----


def _load(spark: SparkSession, a, path: str, init: float | None = float("nan")) -> DataFrame:
    return bigwig.read_track(spark, path, a.bin_size, a.bin_summary, getattr(a, "bin_overlap", 0), init)


def _size(a, path: str) -> int:
    bw = bigwig.BigWig(path)
    try:
        return a.bin_size or bw.bin_size()
    finally:
        bw.close()


def _save(spark: SparkSession, track: DataFrame, like: str, path: str, bin_size: int, names: list[str] | None = None) -> None:
    genome = bigwig.read_genome(spark, like)
    bigwig.write_bigwig(track, genome.where(F.col("seqname").isin(*names)) if names else genome, path, bin_size)


@tool("bigwig-genome", INPUT)
def bigwig_genome(spark, a):
    for r in bigwig.read_genome(spark, a.input).orderBy("idx").collect():
        print(f"{r['seqname']}\t{r['length']}")


@tool("bigwig-nil", INPUT, arg("output"), *BINS, OVERLAP, INIT)
def bigwig_nil(spark, a):
    _save(spark, _load(spark, a, a.input, a.initial_value), a.input, a.output, _size(a, a.input))


@tool("bigwig-statistics", INPUT, arg("--bin-size", type=int, default=0))
def bigwig_statistics(spark, a):
    r = stats.summary(bigwig.read_track(spark, a.input, a.bin_size)).first()
    print(f"bins: {r['n']}\nminimum: {r['min']:f}\nmaximum: {r['max']:f}\nmean: {r['mean']:f}")


@tool("bigwig-histogram", INPUT, arg("--bins", "-b", type=int, default=100), arg("--cumulative", "-c", action="store_true"), *BINS)
def bigwig_histogram(spark, a):
    track = _load(spark, a, a.input, None)
    r = stats.summary(track).first()
    found = stats.histogram(track, r["min"], r["max"], a.bins)
    if a.cumulative:
        found = stats.cumulative(found)
    print(f"{'x':>15}\t{'y':>15}")
    emit(found.select("x", F.format_string("%15e\t%15f", F.col("x"), F.col("y").cast("double")).alias("line")), None, ["x"])


@tool("bigwig-query", INPUT, arg("chrom"), arg("start", type=int), arg("stop", type=int), arg("size", type=int))
def bigwig_query(spark, a):
    rows = bigwig.query(spark, a.input, a.chrom, a.start, a.stop, a.size)
    cells = F.format_string("%s\t%d\t%d\t%.0f\t%f\t%f\t%f\t%f", "seqname", "from", "to", "valid", "min", "max", "sum", "sum_sq")
    print("seqname\tfrom\tto\tvalid\tmin\tmax\tsum\tsum_sq")
    emit(rows.select("seqname", "from", cells.alias("line")), None, ["seqname", "from"])


@tool("bigwig-query-sequence", INPUT, arg("chrom"), arg("start", type=int), arg("stop", type=int), arg("size", type=int), OVERLAP, arg("--bin-summary", choices=STATISTICS, default="mean"))
def bigwig_query_sequence(spark, a):
    rows = bigwig.query_slice(spark, a.input, a.chrom, a.start, a.stop, a.size, a.bin_summary, a.bin_overlap)
    emit(rows.select("seqname", "bin", F.format_string("%s\t%d\t%f", "seqname", "bin", "value").alias("line")), None, ["seqname", "bin"])


@tool("bigwig-counts-to-quantiles", INPUT, arg("output"), *BINS, INIT)
def bigwig_counts_to_quantiles(spark, a):
    _save(spark, stats.counts_to_quantiles(_load(spark, a, a.input, a.initial_value)), a.input, a.output, _size(a, a.input))


@tool("bigwig-quantile-normalize", arg("reference"), INPUT, arg("output"), *BINS, INIT)
def bigwig_quantile_normalize(spark, a):
    both = [_load(spark, a, p, a.initial_value) for p in (a.input, a.reference)]
    _save(spark, stats.quantile_normalize(*both), a.input, a.output, _size(a, a.input))


@tool("bigwig-map", arg("function", help="module:function of (seqname, position, values...)"), arg("output"), arg("inputs", nargs="+"), *BINS, OVERLAP)
def bigwig_map(spark, a):
    size = _size(a, a.inputs[0])
    a.bin_size = size
    each = [_load(spark, a, p) for p in a.inputs]
    _save(spark, tracks.map_python_list(each, a.function, size), a.inputs[0], a.output, size)


@tool("bigwig-edit-chrom-names", INPUT, arg("pattern"), arg("replacement"), arg("--dry-run", action="store_true"))
def bigwig_edit_chrom_names(spark, a):
    import os
    import re

    bw = bigwig.BigWig(a.input)
    names = bw.names(".*")
    bw.close()
    for n in names:
        print(f"{n} -> {re.sub(a.pattern, a.replacement, n)}")
    if not a.dry_run:
        bigwig.rename_chromosomes(a.input, a.input + ".part", a.pattern, a.replacement)
        os.replace(a.input + ".part", a.input)


@tool("bigwig-extract-chroms", arg("names"), INPUT, arg("output"))
def bigwig_extract_chroms(spark, a):
    names = a.names.split(",")
    track = tracks.extract_sequences(bigwig.read_track(spark, a.input), names)
    bw = bigwig.BigWig(a.input)
    size = bw.bin_size()
    bw.close()
    _save(spark, track, a.input, a.output, size, names)


@tool("bigwig-extract", INPUT, arg("regions"), OUTPUT, *BINS, OVERLAP, arg("--initial-value", type=float, default=0.0), arg("--scientific", action="store_true"))
def bigwig_extract(spark, a):
    size = _size(a, a.input)
    found = text.read_bed(spark, a.regions, 3)
    track = _load(spark, a, a.input, a.initial_value)
    if a.output and a.output.endswith((".bw", ".bigWig")):
        _save(spark, tracks.extract_regions(track, found, size), a.input, a.output, size)
    elif a.output is None or a.output.endswith(".table"):
        emit_table(tracks.track_to_ranges_column(found, track, "counts", size).drop("binSize"), a.output, scientific=a.scientific)
    else:
        raise SystemExit("the output is a .table, .bw or .bigWig file")


@tool("bigwig-positive", arg("output"), arg("inputs", nargs="+"), arg("--exclude"), arg("--regions"), arg("--k-nearest", type=int, default=1), arg("--regions-meta"), arg("--threshold", type=float, default=1.0), *BINS, OVERLAP)
def bigwig_positive(spark, a):
    files = [p.rpartition(":") if p.rpartition(":")[2].replace(".", "", 1).lstrip("-").isdigit() and ":" in p else (p, "", "") for p in a.inputs]
    size = _size(a, files[0][0])
    a.bin_size = size
    zipped = tracks.zip_tracks([_load(spark, a, p, None) for p, _, _ in files])
    peaks = intervals.joint_peaks(zipped, [float(t) if t else a.threshold for _, _, t in files], size)
    if a.exclude:
        peaks = intervals.without(peaks, text.read_bed(spark, a.exclude, 3))
    peaks = ranges.by_rank(peaks.withColumnRenamed("values", "test"), [F.desc("sum"), F.col("seqname"), F.col("from")]).drop("sum")
    if a.regions:
        more = a.regions_meta.split(",") if a.regions_meta else []
        near = text.read_bed(spark, a.regions, 6) if a.regions.endswith(".bed") else text.read_table(spark, a.regions, dict.fromkeys([*more, "name"], "string"))
        peaks = joins.annotate_nearest(peaks, near, a.k_nearest, "name", more=more)
    emit_table(peaks, a.output, strand=False, scientific=True)


@tool("chromatin-tables-to-bigwig", arg("genome"), arg("size", type=int), arg("column"), arg("output"), arg("inputs", nargs="+"), arg("--initial-value", type=float, default=0.0))
def chromatin_tables_to_bigwig(spark, a):
    genome = text.read_genome(spark, a.genome)
    init = 0.0 if a.initial_value == 0.0 else float("nan")  # any other initial value means no value
    track = text.read_chromatin_states(spark, a.inputs, a.column)
    bigwig.write_bigwig(tracks.densify(track, genome, a.size, init), genome, a.output, a.size)


# ---- ranges ----


@tool("bed-remove-overlaps", arg("inadmissible"), INPUT, OUTPUT, arg("--input-format", choices=["bed3", "bed6", "bed9", "table"], default="bed3"))
def bed_remove_overlaps(spark, a):
    gone = text.read_bed(spark, a.inadmissible, 3)
    if a.input_format == "table":
        emit_table(joins.anti(text.read_table(spark, a.input), gone), a.output)
        return
    columns = int(a.input_format[3:])
    emit_bed(joins.anti(text.read_bed(spark, a.input, columns), gone), a.output, columns)


@tool("draw-genomic-regions", arg("genome"), arg("n", type=int), arg("length", type=int), OUTPUT, arg("--seed", "-s", type=int), arg("--exclude", "-e"))
def draw_genomic_regions(spark, a):
    import secrets

    seed = a.seed if a.seed is not None else secrets.randbelow(1 << 31)
    exclude = None
    for path in a.exclude.split(",") if a.exclude else ():
        own = text.read_bed(spark, path, 3)
        exclude = own if exclude is None else exclude.unionByName(own)
    emit_bed(ranges.draw_ranges(text.read_genome(spark, a.genome), a.n, a.length, exclude, seed), a.output, 3)


@tool("gtf-to-bed", arg("--input", required=True), arg("--output"), arg("--merge-by", default=""))
def gtf_to_bed(spark, a):
    if a.merge_by:
        rows = text.read_gtf(spark, a.input, {a.merge_by: "string"}, {a.merge_by: ""})
        merged = intervals.merge_by(rows, a.merge_by)
        emit_bed(ranges.by_rank(merged, [F.col("name"), F.col("seqname")]), a.output, 6)
    else:
        emit_bed(text.read_gtf(spark, a.input).withColumnsRenamed({"feature": "name", "score": "gtf_score"}), a.output, 6)


@tool("segmentation-differential", arg("states"), arg("segmentations", nargs="+"), *[arg(f"--{x}") for x in ("filter-bigwig", "filter-out-bigwig", "scores")], arg("--filter-max-size", type=int, default=0), arg("--region-size", type=int, default=0), arg("--print-statistics", action="store_true"), arg("--output"))
def segmentation_differential(spark, a):
    sets = [text.read_bed(spark, p, 6) for p in a.segmentations]
    for option, side in ((a.filter_bigwig, "low"), (a.filter_out_bigwig, "high")):
        if option:
            files = [x.rpartition(":") for x in option.split(",")]
            sets = [segments.filter_by_file(spark, s, p, **{side: float(t)}) for s, (p, _, t) in zip(sets, files, strict=True)]
    found = segments.differential_regions(sets, a.states.split(","))
    order: list[Column] = [F.col("seqname"), F.col("from")]
    if a.scores:
        found = segments.score_by_files(spark, found, a.scores.split(","))
        order.insert(0, F.desc("score"))
    if a.filter_max_size:
        found = ranges.max_size(found, a.filter_max_size)
    if a.region_size:
        found = ranges.resize_centre(found, a.region_size)
    if a.print_statistics:
        emit(intervals.label_statistics(found).select("n", F.format_string("%d sets: %f", "n", "share").alias("line")), None, ["n"])
    emit_table(ranges.by_rank(found, order), a.output, strand=False)


# ---- sequences ----


@tool("fasta-extract", arg("sequences"), arg("regions"), OUTPUT, arg("--output-format", choices=["fasta", "table"], default="fasta"))
def fasta_extract(spark, a):
    cut = whole_or_regions(spark, a.sequences, a.regions)
    if a.output_format == "table":
        emit_table(cut.withColumnRenamed("bases", "sequences"), a.output, strand=False)
        return
    name = F.format_string(">%s|%d|%d", "seqname", "from", "to")
    emit(cut.select("row_id", F.concat_ws("\n", name, F.regexp_replace("bases", "(.{80})(?=.)", "$1\n")).alias("line")), a.output, ["row_id"])


@tool("fasta-unresolved-regions", arg("sequences"), OUTPUT)
def fasta_unresolved_regions(spark, a):
    found = dna.unresolved(text.read_fasta(spark, a.sequences))
    emit(found.select("seqname", "from", text.bed_line(found, 3).alias("line")), a.output, ["seqname", "from"])


@tool("observed-over-expected-cpg", arg("sequences"), arg("regions", nargs="?"), arg("--output-format", choices=["table", "vector"], default="table"))
def observed_over_expected_cpg(spark, a):
    scored = whole_or_regions(spark, a.sequences, a.regions).withColumn("CpG", dna.cpg_score(F.col("bases"))).drop("bases")
    if a.output_format == "table":
        emit_table(scored, None, strand=False)
    else:
        emit(scored.select("row_id", F.col("CpG").cast("string").alias("line")), None, ["row_id"])


def _equivalence(a) -> kmers.Equivalence:
    most = tuple(int(x) for x in a.max_ambiguous.split(","))
    return kmers.Equivalence(a.low, a.high, a.complement, a.reverse, a.revcomp, () if most == (-1,) else most, ALPHABETS[a.alphabet])


@tool("count-kmers", *KMERS, arg("input"), OUTPUT, *KMER_OPTIONS, *[arg(f"--{x}", action="store_true") for x in ("header", "human", "sparse")])
def count_kmers(spark, a):
    eq = _equivalence(a)
    cut = whole_or_regions(spark, a.input, a.regions)
    counts = kmers.count_kmers(cut.withColumnRenamed("bases", "sequence"), eq, "row_id", presence=a.binary)
    listed = kmers.sparse_text(counts) if a.sparse else kmers.human_text(counts) if a.human else kmers.dense(counts)
    column = "text" if a.sparse or a.human else "counts"
    named = cut.drop("bases").join(listed.select(F.col("id").alias("row_id"), F.col(column).alias("k-mers")), "row_id", "left")
    lines = text.table_lines(named, True, False)
    if a.header:
        names = kmers.catalogue(counts).select("k", "class_id", "kmer").collect()  # the classes seen
        head = [(i - len(names) - 1, f"# {'|'.join(kmers.class_of(r['kmer'], eq)[2])}") for i, r in enumerate(names)]
        lines = lines.unionByName(spark.createDataFrame(head, "row_id long, line string"))
    emit(lines, a.output, ["row_id"])


@tool("sequence-similarity", *KMERS, arg("reference"), arg("input"), OUTPUT, *KMER_OPTIONS, arg("--format", choices=["granges", "table"], default="granges"), arg("--measure", choices=["cosine", "tanimoto", "dot-product"], default="cosine"), arg("--step-size", type=int, default=-1))
def sequence_similarity(spark, a):
    eq = _equivalence(a)
    reference = text.read_fasta(spark, a.reference)
    size = reference.select(F.length("sequence")).collect()
    if len(size) != 1:
        raise SystemExit("the reference has one sequence")
    cut = whole_or_regions(spark, a.input, a.regions)
    found = kmers.sequence_similarity(reference, cut.select("row_id", F.col("bases").alias("sequence")), eq, size[0][0], a.step_size, a.measure, a.binary)
    listed = cut.drop("bases").join(found, "row_id", "left").withColumn("similarities", F.coalesce("similarities", F.array().cast("array<double>")))
    if a.format == "granges":
        emit_table(listed, a.output, strand=False)
    else:
        emit(listed.select("row_id", F.array_join(F.transform("similarities", lambda x: F.format_string("%8.4f", x)), " ").alias("line")), a.output, ["row_id"])


@tool("meme-extract", INPUT, arg("basename"), arg("--pseudo-probability", type=float, default=-0.00001), arg("--filter-e-value", type=float, default=0.05), arg("--input-format", choices=["meme", "dreme"], default="meme"), arg("--output-format", choices=["table", "jaspar"], default="table"), arg("--output-type", choices=["pwm", "ppm"], default="pwm"))
def meme_extract(spark, a):
    found = pwm.motifs(Path(a.input).read_text(), a.pseudo_probability, a.output_type == "pwm", a.filter_e_value)
    for i, (name, matrix) in enumerate(found, 1):
        target = Path(f"{a.basename}-{i}.{a.output_format}")
        target.write_text(pwm.write_table(matrix) if a.output_format == "table" else pwm.write_jaspar(matrix, name))


@tool("pwm-scan-regions", arg("sequences"), arg("matrices", nargs="+"), arg("--input"), arg("--input-columns", type=int, choices=[3, 6, 9], default=3), arg("--output"), arg("--summary", choices=["max", "mean"], default="max"))
def pwm_scan_regions(spark, a):
    tables = [pwm.read_matrix(Path(p).read_text()) for p in a.matrices]
    cut = whole_or_regions(spark, a.sequences, a.input, a.input_columns)
    emit_table(pwm.scan_regions(cut, tables, a.summary == "mean").drop("bases"), a.output)


@tool("pwm-scan-sequences", arg("matrix"), INPUT, arg("output"), arg("--bin-summary", choices=STATISTICS, default="max"), arg("--bin-size", type=int, default=10))
def pwm_scan_sequences(spark, a):
    found = text.read_fasta(spark, a.input)
    track = pwm.scan_sequences(found, pwm.read_matrix(Path(a.matrix).read_text()), a.bin_size, a.bin_summary)
    genome = found.select(F.col("idx").cast("int").alias("idx"), "seqname", F.length("sequence").cast("long").alias("length"))
    bigwig.write_bigwig(track, genome, a.output, a.bin_size)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanloom", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="tool", required=True, metavar="TOOL")
    for name, (_, arguments) in TOOLS.items():
        own = commands.add_parser(name)
        for names, options in arguments:
            own.add_argument(*names, **options)
    a = parser.parse_args(argv)
    TOOLS[a.tool][0](ship_package(spark or local_session()), a)
    return 0
