"""From alignment files to a normalised track: pairing, filters, fragment lengths, counts, control, scale."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bam
from . import ranges, stats, tracks
from . import reads as rd

#: The longest delay that the fragment length estimate looks at, in bases.
MOST_DELAY = 2000


@dataclass
class Settings:
    """How reads become a track; the defaults filter nothing and scale nothing."""

    bin_size: int = 10
    method: str = "simple"
    normalize_by: str = ""
    pseudocounts: tuple[float, float] = (0.0, 0.0)
    log: bool = False
    paired_as_single: bool = False
    strand_specific: bool = False
    paired: bool | None = None
    strand: str | None = None
    mapq: int = 0
    duplicates: bool = True
    lengths: tuple[int, int] = (0, 0)
    shift: tuple[int, int] = (0, 0)
    smooth_control: tuple[float, list[int]] | None = None
    filtered: list[str] = field(default_factory=list)
    remove_filtered: bool = False
    estimate: bool = False
    feasible: tuple[int | None, int | None] = (None, None)
    estimate_bin: int = 10
    #: Told (file, step, reads left) after every filter; each count is a pass over the file.
    watch: Callable[[str, str, int], None] | None = None


def genome_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' genome, which must be the same in all."""
    first, *rest = [bam.read_genome(spark, p) for p in paths]
    if not all(ranges.genomes_equal(first, g) for g in rest):
        raise ValueError("the files have different genomes")
    return first


def load_reads(spark: SparkSession, path: str, s: Settings) -> DataFrame:
    """A file's reads after the filters and shifts, in their order."""
    some = bam.read_bam(spark, path, ["name", "seqname", "pos", "length", "flag", "mapq"])
    out = rd.join_mates(some, s.strand_specific, not s.paired_as_single)
    steps = [
        ("paired-end" if s.paired else "single-end", {"paired": s.paired}),
        ("read length", {"min_length": s.lengths[0], "max_length": s.lengths[1]}),
        ("duplicates", {"duplicates": s.duplicates}),
        ("mapping quality", {"mapq": s.mapq}),
        ("strand", {"strand": s.strand}),
    ]
    for name, options in steps:
        out = rd.filter_reads(out, **options)
        if s.watch:
            s.watch(path, name, out.count())
    return rd.shift_reads(out, *s.shift) if any(s.shift) else out


def estimate_fragment_length(reads: DataFrame, genome: DataFrame, most_delay: int = MOST_DELAY, bin_size: int = 10, feasible: tuple[int | None, int | None] = (None, None)) -> tuple[int, DataFrame]:
    """The lag of the highest peak of the strands' cross-correlation, and the cross-correlation.

    Peaks lie in [from, to): by default from one and a half times the length of what is
    correlated - the reads' first bases, so 1 - to the longest delay. No peak is an
    error, and so is a correlation that is higher still at the longest delay.
    """
    correlation = stats.read_cross_correlation(reads, genome, most_delay, bin_size)
    low = 1 if feasible[0] is None else feasible[0]
    high = most_delay if feasible[1] is None else feasible[1]
    return stats.fragment_length(correlation, low, high), correlation


def bam_track(spark: SparkSession, treatment: list[tuple[str, int | None]], control: list[tuple[str, int | None]] = (), settings: Settings | None = None) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, DataFrame]]]:
    """The track of files with their fragment lengths (None: estimated if asked, else reads as they are).

    Returns the dense track, the genome, and by file the estimates that were made.
    """
    s = settings or Settings()
    genome = genome_of(spark, [p for p, _ in (*treatment, *control)])
    found: dict[str, tuple[int, DataFrame]] = {}

    def one(files: list[tuple[str, int | None]]) -> DataFrame:
        parts = None
        for path, length in files:
            reads = load_reads(spark, path, s)
            if length is None and s.estimate:
                found[path] = estimate_fragment_length(reads, genome, MOST_DELAY, s.estimate_bin, s.feasible)
                length = found[path][0]
            own = rd.extend_reads(reads, length or 0)
            parts = own if parts is None else parts.unionByName(own)
        return parts

    chosen = {"remove": s.filtered} if s.remove_filtered else {"zero": s.filtered}
    track = tracks.bam_coverage(
        one(treatment), genome, one(control) if control else None, s.bin_size, s.method,
        normalize_by=s.normalize_by, pseudocounts=s.pseudocounts, log=s.log, smooth_control=s.smooth_control, **chosen,
    )
    kept = genome.where(~F.col("seqname").isin(*s.filtered)) if s.remove_filtered and s.filtered else genome
    return track, kept, found
