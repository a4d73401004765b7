"""Read processing: pairing, filters, shifts, flags, CIGARs. All lazy row operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ["paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "not_passing", "duplicate"]


def flag(column: str, name: str) -> Column:
    return F.col(column).bitwiseAND(1 << FLAGS.index(name)) != 0


def cigar_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR string covers: M, D, N, = and X."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def to_reads(df: DataFrame) -> DataFrame:
    """Ranges of alignments as reads: mapq, duplicate by flag, not paired."""
    dup = flag("flag", "duplicate") if "flag" in df.columns else F.lit(False)
    q = F.col("mapq") if "mapq" in df.columns else F.lit(0)
    return df.select("seqname", "from", "to", "strand", q.alias("mapq"), dup.alias("duplicate"), F.lit(False).alias("paired"))


def mates(alignments: DataFrame) -> DataFrame:
    """name, pair, e: consecutive occurrences of a name two by two, in the order of position.

    A name's occurrences are few in sound files; a name that occurs without bound
    is sorted by the engine, which spills, and its pairs are rows of their own.
    """
    numbered = alignments.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("pos", "flag")) - 1)
    cells = F.collect_list(F.struct("pos", "flag", "length", "mapq", "seqname"))
    return numbered.groupBy("name", F.expr("n div 2").alias("pair")).agg(F.array_sort(cells).alias("e"))


def join_mates(alignments: DataFrame, strand_specific: bool = False, pairs: bool = True) -> DataFrame:
    """Reads from alignments (name, seqname, pos, length, flag, mapq): proper pairs joined, other mapped ends alone.

    Mates are consecutive occurrences of a name, in the order of position.
    """
    a = alignments.where(~flag("flag", "unmapped") & F.col("seqname").isNotNull())
    strand = F.when(flag("flag", "reverse"), "-").otherwise("+")
    single = lambda df: df.select("seqname", F.col("pos").alias("from"), (F.col("pos") + F.col("length")).alias("to"), strand.alias("strand"), "mapq", flag("flag", "duplicate").alias("duplicate"), F.lit(False).alias("paired"))
    if not pairs:
        return single(a)
    proper = flag("flag", "proper_pair") & flag("flag", "paired") & ~flag("flag", "secondary")
    ends = mates(a.where(proper))
    b1, b2 = F.col("e")[0], F.get("e", F.lit(1))
    both = (F.size("e") == 2) & (b1["seqname"] == b2["seqname"])
    bit = lambda b, name: b["flag"].bitwiseAND(1 << FLAGS.index(name)) != 0
    reverse = F.when(bit(b1, "second"), bit(b1, "reverse")).otherwise(bit(b2, "reverse"))
    side = F.when(reverse, "-").otherwise("+") if strand_specific else F.lit("*")
    joined = ends.where(both).select(b1["seqname"].alias("seqname"), b1["pos"].alias("from"), (b2["pos"] + b2["length"]).alias("to"), side.alias("strand"), F.least(b1["mapq"], b2["mapq"]).alias("mapq"), (bit(b1, "duplicate") | bit(b2, "duplicate")).alias("duplicate"), F.lit(True).alias("paired"))
    alone = ends.where(~F.coalesce(both, F.lit(False))).select(F.inline("e"))
    return joined.unionByName(single(alone)).unionByName(single(a.where(~proper)))


def as_single(reads: DataFrame) -> DataFrame:
    return reads.withColumn("paired", F.lit(False))


def filter_reads(reads: DataFrame, paired: bool | None = None, duplicates: bool = True, strand: str | None = None, mapq: int = 0, min_length: int = 0, max_length: int = 0) -> DataFrame:
    """The read filters: paired or single only, no duplicates, strand, quality, length (0: no bound)."""
    keep = F.lit(True)
    if paired is not None:
        keep = keep & (F.col("paired") == paired)
    if not duplicates:
        keep = keep & ~F.col("duplicate")
    if strand:
        keep = keep & (F.col("strand") == strand)
    if mapq > 0:
        keep = keep & (F.col("mapq") >= mapq)
    size = F.col("to") - F.col("from")
    if min_length:
        keep = keep & (size >= min_length)
    if max_length:
        keep = keep & (size <= max_length)
    return reads.where(keep)


def observed(reads: DataFrame, name: str) -> DataFrame:
    """Count what passes here, as a metric of the query (no extra job)."""
    return reads.observe(name, F.count(F.lit(1)).alias("n"))


def shift_reads(reads: DataFrame, forward: int, reverse: int) -> DataFrame:
    """Shift by strand; a start below 0 moves to 0 with the length kept."""
    by = F.when(F.col("strand") == "+", forward).when(F.col("strand") == "-", reverse).otherwise(0)
    moved = F.greatest(F.col("from") + by, F.lit(0))
    return reads.withColumns({"from": moved, "to": moved + (F.col("to") - F.col("from"))})


def extend_reads(reads: DataFrame, length: int) -> DataFrame:
    """Single reads get a fragment length from their 5' end; unstranded single reads are dropped."""
    if length <= 0:
        return reads
    alone = ~F.col("paired")
    start = F.when(alone & (F.col("strand") == "-"), F.greatest(F.col("to") - length, F.lit(0))).otherwise(F.col("from"))
    stop = F.when(alone & (F.col("strand") == "+"), F.col("from") + length).otherwise(F.col("to"))
    return reads.where(~alone | (F.col("strand") != "*")).withColumns({"from": start, "to": stop})


def bam_bin(start: Column, stop: Column) -> Column:
    """The index bin of [start, stop) in the 14-17-20-23-26 bit scheme."""
    last = stop - 1
    out = F.lit(0).cast("long")
    for bits in (26, 23, 20, 17, 14):
        offset = ((1 << (29 - bits)) - 1) // 7
        out = F.when(F.shiftright(start, bits) == F.shiftright(last, bits), F.shiftright(start, bits) + offset).otherwise(out)
    return out
