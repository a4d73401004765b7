"""Queries that write a format and read it back, and the same in SQL over the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, joins, ranges, segments, stats, tracks
from ..operators import reads as rd
from ..sources import bam, bigwig, text
from . import tables as t
from .queries import _DENSE, _dense_track, query
from .scratch import folder, uri

NAMED = f"(SELECT row_id, seqname, f, t, strand, replace(name, ' ', '_') AS name FROM {t.QUERIES})"


def named(spark, d) -> DataFrame:
    """The orders' ranges with a name that has no blanks, and a score."""
    return t.queries(spark, d).withColumns({"name": F.regexp_replace("name", " ", "_"), "score": F.col("row_id") % 1000})


def _place(spark, name: str) -> tuple[str, str]:
    path = f"{folder(spark)}/{name}"
    return path, uri(path)


def _range(df: DataFrame, *more) -> DataFrame:
    return df.select("seqname", F.col("from").alias("start"), F.col("to").alias("stop"), *more)


@query(f"SELECT seqname, f AS start, t AS stop FROM {t.SUBJECTS}")
def bed3_file(spark, d):
    _, at = _place(spark, "x.bed")
    text.write_bed(t.subjects(spark, d), at, 3)
    return _range(text.read_bed(spark, at, 3))


@query(f"SELECT seqname, f AS start, t AS stop, strand, name, row_id % 1000 AS score FROM {NAMED}")
def bed6_file(spark, d):
    _, at = _place(spark, "x.bed")
    text.write_bed(named(spark, d), at, 6, compress=True)
    return _range(text.read_bed(spark, at, 6), "strand", "name", "score")


@query(f"SELECT seqname, f AS start, t AS stop, strand, name, f AS thick_start, t AS thick_end, '0,0,0' AS colour FROM {NAMED}")
def bed9_file(spark, d):
    _, at = _place(spark, "x.bed")
    text.write_bed(named(spark, d), at, 9)
    got = text.read_bed(spark, at, 9)
    return _range(got, "strand", "name", F.col("thickStart").alias("thick_start"), F.col("thickEnd").alias("thick_end"), F.col("itemRgb").alias("colour"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS place, name FROM {NAMED}")
def row_positions(spark, d):
    """Rows of a file are numbered by position, over its partitions."""
    _, at = _place(spark, "x.bed")
    text.write_bed(ranges.by_rank(named(spark, d), [F.col("row_id")]), at, 6)
    got = text.read_bed(spark, at, 6)
    n = got.count()
    halves = [ranges.slice_rows(got, 0, n // 2), ranges.slice_rows(got, n // 2, n)]
    return halves[0].unionByName(halves[1]).select(F.col("row_id").alias("place"), "name")


@query(f"SELECT seqname, f AS start, t AS stop, score AS value FROM {t.SUBJECTS}")
def bedgraph_file(spark, d):
    _, at = _place(spark, "x.bedGraph")
    text.write_bedgraph(t.subjects(spark, d).withColumnRenamed("score", "values"), at)
    return _range(text.read_bedgraph(spark, at), F.col("values").alias("value"))


@query(f"WITH {_DENSE} SELECT seqname, bin, value FROM dense")
def bedgraph_track_file(spark, d):
    g = t.genome(spark, t.READ_LENGTH)
    _, at = _place(spark, "x.bedGraph")
    rows = intervals.runs_to_ranges(_dense_track(spark, d), 100).withColumnRenamed("value", "values")
    head = spark.createDataFrame([(0, "track type=bedGraph")], "n int, line string")
    lines = rows.select(F.lit(1).alias("n"), F.concat_ws("\t", "seqname", F.col("from").cast("string"), F.col("to").cast("string"), F.col("values").cast("string")).alias("line"))
    head.unionByName(lines).orderBy("n").coalesce(1).select("line").write.text(at)
    return text.read_bedgraph_track(spark, at, g, 100)


@query(f"WITH {_DENSE} SELECT seqname, bin, value FROM dense WHERE value > 0")
def wiggle_file(spark, d):
    """Bins without reads are missing, so blocks break."""
    _, at = _place(spark, "x.wig")
    track = _dense_track(spark, d)
    text.write_wig(track.withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(float("nan")))), at, 100)
    return text.read_wig(spark, at, 100)


@query(f"SELECT seqname, f AS start, t AS stop, strand, 'orders' AS source, name AS feature, CAST(row_id % 1000 AS DOUBLE) AS score, -1 AS frame, 'id ' || row_id AS label FROM {NAMED}")
def gtf_file(spark, d):
    _, at = _place(spark, "x.gtf")
    rows = named(spark, d).withColumnRenamed("name", "feature").withColumns({"source": F.lit("orders"), "frame": F.lit(-1), "label": F.concat(F.lit("id "), F.col("row_id").cast("string"))})
    text.write_gtf(rows, at)
    return _range(text.read_gtf(spark, at, {"label": "string"}), "strand", "source", "feature", "score", "frame", "label")


@query(f"SELECT seqname, f AS start, t AS stop, strand, name, row_id % 1000 AS score, row_id::VARCHAR || ',' || (row_id + 1)::VARCHAR AS marks FROM {NAMED}")
def range_table_file(spark, d):
    _, at = _place(spark, "x.table")
    text.write_table(named(spark, d).withColumn("marks", F.array("row_id", F.col("row_id") + 1)), at)
    got = text.read_table(spark, at, {"name": "[]string", "score": "[]int", "marks": "[][]int"})
    return _range(got, "strand", "name", "score", F.array_join(F.col("marks").cast("array<string>"), ",").alias("marks"))


@query(f"SELECT name, row_id % 1000 AS score FROM {NAMED}")
def meta_table_file(spark, d):
    _, at = _place(spark, "x.table")
    text.write_table(named(spark, d), at)
    return text.read_meta(spark, at, {"name": "[]string", "score": "[]int"}).select("name", "score")


def genes(spark, d) -> DataFrame:
    rows = t.queries(spark, d).where("strand <> '*'")
    cds = F.struct((F.col("from") + 10).alias("from"), (F.col("to") - 10).alias("to"))
    return rows.withColumns({"names": F.concat(F.lit("gene"), (F.col("row_id") % 500).cast("string")), "cds": cds})


GENES = f"(SELECT *, 'gene' || (row_id % 500) AS gene FROM {t.QUERIES} WHERE strand <> '*')"


@query(f"SELECT seqname, f AS start, t AS stop, strand, gene AS name, f + 10 AS cds_start, t - 10 AS cds_stop FROM {GENES}")
def genes_file(spark, d):
    _, at = _place(spark, "genes.txt")
    text.write_genes(genes(spark, d), at)
    return _range(text.read_genes(spark, at), "strand", F.col("names").alias("name"), F.col("cds.from").alias("cds_start"), F.col("cds.to").alias("cds_stop"))


@query(f"WITH g AS {GENES}, e AS (SELECT 'gene' || (row_id % 700) AS gene, sum(score) AS expr FROM {t.SUBJECTS} GROUP BY 1) SELECT g.row_id, coalesce(expr, 0.0) AS expr FROM g LEFT JOIN e USING (gene)")
def gene_expression_file(spark, d):
    _, at = _place(spark, "x.gtf")
    rows = t.subjects(spark, d).withColumn("gene_id", F.concat(F.lit("gene"), (F.col("row_id") % 700).cast("string"))).withColumnRenamed("score", "FPKM")
    text.write_gtf(rows, at)
    return text.read_gene_expression(spark, at, genes(spark, d), "gene_id", "FPKM").select("row_id", "expr")


@query(f"WITH g AS {GENES}, e AS (SELECT 'gene' || (row_id % 700) AS gene, sum(score) AS expr FROM {t.SUBJECTS} WHERE strand = '+' GROUP BY 1) SELECT g.row_id, coalesce(expr, 0.0) AS expr FROM g LEFT JOIN e USING (gene)")
def fpkm_file(spark, d):
    _, at = _place(spark, "x.fpkm_tracking")
    names = ["tracking_id", "class_code", "nearest_ref_id", "gene_id", "gene_short_name", "tss_id", "locus", "length", "coverage", "FPKM", "FPKM_lo", "FPKM_hi", "FPKM_status"]
    own = {"gene_id": F.concat(F.lit("gene"), (F.col("row_id") % 700).cast("string")), "FPKM": F.col("score"), "FPKM_status": F.when(F.col("strand") == "+", "OK").otherwise("LOWDATA")}
    t.subjects(spark, d).select(*[own.get(n, F.lit("-")).alias(n) for n in names]).write.csv(at, sep="\t", header=True)
    return text.read_fpkm(spark, at, genes(spark, d)).select("row_id", "expr")


@query(f"SELECT seqname, f AS start, t AS stop, CAST(f AS DOUBLE) AS summit, CAST(score AS DOUBLE) AS pileup, CAST(row_id % 7 AS DOUBLE) AS fold FROM {t.SUBJECTS}")
def peaks_file(spark, d):
    _, at = _place(spark, "peaks.xls")
    cells = ["seqname", F.col("from").cast("string"), (F.col("to") - 1).cast("string"), F.lit("1"), F.col("from").cast("string"), F.col("score").cast("string"), F.lit("0.5"), (F.col("row_id") % 7).cast("string"), F.lit("0.5"), F.concat(F.lit("p"), F.col("row_id").cast("string"))]
    head = "# called peaks\n" + "\t".join(text.PEAK_COLUMNS)
    lines = t.subjects(spark, d).select(text.headed(F.concat_ws("\t", *cells), head).alias("line"))
    spark.createDataFrame([(head,)], "line string").unionByName(lines).write.text(at)
    return _range(text.read_peaks(spark, at), F.col("abs_summit").alias("summit"), "pileup", F.col("fold_enrichment").alias("fold"))


@query(f"SELECT CAST(i - 1 AS INTEGER) AS idx, 'chr' || i AS seqname, CAST({t.LENGTH} AS BIGINT) AS length FROM range(1, 6) x(i)")
def genome_file(spark, d):
    _, at = _place(spark, "x.genome")
    t.genome(spark).orderBy("idx").coalesce(1).select(F.concat_ws("\t", "seqname", "length").alias("line")).write.text(at)
    return text.read_genome(spark, at)


@query(f"SELECT 's' || seqname AS seqname, sequence FROM {t.SEQUENCES}")
def fasta_file(spark, d):
    """Headers hold descriptions with a > of their own."""
    _, at = _place(spark, "x.fa")
    rows = t.sequences(spark, d).select(F.concat(F.lit("s"), "seqname", F.lit(" a > b")).alias("seqname"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    text.write_fasta(rows, at)
    return text.read_fasta(spark, at).select("seqname", "sequence")


@query(f"WITH {_DENSE} SELECT seqname, bin, value FROM dense")
def chromatin_states_file(spark, d):
    base, _ = _place(spark, "")
    track = _dense_track(spark, d)
    lines = track.select("seqname", "bin", F.concat_ws("\t", F.lit("0.5"), F.col("value").cast("string")).alias("line"))
    names = [f"chr{i}" for i in range(1, 6)]
    heads = spark.createDataFrame([(n, i, x) for n in names for i, x in ((-2, f"cell\t{n}"), (-1, "E1\tE2"))], "seqname string, bin long, line string")
    for n in names:  # a file for each sequence
        own = heads.unionByName(lines).where(F.col("seqname") == n)
        own.orderBy("bin").coalesce(1).select("line").write.text(uri(f"{base}{n}"))
    return text.read_chromatin_states(spark, [uri(f"{base}{n}") for n in names], "E2")


@query(f"SELECT seqname, f AS start, t AS stop, name, CASE name WHEN '1-URGENT' THEN '255,0,0' ELSE '0,255,0' END AS colour FROM {NAMED} WHERE name IN ('1-URGENT', '2-HIGH')")
def segmentation_file(spark, d):
    _, at = _place(spark, "x.bed")
    text.write_segmentation(named(spark, d), at, {"1-URGENT": "255,0,0", "2-HIGH": "0,255,0"})
    return _range(text.read_bed(spark, at, 9), "name", F.col("itemRgb").alias("colour"))


# ---- bigWig ----


@functools.lru_cache(maxsize=8)
def _bigwig(spark, d) -> str:
    path, _ = _place(spark, "x.bw")
    bigwig.write_bigwig(_dense_track(spark, d), t.genome(spark, t.READ_LENGTH), path, 100)
    return path


@query(f"WITH {_DENSE} SELECT seqname, bin * 100 AS start, (bin + 1) * 100 AS stop, value FROM dense")
def bigwig_file(spark, d):
    return _range(bigwig.read_bigwig(spark, _bigwig(spark, d)), "value")


@query(f"WITH {_DENSE} SELECT seqname, bin * 100 AS start, (bin + 1) * 100 AS stop, value FROM dense WHERE seqname = 'chr2' AND bin BETWEEN 100 AND 199")
def bigwig_range(spark, d):
    rows = bigwig.read_bigwig(spark, _bigwig(spark, d))
    return _range(rows.where("seqname = 'chr2' and `from` >= 10000 and `to` <= 20000"), "value")


@query(f"WITH {_DENSE} SELECT seqname, bin // 2 AS bin, max(value) AS value FROM dense WHERE bin < {t.READ_LENGTH} // 200 * 2 GROUP BY ALL")
def bigwig_track(spark, d):
    return bigwig.read_track(spark, _bigwig(spark, d), 200, "max")


@query(f"WITH {_DENSE} SELECT seqname, bin, round(avg(value) OVER (PARTITION BY seqname ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM dense")
def bigwig_track_overlap(spark, d):
    return bigwig.read_track(spark, _bigwig(spark, d), 100, "mean", overlap=1).withColumn("value", F.round("value", 6))


_ZOOMED = f"WITH {_DENSE}, z AS (SELECT seqname, bin // 20 AS b, value FROM dense WHERE bin < {t.READ_LENGTH} // 2000 * 20)"


@query(f"{_ZOOMED} SELECT seqname, b * 2000 AS start, (b + 1) * 2000 AS stop, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM z WHERE seqname <> 'chr5' GROUP BY ALL")
def bigwig_query(spark, d):
    rows = bigwig.query(spark, _bigwig(spark, d), "chr[1-4]", 0, t.READ_LENGTH // 2000 * 2000, 2000)
    return _range(rows, F.col("min").alias("low"), F.col("max").alias("high"), F.round(F.col("sum") / F.col("valid"), 6).alias("mean"))


@query(f"WITH {_DENSE} SELECT seqname, (bin - 10) // 5 AS bin, round(avg(value), 6) AS value FROM dense WHERE seqname = 'chr3' AND bin BETWEEN 10 AND 109 GROUP BY ALL")
def bigwig_query_slice(spark, d):
    return bigwig.query_slice(spark, _bigwig(spark, d), "chr3", 1000, 11_000, 500).withColumn("value", F.round("value", 6))


@query(f"WITH {_DENSE} SELECT bin, value FROM dense WHERE seqname = 'chr4'")
def bigwig_query_sequence(spark, d):
    return bigwig.query_sequence(spark, _bigwig(spark, d), "chr4").select("bin", "value")


@query(f"SELECT CAST(i - 1 AS INTEGER) AS idx, 'seq' || i AS seqname, CAST({t.READ_LENGTH} AS BIGINT) AS length FROM range(1, 6) x(i)")
def bigwig_renamed(spark, d):
    path = _bigwig(spark, d)
    bigwig.rename_chromosomes(path, path + ".renamed", "^chr", "seq")
    return bigwig.read_genome(spark, path + ".renamed")


@query(f"WITH {_DENSE}, q AS (SELECT row_id, seqname, f // 10 AS f FROM {t.QUERIES}), x AS (SELECT q.row_id, unnest([0, 1, 2]) AS i, q.seqname, q.f FROM q) SELECT row_id, string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS counts FROM x LEFT JOIN dense ON dense.seqname = x.seqname AND dense.bin = (x.f + i * 100) // 100 GROUP BY row_id")
def bigwig_ranges_column(spark, d):
    start = F.expr("`from` div 10")
    regions = t.queries(spark, d).withColumns({"from": start, "to": start + 300})
    track = bigwig.read_track(spark, _bigwig(spark, d))
    got = tracks.track_to_ranges_column(regions, track, "counts", 100)
    return got.select("row_id", F.array_join(F.transform("counts", lambda x: x.cast("long").cast("string")), ",").alias("counts"))


_REGION = f"WITH {_DENSE}, q AS (SELECT row_id, seqname, f // 10 AS f, f // 10 + 100 AS t FROM {t.QUERIES}), o AS (SELECT row_id, least(q.t, bin * 100 + 100) - greatest(q.f, bin * 100) AS w, value FROM q JOIN dense ON q.seqname = dense.seqname AND bin BETWEEN q.f // 100 AND (q.t - 1) // 100)"


@query(f"{_REGION} SELECT row_id, round(sum(value * w) / sum(w), 6) AS value FROM o GROUP BY row_id")
def region_values(spark, d):
    start = F.expr("`from` div 10")
    regions = t.queries(spark, d).withColumns({"from": start, "to": start + 100})
    return segments.region_values(spark, regions, _bigwig(spark, d)).withColumn("value", F.round("value", 6))


# ---- alignment files ----

ALIGNMENTS = """(SELECT event_id, 'r' || (event_id // 2) AS name, 'chr' || ((event_id // 2) % 5 + 1) AS seqname, (event_id * 7919) % 100000 AS pos, 25 + event_id % 50 AS len,
  CASE WHEN event_id % 10 < 6 THEN 3 + CASE WHEN event_id % 2 = 0 THEN 64 + 32 ELSE 128 + 16 END WHEN event_id % 10 = 9 THEN 4 ELSE CASE WHEN event_id % 4 = 1 THEN 16 ELSE 0 END END + CASE WHEN event_id % 17 = 0 THEN 1024 ELSE 0 END AS flag,
  event_id % 61 AS mapq FROM events)"""


def alignments(spark, d) -> DataFrame:
    """The events as alignments: six of ten are mates of a proper pair, one is unmapped, the others stand alone."""
    e = F.col("event_id")
    side = F.when(e % 2 == 0, 64 + 32).otherwise(128 + 16)
    alone = F.when(e % 4 == 1, 16).otherwise(0)
    kind = F.when(e % 10 < 6, side + 3).when(e % 10 == 9, 4).otherwise(alone)
    return t.table(spark, d, "events").select(
        e,
        F.concat(F.lit("r"), F.expr("event_id div 2").cast("string")).alias("name"),
        F.concat(F.lit("chr"), (F.expr("event_id div 2") % 5 + 1).cast("string")).alias("seqname"),
        ((e * 7919) % 100000).alias("pos"),
        (e % 50 + 25).alias("length"),
        (kind + F.when(e % 17 == 0, 1024).otherwise(0)).cast("int").alias("flag"),
        (e % 61).cast("int").alias("mapq"),
    )


@functools.lru_cache(maxsize=8)
def _bam(spark, d) -> str:
    path, _ = _place(spark, "x.bam")

    def record(r: dict) -> dict:
        end = r["pos"] + r["length"]
        place = 4681 + (r["pos"] >> 14) if r["pos"] >> 14 == (end - 1) >> 14 else 585 + (r["pos"] >> 17)
        return {"name": r["name"], "ref": int(r["seqname"][3:]) - 1, "pos": r["pos"], "flag": r["flag"], "mapq": r["mapq"], "bin": place, "cigar": [(r["length"] - 5, "M"), (2, "I"), (5, "M")], "seq": "ACGT" * 5, "tags": b"NMC\x03"}

    refs = [(f"chr{i}", t.READ_LENGTH) for i in range(1, 6)]
    bam.write_alignments(alignments(spark, d).orderBy("event_id"), record, path, refs, block=16_384)
    return path


@query(f"SELECT name, seqname, pos, CAST(len AS BIGINT) AS length, CAST(flag AS INTEGER) AS flag, CAST(mapq AS INTEGER) AS mapq, (len - 5) || 'M2I5M' AS cigar, repeat('ACGT', 5) AS sequence, '3' AS edits FROM {ALIGNMENTS}")
def bam_file(spark, d):
    """Cut into many ranges of bytes, each of which finds its own first record."""
    rows = bam.read_bam(spark, _bam(spark, d), split_bytes=20_000)
    return rows.select("name", "seqname", "pos", "length", "flag", "mapq", "cigar", "sequence", F.col("tags")["NM"].alias("edits"))


@query(f"SELECT CAST(i - 1 AS INTEGER) AS idx, 'chr' || i AS seqname, CAST({t.READ_LENGTH} AS BIGINT) AS length FROM range(1, 6) x(i)")
def bam_genome(spark, d):
    return bam.read_genome(spark, _bam(spark, d))


@query(f"SELECT seqname, pos AS start, pos + len AS stop, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CAST(mapq AS INTEGER) AS mapq FROM {ALIGNMENTS} WHERE flag & 4 = 0")
def bam_single_end(spark, d):
    return _range(bam.single_end_ranges(bam.read_bam(spark, _bam(spark, d))), "strand", "mapq")


_MATES = f"a AS {ALIGNMENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY pos, flag) - 1) // 2 AS pair, row_number() OVER (PARTITION BY name ORDER BY pos, flag) AS k FROM a WHERE flag & 3 = 3), m AS (SELECT x.seqname, x.pos AS start, y.pos + y.len AS stop, x.mapq AS q1, y.mapq AS q2, x.flag AS f1, y.flag AS f2, x.name FROM n x JOIN n y ON x.name = y.name AND x.pair = y.pair AND x.k + 1 = y.k)"


@query(f"WITH {_MATES} SELECT seqname, start, stop, CAST(f1 AS INTEGER) AS flag1, CAST(f2 AS INTEGER) AS flag2, CAST(q1 AS INTEGER) AS mapq1, CAST(q2 AS INTEGER) AS mapq2 FROM m")
def bam_paired_end(spark, d):
    return _range(bam.paired_end_ranges(bam.read_bam(spark, _bam(spark, d))), "flag1", "flag2", "mapq1", "mapq2")


@query(f"""WITH {_MATES}, alone AS (SELECT seqname, pos AS start, pos + len AS stop, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CAST(mapq AS INTEGER) AS mapq, flag & 1024 <> 0 AS duplicate, false AS paired FROM a
  WHERE flag & 4 = 0 AND (flag & 3 <> 3 OR name NOT IN (SELECT name FROM m)))
SELECT seqname, start, stop, '*' AS strand, CAST(least(q1, q2) AS INTEGER) AS mapq, f1 & 1024 <> 0 OR f2 & 1024 <> 0 AS duplicate, true AS paired FROM m UNION ALL SELECT * FROM alone""")
def mates(spark, d):
    return _range(rd.join_mates(alignments(spark, d)), "strand", "mapq", "duplicate", "paired")


@query(f"SELECT event_id, flag & 16 <> 0 AS reverse, flag & 1 <> 0 AS paired, flag & 1024 <> 0 AS duplicate, CAST(len AS BIGINT) AS covered FROM {ALIGNMENTS}")
def flags_and_cigars(spark, d):
    cigar = F.concat((F.col("length") - 5).cast("string"), F.lit("M2I5M"))
    f = {n: rd.flag("flag", n) for n in ("reverse", "paired", "duplicate")}
    return alignments(spark, d).select("event_id", *[c.alias(n) for n, c in f.items()], rd.cigar_length(cigar).alias("covered"))


@query(f"SELECT count(*) AS n, count(*) FILTER (flag & 4 = 0) AS mapped, CAST(0 AS BIGINT) AS wrong FROM {ALIGNMENTS}")
def bam_bins(spark, d):
    """The stored index bins are those of the records' places."""
    rows = bam.read_bam(spark, _bam(spark, d), ["name"])
    wrong = rd.bam_bin(F.col("pos"), F.col("pos") + F.col("length")) != F.col("bin")
    return rows.agg(F.count("*").alias("n"), F.count_if(~rd.flag("flag", "unmapped")).alias("mapped"), F.count_if(wrong).alias("wrong"))


@query(f"""WITH r AS (SELECT seqname, pos AS f, pos + len AS t FROM {ALIGNMENTS} WHERE flag & 4 = 0),
g AS (SELECT 'chr' || i AS seqname, unnest(generate_series(0, {t.READ_LENGTH} // 100 - 1)) AS bin FROM range(1, 6) x(i)),
c AS (SELECT seqname, bin, count(*) AS v FROM (SELECT seqname, unnest(generate_series(f // 100, least((t - 1) // 100, {t.READ_LENGTH} // 100 - 1))) AS bin FROM r) GROUP BY ALL)
SELECT seqname, bin, CAST(coalesce(v, 0) + 1.5 AS DOUBLE) AS value FROM g LEFT JOIN c USING (seqname, bin)""")
def bam_track(spark, d):
    from ..operators import coverage

    s = coverage.Settings(bin_size=100, paired_as_single=True, pseudocounts=(1.5, 0.0))
    return coverage.bam_track(spark, [(_bam(spark, d), None)], settings=s)[0]


@query(f"WITH {_DENSE} SELECT seqname, bin, round(value * 1e9 / (100.0 * n), 4) AS value FROM dense, (SELECT count(*) AS n FROM {t.READS} WHERE f // 100 < {t.READ_LENGTH} // 100)".replace("1e9", "1e6"))
def coverage_rpkm(spark, d):
    return tracks.bam_coverage(t.reads(spark, d), t.genome(spark, t.READ_LENGTH), bin_size=100, normalize_by="rpkm").withColumn("value", F.round("value", 4))


@query(f"WITH q AS {t.QUERIES}, d AS (SELECT CAST(doc_id AS VARCHAR) AS s, regexp_replace(lower(text), '[^acgtn]', '', 'g') AS x FROM documents) SELECT q.row_id, substr(x, CAST(q.f % 300 + 1 AS BIGINT), 50) AS bases FROM q JOIN d ON d.s = CAST(q.row_id % 200 AS VARCHAR)")
def slice_sequences(spark, d):
    start = F.col("from") % 300
    regions = t.queries(spark, d).withColumns({"seqname": (F.col("row_id") % 200).cast("string"), "from": start, "to": start + 50})
    known = t.sequences(spark, d)
    return joins.slice_sequences(regions.join(known.select("seqname"), "seqname", "left_semi"), known, piece=64).select("row_id", "bases")


@query(f"WITH {_DENSE} SELECT round(avg(value), 6) AS mean, max(value) AS top FROM dense")
def bigwig_statistics(spark, d):
    s = stats.summary(bigwig.read_track(spark, _bigwig(spark, d)))
    return s.select(F.round("mean", 6).alias("mean"), F.col("max").alias("top"))
