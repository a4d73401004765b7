"""Coverage, smoothing, correlation and the formats of tracks."""

import math

import pytest

from spanloom.operators import stats, tracks
from spanloom.sources import bam, bigwig, text


def genome(spark, *g):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(g)], "idx int, seqname string, length long")


def track(spark, values, name="c"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "seqname string, bin long, value double")


def values(df):
    return [r.value for r in df.orderBy("bin").collect()]


def test_mean_overlap(spark):
    r = spark.createDataFrame([("c", 98, 231), ("c", 173, 286), ("c", 0, 33)], "seqname string, `from` long, `to` long")
    got = values(tracks.coverage(r, genome(spark, ("c", 300)), 100, "mean overlap"))
    assert got == pytest.approx([0.35, 1.27, 1.17])


@pytest.mark.parametrize(
    "x,low,sizes,want",
    [
        ([10, 10, 10, 20, 20, 10, 5, 5, 2], 20, [1, 2, 3, 4], [10, 10, 10, 20, 20, 15, 20 / 3, 5.5, 5.5]),
        ([10, 2, 5, 2, 2, 1, 5, 5, 2], 20, [1, 2, 3, 4, 5], [4.2, 4.2, 4.2, 2.4, 3, 3, 3, 3, 3]),
    ],
)
def test_smooth(spark, x, low, sizes, want):
    g = genome(spark, ("c", 9))
    for chunk in (4, 65536):
        assert values(tracks.smooth(track(spark, x), low, sizes, g, 1, chunk)) == pytest.approx(want)


def test_windows_do_not_depend_on_chunks(spark):
    t = track(spark, [1, 5, 2, 8, 3, 9, 4])
    from pyspark.sql import functions as F

    total = lambda a: F.aggregate(F.filter(a, lambda v: ~F.isnan(v)), F.lit(0.0), lambda s, v: s + v)
    assert values(tracks.window_map(t, 3, total, chunk=2)) == values(tracks.window_map(t, 3, total)) == [6, 8, 15, 13, 20, 16, 13]


def test_cross_correlation(spark):
    a, b = [0, 3, 1, 0, 2, 5, 0, 1], [1, 0, 4, 0, 0, 2, 6, 0]
    g = genome(spark, ("c", 8))
    got = {r.lag: r.value for r in stats.cross_correlation(track(spark, a), track(spark, b), g, 1, 0, 4).collect()}
    n, ma, mb = 8, sum(a) / 8, sum(b) / 8
    v = math.sqrt((sum(x * x for x in a) / n - ma**2) * (sum(x * x for x in b) / n - mb**2))
    for lag in range(4):
        assert got[lag] == pytest.approx(sum((a[i] - ma) * (b[i + lag] - mb) for i in range(8 - lag)) / n / v)


def test_bigwig_round_trip(spark, tmp_path):
    nan = float("nan")
    x, y = [nan, 0.0, 1.5, 4.5, nan, 1.0, 8.0], [nan, nan, nan, 2.5, nan]
    path = str(tmp_path / "t.bw")
    both = track(spark, x, "a").unionByName(track(spark, y, "b"))
    bigwig.write_bigwig(both.where("not isnan(value)"), genome(spark, ("a", 70), ("b", 50)), path, 10)
    got = {(r.seqname, r.bin): r.value for r in bigwig.read_track(spark, path, 10).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 1.5, ("a", 3): 4.5, ("a", 5): 1.0, ("a", 6): 8.0, ("b", 3): 2.5}
    assert [tuple(r) for r in bigwig.read_bigwig(spark, path).where("seqname = 'b' and `from` < 40").collect()] == [("b", 30, 40, 2.5)]
    assert bigwig.BigWig(path).bin_size() == 10
    assert [r.seqname for r in bigwig.read_genome(spark, path).collect()] == ["a", "b"]
    bigwig.rename_chromosomes(path, str(tmp_path / "u.bw"), "^", "chr")
    assert {r.seqname for r in bigwig.read_bigwig(spark, str(tmp_path / "u.bw")).collect()} == {"chra", "chrb"}


def test_wig_round_trip(spark, tmp_path):
    nan = float("nan")
    both = track(spark, [nan, 0.0, 1.5, 4.5, 2.0, nan, 1.0, 8.0], "a").unionByName(track(spark, [nan, nan, 0.0, 2.5, nan], "b"))
    text.write_wig(both, str(tmp_path / "w"), 10)
    got = {(r.seqname, r.bin): r.value for r in text.read_wig(spark, str(tmp_path / "w"), 10).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 1.5, ("a", 3): 4.5, ("a", 4): 2.0, ("a", 6): 1.0, ("a", 7): 8.0, ("b", 2): 0.0, ("b", 3): 2.5}


def test_bam(spark, tmp_path):
    path = str(tmp_path / "t.bam")
    bam.write_bam(path, [("c", 100)], [{"name": "x", "pos": 3, "flag": 0, "mapq": 9, "cigar": [(6, "M"), (14, "N"), (1, "I"), (5, "M")], "seq": "ACGTA", "tags": b"NMC\x02"}, {"name": "u", "pos": -1, "ref": -1, "flag": 4}])
    got = bam.read_bam(spark, path)
    r = got.where("name = 'x'").first()
    assert (r.pos, r.length, r.cigar, r.sequence, r.tags) == (3, 25, "6M14N1I5M", "ACGTA", {"NM": "2"})
    assert [(x["from"], x["to"]) for x in bam.single_end_ranges(got).collect()] == [(3, 28)]


def test_text_formats(spark, tmp_path):
    p = tmp_path / "a.bed"
    p.write_text("track x\nchr1\t1\t5\tn\t3\t.\nchr2\t2\t6\tm\t4\t-\n")
    r = text.read_bed(spark, str(p))
    assert sorted((x.seqname, x["from"], x.strand, x.score) for x in r.collect()) == [("chr1", 1, "*", 3), ("chr2", 2, "-", 4)]
    text.write_bed(r, str(tmp_path / "out"), 9, compress=True)
    assert text.read_bed(spark, str(tmp_path / "out"), 9).count() == 2
    f = tmp_path / "a.fa"
    f.write_text(">a|x\nACGT\nAC\n>b y\nGG\n")
    assert sorted((x.seqname, x.sequence) for x in text.read_fasta(spark, str(f)).collect()) == [("a", "ACGTAC"), ("b", "GG")]
    t = tmp_path / "a.table"
    t.write_text("seqnames from to strand v\nc 1 5 + 1,2\nc 7 9 - nil\n")
    x = text.read_table(spark, str(t), {"v": "[][]int"}).orderBy("from").collect()
    assert [(r["from"], r["v"]) for r in x] == [(1, [1, 2]), (7, [])]
    g = tmp_path / "a.gtf"
    g.write_text('c\ts\texon\t1\t9\t.\t+\t.\tgene_id "g 1"; FPKM "2.5";\n')
    assert text.read_gtf(spark, str(g), {"gene_id": "string", "FPKM": "double"}).select("gene_id", "FPKM").first()[:] == ("g 1", 2.5)


def test_last_counts_of_a_stream(spark, tmp_path):
    """Windows still open are counted over all batches; the result is read from files, not from the driver's memory."""
    from spanloom.streaming import coverage as streams

    g = spark.createDataFrame([(0, "c", 100)], "idx int, seqname string, length long")
    reads = spark.range(40).selectExpr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts", "'c' as seqname", "id as `from`", "id + 1 as `to`")
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = streams.stream_coverage(stream, g, 10, "ts", "20 minutes")
    last = streams.to_last(counted, str(tmp_path / "out"), str(tmp_path / "state"))
    assert last.inputFiles() and sorted((r["bin"], r["value"]) for r in last.collect()) == [(i, 10) for i in range(4)]
