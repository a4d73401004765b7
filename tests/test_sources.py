"""Readers on odd files: splits, remote files, headers, positions."""

import numpy as np
import pytest

from spanloom.operators import ranges
from spanloom.sources import bam, bigwig, text

REFS = [("chr1", 100_000), ("chr2", 5000)]


def records(n):
    rng = np.random.default_rng(1)
    return [
        {"name": f"read{i}", "ref": int(rng.integers(0, 2)), "pos": int(rng.integers(0, 4000)), "flag": int(rng.integers(0, 2048)), "mapq": i % 60,
         "cigar": [(int(rng.integers(1, 90)), "M")], "seq": "".join(rng.choice(list("ACGTN"), int(rng.integers(0, 200))))}
        for i in range(n)
    ]


def test_plain_gzip_alignments(spark, tmp_path):
    import gzip

    path = str(tmp_path / "x.bam")
    bam.write_bam(path, REFS, records(20))
    with gzip.open(path) as f:
        data = f.read()
    with gzip.open(path, "wb") as f:
        f.write(data)
    assert bam.read_bam(spark, path).count() == 20


def test_bigwig_tracks(spark, tmp_path):
    path = str(tmp_path / "x.bw")
    values = [("chr1", np.array([1, 2, np.nan, 4, 5, 6, 7, 8, 9, 10], dtype=float)), ("chr2", np.array([np.nan, 3.0]))]
    bigwig.write_file(path, [("chr1", 100), ("chr2", 20)], values, 10)
    got = {(r["seqname"], r["bin"]): r["value"] for r in bigwig.read_track(spark, path, 20).collect()}
    assert got == {("chr1", 0): 1.5, ("chr1", 1): 4, ("chr1", 2): 5.5, ("chr1", 3): 7.5, ("chr1", 4): 9.5, ("chr2", 0): 3}
    tops = {(r["seqname"], r["bin"]): r["value"] for r in bigwig.read_track(spark, path, 10, "max", overlap=1, init=-1.0).collect()}
    assert [tops["chr1", i] for i in range(10)] == [2, 2, 4, 5, 6, 7, 8, 9, 10, 10] and [tops["chr2", i] for i in range(2)] == [3, 3]
    with pytest.raises(ValueError):
        bigwig.query_sequence(spark, path, "chr9")


def test_zoomed_queries_equal_raw_ones(spark, tmp_path):
    path = str(tmp_path / "x.bw")
    v = np.random.default_rng(2).integers(0, 50, 200_000).astype(float)
    v[::7] = np.nan
    bigwig.write_file(path, [("chr1", 2_000_000)], [("chr1", v)], 10)
    bw = bigwig.BigWig(path)
    assert bw.zoom_for(4000) is not None and bw.zoom_for(30) is None
    bw.close()
    got = {r["from"] // 4000: (r["min"], r["max"], r["sum"] / r["valid"]) for r in bigwig.query(spark, path, "chr1", 0, 2_000_000, 4000).collect()}
    for i, x in enumerate(v.reshape(-1, 400)):
        assert got[i][:2] == (np.nanmin(x), np.nanmax(x)) and abs(got[i][2] - np.nanmean(x)) < 1e-4


def test_positions_over_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bed").write_text("".join(f"chr1\t{10 * i + j}\t{100 + j}\n" for j in range(10)))
    got = text.read_bed(spark, str(tmp_path), 3)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(30))
    assert ranges.slice_rows(got, 5, 25).count() == 20


def test_readers_refuse_bad_files(spark, tmp_path):
    (tmp_path / "p.xls").write_text("chr\tstart\tend\n1\t2\t3\n")
    with pytest.raises(ValueError):
        text.read_peaks(spark, str(tmp_path / "p.xls"))
    (tmp_path / "t.table").write_text("a b\n1 2\n")
    with pytest.raises(ValueError):
        text.read_meta(spark, str(tmp_path / "t.table"), {"c": "string"})
    assert [tuple(r) for r in text.read_meta(spark, str(tmp_path / "t.table"), {"b": "[]int"}).collect()] == [(0, 2)]


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    """A scan begins with the largest files; the numbers go by path and place."""
    at = 0
    for name, size in (("a", 3), ("b", 900), ("c", 40), ("d", 2000)):
        (tmp_path / f"{name}.bed").write_text("".join(f"chr1\t{i}\t{i + 1}\n" for i in range(at, at + size)))
        at += size
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key, value in zip(old, ("4096", "16"), strict=True):
            spark.conf.set(key, value)
        got = text.read_bed(spark, str(tmp_path), 3)
        assert got.where("row_id <> `from`").count() == 0 and got.count() == at
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.fixture
def many_tasks(spark):
    """Small pieces of files, and shuffles that are not put together."""
    new = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_tables_are_written_and_read_by_many_tasks(spark, tmp_path, many_tasks):
    rows = spark.range(3000).selectExpr("id as row_id", "'chr1' as seqname", "id as `from`", "id + 5 as `to`", "'+' as strand", "id % 7 as score")
    text.write_table(rows, str(tmp_path / "x.table"))
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "x.table").glob("part-*"))]
    assert len(files) > 1 and {f[0].split()[-1] for f in files} == {"score"} and sum(len(f) - 1 for f in files) == 3000
    (tmp_path / "one.table").write_text("\n".join([files[0][0], *(line for f in files for line in f[1:])]) + "\n")
    for path in ("x.table", "one.table"):
        got = text.read_table(spark, str(tmp_path / path), {"score": "[]int"})
        assert got.rdd.getNumPartitions() > 1
        assert got.count() == 3000 and got.where("row_id <> `from` or score <> `from` % 7").count() == 0
        meta = text.read_meta(spark, str(tmp_path / path), {"score": "[]int"})
        assert meta.rdd.getNumPartitions() > 1 and meta.count() == 3000 and meta.where("score <> row_id % 7").count() == 0
    text.write_table(rows.limit(0), str(tmp_path / "none.table"))
    assert text.read_table(spark, str(tmp_path / "none.table"), {"score": "[]int"}).count() == 0


def test_alignments_are_written_by_many_tasks(spark, tmp_path, many_tasks):
    """The records come back in the rows' order, and no row goes by the driver."""
    path = str(tmp_path / "x.bam")
    rows = spark.range(5000).selectExpr("id", "id % 900 as pos").repartition(7).orderBy("id")
    bam.write_alignments(rows, lambda r: {"name": f"r{r['id']}", "pos": r["pos"], "flag": 0, "cigar": [(9, "M")], "seq": "ACGTA"}, path, REFS, block=1000)
    for split in (1 << 26, 3000):
        got = bam.read_bam(spark, path, split_bytes=split).collect()
        assert sorted((int(r["name"][1:]), r["pos"], r["sequence"], r["length"]) for r in got) == [(i, i % 900, "ACGTA", 9) for i in range(5000)]
    assert [r["name"] for r in bam.read_bam(spark, path).collect()] == [f"r{i}" for i in range(5000)]


def test_gtf_columns_with_and_without_quotes(spark, tmp_path):
    """Tabs within quotes cut nothing, wherever the quotes are."""
    ends = ['id "a b"; v "1";', 'id "a\tb"; v "2";', 'id x; v 3', 'id "y;']
    lines = [f"c\t{s}\texon\t{i}\t9\t.\t+\t.\t{e}" for i, (s, e) in enumerate((s, e) for s in ("s", '"s\tt"') for e in ends)]
    (tmp_path / "x.gtf").write_text("\n".join(lines) + "\n")
    got = text.read_gtf(spark, str(tmp_path / "x.gtf"), {"id": "string", "v": "long"}, {"id": "", "v": 0}).orderBy("row_id").collect()
    assert [(r["from"], r["source"], r["id"], r["v"]) for r in got] == [
        (i, ("s", '"s\tt"')[i // 4], ("a b", "a\tb", "x", "")[i % 4], (1, 2, 3, 0)[i % 4]) for i in range(8)
    ]
