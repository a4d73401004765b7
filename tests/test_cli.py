"""Every command-line tool once, on small files."""

import numpy as np
import pytest

from spanloom.cli.tools import TOOLS, main
from spanloom.functions import pwm
from spanloom.sources import bam, bigwig

GENOME = [("chr1", 1000), ("chr2", 600)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    values = [("chr1", np.arange(100, dtype=float)), ("chr2", np.full(60, 2.0))]
    bigwig.write_file(str(d / "a.bw"), GENOME, values, 10)
    bigwig.write_file(str(d / "b.bw"), GENOME, [(n, v * 2) for n, v in values], 10)
    rows = [{"name": f"r{i}", "ref": i % 2, "pos": 10 * i, "flag": 16 if i % 3 == 0 else 0, "mapq": 30, "bin": 4681, "cigar": [(20, "M")], "seq": "ACGTA" * 4} for i in range(50)]
    rows.append({"name": "bad", "ref": 0, "pos": 5, "flag": 0, "mapq": 1, "bin": 7, "cigar": [(20, "M")], "seq": "A" * 20})
    bam.write_bam(str(d / "x.bam"), GENOME, rows)
    (d / "g.genome").write_text("chr1\t1000\nchr2\t600\n")
    (d / "a.bed").write_text("chr1\t0\t100\tA\t1\t+\nchr1\t200\t320\tB\t2\t-\nchr2\t0\t50\tA\t3\t+\n")
    (d / "b.bed").write_text("chr1\t50\t120\tA\t1\t+\nchr2\t300\t400\tA\t3\t+\n")
    (d / "s.fa").write_text(">chr1 first > one\nacgtacgtnn\nacgcgc\n>chr2\nttttcgcgaacg\n")
    (d / "r.fa").write_text(">ref\nacgtac\n")
    (d / "r.bed").write_text("chr1\t0\t8\nchr2\t4\t10\n")
    (d / "x.gtf").write_text('chr1\tsrc\texon\t10\t20\t1.5\t+\t.\tgene_id "g 1"; other "x";\nchr1\tsrc\texon\t40\t60\t.\t+\t0\tgene_id "g 1";\n')
    (d / "m.table").write_text("A 1.0 -1.0\nC -1.0 1.0\nG 0.5 0.5\nT 0.0 0.0\n")
    (d / "t1.txt").write_text("cell\tchr1\nE1 E2\n" + "".join(f"{i} {i / 2}\n" for i in range(100)))
    (d / "t2.txt").write_text("cell\tchr2\nE1 E2\n" + "".join("1 2\n" for _ in range(60)))
    (d / "m.xml").write_text(
        '<MEME><training_set><letter_frequencies/></training_set><model><background_frequencies><alphabet_array><value letter_id="letter_A">0.25</value>'
        '</alphabet_array></background_frequencies></model><motifs><motif id="m1" name="m1" e_value="0.01"><probabilities><alphabet_matrix><alphabet_array>'
        + "".join(f'<value letter_id="letter_{x}">{p}</value>' for x, p in zip("ACGT", (0.7, 0.1, 0.1, 0.1)))
        + "</alphabet_array></alphabet_matrix></probabilities></motif></motifs></MEME>"
    )
    return d


def run(spark, capsys, *argv):
    assert main([str(a) for a in argv], spark) == 0
    return capsys.readouterr().out.splitlines()


def track(path, name="chr1"):
    bw = bigwig.BigWig(str(path))
    out = np.full(bw.chroms[name][1] // 10, np.nan)
    for b in bw.blocks(bw.chroms[name][0]):
        _, s, e, v = bw.records(*b)
        for x, y, z in zip(s, e, v):
            out[x // 10 : y // 10] = z
    bw.close()
    return out


def test_alignments(spark, capsys, files):
    assert run(spark, capsys, "bam-genome", files / "x.bam") == ["chr1\t1000", "chr2\t600"]
    lines = run(spark, capsys, "bam-check-bin", files / "x.bam")
    assert len(lines) == 1 and "bad" in lines[0] and "expected 4681" in lines[0]
    shown = run(spark, capsys, "bam-view", "--sequence", "--auxiliary", files / "x.bam")
    assert len(shown) == 52 and shown[1].split()[:2] == ["chr1", "0"] and "20M" in shown[1] and "ACGTA" in shown[1]
    run(spark, capsys, "bam-to-bigwig", "--bin-size", "10", "--filter-mapq", "10", "--verbose", files / "x.bam", files / "c.bw")
    got = track(files / "c.bw")
    assert got[0] == 1 and got[1] == 1 and got[40] == 1 and np.nansum(got) == 50


def test_bigwig(spark, capsys, files):
    a, b, out = files / "a.bw", files / "b.bw", files / "out.bw"
    assert run(spark, capsys, "bigwig-genome", a) == ["chr1\t1000", "chr2\t600"]
    run(spark, capsys, "bigwig-nil", "--bin-size", "20", "--bin-summary", "max", a, out)
    assert list(track(out)[:4]) == [1, 1, 3, 3]
    assert run(spark, capsys, "bigwig-statistics", a)[0] == "bins: 160"
    assert len(run(spark, capsys, "bigwig-histogram", "-b", "10", "-c", a)) == 11
    rows = run(spark, capsys, "bigwig-query", a, "chr1", 0, 100, 50)
    assert len(rows) == 3 and rows[1].split("\t")[4:6] == ["0.000000", "4.000000"]
    assert run(spark, capsys, "bigwig-query-sequence", a, "chr2", 0, 40, 20) == ["chr2\t0\t2.000000", "chr2\t1\t2.000000"]
    run(spark, capsys, "bigwig-counts-to-quantiles", a, out)
    assert track(out)[99] == 1
    run(spark, capsys, "bigwig-quantile-normalize", b, a, out)
    assert track(out)[99] == 198
    (files / "tool_plugin.py").write_text("def plus(seqname, position, *values):\n    return sum(values) + position\n")
    spark.sparkContext.addPyFile(str(files / "tool_plugin.py"))
    run(spark, capsys, "bigwig-map", "tool_plugin:plus", out, a, b)
    assert track(out)[5] == 15 + 50
    run(spark, capsys, "bigwig-extract-chroms", "chr2", a, out)
    assert run(spark, capsys, "bigwig-genome", out) == ["chr2\t600"]
    run(spark, capsys, "bigwig-edit-chrom-names", out, "^chr", "seq")
    assert run(spark, capsys, "bigwig-genome", out) == ["seq2\t600"]
    table = run(spark, capsys, "bigwig-extract", a, files / "r.bed", "--bin-size", "2")
    assert len(table) == 3 and table[1].split()[-1] == "0.0,0.0,0.0,0.0"


def test_ranges(spark, capsys, files):
    assert [x.split("\t")[:3] for x in run(spark, capsys, "bed-remove-overlaps", files / "b.bed", files / "a.bed", "--input-format", "bed6")] == [["chr1", "200", "320"], ["chr2", "0", "50"]]
    drawn = run(spark, capsys, "draw-genomic-regions", files / "g.genome", 5, 20, "--seed", 3, "--exclude", files / "a.bed")
    assert len(drawn) == 5
    assert [x.split("\t") for x in run(spark, capsys, "gtf-to-bed", "--input", files / "x.gtf", "--merge-by", "gene_id")] == [["chr1", "10", "60", "g 1", "0", "+"]]
    found = run(spark, capsys, "segmentation-differential", "A", files / "a.bed", files / "b.bed", "--print-statistics")
    assert any("0,1" in x and "chr1" in x for x in found) and sum("sets" in x for x in found) == 2


def test_sequences(spark, capsys, files):
    assert run(spark, capsys, "fasta-extract", files / "s.fa", files / "r.bed") == [">chr1|0|8", "acgtacgt", ">chr2|4|10", "cgcgaa"]
    assert run(spark, capsys, "fasta-unresolved-regions", files / "s.fa") == ["chr1\t8\t10"]
    assert run(spark, capsys, "observed-over-expected-cpg", files / "s.fa", files / "r.bed", "--output-format", "vector") == ["4.0", "3.0"]
    table = run(spark, capsys, "count-kmers", 2, 2, files / "s.fa", "--regions", files / "r.bed", "--sparse", "--header")
    assert table[0].startswith("# ") and any("ac=2,cg=2,gt=2,ta=1" in x for x in table)
    dense = run(spark, capsys, "count-kmers", 2, 2, files / "s.fa", "--regions", files / "r.bed", "--human")
    assert any("aa=0,ac=2" in x for x in dense)
    alike = run(spark, capsys, "sequence-similarity", 2, 2, files / "r.fa", files / "s.fa", "--format", "table", "--step-size", 2)
    assert len(alike) == 2 and alike[0].split()[0] == "1.0000"
    run(spark, capsys, "meme-extract", files / "m.xml", files / "motif")
    assert pwm.read_matrix((files / "motif-1.table").read_text())[0][0] > 1
    scores = run(spark, capsys, "pwm-scan-regions", files / "s.fa", files / "m.table", "--input", files / "r.bed")
    assert scores[1].split()[-1] == "2.0"
    run(spark, capsys, "pwm-scan-sequences", files / "m.table", files / "s.fa", files / "w.bw", "--bin-size", 4)
    assert bigwig.BigWig(str(files / "w.bw")).bin_size() == 4


def test_all_tools_are_there():
    assert len(TOOLS) == 30
