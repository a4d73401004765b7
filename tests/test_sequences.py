"""DNA functions, k-mers and motifs."""

import math

import pytest
from pyspark.sql import functions as F

from spanloom.functions import dna, kmers, pwm


def test_dna(spark):
    s = spark.createDataFrame([("a", "ACgtNNcgwr")], "seqname string, sequence string")
    assert s.select(dna.reverse_complement(F.col("sequence"))).first()[0] == "ywcgnnacgt"
    assert [(r["from"], r["to"]) for r in dna.unresolved(s).collect()] == [(4, 6)]
    assert sorted(r["from"] for r in dna.scan(s, "cg").collect()) == [1, 6]


def test_kmer_classes():
    eq = kmers.Equivalence(4, 5, alphabet=dna.GAPPED, revcomp=True)
    assert kmers.class_of("anntc", eq)[2] == ["anntc", "gannt"]
    every = kmers.Equivalence(4, 5, complement=True, reverse=True, revcomp=True, alphabet=dna.GAPPED)
    assert kmers.class_of("anntc", every)[2] == ["anntc", "tnnag", "ctnna", "gannt"]
    assert kmers.matches("anctc", "aagctc") and not kmers.matches("anctc", "aagntc")
    assert len(list(kmers.instantiate("ctnna"))) == 16 and len(list(kmers.instantiate("ctnna", partial=True))) == 25
    clusters, _ = kmers.graph(["at", "annnc", "atnnc", "anntc", "gctc", "anctc", "aagntc"])
    assert clusters == {"at": 3, "annnc": 17, "atnnc": 19, "anntc": 25, "gctc": 15, "anctc": 29, "aagntc": 55}


def test_kmer_counts(spark):
    s = spark.createDataFrame([("x", "acgtcgcg")], "seqname string, sequence string")
    eq = kmers.Equivalence(4, 6, complement=True, reverse=True, revcomp=True, alphabet=dna.GAPPED)
    got = kmers.count_kmers(s, eq)
    by_hand = {}
    for k in range(4, 7):
        for i in range(8 - k + 1):
            gram = "acgtcgcg"[i : i + k]
            patterns = {""}
            for j, x in enumerate(gram):
                patterns = {p + y for p in patterns for y in ([x] if j in (0, k - 1) else [x, "n"])}
            for c in {kmers.class_of(p, eq)[:2] for p in patterns}:
                by_hand[c] = by_hand.get(c, 0) + 1
    assert {(r.k, r.class_id): r.n for r in got.collect()} == by_hand
    assert sum(kmers.dense(got).first().counts) == sum(by_hand.values())


def test_pwm(spark):
    m = pwm.read_matrix("C 1 2\nA 3 4\nG 5 6\nT 7 8\n")
    s = spark.createDataFrame([("a", "acNt")], "seqname string, sequence string")
    assert s.select(pwm.scores(F.col("sequence"), m)).first()[0] == [5.0, 1.0, 8.0]
    assert s.select(pwm.mean_score(pwm.scores(F.col("sequence"), m))).first()[0] == pytest.approx(math.log(sum(map(math.exp, [5, 1, 8])) / 3))


def test_queries_run(spark):
    from spanloom.plans.queries import QUERIES, SQL

    assert set(SQL) == set(QUERIES)
    assert QUERIES["overlap_counts"](spark, "/root/testdata/sf0.001").count() == 5


def test_similarity_of_large_counts(spark):
    """The product of two norms is beyond a long."""
    counts = spark.createDataFrame([("a", 2, 0, 3_000_000_000), ("a", 2, 1, 4_000_000_000), ("b", 2, 0, 5)], "id string, k int, class_id long, n long")
    reference = spark.createDataFrame([(2, 0, 3_000_000_000), (2, 1, 4_000_000_000)], "k int, class_id long, n long")
    got = {r["id"]: r["value"] for r in kmers.similarity(reference, counts).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(0.6)
