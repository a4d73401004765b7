"""Literal vectors for the range operators."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import intervals, joins, reads
from spanloom.operators.ranges import append, make_ranges, random_ranges, set_lengths, sort, subset
from spanloom.plans import queries, tables


def rows(spark, *r):
    return make_ranges(spark, [(*x, "*") if len(x) == 3 else x for x in r])


def pairs(df):
    return sorted(tuple(r) for r in df.select("q_id", "s_id").collect())


def test_overlaps(spark):
    q = rows(spark, ("chr1", 100, 150), ("chr4", 110, 120), ("chr4", 190, 220), ("chr4", 340, 360), ("chr4", 390, 400), ("chr4", 450, 500))
    s = rows(spark, ("chr4", 100, 150), ("chr4", 200, 250), ("chr4", 300, 350), ("chr4", 400, 450))
    assert pairs(joins.overlap_join(q, s)) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(r.row_id for r in joins.semi(q, s).collect()) == [1, 2, 3]
    assert sorted(r.row_id for r in joins.anti(q, s).collect()) == [0, 4, 5]
    got = sorted((r["row_id"], r["from"], r["to"]) for r in joins.intersection(q, s).collect())
    assert got == [(1, 110, 120), (2, 200, 220), (3, 340, 350)]


def test_nested_and_nearest(spark):
    q = rows(spark, ("chr4", 600, 950), ("chr4", 850, 950))
    s = rows(spark, ("chr4", 100, 900), ("chr4", 200, 800), ("chr4", 300, 700), ("chr4", 400, 600))
    assert pairs(joins.overlap_join(q, s)) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    s = rows(spark, ("chr4", 100, 900), ("chr4", 200, 300), ("chr4", 300, 700), ("chr4", 400, 600))
    got = sorted((r.q_id, r.distance, r.s_id) for r in joins.nearest(q, s, 2).collect())
    assert got == [(0, 0, 0), (0, 0, 2), (0, 0, 3), (0, 300, 1), (1, 0, 0), (1, 150, 2), (1, 250, 3)]


def test_nearest_asks_all_orders(spark):
    d = "/root/testdata/sf0.001"
    ranges = lambda df: [(r["row_id"], r["seqname"], r["from"], r["to"]) for r in df.collect()]
    subjects = ranges(tables.subjects(spark, d))
    want = []
    for q, c, f, t in ranges(tables.queries(spark, d)):
        gaps = sorted((abs(g), -g, s) for s, sc, sf, st in subjects if sc == c for g in [0 if sf <= t and st >= f else f - st if st < f else t - sf])
        touching = sum(g == 0 for g, _, _ in gaps)
        want += [(q, s, -g) for _, g, s in gaps[: touching + 3]]
    assert sorted(tuple(r) for r in queries.QUERIES["nearest"](spark, d).select("q_id", "s_id", "distance").collect()) == sorted(want)


def test_merge(spark):
    r = rows(spark, ("chr1", 6, 21), ("chr1", 10, 31), ("chr1", 24, 81), ("chr2", 6, 21), ("chr2", 10, 31), ("chr3", 0, 5), ("chr3", 5, 9), ("chr3", 2, 2))
    got = sorted((x["seqname"], x["from"], x["to"]) for x in intervals.merge(r).collect())
    assert got == [("chr1", 6, 81), ("chr2", 6, 31), ("chr3", 0, 5), ("chr3", 5, 9)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 40000)), max_size=12), st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 300)), max_size=12))
def test_binned_join_is_the_plain_join(spark, a, b):
    q = rows(spark, *[("c", x, x + n) for x, n in a] or [("c", 0, 0)])
    s = rows(spark, *[("c", x, x + n) for x, n in b] or [("c", 0, 0)])
    want = sorted((i, j) for i, (x, n) in enumerate(a) for j, (y, m) in enumerate(b) if n and m and x < y + m and y < x + n)
    assert pairs(joins.overlap_join(q, s, bits=4)) == want


def test_rows(spark):
    r = make_ranges(spark, [("chr10", 5, 9, "+", 3), ("chr2", 7, 30, "-", 1), ("chr2", 1, 4, "*", 2)], "score long")
    assert [x.row_id for x in sort(r).collect()] == [2, 1, 0]
    assert [x.row_id for x in sort(r, "score", reverse=True).collect()] == [0, 2, 1]
    assert [x.row_id for x in subset(r, [1, 0, 1]).collect()] == [1, 0, 1]
    assert [(x["from"], x["to"]) for x in set_lengths(r, 5).orderBy("row_id").collect()] == [(5, 10), (25, 30), (1, 4)]
    assert append(r, r).count() == 6 and append(r, r).select("row_id").distinct().count() == 6
    g = spark.createDataFrame([(0, "a", 1000), (1, "b", 50)], "idx int, seqname string, length long")
    assert random_ranges(g, 20, 100).where((F.col("from") < 0) | (F.col("to") > 1000) | (F.col("seqname") != "a")).count() == 0


def test_reads(spark):
    a = spark.createDataFrame([("x", "c", 10, 5, 99, 30), ("x", "c", 40, 5, 147, 20), ("y", "c", 7, 4, 16, 9), ("z", "c", 1, 4, 4, 9)], "name string, seqname string, pos long, length long, flag int, mapq int")
    got = sorted((r["from"], r["to"], r["strand"], r["mapq"], r["paired"]) for r in reads.join_mates(a).collect())
    assert got == [(7, 11, "-", 9, False), (10, 45, "*", 20, True)]
    assert spark.range(1).select(reads.cigar_length(F.lit("6M14N1I5M"))).first()[0] == 25


def test_labels_and_overlap_totals_without_pairs(spark):
    """Both equal a plain count over all pairs, and neither lays ranges into cells nor joins them."""
    import random

    rng = random.Random(3)
    place = lambda: (rng.choice(["c", "d"]), rng.choice([0, 65_500, 131_000]) + rng.randrange(90))
    draw = lambda n: [(s, f, f + rng.choice([0, 1, 5, 30, 70_000]), "*") for s, f in (place() for _ in range(n))]
    sets = [draw(25), draw(12), draw(0), [("c", 3, 3, "*"), ("e", 0, 500_000, "+")]]
    regions = draw(120) + [("f", 0, 9, "*")]
    meet = lambda a, b: a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])
    q, *s = (make_ranges(spark, x) for x in (regions, *sets))
    got = intervals.labels(q, *s)
    want = {i: [n for n, x in enumerate(sets) if any(meet(r, y) for y in x)] for i, r in enumerate(regions)}
    assert {r["row_id"]: r["labels"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    every = sum(sets, [])
    shared = [(a[0], min(a[2], b[2]) - max(a[1], b[1])) for a in regions for b in every if meet(a, b)]
    totals = joins.overlap_totals(q, make_ranges(spark, every)).collect()
    assert {r["seqname"]: (r["n"], r["bases"]) for r in totals} == {c: (sum(s == c for s, _ in shared), sum(x for s, x in shared if s == c)) for c in "cd"}
