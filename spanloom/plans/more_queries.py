"""Queries of the operators that work on tables alone: rows, metadata, statistics, k-mers, motifs, streams."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, kmers, pwm
from ..operators import intervals, joins, ranges, stats, tracks
from ..operators import reads as rd
from ..streaming import coverage as streams
from . import tables as t
from .queries import _DENSE, _MATRIX, _dense_track, query
from .scratch import folder, uri


def _range(df: DataFrame, *more) -> DataFrame:
    return df.select("seqname", F.col("from").alias("start"), F.col("to").alias("stop"), *more)


# ---- rows and metadata ----


@query(f"SELECT row_id, CAST(row_number() OVER (ORDER BY length(seqname), seqname, f, t, row_id) AS BIGINT) AS place FROM {t.SUBJECTS}")
def sort_ranges(spark, d):
    return _places(ranges.sort(t.subjects(spark, d)))


@query(f"SELECT row_id, CAST(row_number() OVER (ORDER BY score DESC, row_id) AS BIGINT) AS place FROM {t.SUBJECTS}")
def sort_by_column(spark, d):
    return _places(ranges.sort(t.subjects(spark, d), "score", reverse=True))


def _places(ordered: DataFrame) -> DataFrame:
    """row_id and place of sorted rows: they are written as sorted, and counted by partition."""
    at = uri(folder(ordered.sparkSession) + "/sorted")
    ordered.select("row_id", F.monotonically_increasing_id().alias("at")).write.parquet(at)
    rows = ordered.sparkSession.read.parquet(at).withColumn("part", F.expr("at div 8589934592"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("first"))
    return rows.join(before, "part").select("row_id", (F.col("first") + F.col("at") % 8589934592 + 1).alias("place"))


@query(f"SELECT name, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows, min(f) AS low, round(sum(f % 97) / count(*), 6) AS mean FROM {t.QUERIES} GROUP BY name")
def merge_rows(spark, d):
    """Rows merge into lists by a target, and list columns reduce to numbers."""
    rows = t.queries(spark, d).withColumns({"own": F.col("row_id"), "first": F.col("from"), "rest": F.col("from") % 97}).drop("name")
    named = t.queries(spark, d).select("row_id", F.col("name").alias("target"))
    listed = ranges.merge_rows(rows.join(named, "row_id"), F.col("target"))
    low = ranges.reduce_list(listed, "first", "low", F.array_min)
    mean = ranges.reduce_list(low, "rest", "mean", lambda c: F.round(F.aggregate(c, F.lit(0), lambda a, x: a + x.cast("int")) / F.size(c), 6))
    return mean.select(F.col("idx").alias("name"), F.array_join(F.col("own").cast("array<string>"), ",").alias("rows"), "low", "mean")


@query(f"SELECT row_id, name AS label, f % 10 AS tenth FROM {t.QUERIES}")
def metadata(spark, d):
    df = ranges.add_meta(t.queries(spark, d), "tenth", F.col("from") % 10)
    df = ranges.add_meta(df, "gone", F.lit(1))
    df = ranges.rename_meta(ranges.delete_meta(df, "gone"), "name", "label")
    return ranges.get_meta(df, "label").join(ranges.get_meta(df, "tenth|none", regex=True), "row_id")


@query(f"""WITH s AS {t.SUBJECTS}, q AS {t.QUERIES}, n AS (SELECT max(row_id) + 1 AS n FROM q)
SELECT row_id, seqname, name, CAST(NULL AS DOUBLE) AS score FROM q UNION ALL SELECT row_id + n, seqname, NULL, score FROM s, n""")
def append_ranges(spark, d):
    return ranges.append(t.queries(spark, d), t.subjects(spark, d)).select("row_id", "seqname", "name", "score")


@query(f"SELECT row_id, f AS start FROM {t.QUERIES} WHERE row_id NOT IN (3, 5, 8) AND name IN ('1-URGENT', '2-HIGH') UNION ALL SELECT row_id, f FROM {t.QUERIES} WHERE row_id IN (7, 9) UNION ALL SELECT row_id, f FROM {t.QUERIES} WHERE row_id = 7 UNION ALL SELECT row_id, f FROM {t.QUERIES} WHERE row_id BETWEEN 10 AND 19")
def select_rows(spark, d):
    q = t.queries(spark, d)
    parts = [ranges.name_in(ranges.remove(q, [3, 5, 8]), ["1-URGENT", "2-HIGH"]), ranges.subset(q, [7, 9, 7]).drop("pos"), ranges.slice_rows(q, 10, 20)]
    return functools.reduce(DataFrame.unionByName, parts).select("row_id", F.col("from").alias("start"))


@query(f"SELECT row_id, (f + t) // 2 - 20 AS start, (f + t) // 2 + 20 AS stop FROM {t.SUBJECTS} WHERE t - f <= 50")
def resize_regions(spark, d):
    got = ranges.resize_centre(ranges.max_size(t.subjects(spark, d), 50), 40)
    return got.select("row_id", F.col("from").alias("start"), F.col("to").alias("stop"))


@query(f"WITH q AS (SELECT *, f // 20000 * 20000 AS g FROM {t.QUERIES}) SELECT seqname, g AS start, g + 100 AS stop, arg_min(strand, row_id) AS strand, string_agg(name, ',' ORDER BY row_id) AS names FROM q GROUP BY ALL")
def merge_duplicates(spark, d):
    start = F.expr("`from` div 20000 * 20000")
    got = intervals.merge_duplicates(t.queries(spark, d).withColumns({"from": start, "to": start + 100}))
    return _range(got, "strand", F.array_join("name", ",").alias("names"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(row_id) AS BIGINT) AS total, true AS equal, CAST({t.LENGTH} AS BIGINT) AS length, CAST(6 AS BIGINT) AS sequences, CAST({t.LENGTH} * 5 + 7 AS BIGINT) AS bases FROM {t.QUERIES}")
def permutation_and_genome(spark, d):
    """A permutation keeps the rows; a genome takes another sequence and knows its lengths."""
    g = t.genome(spark)
    more = ranges.add_sequence(g, "chr6", 7)
    rows = ranges.permute(t.queries(spark, d), 3).agg(F.count("*").alias("n"), F.sum("row_id").alias("total"))
    facts = more.agg(F.count("*").alias("sequences")).crossJoin(ranges.genome_total(more).withColumnRenamed("total", "bases"))
    same = ranges.genomes_equal(g, more.where("seqname <> 'chr6'"))
    return rows.crossJoin(facts).withColumns({"equal": F.lit(same), "length": F.lit(ranges.genome_lookup(more, "chr3")).cast("long")})


@query(f"WITH q AS {t.QUERIES}, n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS a, row_number() OVER (ORDER BY row_id DESC) AS b FROM q) SELECT row_id, seqname FROM n WHERE a <= 5 OR b <= 5")
def first_and_last_rows(spark, d):
    return ranges.head_tail(t.queries(spark, d), 10).select("row_id", "seqname")


@query("SELECT CAST(500 AS BIGINT) AS n, CAST(0 AS BIGINT) AS hits, CAST(2000 AS BIGINT) AS width")
def drawn_regions(spark, d):
    """Random regions keep off an exclude set."""
    off = t.queries(spark, d)
    got = ranges.draw_ranges(t.genome(spark, 20 * t.LENGTH), 500, 2000, off, seed=5)
    hits = joins.overlap_join(got, off).agg(F.count("*").alias("hits"))
    return got.agg(F.count("*").alias("n"), F.max(F.col("to") - F.col("from")).alias("width")).crossJoin(hits)


# ---- joins and sets ----


@query(f"""WITH q AS {t.QUERIES}, u AS (SELECT row_id, min({{'seqname': seqname, 'f': f, 't': t}}) AS x FROM {t.SUBJECTS} WHERE strand = '+' GROUP BY row_id),
s AS (SELECT row_id, x.seqname AS seqname, x.f AS f, x.t AS t FROM u),
p AS (SELECT q.row_id, s.row_id AS s_id, CASE WHEN s.f <= q.t AND s.t >= q.f THEN 0 WHEN s.t < q.f THEN q.f - s.t ELSE q.t - s.f END AS distance FROM q JOIN s USING (seqname) WHERE s.f < q.t + 4000 AND s.t > q.f - 4000),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id, distance = 0 ORDER BY abs(distance), distance DESC, s_id) AS r FROM p),
l AS (SELECT row_id, string_agg('s' || s_id, ',' ORDER BY abs(distance), s_id) AS names, string_agg(CAST(distance AS VARCHAR), ',' ORDER BY abs(distance), s_id) AS distances FROM r WHERE (distance = 0 OR r <= 2) AND abs(distance) <= 2000 GROUP BY row_id)
SELECT row_id, coalesce(names, '') AS names, coalesce(distances, '') AS distances FROM q LEFT JOIN l USING (row_id)""")
def annotate_nearest(spark, d):
    # names are looked up by row_id, which the line items repeat: one each
    one = t.subjects(spark, d).where("strand = '+'").groupBy("row_id").agg(F.min(F.struct("seqname", "from", "to")).alias("x"))
    s = one.select("row_id", "x.*", F.lit("+").alias("strand"), F.concat(F.lit("s"), F.col("row_id").cast("string")).alias("label"))
    got = joins.annotate_nearest(t.queries(spark, d), s, 2, "label", 2000)
    return got.select("row_id", F.array_join("names", ",").alias("names"), F.array_join(F.col("distances").cast("array<string>"), ",").alias("distances"))


@query(f"WITH q AS {t.QUERIES}, g AS (SELECT name AS label, max(row_id) AS g_id FROM q GROUP BY name) SELECT s.row_id, g_id FROM {t.SUBJECTS} s JOIN g ON g.label = CASE s.row_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'none' END")
def lookup_by_name(spark, d):
    label = F.when(F.col("row_id") % 3 == 0, "1-URGENT").when(F.col("row_id") % 3 == 1, "5-LOW").otherwise("none")
    known = t.queries(spark, d).withColumnRenamed("name", "names")
    return joins.by_name(t.subjects(spark, d).withColumn("label", label), known, "label").select("row_id", "g_id")


_SETS = f"""q AS {t.QUERIES}, s AS {t.SUBJECTS}, l AS (SELECT q.row_id, count(DISTINCT s.strand) FILTER (s.strand <> '*') AS n FROM q LEFT JOIN s ON q.seqname = s.seqname AND q.f < s.t AND s.f < q.t GROUP BY q.row_id)"""


@query(f"WITH {_SETS} SELECT CAST(n AS INTEGER) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM l), 6) AS share FROM l GROUP BY n")
def label_statistics(spark, d):
    s = t.subjects(spark, d)
    got = intervals.labels(t.queries(spark, d), s.where("strand = '+'"), s.where("strand = '-'"))
    return intervals.label_statistics(got).select("n", F.round("share", 6).alias("share"))


_LABELLED = f"""q AS {t.QUERIES}, s AS {t.SUBJECTS},
l AS (SELECT q.row_id, count(DISTINCT s.strand) FILTER (s.strand = '+') AS p, count(DISTINCT s.strand) FILTER (s.strand <> '+') AS m FROM q LEFT JOIN s ON q.seqname = s.seqname AND q.f < s.t AND s.f < q.t GROUP BY q.row_id)"""


@query(f"WITH {_LABELLED} SELECT row_id, CASE WHEN p + m = 3 THEN CAST('-Infinity' AS DOUBLE) ELSE round(ln(p + 1.0) - ln((m + 1.0) / 2), 6) END AS score FROM l")
def differential_score(spark, d):
    s = t.subjects(spark, d)
    got = intervals.labels(t.queries(spark, d), *[s.where(F.col("strand") == x) for x in "+-*"])
    return intervals.differential_score(got, [0], 3).select("row_id", F.round("score", 6).alias("score"))


_STATES = f"(SELECT seqname, f, t, CASE row_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS name, row_id % 3 AS file FROM {t.SUBJECTS})"


@query(f"""WITH s AS {_STATES}, o AS (SELECT *, max(t) OVER (PARTITION BY name, seqname ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR f >= m THEN 1 ELSE 0 END) OVER (PARTITION BY name, seqname ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT name, seqname, min(f) AS start, max(t) AS stop, string_agg(DISTINCT CAST(file AS VARCHAR), ',' ORDER BY CAST(file AS VARCHAR)) AS labels FROM g GROUP BY name, seqname, run""")
def segmentation_difference(spark, d):
    s = t.subjects(spark, d).withColumn("name", F.when(F.col("row_id") % 2 == 0, "A").otherwise("B"))
    got = intervals.segmentation_difference([s.where(F.col("row_id") % 3 == i) for i in range(3)], ["A", "B"])
    return _range(got, "name", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(f"""WITH {_DENSE}, q AS (SELECT row_id, seqname, f // 10 AS f FROM {t.QUERIES}), m AS (SELECT q.row_id, avg(value) AS mean FROM q JOIN dense ON dense.seqname = q.seqname AND bin >= q.f // 100 AND bin < (q.f + 500) // 100 GROUP BY q.row_id)
SELECT row_id FROM q LEFT JOIN m USING (row_id) WHERE mean IS NULL OR (mean >= 4 AND mean <= 12)""")
def region_threshold(spark, d):
    start = F.expr("`from` div 10")
    regions = t.queries(spark, d).withColumns({"from": start, "to": start + 500})
    return intervals.region_threshold(regions, _dense_track(spark, d), 100, 4, 12).select("row_id")


# ---- tracks and statistics ----


@query(f"""WITH v AS {t.VECTORS}, m AS (SELECT seqname, bin // 4 AS bin, sum(value) / count(*) AS mean, min(value) AS low, max(value) AS high, sum(value * value) / count(*) - (sum(value) / count(*)) ^ 2 AS var FROM v GROUP BY 1, 2)
SELECT seqname, bin, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, floor(mean + 0.5) AS d_mean, floor(low) AS d_low, floor(high) AS d_high, round(var, 6) AS variance FROM m""")
def bin_statistics(spark, d):
    names = {"mean": "mean", "min": "low", "max": "high", "discrete mean": "d_mean", "discrete min": "d_low", "discrete max": "d_high", "variance": "variance"}
    v = t.vector_track(spark, d)
    each = [stats.rebin(v, 4, k).select("seqname", "bin", F.round("value", 6).alias(n)) for k, n in names.items()]
    return functools.reduce(lambda a, b: a.join(b, ["seqname", "bin"]), each)


@query(f"WITH {_DENSE} SELECT value AS x, count(*) AS y FROM dense GROUP BY value")
def exact_histogram(spark, d):
    return stats.histogram(_dense_track(spark, d), 0, 0, 0)


@query(f"""WITH {_DENSE}, b AS (SELECT x, y, sum(y) OVER (ORDER BY x) * 1.0 / sum(y) OVER () AS q FROM (VALUES (0.0, 10), (1.0, 20), (2.0, 30), (5.0, 40)) h(x, y)),
a AS (SELECT DISTINCT value AS x, cume_dist() OVER (ORDER BY value) AS q FROM dense),
m AS (SELECT x, CASE WHEN x = (SELECT min(x) FROM a) THEN 0.0 ELSE coalesce((SELECT min(x) FROM b WHERE b.q >= a.q - 1e-12 AND b.x > 0), 0.0) END AS y FROM a)
SELECT seqname, bin, CAST(y AS DOUBLE) AS value FROM dense JOIN m ON m.x = dense.value""")
def quantile_normalize_to_counts(spark, d):
    counts = spark.createDataFrame([(0.0, 10), (1.0, 20), (2.0, 30), (5.0, 40)], "x double, y long")
    return stats.quantile_normalize_to_counts(_dense_track(spark, d), counts)


@query(f"""WITH {_DENSE}, mo AS (SELECT avg(value) AS mu, avg(value * value) - avg(value) ^ 2 AS v, count(*) AS n FROM dense), l AS (SELECT i AS lag FROM range(0, 5) r(i))
SELECT lag * 100 AS lag, round(sum((a.value - mu) * (b.value - mu)) / any_value(n) / any_value(v), 6) AS value FROM l, mo, dense a JOIN dense b ON a.seqname = b.seqname AND b.bin = a.bin + lag GROUP BY lag""")
def auto_correlation(spark, d):
    g = t.genome(spark, t.READ_LENGTH)
    got = stats.auto_correlation(tracks.coverage(t.reads(spark, d), g, 100), g, 100, 0, 500)
    return got.select("lag", F.round("value", 6).alias("value"))


_ENDS = f"""g AS (SELECT 'chr' || i AS seqname, unnest(generate_series(0, {t.READ_LENGTH} // 50 - 1)) AS bin FROM range(1, 6) x(i)),
f AS (SELECT seqname, f // 50 AS bin, count(*) AS p FROM {t.READS} WHERE strand = '+' AND f // 50 < {t.READ_LENGTH} // 50 GROUP BY ALL), r AS (SELECT seqname, t // 50 AS bin, count(*) AS m FROM {t.READS} WHERE strand = '-' AND t // 50 < {t.READ_LENGTH} // 50 GROUP BY ALL),
dense AS (SELECT seqname, bin, CAST(coalesce(p, 0) AS DOUBLE) AS p, CAST(coalesce(m, 0) AS DOUBLE) AS m FROM g LEFT JOIN f USING (seqname, bin) LEFT JOIN r USING (seqname, bin)),
mo AS (SELECT avg(p) AS m1, avg(m) AS m2, avg(p * p) - avg(p) ^ 2 AS v1, avg(m * m) - avg(m) ^ 2 AS v2, count(*) AS n FROM dense), l AS (SELECT i AS lag FROM range(0, 8) r(i))"""


@query(f"WITH {_ENDS} SELECT lag * 50 AS lag, round(sum((a.p - m1) * (b.m - m2)) / any_value(n) / sqrt(any_value(v1 * v2)), 6) AS value FROM l, mo, dense a JOIN dense b ON a.seqname = b.seqname AND b.bin = a.bin + lag GROUP BY lag")
def read_cross_correlation(spark, d):
    got = stats.read_cross_correlation(t.reads(spark, d), t.genome(spark, t.READ_LENGTH), 400, 50)
    return got.select("lag", F.round("value", 6).alias("value"))


@query(f"WITH {_DENSE}, w AS (SELECT seqname, bin, greatest(max(p) OVER w, max(m) OVER w) AS value FROM dense WINDOW w AS (PARTITION BY seqname ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT * FROM w")
def window_map_list(spark, d):
    g, r = t.genome(spark, t.READ_LENGTH), t.reads(spark, d)
    both = [tracks.densify(tracks.coverage(r.where(f"strand = '{s}'"), g, 100), g, 100) for s in "+-"]
    top = lambda a: F.array_max(F.filter(a, lambda x: ~F.isnan(x)))
    return tracks.window_map_list(both, 3, lambda w: F.array_max(F.transform(w, top)))


@query(f"WITH {_DENSE}, q AS (SELECT DISTINCT seqname, unnest(range(f // 10 // 100, (f // 10 + 300) // 100)) AS bin FROM {t.QUERIES}) SELECT seqname, bin, value FROM dense JOIN q USING (seqname, bin) WHERE seqname IN ('chr1', 'chr4') AND bin BETWEEN 20 AND 499")
def extract_regions(spark, d):
    start = F.expr("`from` div 10")
    regions = t.queries(spark, d).withColumns({"from": start, "to": start + 300})
    cut = tracks.extract_sequences(tracks.extract_regions(_dense_track(spark, d), regions, 100), ["chr1", "chr4"])
    both = [tracks.get_slice(cut, s, 2000, 50_000, 100) for s in ("chr1", "chr4")]
    return both[0].unionByName(both[1]).where(~F.isnan("value"))


@query(f"WITH {_DENSE}, q AS (SELECT row_id, seqname, f // 10 AS f, strand FROM {t.QUERIES} WHERE strand <> '*'), x AS (SELECT q.*, unnest([0, 1, 2]) AS i FROM q) SELECT row_id, string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY CASE strand WHEN '-' THEN -i ELSE i END) AS counts FROM x LEFT JOIN dense ON dense.seqname = x.seqname AND dense.bin = (x.f + i * 100) // 100 GROUP BY row_id")
def track_to_ranges(spark, d):
    start = F.expr("`from` div 10")
    regions = t.queries(spark, d).where("strand <> '*'").withColumns({"from": start, "to": start + 300})
    got = tracks.track_to_ranges_column(regions, _dense_track(spark, d), "counts", 100, reverse_negative=True)
    return got.select("row_id", F.array_join(F.transform("counts", lambda x: x.cast("long").cast("string")), ",").alias("counts"))


@query(f"""WITH q AS {t.QUERIES}, n AS (SELECT name, row_number() OVER (ORDER BY name <> '5-LOW', min(row_id)) - 1 AS state FROM q GROUP BY name),
c AS (SELECT row_id, seqname, name, unnest(range(f // 500, (f + 1000) // 500)) AS bin FROM q) SELECT seqname, bin, CAST(arg_max(state, row_id) AS DOUBLE) AS value FROM c JOIN n USING (name) GROUP BY seqname, bin""")
def segmentation_track(spark, d):
    segments = t.queries(spark, d).withColumn("to", F.col("from") + 1000)
    return tracks.segmentation_track(segments, 500, "5-LOW")[0]


# ---- sequences ----


@query(f"WITH s AS {t.SEQUENCES} SELECT seqname, length(sequence) AS n, replace(sequence, 'n', '') AS decoded, round(ln(exp(-1.0) + exp(-2.0)), 6) AS plus, round(ln(exp(-1.0) - exp(-2.0)), 6) AS minus FROM s")
def codes_and_logs(spark, d):
    codes = dna.encode(F.col("sequence"))
    known = F.filter(codes, lambda c: c >= 0)
    a, b = F.lit(-1.0), F.lit(-2.0)
    return t.sequences(spark, d).select("seqname", F.size(codes).cast("long").alias("n"), dna.decode(known).alias("decoded"), F.round(dna.log_add(a, b), 6).alias("plus"), F.round(dna.log_sub(a, b), 6).alias("minus"))


_GAPS = "regexp_replace(lower(text), '[^acgtn]', '', 'g')"
_GRAMS = f"""s AS {t.SEQUENCES}, p AS (SELECT seqname, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) AS g FROM s WHERE length(sequence) >= 3),
e AS (SELECT seqname, g, count(*) AS n FROM p WHERE regexp_full_match(g, '[acgt]{{3}}') GROUP BY ALL),
x AS (SELECT seqname, n, g AS e, unnest([g, g[1] || 'n' || g[3]]) AS g FROM e),
c AS (SELECT seqname, n, e, g, reverse(translate(g, 'acgt', 'tgca')) AS r FROM x),
z AS (SELECT DISTINCT seqname, n, e, CASE WHEN translate(g, 'acgtn', '01234') <= translate(r, 'acgtn', '01234') THEN g ELSE r END AS kmer FROM c),
k AS (SELECT seqname AS id, kmer, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT * FROM k")
def kmer_counts_gapped(spark, d):
    """Patterns with a gap in the middle, a pattern and its reverse complement as one class."""
    eq = kmers.Equivalence(3, 3, revcomp=True, alphabet=dna.GAPPED)
    return kmers.count_kmers(t.sequences(spark, d), eq).select("id", "kmer", "n")


@query(f"WITH {_GRAMS} SELECT id, kmer, CAST(1 AS BIGINT) AS n FROM k WHERE kmer NOT LIKE '%n%'")
def kmer_presence(spark, d):
    """Presence only, and no pattern with an ambiguous letter."""
    eq = kmers.Equivalence(3, 3, revcomp=True, max_ambiguous=(0,), alphabet=dna.GAPPED)
    return kmers.count_kmers(t.sequences(spark, d), eq, presence=True).select("id", "kmer", "n")


@query(f"WITH {_GRAMS} SELECT id, kmer, n FROM k WHERE kmer IN ('acg', 'ana', 'aag')")
def kmer_patterns(spark, d):
    """A fixed set of patterns: a class is counted by any of its members."""
    eq = kmers.Equivalence(3, 3, revcomp=True, alphabet=dna.GAPPED)
    return kmers.count_kmers(t.sequences(spark, d), eq, patterns=["cgt", "ana", "aag"]).select("id", "kmer", "n")


@query(f"WITH {_GRAMS} SELECT id, string_agg(kmer || '=' || n, ',' ORDER BY translate(kmer, 'acgtn', '01234')) AS text FROM k GROUP BY id")
def kmer_sparse_text(spark, d):
    eq = kmers.Equivalence(3, 3, revcomp=True, alphabet=dna.GAPPED)
    return kmers.sparse_text(kmers.count_kmers(t.sequences(spark, d), eq))


@query(f"""WITH {_GRAMS}, o AS (SELECT * FROM k WHERE kmer NOT LIKE '%n%'), f AS (SELECT kmer, sum(n) AS r FROM o GROUP BY kmer), b AS (SELECT sum(r * r) AS rr FROM f)
SELECT id, round(sum(n * r) / sqrt(sum(n * n) * any_value(rr)), 6) AS value FROM o JOIN f USING (kmer), b GROUP BY id""")
def kmer_similarity(spark, d):
    """The cosine of every sequence's counts with those of all together."""
    eq = kmers.Equivalence(3, 3, revcomp=True)
    counts = kmers.count_kmers(t.sequences(spark, d), eq)
    return kmers.similarity(counts.select("k", "class_id", "n"), counts).select("id", F.round("value", 6).alias("value"))


_SCORES = f"""s AS {t.SEQUENCES}, x AS (SELECT seqname, sequence FROM s UNION ALL SELECT seqname || 'r', reverse(translate(sequence, 'acgt', 'tgca')) FROM s),
p AS (SELECT seqname, sequence, unnest(range(0, length(sequence) - 3)) AS i FROM x WHERE length(sequence) >= 4), m AS (SELECT {_MATRIX} AS m),
y AS (SELECT seqname, i, sum(coalesce(CASE WHEN substr(sequence, i + j, 1) = 'n' THEN 0 ELSE m[instr('acgt', substr(sequence, i + j, 1))][j] END, 0)) AS v FROM p, m, (SELECT unnest(range(1, 5)) AS j) GROUP BY ALL),
z AS (SELECT seqname, CAST(max(v) AS DOUBLE) AS top, ln(avg(exp(CAST(v AS DOUBLE)))) AS mean FROM y GROUP BY seqname)"""


@query(f"WITH {_SCORES} SELECT s.seqname, coalesce(round(greatest(a.top, b.top), 6), CAST('-Infinity' AS DOUBLE)) AS top, coalesce(round(ln((exp(a.mean) + exp(b.mean)) / 2), 6), CAST('-Infinity' AS DOUBLE)) AS mean FROM s LEFT JOIN z a ON a.seqname = s.seqname LEFT JOIN z b ON b.seqname = s.seqname || 'r'")
def pwm_scan_regions(spark, d):
    """Over both strands: the largest score, and the log of the mean of the exponentials."""
    s = t.sequences(spark, d).withColumn("bases", F.coalesce("sequence", F.lit(""))).drop("sequence")
    top = pwm.scan_regions(s, [_MATRIX]).select("seqname", F.round(F.col("counts")[0], 6).alias("top"))
    mean = pwm.scan_regions(s, [_MATRIX], mean=True).select("seqname", F.round(F.col("counts")[0], 6).alias("mean"))
    return top.join(mean, "seqname")


@query(f"""WITH {_SCORES}, l AS (SELECT seqname, length(sequence) AS n FROM s), b AS (SELECT a.seqname, a.i // 10 AS bin, greatest(a.v, c.v) AS v FROM y a JOIN l USING (seqname) JOIN y c ON c.seqname = a.seqname || 'r' AND c.i = l.n - 4 - a.i)
SELECT seqname, bin, round(CAST(max(v) AS DOUBLE), 6) AS value FROM b GROUP BY seqname, bin""")
def pwm_scan_sequences(spark, d):
    return pwm.scan_sequences(t.sequences(spark, d), _MATRIX, 10).withColumn("value", F.round("value", 6))


# ---- reads and streams ----


@query(f"SELECT CASE WHEN duplicate THEN 1 ELSE 0 END AS marked, strand, count(*) AS n FROM {t.READS} WHERE NOT paired AND mapq >= 10 GROUP BY ALL")
def single_reads(spark, d):
    flagged = t.reads(spark, d).withColumn("flag", F.when(F.col("duplicate"), 1024).otherwise(0)).drop("duplicate")
    kept = rd.filter_reads(rd.as_single(rd.to_reads(flagged.where("not paired"))), paired=False, mapq=10)
    return kept.groupBy(F.col("duplicate").cast("int").alias("marked"), "strand").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, 'chr' || (user_id % 5 + 1) AS seqname, CAST((event_id * 7919) % 100000 // 1000 AS BIGINT) AS bin FROM events)
SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, seqname, bin, count(*) AS n FROM e GROUP BY ALL""")
def stream_coverage(spark, d):
    """The events as a stream, file by file, counted by window, sequence and bin."""
    at = folder(spark)
    static = t.table(spark, d, "events")
    start = (F.col("event_id") * 7919) % 100000
    rows = static.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("seqname"), start.alias("from"), (start + 1).alias("to"))
    rows.repartition(4).write.parquet(uri(at + "/in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(uri(at + "/in"))
    counted = streams.stream_coverage(stream, t.genome(spark), 1000, "ts", "10 minutes", "10000 days")
    last = streams.to_last(counted, uri(at + "/out"), uri(at + "/state"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "seqname", "bin", F.col("value").alias("n"))
