"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. A source's target is its weight's share of all words, at most
``cap`` times its own; what is above goes to the others by weight until none is
above. In closed form: with the sources in the order of cap over weight, the
water level is where the capped ones end.

Each source is dealt by hash into blocks: at least BLOCKS, and so many that the
largest source has about BLOCK_ROWS documents in one. A source is taken
whole as often as its target allows; of the rest, its blocks are drawn in an
order permuted by hash until the target is reached, and in the block at the
border, documents in a permuted order. Block quotas are exact by source. Which
output shard gets how many of a source's blocks is drawn by a tree: every node
splits its quotas between its halves by a multivariate hypergeometric draw, one
source after another, each conditional on the rest. A source's permuted blocks
then go to the shards in disjoint runs, and a document's ``pick`` orders it
within its shard (the local shuffle).

Only counts by (source, block) and by source are exchanged, combined before the
shuffle; the documents meet the block plan in a join on (source, block), so that
a hot source is spread over its blocks. Draws depend on the seed and the rows
alone: reruns agree. Window orderings are within one source's blocks (at most
``blocks`` rows) or one border block's documents.

Defined cases: a null text has size 0 and is taken for 0; null is a source of its
own, in order the last; with no words every target is 0; rows with the same id
share their block, and within it they stand by size and by a hash of their text, so
reruns take the same texts; of equal rows some may be taken once more than others,
and which of them cannot be told; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .textops import SPACE_WORD_RE

WEIGHTS = [5, 2, 1]
CAP = 3
BLOCKS = 256
#: Documents of the largest source in a block, beyond which there are more blocks.
BLOCK_ROWS = 4096
SHARDS = 8


def _unit(*parts: Column) -> Column:
    """A number from 0 to 2^32-1 by md5 of the parts; a null part counts as its own text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> with weight and target; one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    level = ranked.withColumn("weight", weight.cast("long")).withColumn("ratio", (cap * F.col("source_size")) / F.col("weight"))
    order = Window.orderBy("ratio", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    run = (
        level.withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("lambda", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first source whose cap is not below the level of those from it on sets the level
    fixed = F.min(F.when(F.col("lambda") <= F.col("ratio"), F.struct("ratio", "n", "lambda"))).over(everything)["lambda"]
    target = F.least((cap * F.col("source_size")).cast("double"), fixed * F.col("weight"))
    return run.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "weight", "target")


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` fall into ``draws``, by inversion at u in [0, 1).

    Two walks over the support by the ratio of neighbouring probabilities, as
    logarithms relative to the largest so far, so that nothing vanishes or
    overflows: one sums the mass, one stops where u lies.
    """
    low = F.greatest(F.lit(0).cast("long"), draws + good - total)
    high = F.least(good, draws)
    ratio = lambda k: F.log(((good - k + 1) * (draws - k + 1)).cast("double")) - F.log((k * (total - good - draws + k)).cast("double"))
    support = F.sequence(low + 1, F.greatest(high, low + 1))
    zero, one = F.lit(0.0), F.lit(1.0)

    def add(a: Column, k: Column) -> Column:
        return _let(a["log"] + ratio(k), lambda x: F.struct(x.alias("log"), F.greatest(a["top"], x).alias("top"), (a["sum"] * F.exp(a["top"] - F.greatest(a["top"], x)) + F.exp(x - F.greatest(a["top"], x))).alias("sum")))

    mass = F.aggregate(support, F.struct(zero.alias("log"), zero.alias("top"), one.alias("sum")), add)

    def walk(m: Column) -> Column:
        first = F.struct(zero.alias("log"), F.exp(-m["top"]).alias("sum"), F.lit(0).cast("long").alias("below"))

        def pass_by(a: Column, k: Column) -> Column:
            over = F.when(a["sum"] <= u * m["sum"], 1).otherwise(0).cast("long")
            return _let(a["log"] + ratio(k), lambda x: F.struct(x.alias("log"), (a["sum"] + F.exp(x - m["top"])).alias("sum"), (a["below"] + over).alias("below")))

        return F.aggregate(support, first, pass_by)["below"]

    return F.when(high > low, F.least(high, low + _let(mass, walk))).otherwise(low)


def shard_quotas(units: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """source, units -> source, shard, quota, from (the run of the source's permuted units), by the splitting tree."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = units.select("source", F.lit(0).alias("node"), F.col("units").alias("quota"))
    width = shards
    while width > 1:
        width //= 2
        # the left half's capacity is half of the node's units; sources draw from it in turn
        listed = nodes.groupBy("node").agg(F.sum("quota").alias("all"), F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("list"))
        state = F.struct((F.col("all") - F.expr("`all` div 2")).alias("draws"), F.col("all").alias("left"), F.array().cast("array<bigint>").alias("taken"))

        def step(a: Column, x: Column) -> Column:
            u = _unit(F.lit(seed), F.lit(width), F.col("node"), x["source"]) / F.lit(2.0**32)
            drawn = _hypergeometric(x["quota"], a["left"], a["draws"], u)
            return _let(drawn, lambda k: F.struct((a["draws"] - k).alias("draws"), (a["left"] - x["quota"]).alias("left"), F.concat(a["taken"], F.array(k)).alias("taken")))

        split = listed.withColumn("taken", F.aggregate("list", state, step)["taken"])

        def halves(x: Column) -> Column:
            part = lambda side, quota: F.struct(x["list"]["source"].alias("source"), (F.col("node") * 2 + side).alias("node"), quota.alias("quota"))
            return F.array(part(0, x["taken"]), part(1, x["list"]["quota"] - x["taken"]))

        nodes = split.select(F.inline(F.flatten(F.transform(F.arrays_zip("list", "taken"), halves))))
    run = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("source", F.col("node").alias("shard"), "quota", F.coalesce(F.sum("quota").over(run), F.lit(0)).alias("from"))


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies (how often it is taken), placed (shard of each copy) and pick."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(SPACE_WORD_RE), F.lit(0))).cast("long")
    key = _unit(F.col(id_col), F.lit(seed))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), key.alias("pick"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = stage(rows, "mix-rows")
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while largest > blocks * BLOCK_ROWS:
        blocks *= 2
    rows = rows.withColumn("block", (F.col("pick") % blocks).cast("int"))

    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = sums.join(aims, sums["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    order = Window.partitionBy("source").orderBy("turn", "block")
    plan = (
        plan.withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("turn", _unit(F.col("block"), F.col("source"), F.lit(seed)))
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("drawn", (F.col("words") > 0) & (F.col("before") + F.col("words") <= F.col("rest")))
        .withColumn("border", (F.col("words") > 0) & ~F.col("drawn") & (F.col("before") < F.col("rest")))
        .withColumn("units", F.col("whole") + F.when(F.col("drawn") | F.col("border"), 1).otherwise(0))
        .withColumn("unit_from", F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("units"))
    )
    plan = stage(plan, "mix-plan")
    quotas = shard_quotas(plan.groupBy("source").agg(F.sum("units").alias("units")), shards, seed)
    runs = quotas.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("from", "quota", "shard"))).alias("runs"))
    plan = plan.join(runs, plan["source"].eqNullSafe(runs["source"]), "left").drop(runs["source"])
    shard_of = lambda u: F.element_at(F.filter("runs", lambda r: (r["from"] <= u) & (u < r["from"] + r["quota"])), 1)["shard"]
    placed = F.when(F.col("units") > 0, F.transform(F.sequence(F.col("unit_from"), F.greatest(F.col("unit_from") + F.col("units") - 1, F.col("unit_from"))), shard_of)).otherwise(F.array().cast("array<int>"))
    plan = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "whole", "rest", "before", "drawn", "border", placed.alias("shards"))

    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["block"] == plan["b"])).drop("s", "b")
    inner = joined.where("not border").withColumn("copies", F.col("whole") + F.when(F.col("drawn"), 1).otherwise(0))
    walk = Window.partitionBy("source", "block").orderBy("pick", "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where("border").withColumn("upto", F.col("before") + F.sum("size").over(walk) - F.col("size"))
    edge = edge.withColumn("copies", F.col("whole") + F.when(F.col("upto") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    both = inner.unionByName(edge)
    taken = F.when(F.col("copies") > 0, F.slice("shards", F.lit(1), F.greatest(F.col("copies").cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return both.select("doc_id", "size", "source", "source_size", "target", "copies", taken.alias("placed"), "pick")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_sql(table: str = "documents") -> str:
    unit = lambda *p: "CAST(('0x' || substr(md5(" + " || '|' || ".join(p) + "), 1, 8)) AS BIGINT)"
    return f"""
WITH RECURSIVE mix_d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD_RE}')) AS BIGINT) AS size,
         {unit("coalesce(CAST(doc_id AS VARCHAR), '~')", "'0'")} AS pick FROM {table}
), mix_r AS (SELECT *, pick % {BLOCKS} AS block FROM mix_d),
mix_b AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM mix_r GROUP BY source, block),
mix_s AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM mix_b GROUP BY source),
mix_n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM mix_s),
mix_w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM mix_n),
mix_l AS (SELECT *, CAST({CAP} * source_size AS DOUBLE) / weight AS ratio FROM mix_w),
mix_c AS (
  SELECT *, coalesce(sum({CAP} * source_size) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(source_size) OVER () AS total,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM mix_l
), mix_v AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM mix_c),
mix_f AS (SELECT arg_min(level, ratio * 1e6 + n) AS level FROM mix_v WHERE level <= ratio),
mix_t AS (SELECT source, source_size, coalesce(least(CAST({CAP} * source_size AS DOUBLE), (SELECT level FROM mix_f) * weight), 0.0) AS target FROM mix_v),
mix_p AS (
  SELECT b.source, block, words, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    {unit("CAST(block AS VARCHAR)", "coalesce(b.source, '~')", "'0'")} AS turn
  FROM mix_b b JOIN mix_t t ON b.source IS NOT DISTINCT FROM t.source
), mix_q AS (
  SELECT *, target - whole * source_size AS rest,
    sum(words) OVER (PARTITION BY source ORDER BY turn, block ROWS UNBOUNDED PRECEDING) - words AS before FROM mix_p
), mix_j AS (
  SELECT r.*, source_size, target, whole, rest, before, before + words <= rest AS drawn,
    before + sum(size) OVER (PARTITION BY r.source, r.block ORDER BY pick, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS upto
  FROM mix_r r JOIN mix_q q ON r.source IS NOT DISTINCT FROM q.source AND r.block = q.block
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN drawn THEN 1 WHEN before < rest AND upto + CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM mix_j
"""


OP4_SQL = mix_sql()
