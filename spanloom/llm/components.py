"""Connected components of an edge table, without gathering edges anywhere.

Alternating large-star and small-star steps (each a map-side-combined minimum per
vertex and a join) turn every component into a star around its smallest vertex,
in rounds that grow with the logarithm of the number of vertices. Every round is
staged, so lost executors cost one round at most, and the round before the last
one staged is deleted.

Defined cases: edges with a null end and loops are dropped, repeated edges count
once, both directions are the same edge; without edges there are no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import drop_path, stage_at, stage_path


def _pairs(*pairs) -> Column:
    return F.inline(F.array(*[F.struct(F.col(x).alias(p), F.col(y).alias(q)) for (x, p), (y, q) in pairs]))


def _mark(edges: DataFrame) -> tuple:
    """What tells a set of edges from another: count and sum of 128 bits of hashes."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total(1), total(2)).first())


def components(edges: DataFrame) -> DataFrame:
    """a long, b long -> node, root (the component's smallest node), for nodes that have an edge."""
    spark = edges.sparkSession
    paths = [stage_path(spark, "edges")]
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage_at(clean.distinct(), paths[0])
    was = _mark(now)
    while True:
        near = now.select(_pairs((("a", "u"), ("b", "v")), (("b", "u"), ("a", "v"))))
        least = near.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(_pairs((("b", "a"), ("m", "b")), (("a", "a"), ("m", "b"))))
        paths.append(stage_path(spark, "edges"))
        after = stage_at(small.where("a <> b").distinct(), paths[-1])
        mark = _mark(after)
        now, same, was = after, mark == was, mark
        drop_path(spark, paths[-2])
        if same:
            break
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends)
