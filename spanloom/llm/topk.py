"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integer components. Queries and candidates are dealt into blocks
of bounded size, and every query block meets every candidate block once: a block
pair is one task's work, so neither side is ever broadcast or gathered whole.
Within a pair the candidates lie dimension by dimension (vertical layout). Dot
products are accumulated one block of dimensions at a time; after each block the
Cauchy-Schwarz bound on the mass that remains decides which candidates can still
reach a query's k-th best lower bound, and the survivors are compacted. The first
candidate block is searched before the others, and each query's k-th best score in it
is the bound that the other pairs start from. Each pair hands on at most k rows per
query, merged by a group-limited window.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither as query nor as candidate; a null id takes no part; missing
components (shorter vectors) count as 0; repeated ids are separate candidates,
but a row never meets a candidate of its own id, and repeated query rows ask once; ties go
to the smaller id; a score beyond 64 bits that is among a query's best of a block is an error;
an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Rows of a query block and of a candidate block: 4,096 and 32,768 vectors of 64 components are 2 and 17 MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 32768
DIM_BLOCK = 16

_PAIR = "query_id long, vec_id long, score long"


def _matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    """Lists of whole doubles as an array of ``width`` rows, one column per vector."""
    lists = table.column(column).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(out.T)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one query with some candidates in whole numbers; an error where one does not fit 64 bits."""
    reach = np.abs(q) @ np.abs(c)
    out = np.zeros(c.shape[1], np.int64)
    small = reach < 2.0**62
    # no partial sum leaves 64 bits, whatever the order
    out[small] = q.astype(np.int64) @ c[:, small].astype(np.int64)
    for j in np.flatnonzero(~small):
        score = sum(int(x) * int(y) for x, y in zip(q, c[:, j], strict=True))
        if not -(2**63) <= score < 2**63:
            raise OverflowError(f"a score of {score} does not fit 64 bits")
        out[j] = score
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, dim_block: int = DIM_BLOCK, floors: np.ndarray | None = None):
    """The k best candidates of each query: index of query, index of candidate, score.

    q and c hold one vector per column; floors: scores below which nothing is wanted
    of each query. Exact: a candidate goes only if its upper bound is below the k-th
    best lower bound, and ties keep their place. Bounds allow for the rounding of the
    partial sums; where these may not be whole numbers any more (large components),
    the survivors' scores are computed in 64-bit integers.
    """
    dims, n = c.shape
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not n or not q.shape[1]:
        return found
    large = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1) >= 2**53
    cuts = list(range(0, dims, dim_block)) or [0]
    mass = lambda m: np.stack([np.sqrt((m[s:].astype(float) ** 2).sum(0)) for s in [*cuts[1:], dims]])
    q_rest, c_rest = mass(q), mass(c)
    rounding = 4 * (dims + 1) * 2.0**-53 * np.sqrt((c**2).sum(0)) if large else np.zeros(n)
    q_norm = np.sqrt((q**2).sum(0))
    end = cuts[1] if len(cuts) > 1 else dims
    for at in range(0, q.shape[1], 256):
        first = q[:end, at : at + 256].T @ c[:end]
        for i, part in enumerate(first, at):
            own = q_ids[i]
            alive = None
            wanted = -np.inf if floors is None else floors[i]
            for b, cut in enumerate(cuts):
                if b:
                    stop = cut + dim_block
                    part = part + q[cut:stop, i] @ (c[cut:stop] if alive is None else c[cut:stop, alive])
                if len(part) <= k + 1 and wanted == -np.inf:
                    continue
                rest, error = (c_rest[b], rounding) if alive is None else (c_rest[b, alive], rounding[alive])
                slack = q_rest[b, i] * rest * (1 + 1e-9) + q_norm[i] * error + 1e-6
                low = part - slack
                low[(c_ids if alive is None else c_ids[alive]) == own] = -np.inf
                floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                keep = np.flatnonzero(part + slack >= max(floor, wanted))
                if len(keep) < 0.7 * len(part):
                    alive = keep if alive is None else alive[keep]
                    part = part[keep]
            alive = np.arange(n) if alive is None else alive
            others = c_ids[alive] != own
            alive, part = alive[others], part[others]
            score = _exact(q[:, i], c[:, alive]) if large else np.rint(part).astype(np.int64)
            best = np.lexsort((c_ids[alive], ~score))[:k]  # ~ turns the order without overflow
            found.append((np.full(len(best), own), c_ids[alive[best]], score[best]))
    return found


def _pairs(queries: DataFrame, candidates: DataFrame, width: int, k: int) -> DataFrame:
    """The k best of every query in each pair of blocks; queries have ``floor``, a score that is reached elsewhere."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        floors = np.array([-np.inf if x is None else float(x) * (1 - 1e-12) - 1 if x > 0 else float(x) * (1 + 1e-12) - 1 for x in left.column("floor").to_pylist()])
        asked, given = left.column("query").to_numpy(), right.column("vid").to_numpy()
        found = search_block(asked, _matrix(left, "vector", width), given, _matrix(right, "v", width), k, floors=floors)
        cat = lambda j: np.concatenate([x[j] for x in found]) if found else np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(cat(0), pa.int64()), "vec_id": pa.array(cat(1), pa.int64()), "score": pa.array(cat(2), pa.int64())})

    # both sides come from one table: names of their own keep them apart
    left = queries.select(F.col("qb").alias("query_block"), F.col("cb").alias("block"), F.col("vid").alias("query"), F.col("v").alias("vector"), "floor")
    return left.groupBy("query_block", "block").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(pair, _PAIR)


def top_k(vectors: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score."""
    raw = vectors.select(F.col(vec_id).cast("long").alias("vid"), F.transform(embedding, lambda x: x.cast("double")).alias("raw"), is_query.alias("isq"))
    sound = raw.where("vid is not null and raw is not null and forall(raw, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    whole = F.transform("raw", lambda x: F.rint(F.floor(F.lit(float(scale)) * x).cast("double")))
    # beyond 64 bits floor has no whole number to give, and the product is one already
    huge = F.transform("raw", lambda x: F.lit(float(scale)) * x)
    v = F.when(F.exists("raw", lambda x: F.abs(F.lit(float(scale)) * x) >= 2.0**62), huge).otherwise(whole)
    ready = sound.select("vid", F.coalesce("isq", F.lit(False)).alias("isq"), v.alias("v"))
    n, m, width = ready.agg(F.count("*"), F.count_if("isq"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    q_blocks, c_blocks = max(1, math.ceil(m / query_block)), max(1, math.ceil(n / candidate_block))
    # every block smaller than its bound and the tasks enough to fill a small cluster
    c_blocks = max(c_blocks, min(math.ceil(n / 4096), 12)) if n else 1
    place = lambda blocks, seed: F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(blocks)).cast("int")
    asked = ready.where("isq").dropDuplicates(["vid", "v"]).select(place(q_blocks, 1).alias("qb"), "vid", "v")
    given = ready.select(place(c_blocks, 2).alias("cb"), "vid", "v")
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    copies = given.select(every(0, q_blocks - 1).alias("qb"), "cb", "vid", "v")
    none = F.lit(None).cast("long").alias("floor")
    # the first candidate block gives each query a score that its k best reach; the other blocks start from it
    near = _pairs(asked.select("qb", F.lit(0).alias("cb"), "vid", "v", none), copies.where("cb = 0"), width, k)
    if c_blocks > 1:
        near = stage(near, "nearest")
        own = near.groupBy(F.col("query_id").alias("vid")).agg(F.count("*").alias("c"), F.sort_array(F.collect_list("score"), False).alias("scores"))
        floors = own.where(F.col("c") >= k).select("vid", F.element_at("scores", k).alias("floor"))
        later = asked.join(floors, "vid", "left").select("qb", every(1, c_blocks - 1).alias("cb"), "vid", "v", "floor")
        near = near.unionByName(_pairs(later, copies.where("cb > 0"), width, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, 20, F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
