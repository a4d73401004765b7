"""Ranges, reads, tracks and sequences derived from the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 1_000_200
READ_LENGTH = 101_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000000
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("seqname"),
        start.alias("from"),
        (start + 25 + F.col("l_quantity").cast("long")).alias("to"),
        F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("*").alias("strand"),
        F.col("l_quantity").alias("score"),
    )


def queries(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("o_orderkey") * 15485863) % 1000000
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("seqname"),
        start.alias("from"),
        (start + 100).alias("to"),
        F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise("*").alias("strand"),
        F.col("o_orderpriority").alias("name"),
    )


def genome(spark: SparkSession, length: int = LENGTH) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("seqname"), F.lit(length).cast("long").alias("length"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    start = (e * 7919) % 100000
    return table(spark, d, "events").select(
        e.alias("row_id"),
        F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("seqname"),
        start.alias("from"),
        (start + 25 + e % 50).alias("to"),
        F.when(e % 2 == 0, "+").otherwise("-").alias("strand"),
        (e % 61).cast("int").alias("mapq"),
        (e % 17 == 0).alias("duplicate"),
        (e % 3 == 0).alias("paired"),
    )


def vector_track(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("seqname"), F.posexplode("embedding").alias("bin", "v")).select("seqname", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("value"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("seqname"), F.regexp_replace(F.lower("text"), "[^acgtn]", "").alias("sequence"))


SUBJECTS = """(SELECT l_orderkey * 10 + l_linenumber AS row_id, 'chr' || (l_suppkey % 5 + 1) AS seqname,
  (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 AS f,
  (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 + 25 + CAST(l_quantity AS BIGINT) AS t,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '*' END AS strand, l_quantity AS score FROM lineitem)"""
QUERIES = """(SELECT o_orderkey AS row_id, 'chr' || (o_custkey % 5 + 1) AS seqname, (o_orderkey * 15485863) % 1000000 AS f,
  (o_orderkey * 15485863) % 1000000 + 100 AS t, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '*' END AS strand, o_orderpriority AS name FROM orders)"""
READS = """(SELECT event_id AS row_id, 'chr' || (user_id % 5 + 1) AS seqname, (event_id * 7919) % 100000 AS f,
  (event_id * 7919) % 100000 + 25 + event_id % 50 AS t, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
  event_id % 61 AS mapq, event_id % 17 = 0 AS duplicate, event_id % 3 = 0 AS paired FROM events)"""
VECTORS = """(SELECT CAST(vec_id AS VARCHAR) AS seqname, unnest(range(0, len(embedding))) AS bin, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
SEQUENCES = """(SELECT CAST(doc_id AS VARCHAR) AS seqname, regexp_replace(lower(text), '[^acgtn]', '', 'g') AS sequence FROM documents)"""
