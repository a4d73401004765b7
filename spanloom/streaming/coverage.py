"""Coverage over a stream of reads, by event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tracks import bins_of


def stream_coverage(reads: DataFrame, genome: DataFrame, bin_size: int, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, seqname, bin, value: read counts by bin and window; reads later than the watermark are left out."""
    known = reads.withWatermark(time, late).join(bins_of(genome, bin_size), "seqname").where((F.col("from") >= 0) & (F.expr(f"`from` div {bin_size}") < F.col("n_bins")))
    last = F.least(F.expr(f"(`to` - 1) div {bin_size}"), F.col("n_bins") - 1)
    cells = known.withColumn("_a", F.expr(f"`from` div {bin_size}")).withColumn("_b", last).where("_a <= _b").withColumn("bin", F.explode(F.sequence("_a", "_b")))
    return cells.groupBy(F.window(time, window), "seqname", "bin").agg(F.count("*").alias("value"))


def to_parquet(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet until the available input is read."""
    return counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def to_last(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All windows, finished or not, as they are when the available input is read; tasks write them, the driver holds none."""
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(number)

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = counts.sparkSession
    return spark.read.schema(counts.schema).parquet(f"{path}/{max(written)}") if written else spark.createDataFrame([], counts.schema)
