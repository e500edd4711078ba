"""Answers as a stream: late rows dropped by watermark, repeated answers once, counts by window, states for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.review import Memory, card_states

BUCKETS = 1024


def answers(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without repeated event ids inside the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(stream: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """day, user_id, n, lapses: tumbling windows of a day. delay None: the stream has its watermark already."""
    kept = stream.withWatermark("ts", delay) if delay else stream
    grouped = kept.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 0).cast("int")).alias("lapses"))
    return grouped.select(F.col("window.start").alias("day"), "user_id", "n", "lapses")


def state_sink(stream: DataFrame, log_path: str, state_path: str, checkpoint: str, memory: Memory = Memory()) -> DataStreamWriter:
    """Each batch appends its answers to the log and refolds the cards they touch; a batch that runs twice gives the same files.

    The log lies in BUCKETS folders by card, and a batch reads those of its cards only.
    """
    bucket = F.pmod(F.xxhash64("card_id"), F.lit(BUCKETS)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("bucket", bucket).persist()
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        some = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        log = spark.read.parquet(log_path).where(F.col("bucket").isin(some)).drop("bucket")
        touched = rows.select(F.col("card_id").alias("__c")).distinct()
        states = card_states(log.join(touched, F.col("card_id") == F.col("__c"), "left_semi"), memory)
        states.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each card from the batches' files."""
    columns = [c for c in states.columns if c != "batch"]
    return states.groupBy("card_id").agg(F.max_by(F.struct(*columns), "batch").alias("__s")).select("__s.*")
