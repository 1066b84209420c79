"""Counts of events per window of time, as a stream and as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import shared_folder


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per tumbling window of ``ts``; in a stream, events more than ``late`` behind are
    dropped. The same plan serves batches, where the watermark has no effect."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def trailing_counts(events: DataFrame, key: str, item: str, seconds: int) -> DataFrame:
    """(``item``, n): the events of the same key in the window of ``seconds`` up to each event's ts, itself and those of
    the same time included.

    A key's events are cut into spans of the window's length, and each span also gets those of the span before it,
    which is as far as a window reaches; so a busy key is counted in many tasks.
    """
    micros = F.unix_micros("ts")
    span = F.floor(micros / (seconds * 1_000_000))
    rows = events.where(F.col("ts").isNotNull()).select(key, item, micros.alias("_t"), F.explode(F.array(F.struct(span.alias("s"), F.lit(True).alias("own")), F.struct((span + 1).alias("s"), F.lit(False).alias("own")))).alias("_p"))
    up_to = Window.partitionBy(key, "_p.s").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("n", F.count(F.lit(1)).over(up_to)).where("_p.own").select(item, "n")


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and read it. Each batch overwrites it
    with the complete result, or appends, so that a repeated batch leaves it the same; state and progress are
    kept in the same folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.drop("batch") if mode != "complete" else found
