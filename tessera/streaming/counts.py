"""Streams, an extension: anchor counts and gap groups over Structured Streaming sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import shared_folder


def read_files(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def anchor_counts(stream: DataFrame) -> DataFrame:
    """``(anchor, entity)`` to running counts (complete or update mode)."""
    return stream.groupBy("anchor", F.coalesce("entity", F.lit(-1)).cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts of each token in tumbling windows; rows later than ``late`` are dropped and closed windows forgotten."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "token", "n")


def gap_sessions(stream: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """Labels of a user grouped while the gap between them stays under ``gap``: session windows."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drain(result: DataFrame) -> DataFrame:
    """Run a stream over all that is there now and return its last complete output, from files of the shared
    folder: each batch writes its state's table whole, the last one's stays."""
    spark, path = result.sparkSession, f"{shared_folder(result.sparkSession)}/tessera/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out")

    query = result.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")


def drain_to_files(result: DataFrame) -> DataFrame:
    """As ``drain`` for append mode, into Parquet files of the shared folder (exactly once, by the sink's log)."""
    spark, path = result.sparkSession, f"{shared_folder(result.sparkSession)}/tessera/stream-{uuid.uuid4().hex}"
    query = result.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")
