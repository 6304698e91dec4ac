"""Structured Streaming over the events table: daily counts and admission (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.storage import session_dir


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else sf_dir + "/events*.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, n): events per UTC day, counted by a stream that ends with its input.

    Each micro-batch writes the days that changed; the watermark lets state forget days that can
    change no more. The last that was written of a day holds.
    """
    out = f"{session_dir(spark)}/daily-{uuid.uuid4().hex}"
    days = stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    rows = days.select(F.to_date("window.start").alias("day"), "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")  # again after a failure, the same

    q = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("day").agg(F.max_by("n", "batch").alias("n"))
