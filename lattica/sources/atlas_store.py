"""Versioned atlases in Parquet: append-only, read by version key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "versions"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, parts) of complete atlases; none where nothing was saved."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{HEADER}")
    schema = "version string, parts array<string>"
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{HEADER}")


def save(path: str, version: str, parts: dict[str, DataFrame], most_nodes: int | None = None) -> bool:
    """Appends the parts (nodes, edges, metrics, ...) under a version; False where it is there already.

    The header row is written last and marks the version complete; parts of an attempt that ended
    before it are overwritten by the next one. ``most_nodes`` refuses larger atlases before a write.
    """
    spark = next(iter(parts.values())).sparkSession
    if not versions(spark, path).where(F.col("version") == version).isEmpty():
        return False
    if most_nodes is not None and (n := parts["nodes"].count()) > most_nodes:
        raise ValueError(f"{n} nodes; at most {most_nodes} are kept")
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    spark.createDataFrame([(version, sorted(parts))], "version string, parts array<string>").coalesce(1).write.mode("append").parquet(f"{path}/{HEADER}")
    return True


def load(spark: SparkSession, path: str, version: str, part: str, *order: str) -> DataFrame:
    """One part of a complete version, in key order where one is given; an error for an unknown version."""
    row = versions(spark, path).where(F.col("version") == version).first()
    if row is None or part not in row["parts"]:
        raise KeyError(f"{version}: {part}")
    rows = spark.read.parquet(f"{path}/{part}/version={version}")
    return rows.orderBy(*order) if order else rows


def refuse_large(files: DataFrame, size: str, most_bytes: int) -> DataFrame:
    """The files, or an error where they hold more bytes than allowed; asked before any is read."""
    total = files.agg(F.sum(size)).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"{total} bytes; at most {most_bytes} are read")
    return files
