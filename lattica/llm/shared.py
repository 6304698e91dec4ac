"""Tables in the folder that driver and executors share, and shipping of this package to executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lattica.functions.storage import session_dir, ship

__all__ = ["session_dir", "ship", "table"]


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
