"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_ONE = threading.Lock()  # operators may run side by side
_SESSION = f"lattica-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, one local folder in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        with _ONE:
            if not _OWN:
                _OWN.append("file://" + tempfile.mkdtemp(prefix="lattica-"))
        at = _OWN[0]
    return at.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this process's tables in the shared folder."""
    return f"{shared_dir(spark)}/{_SESSION}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables of this process. Results that are still to be read need theirs; call it after them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that tasks import it anywhere."""
    sc = spark.sparkContext
    with _ONE:
        if getattr(sc, "_lattica_shipped", False):
            return
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = os.path.join(tempfile.mkdtemp(), "lattica.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("lattica", os.path.relpath(full, top)))
        sc.addPyFile(out)
        sc._lattica_shipped = True
