"""Tables that cut lineage: Parquet below the shared folder that the cluster names
in ``spark.checkpoint.dir`` (never a machine-local folder), so a lost executor
costs the recomputation of its own tasks only."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``. Where it is
    unset, a folder of this process on a local master, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = "file://" + os.path.join(tempfile.gettempdir(), f"factorloom-{uuid.uuid4().hex}")
    return _own


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder below the shared one that goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. The table
    goes with :func:`drop`, or when the JVM ends."""
    path = f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, once nothing reads them any more."""
    for table in tables:
        place, files = _place(table.sparkSession, table._written)
        files.delete(place, True)
