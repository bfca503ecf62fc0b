"""Helpers that the operators of this subpackage share; tables that cut lineage are
those of ``sources.scratch``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, written  # noqa: F401

#: Rows in one Arrow batch between the JVM and Python; bounds a worker's memory.
BATCH_ROWS = 256


#: Bytes of a table of fixed-width rows that may be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """A written table of fixed-width columns, broadcast if all its rows fit in
    ``BROADCAST_BYTES``, else joined by shuffle."""
    width = 16 + sum(8 * max(1, str(t.dataType).count("Type") - 1) + 8 for t in df.schema)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch, for the whole session: the same number for every
    operator of this subpackage, so that no lazy plan depends on which came last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def text_key(column: Column, seed: int) -> Column:
    """A 64-bit hash of a text; two seeds make a 128-bit key."""
    return F.xxhash64(F.lit(seed), column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
