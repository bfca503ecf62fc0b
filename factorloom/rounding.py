"""Doubles of a result cut to a number of digits, alike in Spark and SQL.

``floor(x * 10**digits + CUT)``: half as CUT would fall on values that are common
in results: shares of small groups and means of prices have a 5 as their last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import known

CUT = 0.4142


def cut(x, digits: int):
    """x to a number of digits; what is too large for that is infinite."""
    scale = 10.0**digits
    return F.when(F.abs(x) < 1e12, F.floor(x * scale + CUT) / scale).otherwise(F.signum(x) * F.lit(float("inf")))


def cut_sql(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}::double"
    return f"case when abs({x}) < 1e12 then floor(({x})::double * {scale} + {CUT}::double) / {scale} else sign({x}) * 'inf'::double end"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, missing as NULL, and dates as text."""
    return df.select(*[cut(known(F.col(c)), digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])
