"""Reading and checking panels.

A panel is a long DataFrame with one row for each (symbol, time). Doubles may be
NULL or NaN for missing; inside the engine missing is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def field(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"missing column `{name}`")
    return df.schema[name].dataType


def require_double(df: DataFrame, name: str) -> None:
    if not isinstance(field(df, name), T.DoubleType):
        raise ValueError(f"column `{name}` must be f64, found {field(df, name).simpleString()}")


def require_boolean(df: DataFrame, name: str) -> None:
    if not isinstance(field(df, name), T.BooleanType):
        raise ValueError(f"column `{name}` must be bool, found {field(df, name).simpleString()}")


def require_group(df: DataFrame, name: str) -> None:
    if not isinstance(field(df, name), (T.StringType, *_WHOLE)):
        raise ValueError(f"group column `{name}` must be a string or whole number, found {field(df, name).simpleString()}")


def clean(df: DataFrame, names: list[str]) -> DataFrame:
    """NaN as NULL in the double columns listed."""
    return df.withColumns({n: F.nanvl(F.col(f"`{n}`"), F.lit(None).cast("double")) for n in names}) if names else df


def check_keys(df: DataFrame, symbol: str, time: str, groups: list[str] = ()) -> None:
    """Keys without NULL or NaN and without duplicates; groups without NULL and
    within 32 bits. Two actions over the key columns only."""
    tests = []
    for name in (symbol, time):
        kind = field(df, name)
        tests.append((F.col(f"`{name}`").isNull(), f"null values are not allowed in time/symbol column `{name}`"))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            tests.append((F.isnan(f"`{name}`"), f"NaN values are not allowed in structural column `{name}`"))
    for name in groups:
        tests.append((F.col(f"`{name}`").isNull(), f"null values are not allowed in group column `{name}`"))
        if isinstance(field(df, name), T.LongType):
            tests.append((~F.col(f"`{name}`").between(-(2**31), 2**31 - 1), f"group column `{name}` does not fit in 32 bits"))
    found = df.agg(*[F.coalesce(F.max(t.cast("int")), F.lit(0)).alias(f"t{i}") for i, (t, _) in enumerate(tests)]).first()
    for i, (_, message) in enumerate(tests):
        if found[i]:
            raise ValueError(message)
    twice = df.groupBy(symbol, time).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate (`{twice[0][0]}`, `{twice[0][1]}`) value found")


def roundtrip(df: DataFrame) -> DataFrame:
    return df


def read_factors(spark, path: str, symbol: str, time: str, factors: list[str]) -> DataFrame:
    """Keys and the listed factors of a Parquet file; nothing else is read."""
    source = spark.read.parquet(path)
    for name in (symbol, time, *factors):
        field(source, name)
    return source.select(symbol, time, *factors)


def check_same_keys(panel: DataFrame, source: DataFrame, symbol: str, time: str) -> None:
    a, b = panel.select(symbol, time), source.select(symbol, time)
    for x, y in ((a, b), (b, a)):
        if x.join(y, [symbol, time], "left_anti").limit(1).collect():
            raise ValueError("factor_source panel does not match the input panel")
    check_keys(source, symbol, time)
