"""A price panel made from an order-line table: one asset for each supplier, one
bar for each month or week of shipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """x to a number of digits by floating arithmetic alone, which is the same in
    every engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def bars(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """asset, time (date), open high low close volume vwap cap, sector industry
    subindustry, tradable, index_open index_close mkt smb hml."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = read("lineitem").select(F.col("l_suppkey").alias("asset"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("time"), *order, "l_quantity")
    # few lines are of one bar: they are dealt as they are, which is less than their aggregates
    lines = lines.repartition("asset", "time").select(
        "asset", "time", F.struct(*order).alias("at"), fixed(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("price"), "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("money"),
    )
    bar = lines.groupBy("asset", "time").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), (F.sum("money").cast("double") / F.sum("l_quantity")).alias("vwap"),
    )
    suppliers = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    suppliers = suppliers.select(F.col("s_suppkey").alias("asset"), F.col("n_regionkey").cast("int").alias("sector"), F.col("s_nationkey").cast("int").alias("industry"))
    bar = bar.join(suppliers, "asset").withColumns(
        {
            "vwap": fixed(F.col("vwap"), 6),
            "subindustry": (F.col("industry") * 2 + F.col("asset") % 2).cast("int"),
            "cap": fixed(F.col("close") * (F.col("asset") % 5 + 1), 4),
            "tradable": F.col("volume") > 40,
        }
    )
    day = Window.partitionBy("time")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).over(day).cast("double")
    n = F.count(F.lit(1)).over(day)
    bar = bar.withColumns({"index_open": fixed(exact("open") / n, 4), "index_close": fixed(exact("close") / n, 4)})
    return bar.withColumns(
        {
            "mkt": fixed(F.col("index_close") / F.col("index_open") - 1, 6),
            "smb": fixed(F.sin(F.col("index_close")), 6),
            "hml": fixed(F.cos(F.col("index_open") * 3), 6),
        }
    )


#: The same panel in SQL, as common table expressions that end with ``panel``.
SQL = """
with lines as (select l_suppkey as asset, date_trunc('{unit}', l_shipdate)::date as time,
    struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_extendedprice) as ord,
    floor(l_extendedprice / l_quantity * 10000.0::double + 0.5) / 10000.0::double as price, l_quantity, l_extendedprice::decimal(18,2) as money from lineitem),
bar as (select asset, time, arg_min(price, ord) as open, max(price) as high, min(price) as low, arg_max(price, ord) as close,
    sum(l_quantity) as volume, floor(sum(money)::double / sum(l_quantity) * 1000000.0::double + 0.5) / 1000000.0::double as vwap from lines group by asset, time),
panel as (select bar.*, n_regionkey as sector, s_nationkey as industry, (s_nationkey * 2 + asset % 2)::int as subindustry,
    volume > 40 as tradable, row_number() over (partition by asset order by time) as i
    from bar join supplier on s_suppkey = asset join nation on n_nationkey = s_nationkey)
"""
def _fixed_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits}::double + 0.5::double) / 1e{digits}::double"


_MEAN = "sum({}::decimal(18,4))::double / count(*)"
#: The columns of the market besides, as ``wide``; behind ``SQL``.
WIDE_SQL = f""",
idx as (select time, {_fixed_sql(_MEAN.format('open'), 4)} as index_open, {_fixed_sql(_MEAN.format('close'), 4)} as index_close from panel group by time),
wide as (select panel.*, {_fixed_sql('close * (asset % 5 + 1)', 4)} as cap, index_open, index_close, {_fixed_sql('index_close / index_open - 1', 6)} as mkt, {_fixed_sql('sin(index_close)', 6)} as smb, {_fixed_sql('cos(index_open * 3)', 6)} as hml
    from panel join idx using (time))
"""
