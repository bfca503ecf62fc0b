"""Registered queries against their SQL on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from factorloom import queries

SF = "/root/testdata/sf0.001"
#: The tables for which the noisy factors are known: on smaller ones other ranks part
#: values that are equal but for rounding noise (alpha50 and alpha78).
LIBRARY_SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()
NAMES = "panel expr_sma expr_multi_resi compute_top compute_to_parquet qlib_alpha158 worldquant_alpha101 with_labels_calendar evaluate_summary evaluate_bins_global evaluate_portfolio_factor_weights evaluate_factor_source report_long_short report_rolling_mean report_histogram".split()


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(names)


def database(folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, name):
    folder = LIBRARY_SF if name in queries.BUILDERS else SF
    df = queries.queries()[name](spark, folder)
    cursor = database(folder).execute(queries.oracle_sql()[name])
    got, want = shown(df.collect(), df.columns), shown(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got[1] == want[1] and got[0] == want[0] and got[0]


def test_all_queries_have_sql_but_the_noisy_ones():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {f"{n}_noisy" for n, names in queries.NOISY.items() if names}
