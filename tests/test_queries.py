"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from sheaf.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_negative_parens_of_odd_balances(spark, tmp_path):
    """Zeros of both signs, what rounds to zero, nulls, and balances whose neighbours lie further apart than a cent."""
    odd = [None, 0.0, -0.0, 0.004, -0.004, 0.005, -0.005, -0.5, -0.995, -1.0, 0.125, -999.995, 999.995, -1000.0, 1234567.895, 75891102442745.59375, -75891102442745.59375, 45678901234567.998, -2.0**46 - 0.015625, 2.0**53 + 2, -(2.0**62) - 1024]
    df = pd.DataFrame({"c_custkey": range(len(odd)), "c_acctbal": pd.Series(odd, dtype="float64")})
    df.to_parquet(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet')")
    want = con.execute(ORACLE_SQL["fmt_negative_parens"] + " ORDER BY c_custkey").fetchall()
    got = QUERIES["fmt_negative_parens"](spark, str(tmp_path)).orderBy("c_custkey").collect()
    assert [tuple(r) for r in got] == want and want[0] == (0, None, None) and want[2] == (2, "0", "-0.00")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
