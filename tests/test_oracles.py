"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from tagtriage.sources.tables import TABLES  # noqa: E402

from core_data import SMALL  # noqa: E402

SQL = E.oracle_sql()
QS = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QS[name](spark, SMALL)
    rows, cols = df.collect(), df.columns
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QS)
    assert len(QS) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert "f1" in df.columns
