"""Every registered query of the ledger engine against its DuckDB SQL."""

import decimal
import math
import os

import duckdb
import pytest

from ledgerloom.plans import catalogue

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert left == right
    assert left


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(SQL)


def test_no_window_over_a_whole_table(spark, capsys):
    """A window without a partition is planned for tables of one row a partition or a literal's size only."""
    catalogue.queries()["ledger_projection"](spark, SF).explain("simple")
    assert "SinglePartition" not in capsys.readouterr().out.split("BroadcastExchange")[0]
