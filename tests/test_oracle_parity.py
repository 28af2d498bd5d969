"""Every registered query against its DuckDB twin (rows, columns, values)."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare
from ledgerline.plans import catalog, oracle

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def report(spark, sf_dir):
    return compare(spark, sf_dir, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(report, name):
    r = report[name]
    assert "error" not in r, r.get("error")
    assert r["cols_match"], r.get("cols")
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["exact"], r.get("sample_diff")
    assert r["types_match"], r.get("types")


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["total_revenue"] > 0
