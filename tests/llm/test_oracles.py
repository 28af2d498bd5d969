import pytest

from check_oracle import compare
from ledgerline.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    r = compare(spark, sf_dir, [name], verbose=False)[name]
    assert "error" not in r, r.get("error")
    assert r["cols_match"] and r["types_match"] and r["exact"], r
