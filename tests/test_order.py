"""Rows come in the order that a query promises (O1-O5): that of its DuckDB twin, sorted."""

import pytest

from check_oracle import duck
from ledgerline.plans import catalog, oracle

ORDERS = {
    "monthly_performance": "month",
    "department_performance": "actual_revenue DESC, department",
    "regional_profitability": "net_profit DESC, region",
    "product_profitability": "net_profit DESC, product_line",
    "expenses_by_category": "expenses DESC, category",
    "revenue_cohorts": "cohort_month, elapsed_months",
}
DIMENSIONS = ["star_dim_departments", "star_dim_regions", "star_dim_products", "star_dim_categories"]


@pytest.mark.parametrize("name", ORDERS)
def test_rows_come_in_order(spark, sf_dir, name):
    columns = [c.removesuffix(" DESC") for c in ORDERS[name].split(", ")]
    got = [tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, sf_dir).collect()]
    sql = oracle.oracle_sql()[name].rstrip().rstrip(";")
    want = duck(sf_dir).execute(f"SELECT {', '.join(columns)} FROM ({sql}) t ORDER BY {ORDERS[name]}").fetchall()
    assert len(want) > 1 and got == want


@pytest.mark.parametrize("name", DIMENSIONS)
def test_ids_follow_sorted_names(spark, sf_dir, name):
    rows = [tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect()]
    names = [n for _, n in sorted(rows)]
    assert [i for i, _ in sorted(rows)] == list(range(1, len(rows) + 1))
    assert names == sorted(set(names)) and len(names) > 1
