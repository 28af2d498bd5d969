"""Sums of the fact at coarser grains, in the fact's own shape.

A row of ``by_cell`` stands for all transactions of a month with the same four
ids, dated the first of that month; a row of ``by_client_month`` for a client's
revenue in a month.  Both have the fact's column names, and both are sums of
decimals, so summing them over any set of segments gives exactly what the fact
gives: the queries that group the fact by month and ids (``metrics``,
``reports``, ``bi.measures``) take the cells in its place, and those about
clients (``cohorts``, ``bi.net_revenue_retention``) the client months.  Queries
that look at single transactions need the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohorts import is_valid_revenue
from .star import period_of

CELL_KEYS = ("period", "dept_id", "region_id", "product_id", "category_id")
SUM = "decimal(28,4)"
CELL_SCHEMA = (f"date date, revenue {SUM}, expenses {SUM}, dept_id int, region_id int, product_id int, category_id int, "
               "n_rows bigint, period int")
CLIENT_SCHEMA = f"client_id string, date date, revenue {SUM}"


def by_cell(fact_tx: DataFrame) -> DataFrame:
    """One row per month (null: no date) and ids (null: none): exact sums and the number of transactions."""
    rows = fact_tx.withColumn("period", period_of(F.col("date"))).withColumn("n_rows", F.lit(1).cast("bigint"))
    return merged_cells(rows)


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of several segments as one row each."""
    sums = cells.groupBy(*CELL_KEYS).agg(
        F.min(F.trunc("date", "month")).alias("date"), F.sum("revenue").cast(SUM).alias("revenue"),
        F.sum("expenses").cast(SUM).alias("expenses"), F.sum("n_rows").alias("n_rows"))
    return sums.select("date", "revenue", "expenses", "dept_id", "region_id", "product_id", "category_id", "n_rows", "period")


def by_client_month(fact_tx: DataFrame) -> DataFrame:
    """A client's revenue by month, of the rows that count for cohorts."""
    return merged_clients(fact_tx.where(is_valid_revenue()))


def merged_clients(clients: DataFrame) -> DataFrame:
    """Client months of several segments as one row each."""
    return clients.groupBy("client_id", F.trunc("date", "month").alias("date")).agg(
        F.sum("revenue").cast(SUM).alias("revenue"))
