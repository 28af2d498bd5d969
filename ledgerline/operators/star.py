"""Initial load: raw files -> star schema (dimensions with dense ids, facts).

Dimension ids are positions of the sorted distinct names; facts look their
names up with left joins (unknown or null name -> null id, row kept).  The
dimensions are distinct name sets, so after their aggregate stage AQE sees
their real size and turns the lookups into broadcast joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INVOICE_STATUSES
from ..functions.numeric import MONEY
from ..session import materialize
from ..sources.fixtures import TRANSACTION_ORDER
from .positions import range_count, stored, with_row_positions

# (dimension table, id column, name column, raw column)
DIMENSIONS = (
    ("dim_departments", "dept_id", "dept_name", "department"),
    ("dim_regions", "region_id", "region_name", "region"),
    ("dim_products", "product_id", "product_name", "product_line"),
    ("dim_expense_categories", "category_id", "category_name", "expense_category"),
)


def dimensions(raw_tx: DataFrame, raw_budgets: DataFrame) -> dict[str, DataFrame]:
    """Departments and regions come from transactions and budgets (set union);
    products and categories from transactions only.

    All four member sets come from one pass (each row emits its (dimension,
    name) pairs; a partial distinct per task shuffles only a few rows) and
    are numbered together, grouped by dimension; the numbered members are
    materialized (reliable checkpoint) so the fact lookups read a finished
    table instead of recomputing the raw joins.
    """
    def pairs(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("dim"), F.col(c).alias("name")) for c in cols])).alias("p")).select("p.*")

    tx_cols = [raw for _, _, _, raw in DIMENSIONS]
    members = materialize(pairs(raw_tx, tx_cols).union(pairs(raw_budgets, ["department", "region"]))
                          .where(F.col("name").isNotNull()).distinct(), "members")
    numbered = materialize(with_row_positions(members, ["name"], ["dim"], out="id"), "dimensions")
    return {table: numbered.where(F.col("dim") == raw_col).select(
                F.col("id").cast("int").alias(id_col), F.col("name").alias(name_col))
            for table, id_col, name_col, raw_col in DIMENSIONS}


def lookup_ids(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Replace the four dimension names with their ids (left joins)."""
    for table, id_col, name_col, raw_col in DIMENSIONS:
        if raw_col not in df.columns:
            continue
        dim = dims[table]
        df = df.join(dim, df[raw_col] == dim[name_col], "left").drop(name_col, raw_col)
    return df


# Raw files carry their file order in these columns (see sources.files).
FILE_ORDER = ["_src_file", "_src_block", "_src_pos"]


def _order(df: DataFrame, default: list[str]) -> list[str]:
    """File order when the raw rows come from files, else the given total order."""
    return FILE_ORDER if all(c in df.columns for c in FILE_ORDER) else default


def fact_transactions(raw_tx: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Ids are row positions in file order (or, for the fixture view, in
    line-item order).  Names give way to their ids before the sort, so neither
    its shuffle nor its table carries them."""
    raw_tx = stored(raw_tx)
    order = _order(raw_tx, list(TRANSACTION_ORDER))
    rows = lookup_ids(raw_tx, dims).select(
        *order, "date",
        F.coalesce(F.col("revenue"), F.lit(0)).cast(MONEY).alias("revenue"),
        F.coalesce(F.col("expenses"), F.lit(0)).cast(MONEY).alias("expenses"),
        "dept_id", "region_id", "product_id", "category_id",
        F.coalesce(F.col("client_id"), F.lit("")).alias("client_id"),
    )
    numbered = with_row_positions(rows, order, out="transaction_id", buckets=range_count(raw_tx), keep_order=False)
    return numbered.select("transaction_id", *[c for c in numbered.columns if c != "transaction_id"])


def fact_budgets(raw_budgets: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    numbered = with_row_positions(raw_budgets, _order(raw_budgets, ["month", "department", "region"]),
                                  out="budget_id")
    facts = lookup_ids(numbered, {k: v for k, v in dims.items() if k in ("dim_departments", "dim_regions")})
    return facts.select(
        "budget_id", "month", "dept_id", "region_id",
        F.coalesce(F.col("budgeted_revenue"), F.lit(0)).cast(MONEY).alias("budgeted_revenue"),
        F.coalesce(F.col("budgeted_expenses"), F.lit(0)).cast(MONEY).alias("budgeted_expenses"),
    )


def status_number(status: F.Column) -> F.Column:
    """Invoice status text -> stage 1..5; anything unknown is stage 1."""
    expr = F.lit(1)
    for i, t in reversed(list(enumerate(INVOICE_STATUSES, start=1))):
        expr = F.when(status == t, F.lit(i)).otherwise(expr)
    return expr.cast("int")


def fact_invoices(raw_invoices: DataFrame) -> DataFrame:
    return raw_invoices.select(
        "invoice_id", "client_id", "issue_date",
        F.coalesce(F.col("amount"), F.lit(0)).cast(MONEY).alias("amount"),
        "status", status_number(F.col("status")).alias("status_num"),
    )


def period_of(date: F.Column) -> F.Column:
    """The month of a date as yyyymm, the fact's partition; null without a date."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def dim_calendar(fact_tx: DataFrame) -> DataFrame:
    """One row per day between the first and last transaction date."""
    bounds = fact_tx.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.date_format("date", "yyyy-MM").alias("month"),
        F.month("date").alias("month_no"),
    )


@dataclass
class Star:
    fact_transactions: DataFrame
    fact_budgets: DataFrame
    fact_invoices: DataFrame
    dim_departments: DataFrame
    dim_regions: DataFrame
    dim_products: DataFrame
    dim_expense_categories: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def build_star(raw_tx: DataFrame, raw_budgets: DataFrame, raw_invoices: DataFrame) -> Star:
    dims = dimensions(raw_tx, raw_budgets)
    return Star(
        fact_transactions=fact_transactions(raw_tx, dims),
        fact_budgets=fact_budgets(raw_budgets, dims),
        fact_invoices=fact_invoices(raw_invoices),
        **dims,
    )


SQL_STAR = """
dim_departments AS (
  SELECT CAST(row_number() OVER (ORDER BY dept_name) AS INTEGER) AS dept_id, dept_name FROM (
    SELECT department AS dept_name FROM raw_transactions WHERE department IS NOT NULL
    UNION SELECT department FROM raw_budgets WHERE department IS NOT NULL)
),
dim_regions AS (
  SELECT CAST(row_number() OVER (ORDER BY region_name) AS INTEGER) AS region_id, region_name FROM (
    SELECT region AS region_name FROM raw_transactions WHERE region IS NOT NULL
    UNION SELECT region FROM raw_budgets WHERE region IS NOT NULL)
),
dim_products AS (
  SELECT CAST(row_number() OVER (ORDER BY product_name) AS INTEGER) AS product_id, product_name FROM (
    SELECT DISTINCT product_line AS product_name FROM raw_transactions WHERE product_line IS NOT NULL)
),
dim_expense_categories AS (
  SELECT CAST(row_number() OVER (ORDER BY category_name) AS INTEGER) AS category_id, category_name FROM (
    SELECT DISTINCT expense_category AS category_name FROM raw_transactions WHERE expense_category IS NOT NULL)
),
fact_transactions AS (
  SELECT CAST(row_number() OVER (ORDER BY t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_quantity,
           t.l_extendedprice, t.l_discount, t.l_returnflag) AS BIGINT) AS transaction_id,
    t.date, CAST(coalesce(t.revenue, 0) AS DECIMAL(18,4)) AS revenue,
    CAST(coalesce(t.expenses, 0) AS DECIMAL(18,4)) AS expenses,
    d.dept_id, g.region_id, p.product_id, k.category_id, coalesce(t.client_id, '') AS client_id
  FROM raw_transactions t
  LEFT JOIN dim_departments d ON t.department = d.dept_name
  LEFT JOIN dim_regions g ON t.region = g.region_name
  LEFT JOIN dim_products p ON t.product_line = p.product_name
  LEFT JOIN dim_expense_categories k ON t.expense_category = k.category_name
),
fact_budgets AS (
  SELECT CAST(row_number() OVER (ORDER BY b.month, b.department, b.region) AS BIGINT) AS budget_id,
    b.month, d.dept_id, g.region_id,
    CAST(coalesce(b.budgeted_revenue, 0) AS DECIMAL(18,4)) AS budgeted_revenue,
    CAST(coalesce(b.budgeted_expenses, 0) AS DECIMAL(18,4)) AS budgeted_expenses
  FROM raw_budgets b
  LEFT JOIN dim_departments d ON b.department = d.dept_name
  LEFT JOIN dim_regions g ON b.region = g.region_name
),
fact_invoices AS (
  SELECT invoice_id, client_id, issue_date, CAST(coalesce(amount, 0) AS DECIMAL(18,4)) AS amount, status,
    CAST(CASE status WHEN '1-Created' THEN 1 WHEN '2-Delivered' THEN 2 WHEN '3-Approved' THEN 3
         WHEN '4-Pending Payment' THEN 4 WHEN '5-Settled' THEN 5 ELSE 1 END AS INTEGER) AS status_num
  FROM raw_invoices
),
dim_calendar AS (
  SELECT CAST(gs AS DATE) AS date, CAST(year(gs) AS INTEGER) AS year, CAST(quarter(gs) AS INTEGER) AS quarter,
    strftime(gs, '%Y-%m') AS month, CAST(month(gs) AS INTEGER) AS month_no
  FROM (SELECT min(date) AS lo, max(date) AS hi FROM fact_transactions) b,
    generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(gs)
  WHERE b.lo IS NOT NULL
)"""
