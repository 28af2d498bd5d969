"""Finance fixture views derived from the driver's TPC-H-style tables.

The test data has no finance tables, so the raw inputs of the engine (the
transactions, budgets and invoices files, and a dirty upload stream) are
declared here as views over ``lineitem orders customer nation region part
events``.  Each view exists twice: as a DataFrame builder (what the engine
runs) and as DuckDB SQL text (what the correctness oracle runs).  Both must
stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import INVOICE_STATUSES
from ..functions.numeric import MONEY

DEC = "decimal(12,2)"

# Priority digit -> invoice status text of that stage.
STATUS_TEXT = {t[0]: t for t in INVOICE_STATUSES}

# Parameters of the dirty upload stream.
UPLOAD_AS_OF = "2024-01-25"
UPLOAD_SUBMITTED_AT = "2024-01-31 00:00:00"
REVIEW_DAYS = (10, 20)
UPLOAD_HEADERS = ("transaction_date", "sales", "spending", "division", "area", "segment", "type", "customer")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(c: str) -> F.Column:
    return F.col(c).cast(DEC)


def _customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (segment, region name).  nation/region are 25/5 rows by the
    TPC-H definition, so the planner broadcasts them on its own."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", "c_mktsegment", "r_name"))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions file: one row per line item.  Orders meet their customers
    before the line items, of which there are several times as many."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    geo = _customer_geo(spark, sf_dir)
    returned = F.col("l_returnflag") == "R"
    return (
        li.join(o.join(geo, o.o_custkey == geo.c_custkey), li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
            F.col("o_orderdate").cast("date").alias("date"),
            F.when(returned, F.lit(0)).otherwise(_dec("l_extendedprice") * (F.lit(1) - _dec("l_discount")))
            .cast(MONEY).alias("revenue"),
            (_dec("p_retailprice") * _dec("l_quantity")).cast(MONEY).alias("expenses"),
            F.col("c_mktsegment").alias("department"),
            F.col("r_name").alias("region"),
            F.col("p_type").alias("product_line"),
            F.col("p_brand").alias("expense_category"),
            F.when(returned, F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("client_id"),
        )
    )


# Total order for transaction ids; ties are rows identical in every output column.
TRANSACTION_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                     "l_discount", "l_returnflag")


def raw_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly budgets file: month x department x region."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    geo = _customer_geo(spark, sf_dir)
    agg = (
        o.join(geo, o.o_custkey == geo.c_custkey)
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                 F.col("c_mktsegment").alias("department"), F.col("r_name").alias("region"))
        .agg(F.sum(_dec("o_totalprice")).alias("rev"))
    )
    return agg.select(
        "month", "department", "region",
        F.col("rev").cast(MONEY).alias("budgeted_revenue"),
        (F.col("rev") * F.lit(0.60).cast("decimal(3,2)")).cast(MONEY).alias("budgeted_expenses"),
    )


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices file: one invoice per order, status from the priority digit."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
                                              "o_orderpriority")
    digit = F.substring("o_orderpriority", 1, 1)
    status = F.col("o_orderpriority")
    for d, text in reversed(list(STATUS_TEXT.items())):
        status = F.when(digit == d, F.lit(text)).otherwise(status)
    return o.select(
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        F.col("o_custkey").cast("string").alias("client_id"),
        F.col("o_orderdate").cast("date").alias("issue_date"),
        _dec("o_totalprice").cast(MONEY).alias("amount"),
        status.alias("status"),
    )


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of dirty transaction uploads rendered from ``events``.

    One batch per day of the month (``batch_id``), rows ordered by
    ``(event_id, copy)``; every value is text under alternative headers, with
    several date and money spellings, blanks, garbage and exact duplicates.
    """
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    geo = _customer_geo(spark, sf_dir)
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    e = (ev.join(geo, ev.user_id == geo.c_custkey, "left")
         .join(p, ev.user_id == p.p_partkey, "left"))
    eid = F.col("event_id")
    batch = F.dayofmonth("ts")
    d = F.col("ts").cast("date")
    both_garbage = batch.isin(*REVIEW_DAYS) & (eid % 3 == 0)
    sales = (F.col("value").cast(DEC) * 200).cast("decimal(14,2)")
    spend = (F.col("value").cast(DEC) * 100).cast("decimal(14,2)")
    s_txt, p_txt = sales.cast("string"), spend.cast("string")
    return (
        e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(eid % 50 == 0, 2).otherwise(1))))
        .select(
            batch.alias("batch_id"),
            F.concat(F.lit("upload_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")).alias("filename"),
            "event_id",
            F.col("copy").cast("int").alias("copy"),
            F.when(eid % 23 == 0, F.lit(""))
            .when(eid % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(eid % 3 == 1, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.date_format(d, "dd-MM-yyyy")).alias("transaction_date"),
            F.when(both_garbage | (eid % 37 == 0), F.lit("TBD"))
            .when(eid % 4 == 0, s_txt)
            .when(eid % 4 == 1, F.concat(F.lit("$"), F.format_number(sales, 2)))
            .when(eid % 4 == 2, F.format_number(sales, 2))
            .otherwise(F.concat(F.lit(" "), s_txt, F.lit(" "))).alias("sales"),
            F.when(both_garbage, F.lit("-"))
            .when(eid % 29 == 0, F.concat(F.lit("("), p_txt, F.lit(")")))
            .when(eid % 5 == 0, F.concat(F.lit("$"), F.format_number(spend, 2)))
            .when(eid % 5 == 1, p_txt)
            .when(eid % 5 == 2, F.concat(F.lit("$"), p_txt))
            .when(eid % 5 == 3, F.concat(p_txt, F.lit(" ")))
            .otherwise(F.format_number(spend, 2)).alias("spending"),
            F.when(eid % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("event_type")).alias("division"),
            F.when(eid % 17 == 0, F.lit("  ")).otherwise(F.col("r_name")).alias("area"),
            F.col("p_type").alias("segment"),
            F.col("p_brand").alias("type"),
            F.col("user_id").cast("string").alias("customer"),
        )
    )


# ---------------------------------------------------------------------------
# DuckDB twins (same definitions, SQL text).
# ---------------------------------------------------------------------------

_STATUS_CASE = " ".join(f"WHEN substr(o_orderpriority, 1, 1) = '{d}' THEN '{t}'" for d, t in STATUS_TEXT.items())

SQL_FIXTURES = f"""
customer_geo AS (
  SELECT c.c_custkey, c.c_mktsegment, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw_transactions AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_returnflag,
    CAST(o.o_orderdate AS DATE) AS date,
    CAST(CASE WHEN l.l_returnflag = 'R' THEN 0
         ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(12,2))) END
         AS DECIMAL(18,4)) AS revenue,
    CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS expenses,
    g.c_mktsegment AS department, g.r_name AS region, p.p_type AS product_line, p.p_brand AS expense_category,
    CASE WHEN l.l_returnflag = 'R' THEN '' ELSE CAST(o.o_custkey AS VARCHAR) END AS client_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer_geo g ON o.o_custkey = g.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
raw_budgets AS (
  SELECT month, department, region,
    CAST(rev AS DECIMAL(18,4)) AS budgeted_revenue,
    CAST(rev * CAST(0.60 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS budgeted_expenses
  FROM (
    SELECT strftime(o.o_orderdate, '%Y-%m') AS month, g.c_mktsegment AS department, g.r_name AS region,
      sum(CAST(o.o_totalprice AS DECIMAL(12,2))) AS rev
    FROM orders o JOIN customer_geo g ON o.o_custkey = g.c_custkey
    GROUP BY 1, 2, 3)
),
raw_invoices AS (
  SELECT 'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_custkey AS VARCHAR) AS client_id,
    CAST(o_orderdate AS DATE) AS issue_date, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS amount,
    CASE {_STATUS_CASE} ELSE o_orderpriority END AS status
  FROM orders
),
upload_src AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, g.c_mktsegment, g.r_name, p.p_type, p.p_brand,
    CAST(day(e.ts) AS INTEGER) AS batch_id, CAST(e.ts AS DATE) AS d,
    CAST(CAST(e.value AS DECIMAL(12,2)) * 200 AS DECIMAL(14,2)) AS s_amt,
    CAST(CAST(e.value AS DECIMAL(12,2)) * 100 AS DECIMAL(14,2)) AS p_amt,
    (day(e.ts) IN {REVIEW_DAYS} AND e.event_id % 3 = 0) AS both_garbage
  FROM events e LEFT JOIN customer_geo g ON e.user_id = g.c_custkey
  LEFT JOIN part p ON e.user_id = p.p_partkey
),
raw_upload AS (
  SELECT batch_id, 'upload_' || strftime(ts, '%Y-%m-%d') || '.csv' AS filename, event_id, CAST(cp AS INTEGER) AS copy,
    CASE WHEN event_id % 23 = 0 THEN ''
         WHEN event_id % 3 = 0 THEN strftime(d, '%Y-%m-%d')
         WHEN event_id % 3 = 1 THEN strftime(d, '%m/%d/%Y')
         ELSE strftime(d, '%d-%m-%Y') END AS transaction_date,
    CASE WHEN both_garbage OR event_id % 37 = 0 THEN 'TBD'
         WHEN event_id % 4 = 0 THEN CAST(s_amt AS VARCHAR)
         WHEN event_id % 4 = 1 THEN '$' || format('{{:,.2f}}', s_amt)
         WHEN event_id % 4 = 2 THEN format('{{:,.2f}}', s_amt)
         ELSE ' ' || CAST(s_amt AS VARCHAR) || ' ' END AS sales,
    CASE WHEN both_garbage THEN '-'
         WHEN event_id % 29 = 0 THEN '(' || CAST(p_amt AS VARCHAR) || ')'
         WHEN event_id % 5 = 0 THEN '$' || format('{{:,.2f}}', p_amt)
         WHEN event_id % 5 = 1 THEN CAST(p_amt AS VARCHAR)
         WHEN event_id % 5 = 2 THEN '$' || CAST(p_amt AS VARCHAR)
         WHEN event_id % 5 = 3 THEN CAST(p_amt AS VARCHAR) || ' '
         ELSE format('{{:,.2f}}', p_amt) END AS spending,
    CASE WHEN event_id % 2 = 0 THEN c_mktsegment ELSE event_type END AS division,
    CASE WHEN event_id % 17 = 0 THEN '  ' ELSE r_name END AS area,
    p_type AS segment, p_brand AS type, CAST(user_id AS VARCHAR) AS customer
  FROM upload_src, unnest(generate_series(1, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) AS t(cp)
)"""
