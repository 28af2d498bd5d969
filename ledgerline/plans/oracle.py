"""DuckDB twins of the query library (the correctness oracle).

Each entry is one self-contained statement over the driver's tables:
the fixture views and the star schema as CTEs, then the query.
"""

from __future__ import annotations

import re

from ..operators.star import SQL_STAR
from ..sources.fixtures import SQL_FIXTURES

PREFIX = "WITH " + SQL_FIXTURES.strip() + ",\n" + SQL_STAR.strip() + "\n"

_SQL: dict[str, str] = {}
_PARTS: dict[str, tuple[str, str]] = {}


def sql(name: str, body: str, extra_ctes: str = "") -> None:
    _PARTS[name] = (body, extra_ctes)
    prefix = PREFIX if not extra_ctes else PREFIX.rstrip() + ",\n" + extra_ctes.strip() + "\n"
    _SQL[name] = prefix + body.strip()


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def money(x: str) -> str:
    return f"(CAST(round({x}, 2) AS DOUBLE) + 0.0)"


def dbl(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) + 0.0)"


def ratio(num: str, den: str, positive_only: bool = True) -> str:
    guard = f"({den}) > 0" if positive_only else f"({den}) <> 0"
    return f"(CASE WHEN {guard} THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def pct(num: str, den: str, positive_only: bool = True) -> str:
    return f"(round({ratio(num, den, positive_only)} * 100.0, 2) + 0.0)"


def frac(num: str, den: str, positive_only: bool = True) -> str:
    return f"(round({ratio(num, den, positive_only)}, 6) + 0.0)"


def dsum(x: str) -> str:
    return f"coalesce(sum({x}), CAST(0 AS DECIMAL(18,4)))"


# ---------------------------------------------------------------------------
# star schema
# ---------------------------------------------------------------------------
sql("star_dim_departments", "SELECT * FROM dim_departments")
sql("star_dim_regions", "SELECT * FROM dim_regions")
sql("star_dim_products", "SELECT * FROM dim_products")
sql("star_dim_categories", "SELECT * FROM dim_expense_categories")
sql("star_fact_transactions", "SELECT * FROM fact_transactions")
sql("star_fact_budgets", "SELECT * FROM fact_budgets")
sql("star_fact_invoices", "SELECT * FROM fact_invoices")
sql("dim_calendar", "SELECT * FROM dim_calendar")

# ---------------------------------------------------------------------------
# executive metrics
# ---------------------------------------------------------------------------
sql("kpis", f"""
SELECT {dbl('rev')} AS total_revenue, {dbl('exp')} AS total_expenses, {dbl('rev - exp')} AS net_profit,
  {ratio('rev - exp', 'rev')} AS profit_margin, {ratio('rev - exp', 'exp')} AS roi,
  {dbl('rev - brev')} AS budget_variance, {ratio('rev - brev', 'brev')} AS budget_variance_pct
FROM (SELECT {dsum('revenue')} AS rev, {dsum('expenses')} AS exp FROM fact_transactions) a,
     (SELECT {dsum('budgeted_revenue')} AS brev FROM fact_budgets) b""")

sql("monthly_performance", f"""
SELECT month, {dbl('revenue')} AS revenue, {dbl('expenses')} AS expenses, {money('revenue - expenses')} AS net_profit,
  {money('sum(revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_total_revenue,
  CASE WHEN lag(revenue) OVER (ORDER BY month) IS NULL THEN 0.0
       ELSE round(CASE WHEN lag(revenue) OVER (ORDER BY month) = 0 THEN NULL
                  ELSE CAST(revenue - lag(revenue) OVER (ORDER BY month) AS DOUBLE)
                       / CAST(lag(revenue) OVER (ORDER BY month) AS DOUBLE) END * 100.0, 2) + 0.0 END AS rev_growth_pct
FROM (SELECT strftime(date, '%Y-%m') AS month, {dsum('revenue')} AS revenue, {dsum('expenses')} AS expenses
      FROM fact_transactions WHERE date IS NOT NULL GROUP BY 1)""")

sql("department_performance", f"""
SELECT d.dept_name AS department, {money('ar')} AS actual_revenue, {money('br')} AS budget_revenue,
  {money('ar - br')} AS revenue_variance, {money('ae')} AS actual_expenses, {money('be')} AS budget_expenses,
  {money('be - ae')} AS expense_variance
FROM (SELECT coalesce(a.dept_id, b.dept_id) AS dept_id, coalesce(a.ar, 0) AS ar, coalesce(a.ae, 0) AS ae,
        coalesce(b.br, 0) AS br, coalesce(b.be, 0) AS be
      FROM (SELECT dept_id, {dsum('revenue')} AS ar, {dsum('expenses')} AS ae FROM fact_transactions
            WHERE dept_id IS NOT NULL GROUP BY 1) a
      FULL OUTER JOIN (SELECT dept_id, {dsum('budgeted_revenue')} AS br, {dsum('budgeted_expenses')} AS be
            FROM fact_budgets WHERE dept_id IS NOT NULL GROUP BY 1) b ON a.dept_id = b.dept_id) m
LEFT JOIN dim_departments d ON m.dept_id = d.dept_id""")

sql("regional_profitability", f"""
SELECT d.region_name AS region, {money('r')} AS revenue, {money('e')} AS expenses, {money('r - e')} AS net_profit,
  {pct('r - e', 'r')} AS profit_margin_pct
FROM (SELECT region_id, {dsum('revenue')} AS r, {dsum('expenses')} AS e FROM fact_transactions
      WHERE region_id IS NOT NULL GROUP BY 1) a
LEFT JOIN dim_regions d ON a.region_id = d.region_id""")

sql("product_profitability", f"""
SELECT d.product_name AS product_line, {money('r')} AS revenue, {money('e')} AS expenses, {money('r - e')} AS net_profit,
  {pct('r - e', 'r')} AS profit_margin_pct, {pct('r - e', 'sum(r - e) OVER ()', positive_only=False)} AS profit_contribution_pct
FROM (SELECT product_id, {dsum('revenue')} AS r, {dsum('expenses')} AS e FROM fact_transactions
      WHERE product_id IS NOT NULL GROUP BY 1) a
LEFT JOIN dim_products d ON a.product_id = d.product_id""")

sql("expenses_by_category", f"""
SELECT d.category_name AS category, {money('e')} AS expenses, {pct('e', 'sum(e) OVER ()')} AS expense_share_pct
FROM (SELECT category_id, {dsum('expenses')} AS e FROM fact_transactions
      WHERE category_id IS NOT NULL GROUP BY 1) a
LEFT JOIN dim_expense_categories d ON a.category_id = d.category_id""")

# ---------------------------------------------------------------------------
# cohorts
# ---------------------------------------------------------------------------
COHORT_CTES = f"""
cm AS (
  SELECT client_id, strftime(date, '%Y-%m') AS trans_month, sum(revenue) AS revenue FROM fact_transactions
  WHERE revenue > 0 AND client_id IS NOT NULL AND client_id <> '' AND date IS NOT NULL GROUP BY 1, 2
),
cc AS (SELECT client_id, min(trans_month) AS cohort_month FROM cm GROUP BY 1),
cells AS (
  SELECT cc.cohort_month,
    CAST((CAST(substr(cm.trans_month, 1, 4) AS INTEGER) - CAST(substr(cc.cohort_month, 1, 4) AS INTEGER)) * 12
         + CAST(substr(cm.trans_month, 6, 2) AS INTEGER) - CAST(substr(cc.cohort_month, 6, 2) AS INTEGER) AS INTEGER)
      AS elapsed_months,
    sum(cm.revenue) AS cohort_revenue, count(DISTINCT cm.client_id) AS active_clients
  FROM cm JOIN cc ON cm.client_id = cc.client_id GROUP BY 1, 2
),
sizes AS (SELECT cohort_month, count(DISTINCT client_id) AS total_clients FROM cc GROUP BY 1),
base AS (SELECT cohort_month, cohort_revenue AS base_rev FROM cells WHERE elapsed_months = 0),
rc AS (
  SELECT c.cohort_month, CAST(s.total_clients AS BIGINT) AS total_clients, {money('b.base_rev')} AS base_rev,
    c.elapsed_months, {money('c.cohort_revenue')} AS cohort_revenue, CAST(c.active_clients AS BIGINT) AS active_clients,
    {pct('c.cohort_revenue', 'b.base_rev')} AS revenue_retention_pct,
    {pct('c.active_clients', 's.total_clients')} AS client_retention_pct
  FROM cells c LEFT JOIN sizes s ON c.cohort_month = s.cohort_month
  LEFT JOIN base b ON c.cohort_month = b.cohort_month
  WHERE c.elapsed_months >= 0 AND c.elapsed_months < 12
)"""

sql("client_cohorts", "SELECT client_id, cohort_month FROM cc", COHORT_CTES)
sql("client_monthly_revenue", f"SELECT client_id, trans_month, {dbl('revenue')} AS revenue FROM cm", COHORT_CTES)
sql("cohort_sizes", "SELECT cohort_month, CAST(total_clients AS BIGINT) AS total_clients FROM sizes", COHORT_CTES)
sql("revenue_cohorts", "SELECT * FROM rc", COHORT_CTES)
sql("cohort_summary", """
SELECT round(avg(CASE WHEN elapsed_months = 1 THEN revenue_retention_pct END), 4) AS avg_m1_revenue_retention,
  round(avg(CASE WHEN elapsed_months = 3 THEN client_retention_pct END), 4) AS avg_m3_client_retention,
  count(DISTINCT cohort_month) AS active_cohorts
FROM rc""", COHORT_CTES)
for _key, _val in (("cohort_pivot_revenue", "revenue_retention_pct"), ("cohort_pivot_clients", "client_retention_pct")):
    _cols = ", ".join(f"max(CASE WHEN elapsed_months = {i} THEN {_val} END) AS m{i}" for i in range(12))
    sql(_key, f"SELECT cohort_month, {_cols} FROM rc GROUP BY cohort_month", COHORT_CTES)

# ---------------------------------------------------------------------------
# invoice funnel
# ---------------------------------------------------------------------------
FUNNEL_CTES = """
stages AS (SELECT * FROM (VALUES (1, '1. Created'), (2, '2. Delivered'), (3, '3. Approved'),
  (4, '4. Pending Payment'), (5, '5. Settled')) t(stage_num, stage)),
funnel AS (
  SELECT s.stage_num, s.stage, count(i.invoice_id) AS cnt, coalesce(sum(i.amount), 0) AS amount,
    (SELECT count(*) FROM fact_invoices) AS all_invoices
  FROM stages s LEFT JOIN fact_invoices i ON i.status_num >= s.stage_num
  GROUP BY s.stage_num, s.stage
)"""
_FUNNEL_SELECT = f"""
SELECT stage, CAST(cnt AS BIGINT) AS invoice_count, {money('amount')} AS total_amount,
  {pct('cnt', 'all_invoices')} AS pct_conversion FROM funnel"""
sql("invoice_funnel", _FUNNEL_SELECT, FUNNEL_CTES)
sql("invoice_funnel_theta", _FUNNEL_SELECT, FUNNEL_CTES)
sql("collection_summary", f"""
SELECT {money('c.amount')} AS total_created, {money('s.amount')} AS total_settled,
  {pct('s.cnt', 's.all_invoices')} AS collection_rate_pct, {money('c.amount - s.amount')} AS uncollected
FROM funnel c, funnel s WHERE c.stage_num = 1 AND s.stage_num = 5""", FUNNEL_CTES)

# ---------------------------------------------------------------------------
# ingestion: mapping, cleaning, audit, verdict, merge, log
# ---------------------------------------------------------------------------
from ..functions.cleaning import (  # noqa: E402
    DATE_PATTERNS, FALLBACK_PATTERNS, FLOAT_TEXT, SPACE, TIME_TEXT, TIMED_PATTERNS)  # noqa: E402
from ..functions.constants import DQ_RULES, NULL_TOKENS  # noqa: E402
from ..sources.fixtures import UPLOAD_AS_OF, UPLOAD_SUBMITTED_AT  # noqa: E402

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


def nt(x: str) -> str:
    return f"(CASE WHEN {x} IN ({_TOKENS}) THEN NULL ELSE {x} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_numeric(x: str) -> str:
    s1 = f"replace(replace({strip(x)}, '$', ''), ',', '')"
    s2 = f"(CASE WHEN starts_with({s1}, '(') AND ends_with({s1}, ')') THEN '-' || substr({s1}, 2, length({s1}) - 2) ELSE {s1} END)"
    v = f"(CASE WHEN regexp_full_match({s2}, '{FLOAT_TEXT}') THEN TRY_CAST(replace({strip(s2)}, '_', '') AS DOUBLE) END)"
    return f"(CASE WHEN {v} IS NOT NULL AND isfinite({v}) THEN {v} ELSE 0.0 END)"


def parse_date(x: str) -> str:
    """Same formats and shape guards as the Spark side (DuckDB's %Y alone
    would also take a 2-digit year)."""
    s = strip(x)
    tries = ", ".join(f"CASE WHEN regexp_full_match({s}, '{guard}') THEN CAST(try_strptime({s}, '{fmt}') AS DATE) END"
                      for _, fmt, guard in DATE_PATTERNS + FALLBACK_PATTERNS)
    tries += "".join(f", CASE WHEN regexp_full_match({s}, '({date}){TIME_TEXT}') THEN "
                     f"CAST(try_strptime(regexp_extract({s}, '^({date})', 1), '{fmt}') AS DATE) END"
                     for _, fmt, date in TIMED_PATTERNS)
    return f"coalesce({tries})"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


_MSG = {r: m for r, _, m in DQ_RULES}
_SEV = {r: s for r, s, _ in DQ_RULES}
_ORD = " ".join(f"WHEN '{r}' THEN {i}" for i, (r, _, _) in enumerate(DQ_RULES, start=1))
_DIMS_SQL = ", ".join(f"c.{c}" for c in ("date", "revenue", "expenses", "department", "region", "product_line",
                                         "expense_category", "client_id"))
_BLANK_LIST = ("concat_ws(', ', " + ", ".join(
    f"CASE WHEN {blank(c)} THEN '{c}' END" for c in ("department", "region", "product_line", "expense_category"))
    + ")")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _msg_sql(rule: str, value: str | None = None) -> str:
    text = _MSG[rule]
    if value is None:
        return _lit(text)
    head, tail = text.split("{}")
    return f"{_lit(head)} || {value} || {_lit(tail)}"


def _issue(rule: str, where: str, amount: str = "NULL", date: str = "NULL", cols: str = "NULL",
           value: str | None = None) -> str:
    return (f"SELECT c.batch_id, c.row_num, '{rule}' AS rule, '{_SEV[rule]}' AS severity, "
            f"CAST({amount} AS DOUBLE) AS amount, CAST({date} AS DATE) AS date, CAST({cols} AS VARCHAR) AS columns, "
            f"{_msg_sql(rule, value)} AS msg FROM upload_clean c WHERE {where}")


_AS_OF = f"DATE '{UPLOAD_AS_OF}'"
_FAILED = (f"(c.date IS NULL OR c.date > {_AS_OF} OR c.revenue < 0 OR c.expenses < 0 "
           f"OR (coalesce(c.revenue, 0) = 0 AND coalesce(c.expenses, 0) = 0) OR {_BLANK_LIST.replace('(department', '(c.department')} <> '')")

INGEST_CTES = f"""
upload_numbered AS (
  SELECT batch_id, filename, transaction_date, sales, spending, division, area, segment, type, customer,
    CAST(row_number() OVER (PARTITION BY batch_id ORDER BY event_id, copy) AS BIGINT) AS row_num
  FROM raw_upload
),
upload_mapped AS (
  SELECT batch_id, filename, row_num, {nt('transaction_date')} AS date, {nt('sales')} AS revenue,
    {nt('spending')} AS expenses, {nt('division')} AS department, {nt('area')} AS region,
    {nt('segment')} AS product_line, {nt('type')} AS expense_category, {nt('customer')} AS client_id
  FROM upload_numbered
),
upload_clean AS (
  SELECT batch_id, filename, row_num, {parse_date('date')} AS date, {clean_numeric('revenue')} AS revenue,
    {clean_numeric('expenses')} AS expenses, {strip('department')} AS department, {strip('region')} AS region,
    {strip('product_line')} AS product_line, {strip('expense_category')} AS expense_category,
    {strip('client_id')} AS client_id
  FROM upload_mapped
),
upload_dups AS (
  SELECT batch_id, row_num, first_row_num FROM (
    SELECT c.batch_id, c.row_num, min(c.row_num) OVER (PARTITION BY c.batch_id, {_DIMS_SQL}) AS first_row_num
    FROM upload_clean c) WHERE row_num <> first_row_num
),
upload_issues AS (
  {_issue('missing_date', 'c.date IS NULL')}
  UNION ALL {_issue('future_dates', f'c.date > {_AS_OF}', date='c.date', value="strftime(c.date, '%Y-%m-%d')")}
  UNION ALL {_issue('negative_revenue', 'c.revenue < 0', amount='c.revenue', value="printf('%.2f', c.revenue)")}
  UNION ALL {_issue('negative_expenses', 'c.expenses < 0', amount='c.expenses', value="printf('%.2f', c.expenses)")}
  UNION ALL {_issue('null_amounts', 'coalesce(c.revenue, 0) = 0 AND coalesce(c.expenses, 0) = 0')}
  UNION ALL {_issue('blank_fields', _BLANK_LIST.replace('(department', '(c.department') + " <> ''",
                    cols=_BLANK_LIST, value=_BLANK_LIST)}
  UNION ALL SELECT d.batch_id, d.row_num, 'overlapping_rows', 'Info', CAST(NULL AS DOUBLE), CAST(NULL AS DATE),
    CAST(NULL AS VARCHAR), {_msg_sql('overlapping_rows')} FROM upload_dups d
  UNION ALL {_issue('extreme_revenue', 'c.revenue > 50000', amount='c.revenue', value="printf('%.2f', c.revenue)")}
  UNION ALL {_issue('extreme_expenses', 'c.expenses > 25000', amount='c.expenses', value="printf('%.2f', c.expenses)")}
),
upload_failed AS (SELECT c.batch_id, c.row_num, {_FAILED} AS failed FROM upload_clean c),
upload_verdict AS (
  SELECT batch_id, row_count, failed_rows, health_score,
    CASE WHEN health_score >= 0.8 THEN 'Accepted' WHEN health_score >= 0.5 THEN 'Needs Review' ELSE 'Rejected' END
      AS status, filename
  FROM (SELECT f.batch_id, count(*) AS row_count, CAST(count_if(f.failed) AS BIGINT) AS failed_rows,
          (1.0 - CAST(count_if(f.failed) AS DOUBLE) / CAST(count(*) AS DOUBLE)) + 0.0 AS health_score,
          min(c.filename) AS filename
        FROM upload_failed f JOIN upload_clean c ON f.batch_id = c.batch_id AND f.row_num = c.row_num
        GROUP BY f.batch_id)
),
verdicts AS (
  SELECT batch_id, row_count, failed_rows, health_score, status,
    CAST(CASE WHEN status IN ('Accepted', 'Needs Review') THEN row_count ELSE 0 END AS BIGINT) AS accepted_rows,
    CAST(CASE WHEN status IN ('Accepted', 'Needs Review') THEN 0 ELSE row_count END AS BIGINT) AS rejected_rows,
    status IN ('Accepted', 'Needs Review') AS success, filename
  FROM upload_verdict
),
merged AS (
  SELECT batch_id, row_count,
    coalesce(sum(row_count) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before
  FROM verdicts WHERE success
),
issue_ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id, rule ORDER BY row_num) AS rn FROM upload_issues),
issue_rules AS (
  SELECT batch_id, rule, severity, count(*) AS issue_count, arg_min(msg, row_num) AS first_msg,
    string_agg('Row ' || CAST(row_num AS VARCHAR), ', ' ORDER BY row_num) FILTER (WHERE rn <= 10) AS row_list,
    CASE rule {_ORD} END AS ord
  FROM issue_ranked GROUP BY batch_id, rule, severity
),
issues_json AS (
  SELECT batch_id, '{{' || string_agg('"' || rule || '": ' || CAST(issue_count AS VARCHAR), ', ' ORDER BY ord) || '}}' AS issues_json
  FROM issue_rules GROUP BY batch_id
)"""


def _ext_dim(dim: str, id_col: str, name_col: str, raw_col: str) -> str:
    return f"""
SELECT {id_col}, {name_col} FROM {dim}
UNION ALL
SELECT CAST((SELECT count(*) FROM {dim}) + row_number() OVER (ORDER BY fb, fr) AS INTEGER), name FROM (
  SELECT name, batch_id AS fb, row_num AS fr FROM (
    SELECT nullif({strip('c.' + raw_col)}, '') AS name, c.batch_id, c.row_num,
      row_number() OVER (PARTITION BY nullif({strip('c.' + raw_col)}, '') ORDER BY c.batch_id, c.row_num) AS k
    FROM upload_clean c WHERE c.batch_id IN (SELECT batch_id FROM merged))
  WHERE k = 1 AND name IS NOT NULL AND name NOT IN (SELECT {name_col} FROM {dim}))"""


_EXT = {
    "ext_departments": ("dim_departments", "dept_id", "dept_name", "department"),
    "ext_regions": ("dim_regions", "region_id", "region_name", "region"),
    "ext_products": ("dim_products", "product_id", "product_name", "product_line"),
    "ext_categories": ("dim_expense_categories", "category_id", "category_name", "expense_category"),
}
EXT_CTES = INGEST_CTES + ",\n" + ",\n".join(f"{k} AS ({_ext_dim(*v)})" for k, v in _EXT.items())

sql("ingest_mapped", "SELECT * FROM upload_mapped", INGEST_CTES)
sql("ingest_clean", "SELECT * FROM upload_clean", INGEST_CTES)
_MAP = [("date", "transaction_date"), ("revenue", "sales"), ("expenses", "spending"), ("department", "division"),
        ("region", "area"), ("product_line", "segment"), ("expense_category", "type"), ("client_id", "customer")]
sql("ingest_mapping_report", " UNION ALL ".join(
    f"SELECT batch_id, '{canon}' AS canonical, '{src}' AS source_column, count({nt(src)}) AS non_null_count, "
    f"count({nt(src)}) > 0 AS mapped FROM raw_upload GROUP BY batch_id" for canon, src in _MAP), INGEST_CTES)
sql("ingest_preview", "SELECT * FROM upload_numbered WHERE row_num <= 5", INGEST_CTES)
sql("dq_issues", "SELECT * FROM upload_issues", INGEST_CTES)
sql("dq_rule_counts", "SELECT batch_id, rule, severity, count(*) AS issue_count FROM upload_issues "
    "GROUP BY batch_id, rule, severity", INGEST_CTES)
sql("dq_failed_rows", "SELECT * FROM upload_failed", INGEST_CTES)
sql("dq_duplicates", "SELECT * FROM upload_dups", INGEST_CTES)
sql("dq_issue_summary", """
SELECT batch_id, rule, severity, issue_count, first_msg,
  row_list || CASE WHEN issue_count > 10 THEN ' and ' || CAST(issue_count - 10 AS VARCHAR) || ' more rows...'
                   ELSE '' END AS affected
FROM issue_rules""", INGEST_CTES)
sql("ingest_verdict", "SELECT * FROM verdicts", INGEST_CTES)
sql("merge_dim_departments", "SELECT * FROM ext_departments", EXT_CTES)
sql("merge_dim_regions", "SELECT * FROM ext_regions", EXT_CTES)
sql("merge_dim_products", "SELECT * FROM ext_products", EXT_CTES)
sql("merge_dim_categories", "SELECT * FROM ext_categories", EXT_CTES)
sql("merge_transactions", f"""
SELECT CAST(m0.max_id + mb.rows_before + c.row_num AS BIGINT) AS transaction_id, c.date,
  CAST(c.revenue AS DECIMAL(18,4)) AS revenue, CAST(c.expenses AS DECIMAL(18,4)) AS expenses,
  d.dept_id, g.region_id, p.product_id, k.category_id, coalesce(c.client_id, '') AS client_id, c.batch_id
FROM upload_clean c JOIN merged mb ON c.batch_id = mb.batch_id
CROSS JOIN (SELECT coalesce(max(transaction_id), 0) AS max_id FROM fact_transactions) m0
LEFT JOIN ext_departments d ON nullif({strip('c.department')}, '') = d.dept_name
LEFT JOIN ext_regions g ON nullif({strip('c.region')}, '') = g.region_name
LEFT JOIN ext_products p ON nullif({strip('c.product_line')}, '') = p.product_name
LEFT JOIN ext_categories k ON nullif({strip('c.expense_category')}, '') = k.category_name""", EXT_CTES)
sql("ingestion_log_entry", f"""
SELECT CAST(1 + row_number() OVER (ORDER BY v.batch_id) AS BIGINT) AS batch_id,
  CAST(TIMESTAMP '{UPLOAD_SUBMITTED_AT}' AS TIMESTAMP) AS submitted_at, v.filename, CAST(v.row_count AS BIGINT) AS row_count,
  v.status, round(v.health_score * 100.0, 2) + 0.0 AS health_score, coalesce(j.issues_json, '{{}}') AS issues_json,
  v.accepted_rows, v.rejected_rows
FROM verdicts v LEFT JOIN issues_json j ON v.batch_id = j.batch_id""", INGEST_CTES)
sql("ingestion_issues", """
SELECT CAST(1 + n.pos AS BIGINT) AS batch_id, i.row_num, i.rule, i.severity, i.amount, i.date, i.columns, i.msg
FROM upload_issues i JOIN (SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS pos FROM verdicts) n
  ON i.batch_id = n.batch_id""", INGEST_CTES)
sql("ingestion_log_listing", f"""
SELECT batch_id AS "Batch ID", submitted_at AS "Timestamp", filename AS "Filename", row_count AS "Total Rows",
  status AS "Verdict Status", health_score AS "Health Score", issues_json AS "Issues",
  accepted_rows AS "Accepted Rows", rejected_rows AS "Rejected Rows"
FROM (
  SELECT CAST(1 AS BIGINT) AS batch_id, CAST(TIMESTAMP '{UPLOAD_SUBMITTED_AT}' AS TIMESTAMP) AS submitted_at,
    'transactions.csv' AS filename, count(*) AS row_count, 'Accepted' AS status, 100.0 AS health_score,
    '[]' AS issues_json, count(*) AS accepted_rows, CAST(0 AS BIGINT) AS rejected_rows FROM fact_transactions
  UNION ALL
  SELECT CAST(1 + row_number() OVER (ORDER BY v.batch_id) AS BIGINT), CAST(TIMESTAMP '{UPLOAD_SUBMITTED_AT}' AS TIMESTAMP),
    v.filename, CAST(v.row_count AS BIGINT), v.status, round(v.health_score * 100.0, 2) + 0.0,
    coalesce(j.issues_json, '{{}}'), v.accepted_rows, v.rejected_rows
  FROM verdicts v LEFT JOIN issues_json j ON v.batch_id = j.batch_id)""", INGEST_CTES)
sql("integrity_audit", """
SELECT (SELECT count(*) FROM dim_departments) AS total_departments, (SELECT count(*) FROM dim_regions) AS total_regions,
  count(*) AS total_transactions, CAST(count_if(revenue < 0) AS BIGINT) AS negative_revenue_rows,
  CAST(count_if(expenses < 0) AS BIGINT) AS negative_expense_rows
FROM fact_transactions""")

# ---------------------------------------------------------------------------
# report tables
# ---------------------------------------------------------------------------
MONTHLY_CTE = f"""
mt AS (SELECT strftime(date, '%Y-%m') AS month, {dsum('revenue')} AS revenue, {dsum('expenses')} AS expenses
       FROM fact_transactions WHERE date IS NOT NULL GROUP BY 1),
rmm AS (
  SELECT 0 AS g, month, {dbl('revenue')} AS revenue, {dbl('expenses')} AS expenses, {dbl('revenue - expenses')} AS net_profit,
    {frac('revenue - expenses', 'revenue', False)} AS profit_margin,
    {dbl('sum(revenue) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_total_revenue
  FROM mt
  UNION ALL
  SELECT 1, 'Total', {dbl('sum(revenue)')}, {dbl('sum(expenses)')}, {dbl('sum(revenue) - sum(expenses)')},
    {frac('sum(revenue) - sum(expenses)', 'sum(revenue)', False)}, NULL FROM mt
),
bva_rows AS (
  SELECT d.dept_name, d.dept_id,
    coalesce((SELECT sum(revenue) FROM fact_transactions t WHERE t.dept_id = d.dept_id), 0) AS ar,
    coalesce((SELECT sum(budgeted_revenue) FROM fact_budgets b WHERE b.dept_id = d.dept_id), 0) AS br,
    coalesce((SELECT sum(expenses) FROM fact_transactions t WHERE t.dept_id = d.dept_id), 0) AS ae,
    coalesce((SELECT sum(budgeted_expenses) FROM fact_budgets b WHERE b.dept_id = d.dept_id), 0) AS be
  FROM (SELECT dept_name, min(dept_id) AS dept_id FROM dim_departments
        WHERE dept_name IS NOT NULL AND dept_name <> '' GROUP BY 1) d
),
bva AS (
  SELECT 0 AS g, dept_name AS department, {dbl('ar')} AS actual_revenue, {dbl('br')} AS budget_revenue,
    {dbl('ar - br')} AS revenue_variance, {dbl('ae')} AS actual_expenses, {dbl('be')} AS budget_expenses,
    {dbl('be - ae')} AS expense_variance FROM bva_rows
  UNION ALL
  SELECT 1, 'Total', {dbl('sum(ar)')}, {dbl('sum(br)')}, {dbl('sum(ar) - sum(br)')}, {dbl('sum(ae)')}, {dbl('sum(be)')},
    {dbl('sum(be) - sum(ae)')} FROM bva_rows
)"""


def _segment_sql(dim: str, id_col: str, name_col: str, label: str) -> str:
    return f"""
WITH_ROWS AS (
  SELECT d.{name_col} AS k,
    coalesce((SELECT sum(revenue) FROM fact_transactions t WHERE t.{id_col} = d.{id_col}), 0) AS rev,
    coalesce((SELECT sum(expenses) FROM fact_transactions t WHERE t.{id_col} = d.{id_col}), 0) AS exp
  FROM (SELECT {name_col}, min({id_col}) AS {id_col} FROM {dim}
        WHERE {name_col} IS NOT NULL AND {name_col} <> '' GROUP BY 1) d)
SELECT k AS {label}, {dbl('rev')} AS revenue, {dbl('exp')} AS expenses, {dbl('rev - exp')} AS net_profit,
  {frac('rev - exp', 'rev', False)} AS margin FROM WITH_ROWS
UNION ALL
SELECT 'Total', {dbl('sum(rev)')}, {dbl('sum(exp)')}, {dbl('sum(rev) - sum(exp)')},
  {frac('sum(rev) - sum(exp)', 'sum(rev)', False)} FROM WITH_ROWS"""


sql("report_monthly_margin", "SELECT * EXCLUDE (g) FROM rmm", MONTHLY_CTE)
sql("report_budget_vs_actual", "SELECT * EXCLUDE (g) FROM bva", MONTHLY_CTE)
for _key, _args in (("report_segment_region", ("dim_regions", "region_id", "region_name", "region")),
                    ("report_segment_product", ("dim_products", "product_id", "product_name", "product_line"))):
    _body = _segment_sql(*_args)
    _ctes, _sel = _body.split(")\nSELECT", 1)
    sql(_key, "SELECT" + _sel, _ctes.replace("WITH_ROWS AS (", "seg_rows AS (", 1).strip() + ")")
    _SQL[_key] = _SQL[_key].replace("FROM WITH_ROWS", "FROM seg_rows")
sql("report_kpi_cards", """
SELECT revenue AS total_revenue, net_profit AS total_net_profit, profit_margin AS net_profit_margin
FROM rmm WHERE g = 1""", MONTHLY_CTE)
sql("report_overview", """
SELECT metric, round(current_value, 4) AS current_value, round(target_value, 4) AS target_value,
  round(variance, 4) AS variance FROM (
  SELECT 1 AS o, 'Total Sales Revenue' AS metric, m.revenue AS current_value, b.budget_revenue AS target_value,
    m.revenue - b.budget_revenue AS variance FROM rmm m, bva b WHERE m.g = 1 AND b.g = 1
  UNION ALL
  SELECT 2, 'Operational Expenses', m.expenses, b.budget_expenses, b.budget_expenses - m.expenses
    FROM rmm m, bva b WHERE m.g = 1 AND b.g = 1
  UNION ALL
  SELECT 3, 'Net Operating Profit', m.net_profit, b.budget_revenue - b.budget_expenses,
    m.net_profit - (b.budget_revenue - b.budget_expenses)
    FROM rmm m, bva b WHERE m.g = 1 AND b.g = 1)""", MONTHLY_CTE)

# ---------------------------------------------------------------------------
# BI measures
# ---------------------------------------------------------------------------


def _core(by_sql: str = "", join: str = "", key: str = "") -> str:
    sel = f"{key} AS {by_sql}, " if by_sql else ""
    grp = f" GROUP BY {key}" if by_sql else ""
    return f"""
SELECT {sel}{dbl('rev')} AS total_revenue, {dbl('exp')} AS total_expenses, {dbl('rev - exp')} AS net_profit,
  {frac('rev - exp', 'rev', False)} AS profit_margin, {frac('rev - exp', 'exp', False)} AS roi
FROM (SELECT {sel}{dsum('t.revenue')} AS rev, {dsum('t.expenses')} AS exp FROM fact_transactions t {join}{grp})"""


sql("bi_core_measures", _core())
_q = _core("region", "LEFT JOIN dim_regions g ON t.region_id = g.region_id", "g.region_name")
sql("bi_core_measures_by_region", _q.replace("SELECT g.region_name AS region, " + dbl("rev"),
                                             "SELECT region, " + dbl("rev"), 1))
_q = _core("department", "LEFT JOIN dim_departments d ON t.dept_id = d.dept_id", "d.dept_name")
sql("bi_core_measures_by_department", _q.replace("SELECT d.dept_name AS department, " + dbl("rev"),
                                                 "SELECT department, " + dbl("rev"), 1))
_q = _core("product_line", "LEFT JOIN dim_products p ON t.product_id = p.product_id", "p.product_name")
sql("bi_core_measures_by_product", _q.replace("SELECT p.product_name AS product_line, " + dbl("rev"),
                                              "SELECT product_line, " + dbl("rev"), 1))
_q = _core("month", "", "strftime(t.date, '%Y-%m')")
sql("bi_core_measures_by_month", _q.replace("SELECT strftime(t.date, '%Y-%m') AS month, " + dbl("rev"),
                                            "SELECT month, " + dbl("rev"), 1))
sql("bi_core_measures_filtered", f"""
SELECT region, {dbl('rev')} AS total_revenue, {dbl('exp')} AS total_expenses, {dbl('rev - exp')} AS net_profit,
  {frac('rev - exp', 'rev', False)} AS profit_margin, {frac('rev - exp', 'exp', False)} AS roi
FROM (SELECT g.region_name AS region, {dsum('t.revenue')} AS rev, {dsum('t.expenses')} AS exp
      FROM fact_transactions t LEFT JOIN dim_regions g ON t.region_id = g.region_id
      WHERE year(t.date) = 1996 GROUP BY 1)""")
sql("bi_core_measures_sliced", f"""
SELECT product_line, {dbl('rev')} AS total_revenue, {dbl('exp')} AS total_expenses, {dbl('rev - exp')} AS net_profit,
  {frac('rev - exp', 'rev', False)} AS profit_margin, {frac('rev - exp', 'exp', False)} AS roi
FROM (SELECT p.product_name AS product_line, {dsum('t.revenue')} AS rev, {dsum('t.expenses')} AS exp
      FROM fact_transactions t JOIN dim_regions g ON t.region_id = g.region_id
      LEFT JOIN dim_products p ON t.product_id = p.product_id
      WHERE g.region_name IN ('ASIA', 'EUROPE') AND year(t.date) IN (1995, 1996) AND quarter(t.date) IN (3, 4) GROUP BY 1)""")
sql("bi_variance_measures", f"""
SELECT coalesce(a.department, b.department) AS department, {dbl('coalesce(a.rev, 0)')} AS total_revenue,
  {dbl('coalesce(b.brev, 0)')} AS budget_revenue, {dbl('coalesce(a.rev, 0) - coalesce(b.brev, 0)')} AS revenue_variance,
  {frac('coalesce(a.rev, 0) - coalesce(b.brev, 0)', 'coalesce(b.brev, 0)', False)} AS revenue_variance_pct,
  {dbl('coalesce(b.bexp, 0)')} AS budget_expenses, {dbl('coalesce(a.exp, 0)')} AS total_expenses,
  {dbl('coalesce(b.bexp, 0) - coalesce(a.exp, 0)')} AS expense_variance
FROM (SELECT d.dept_name AS department, {dsum('t.revenue')} AS rev, {dsum('t.expenses')} AS exp
      FROM fact_transactions t LEFT JOIN dim_departments d ON t.dept_id = d.dept_id GROUP BY 1) a
FULL OUTER JOIN (SELECT d.dept_name AS department, {dsum('f.budgeted_revenue')} AS brev,
      {dsum('f.budgeted_expenses')} AS bexp
      FROM fact_budgets f LEFT JOIN dim_departments d ON f.dept_id = d.dept_id GROUP BY 1) b
  ON a.department IS NOT DISTINCT FROM b.department""")
MONTH_SERIES = """
ms AS (
  SELECT c.month, c.year, r.revenue FROM (SELECT DISTINCT month, year FROM dim_calendar) c
  LEFT JOIN (SELECT strftime(date, '%Y-%m') AS month, sum(revenue) AS revenue FROM fact_transactions
             WHERE date IS NOT NULL GROUP BY 1) r ON c.month = r.month
)"""
sql("bi_mom_growth", f"""
SELECT month, {dbl('revenue')} AS revenue, {dbl('prev')} AS prev_month_revenue,
  {frac('coalesce(revenue, 0) - coalesce(prev, 0)', 'coalesce(prev, 0)', False)} AS mom_growth
FROM (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev FROM ms)""", MONTH_SERIES)
sql("bi_ytd_revenue", f"""
SELECT year, month, {dbl('revenue')} AS revenue,
  {dbl('sum(revenue) OVER (PARTITION BY year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
    AS ytd_revenue
FROM ms""", MONTH_SERIES)
sql("bi_net_revenue_retention", f"""
SELECT cohort_month, month,
  CAST((CAST(substr(month, 1, 4) AS INTEGER) - CAST(substr(cohort_month, 1, 4) AS INTEGER)) * 12
       + CAST(substr(month, 6, 2) AS INTEGER) - CAST(substr(cohort_month, 6, 2) AS INTEGER) AS INTEGER) AS elapsed_months,
  {dbl('rev')} AS cohort_revenue, {dbl('base')} AS base_revenue, {frac('rev', 'base', False)} AS net_revenue_retention
FROM (SELECT cohort_month, month, rev,
        max(CASE WHEN month = cohort_month THEN rev END) OVER (PARTITION BY cohort_month) AS base
      FROM (SELECT cc.cohort_month, cm.trans_month AS month, sum(cm.revenue) AS rev
            FROM cm JOIN cc ON cm.client_id = cc.client_id GROUP BY 1, 2))""", COHORT_CTES)
sql("bi_settlement_conversion", f"""
SELECT stage_num AS stage_order, stage, CAST(cnt AS BIGINT) AS invoices_at_stage,
  CAST(all_invoices AS BIGINT) AS total_invoices, {frac('cnt', 'all_invoices', False)} AS conversion_rate
FROM funnel""", FUNNEL_CTES)
sql("bi_star_flat", """
SELECT t.transaction_id, t.date, CAST(year(t.date) AS INTEGER) AS year, CAST(quarter(t.date) AS INTEGER) AS quarter,
  strftime(t.date, '%Y-%m') AS month, t.revenue, t.expenses, d.dept_name AS department, g.region_name AS region,
  p.product_name AS product_line, k.category_name AS expense_category, t.client_id
FROM fact_transactions t
LEFT JOIN dim_departments d ON t.dept_id = d.dept_id LEFT JOIN dim_regions g ON t.region_id = g.region_id
LEFT JOIN dim_products p ON t.product_id = p.product_id
LEFT JOIN dim_expense_categories k ON t.category_id = k.category_id""")


def _bi_num(x: str) -> str:
    return f"TRY_CAST(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


sql("bi_clean_transactions", f"""
SELECT batch_id, filename, event_id, copy, division, area, segment, type, customer,
  coalesce(CAST(try_strptime({strip('transaction_date')}, '%Y-%m-%d') AS DATE),
           CAST(try_strptime({strip('transaction_date')}, '%m/%d/%Y') AS DATE)) AS Date,
  {_bi_num('sales')} AS Revenue, {_bi_num('spending')} AS Expenses
FROM raw_upload""")

# ---------------------------------------------------------------------------
# streaming ingestion: the stream appends exactly the batch merge's rows
# ---------------------------------------------------------------------------
_SQL["stream_ingest"] = _SQL["merge_transactions"].replace(
    "coalesce(c.client_id, '') AS client_id, c.batch_id\n", "coalesce(c.client_id, '') AS client_id\n")
# the mapping of headers is the same whatever their spelling
_SQL["stream_ingest_headers"] = _SQL["stream_ingest"]

# ---------------------------------------------------------------------------
# incremental aggregates: the same queries over the star with the merged uploads' rows
# ---------------------------------------------------------------------------
_GROWN = {"fact_transactions": "grown_transactions", "dim_departments": "ext_departments", "dim_regions": "ext_regions",
          "dim_products": "ext_products", "dim_expense_categories": "ext_categories"}
GROWN_CTES = EXT_CTES + f""",
appended AS ({_PARTS["merge_transactions"][0]}),
grown_transactions AS (
  SELECT * FROM fact_transactions UNION ALL BY NAME SELECT * EXCLUDE (batch_id) FROM appended
)"""


def _grown(text: str) -> str:
    for old, new in _GROWN.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


for _key in ("kpis", "monthly_performance", "department_performance", "regional_profitability", "product_profitability",
             "expenses_by_category", "report_monthly_margin", "cohort_sizes", "revenue_cohorts"):
    _body, _ctes = _PARTS[_key]
    sql(f"rollup_{_key}", _grown(_body), GROWN_CTES + (",\n" + _grown(_ctes) if _ctes else ""))
