"""Fixed values that must equal the original application's for right results.

Kept together, in natural order, as plain text.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Invoice status texts, stage 1..5 (unknown text -> stage 1).
INVOICE_STATUSES = ["1-Created", "2-Delivered", "3-Approved", "4-Pending Payment", "5-Settled"]

# Funnel stage labels, stage 1..5.
FUNNEL_STAGES = ["1. Created", "2. Delivered", "3. Approved", "4. Pending Payment", "5. Settled"]

# Canonical upload columns and their header synonyms, in priority order.
COLUMN_SYNONYMS = {
    "date": ["date", "transaction_date", "trans_date", "day"],
    "revenue": ["revenue", "sales", "income", "turnover", "rev"],
    "expenses": ["expenses", "costs", "expense", "exp", "spending", "outflow"],
    "department": ["department", "dept", "cost_center", "division"],
    "region": ["region", "area", "zone", "location"],
    "product_line": ["product line", "product_line", "product", "segment", "line"],
    "expense_category": ["expense category", "expense_category", "category", "type", "expense_type"],
    "client_id": ["client id", "client_id", "client", "customer id", "customer_id", "customer"],
}

# Text read as missing by the CSV reader of the original application.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Quality rules: key, severity, message (``{}`` = value), in report order.
DQ_RULES = [
    ("missing_date", "Critical", "Transaction date is missing or unparseable."),
    ("future_dates", "Warning", "Date '{}' is in the future."),
    ("negative_revenue", "Warning", "Revenue amount ${} is negative."),
    ("negative_expenses", "Warning", "Expenses amount ${} is negative."),
    ("null_amounts", "Warning", "Transaction has zero revenue and zero expenses."),
    ("blank_fields", "Warning", "Blank categorizations in: {}"),
    ("overlapping_rows", "Info", "Exact duplicate transaction row."),
    ("extreme_revenue", "Info", "Large revenue spike: ${}."),
    ("extreme_expenses", "Info", "Large expense spike: ${}."),
]

# Outlier thresholds (strictly greater than).
EXTREME_REVENUE = 50000
EXTREME_EXPENSES = 25000

# Verdict thresholds on the batch health score.
ACCEPT_SCORE = 0.8
REVIEW_SCORE = 0.5

# Dimension columns checked by the blank-fields rule (client id is exempt).
BLANK_CHECK_COLUMNS = ["department", "region", "product_line", "expense_category"]

# Rows listed per rule in the issue summary.
ISSUE_ROWS_SHOWN = 10

# Cohort window: elapsed months 0..11.
COHORT_MONTHS = 12

# BI cleaning script renames (source header -> target), in listed order.
BI_RENAMES = [("spending", "Expenses"), ("costs", "Expenses"), ("outflow", "Expenses"),
              ("income", "Revenue"), ("sales", "Revenue"), ("earnings", "Revenue")]
