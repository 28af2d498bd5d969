"""The Spark cleaning expressions and their DuckDB oracle twins agree on
awkward literal inputs (not only on the fixture's spellings)."""

import duckdb
from pyspark.sql import functions as F

from ledgerline.functions.cleaning import clean_numeric, parse_date
from ledgerline.plans import oracle

TEXTS = ["$1,234.50", "(500.00)", "$(500)", "-$5", "(-500.00)", "5%", "500-", " 12 ", "1e3", "1_000", ".5", "5.",
         "TBD", "-", "", "  7.25  ", "2025-06-15", "06/15/2025", "15-06-2025", "15/06/2025", "06/15/25",
         "2025-06-15 13:45:00", "06/15/2025 13:45", "2025-02-30", "20250615", "2025/06/15", "garbage"]


def test_clean_numeric_and_parse_date_match_duckdb(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    got = {r["x"]: (r["n"], r["d"]) for r in df.select(
        "x", clean_numeric(F.col("x")).alias("n"), parse_date(F.col("x")).alias("d")).collect()}
    values = ", ".join("(" + oracle._lit(t) + ")" for t in TEXTS)
    sql = (f"SELECT x, {oracle.clean_numeric('x')} AS n, {oracle.parse_date('x')} AS d "
           f"FROM (VALUES {values}) t(x)")
    want = {x: (n, d) for x, n, d in duckdb.connect().execute(sql).fetchall()}
    assert got == want
