"""BI cleaning script renames and the upload mapping report."""

import datetime as dt

from ledgerline.functions.headers import mapping_report
from ledgerline.operators.bi import clean_transactions


def test_bi_clean_renames_and_numbers(spark):
    df = spark.createDataFrame(
        [("2025-01-05", "(500.00)", None, "$1,200.50", "x"), ("01/07/2025", "TBD", "300", None, "y")],
        "Date string, income string, sales string, costs string, note string")
    rows = clean_transactions(df).orderBy("note").collect()
    assert rows[0]["Revenue"] == 500.0            # parentheses dropped: (500.00) reads as +500
    assert rows[0]["Expenses"] == 1200.5
    assert rows[1]["Revenue"] == 300.0            # income unreadable -> next listed source (sales)
    assert rows[0]["Date"] == dt.date(2025, 1, 5) and rows[1]["Date"] == dt.date(2025, 1, 7)
    assert "income" not in clean_transactions(df).columns and "note" in clean_transactions(df).columns


def test_bi_clean_missing_fields_tolerated(spark):
    df = spark.createDataFrame([("a",)], "note string")
    r = clean_transactions(df).first()
    assert r["Revenue"] is None and r["Expenses"] is None and r["Date"] is None


def test_mapping_report(spark):
    df = spark.createDataFrame([(1, "2025-01-01", "10", None), (1, "N/A", "20", None)],
                               "batch_id int, Day string, Income string, Extra string")
    rep = {r["canonical"]: r for r in mapping_report(df).collect()}
    assert rep["date"]["source_column"] == "Day" and rep["date"]["non_null_count"] == 1
    assert rep["revenue"]["mapped"] is True and rep["revenue"]["non_null_count"] == 2
    assert rep["client_id"]["source_column"] is None and rep["client_id"]["mapped"] is False
