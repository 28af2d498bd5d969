"""Literal-row tests of value cleaning and header mapping."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.cleaning import bi_number, clean_numeric, parse_date
from ledgerline.functions.headers import map_columns, normalise_header, resolve_headers


def _one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    (None, 0.0), ("", 0.0), ("  ", 0.0), ("$1,234.50", 1234.5), ("(500.00)", -500.0), ("$(500)", -500.0),
    ("-$5", -5.0), ("(-500.00)", 0.0), ("€5", 0.0), ("5%", 0.0), ("500-", 0.0), ("( 500 )", 0.0),
    ("1_000", 1000.0), ("1d", 0.0), ("1f", 0.0), (" 12 ", 12.0), ("1e3", 1000.0), ("inf", 0.0), ("nan", 0.0),
    ("TBD", 0.0), ("-", 0.0), ("\u00a0500.00", 500.0), ("$\u00a01,200\u3000", 1200.0), ("\u2007(7)\u202f", -7.0), (".5", 0.5), ("5.", 5.0), ("()", 0.0),
])
def test_clean_numeric(spark, text, expected):
    assert _one(spark, clean_numeric, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2025-06-15", dt.date(2025, 6, 15)),
    ("2025-6-5", dt.date(2025, 6, 5)),
    ("2025-06-15 13:45:00", dt.date(2025, 6, 15)),
    ("06/15/2025", dt.date(2025, 6, 15)),
    ("01/05/2025", dt.date(2025, 1, 5)),          # US order wins on ambiguous slashes
    ("06/15/2025 13:45", dt.date(2025, 6, 15)),
    ("06/15/25", dt.date(2025, 6, 15)),
    ("06/15/69", dt.date(1969, 6, 15)),           # two-digit years 69..99 -> 19xx
    ("06/15/68", dt.date(2068, 6, 15)),
    ("15-06-2025", dt.date(2025, 6, 15)),
    ("15/06/2025", dt.date(2025, 6, 15)),          # day > 12: day-first
    ("2025-06-15T13:45:00", dt.date(2025, 6, 15)),
    ("20250615", dt.date(2025, 6, 15)),
    ("2025/06/15", dt.date(2025, 6, 15)),
    ("Jun 15, 2025", dt.date(2025, 6, 15)),
    ("June 15, 2025", dt.date(2025, 6, 15)),
    ("15 Jun 2025", dt.date(2025, 6, 15)),
    ("  2025-06-15  ", dt.date(2025, 6, 15)),
    ("\u00a02025-06-15\u3000", dt.date(2025, 6, 15)),
    ("2025-06-15 10:30", dt.date(2025, 6, 15)),
    ("2025-06-15T10:30:00Z", dt.date(2025, 6, 15)),
    ("2025-06-15T23:30:00+02:00", dt.date(2025, 6, 15)),  # the day as written
    ("2025-06-15 10:30:00.123", dt.date(2025, 6, 15)),
    ("6/15/2025 10:30:45", dt.date(2025, 6, 15)),
    ("6/15/2025 10:30 AM", dt.date(2025, 6, 15)),
    ("15/6/2025 10:30:45", dt.date(2025, 6, 15)),
    ("15-Jun-2025", dt.date(2025, 6, 15)),
    ("June 15 2025", dt.date(2025, 6, 15)),
    ("Jun 15 2025", dt.date(2025, 6, 15)),
    ("15 June 2025", dt.date(2025, 6, 15)),
    ("2025-06-15 25:30", None), ("2025-06-15 10:30 XM", None),
    ("2025-02-30", None), ("garbage", None), ("", None), (None, None), ("25-06-15", None),
])
def test_parse_date(spark, text, expected):
    assert _one(spark, parse_date, text) == expected


def _by_pandas(text):
    try:
        day = pd.to_datetime(text)
    except (ValueError, OverflowError):
        return None
    return None if pd.isna(day) else day.date()


def test_free_dates_are_those_of_pandas(spark):
    """Spellings beyond the listed formats: every month's names in every usual order, and texts that are no dates."""
    forms = ["15 {} 2025", "{} 15 2025", "{} 15, 2025", "{} 15th, 2025", "15th of {} 2025", "15-{}-25", "15{}2025", "2025 {} 15",
             "2025-{}-15", "{}-15-2025", "15. {} 2025", "Sunday, {} 15, 2025", "Sun 15 {} 2025", "{} 2025", "2025 {}",
             "{}. 15, 2025", "15/{}/2025", "{} 15 2025 10:30", "{} 15, 2025 3:45 PM", "{} 15, 2025 at 3pm", "{} 3rd 2024",
             "15 {} 2025 10:30:45.5", "15 {} 2025T10:30", "{} 31 2025", "{} 29, 2024", "{} 0, 2024", "{}, 2025", "{} 15 25",
             "{} 2025 15", "15 2025 {}", "2025 15 {}", "the {} 2025", "{} 15 2025 25:10"]
    names = ["Jan", "February", "MAR", "april", "May", "Jun", "July", "aug", "Sept", "september", "Oct", "nov", "DECEMBER", "Foo"]
    texts = [f.format(n) for f in forms for n in names]
    texts += ["15.06.2025", "06.15.2025", "01.05.2025", "2025.06.15", "2025 6 15", "6 15 2025", "2025-06", "06/2025", "06-2025",
              "2025", "2025Q2", "2025-Q3", "4Q2024", "2025-13-06", "31.04.2025", "13.13.2025", "99999", "12.5", "5-", "12.2025",
              "2025.06.15 13:30 PM", "15.06.2025 10:30", "2025-06-15 24:00", "00/2025", "2025-00-10", "on 15 June 2025",
              "2025-06-15 10:30 +0200", "June 15 2025, 10:30 UTC", "2025-6-5 3 PM", "Thursday 19 June 2025", "abc 2025"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = {r["x"]: r["d"] for r in df.select("x", parse_date(F.col("x")).alias("d")).collect()}
    want = {t: _by_pandas(t) for t in texts}
    assert sum(d is not None for d in want.values()) > 300
    assert {t: d for t, d in got.items() if d != want[t]} == {}


@pytest.mark.parametrize("text,expected", [
    ("15 Jun 68", dt.date(2068, 6, 15)), ("Jun 15 69", dt.date(1969, 6, 15)), ("25.06.15", None), ("June 15", None), ("10:30", None),
    ("-5", None), ("June 15, 2025" + " " * 80 + "x", None), ("2025Q5", None)])
def test_free_dates_of_our_own(spark, text, expected):
    assert _one(spark, parse_date, text) == expected


@pytest.mark.parametrize("text,expected", [("(500.00)", 500.0), ("$1,234.50", 1234.5), ("TBD", None), ("-5", -5.0)])
def test_bi_number(spark, text, expected):
    assert _one(spark, bi_number, text) == expected


def test_header_normalisation():
    assert normalise_header("  Product_Line ") == "product line"
    assert normalise_header("Expense__Category") == "expense category"


def test_column_mapping_names_and_order():
    m = resolve_headers(["transaction_date", "sales", "spending", "cost_center", "area", "segment", "type"])
    assert list(m) == ["date", "revenue", "expenses", "department", "region", "product_line",
                       "expense_category", "client_id"]
    assert m["date"] == "transaction_date" and m["revenue"] == "sales" and m["expenses"] == "spending"
    assert m["region"] == "area" and m["product_line"] == "segment" and m["expense_category"] == "type"
    assert m["client_id"] is None
    # intended deviation: synonyms are normalised like headers, so cost_center maps
    assert m["department"] == "cost_center"


def test_column_mapping_second_header_set():
    m = resolve_headers(["Date", "Rev", "Outflow", "division", "area", "line", "type"])
    assert m == {"date": "Date", "revenue": "Rev", "expenses": "Outflow", "department": "division",
                 "region": "area", "product_line": "line", "expense_category": "type", "client_id": None}


def test_column_mapping_rules():
    # substring fallback in file order, short synonyms over-match
    assert resolve_headers(["Holiday", "Amount"])["date"] == "Holiday"
    # a header claimed twice goes to the later canonical column
    m = resolve_headers(["Expense Category"])
    assert m["expense_category"] == "Expense Category" and m["expenses"] is None
    # two raw headers with one normal form: the last wins
    assert resolve_headers(["Sales", "sales "])["revenue"] == "sales "


def test_map_columns_frame(spark):
    df = spark.createDataFrame([("2025-01-01", "10", "N/A")], "Day string, Income string, Outflow string")
    out = map_columns(df)
    assert out.columns == ["date", "revenue", "expenses", "department", "region", "product_line",
                           "expense_category", "client_id"]
    r = out.first()
    assert r["date"] == "2025-01-01" and r["revenue"] == "10" and r["expenses"] is None and r["region"] is None
