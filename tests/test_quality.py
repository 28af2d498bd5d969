"""The nine audit rules at their thresholds, and the anomalous 5-row upload."""

import datetime as dt

import pytest

from ledgerline.operators import quality
from ledgerline.plans.jobs import ingest_file, init_load
from ledgerline.session import scratch_path
from ledgerline.sources import fixtures, tables

SCHEMA = ("batch_id int, row_num bigint, date date, revenue double, expenses double, department string, "
          "region string, product_line string, expense_category string, client_id string")
D = dt.date(2025, 6, 15)


def _rows(spark, rows):
    full = [(1, i + 1, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def _rules(spark, rows, as_of="2025-12-31"):
    iss = quality.issues(_rows(spark, rows), as_of).collect()
    return {(r["row_num"], r["rule"]) for r in iss}


def test_thresholds(spark):
    rows = [
        (D, 50000.0, 25000.0, "S", "N", "P", "C", "1"),     # exactly at thresholds: nothing
        (D, 50000.01, 25000.01, "S", "N", "P", "C", "1"),   # strictly above: both extreme
        (D, 0.0, 0.0, "S", "N", "P", "C", "1"),             # null_amounts
        (D, -1.0, -2.0, "S", "N", "P", "C", "1"),           # negatives
        (None, 1.0, 1.0, "S", "N", "P", "C", "1"),          # missing date
        (dt.date(2026, 1, 1), 1.0, 1.0, "S", "N", "P", "C", "1"),  # future
        (dt.date(2025, 12, 31), 1.0, 1.0, "S", " ", None, "C", None),  # as_of itself: not future; blanks
    ]
    got = _rules(spark, rows)
    assert not any(r == 1 for r, _ in got)
    assert {(2, "extreme_revenue"), (2, "extreme_expenses")} <= got
    assert (3, "null_amounts") in got
    assert {(4, "negative_revenue"), (4, "negative_expenses")} <= got
    assert (5, "missing_date") in got
    assert (6, "future_dates") in got
    assert (7, "blank_fields") in got and (7, "future_dates") not in got


def test_blank_fields_message_and_client_exempt(spark):
    iss = quality.issues(_rows(spark, [(D, 1.0, 0.0, None, "", "P", "  ", None)]), "2025-12-31").collect()
    (b,) = [r for r in iss if r["rule"] == "blank_fields"]
    assert b["columns"] == "department, region, expense_category"
    assert b["msg"] == "Blank categorizations in: department, region, expense_category"


def test_duplicates_first_kept_nulls_equal(spark):
    row = (None, 5.0, 1.0, "S", None, "P", "C", None)
    got = _rules(spark, [row, row, (D, 5.0, 1.0, "S", "N", "P", "C", "1"), row])
    dups = sorted(r for r, rule in got if rule == "overlapping_rows")
    assert dups == [2, 4]


def test_messages(spark):
    iss = quality.issues(_rows(spark, [(dt.date(2026, 2, 1), -500.0, 30000.0, "S", "N", "P", "C", "1")]),
                         "2025-12-31").collect()
    msgs = {r["rule"]: r["msg"] for r in iss}
    assert msgs["future_dates"] == "Date '2026-02-01' is in the future."
    assert msgs["negative_revenue"] == "Revenue amount $-500.00 is negative."
    assert msgs["extreme_expenses"] == "Large expense spike: $30000.00."


@pytest.mark.parametrize("failed,n,status", [(1, 5, "Accepted"), (2, 10, "Accepted"), (3, 10, "Needs Review"),
                                             (5, 10, "Needs Review"), (6, 10, "Rejected"), (4, 5, "Rejected")])
def test_verdict_thresholds(spark, failed, n, status):
    rows = [(None if i < failed else D, 1.0, 1.0, "S", "N", "P", "C", "1") for i in range(n)]
    v = quality.verdicts(_rows(spark, rows), "2025-12-31").first()
    assert v["status"] == status
    assert v["health_score"] == pytest.approx(1 - failed / n)


ANOMALOUS = """Date,Revenue,Expenses,Department,Region,Product Line,Expense Category
2025-06-15,5400.00,1200.00,Sales,South,Software Licenses,Salaries
2025-06-16,4500.00,{neg},Marketing,North,Consulting Services,Marketing Ads
2025-06-17,,,Operations,West,Hardware Systems,Rent
2026-12-01,12000.00,4000.00,Engineering,East,Cloud Subscriptions,Software Subscriptions
,3400.00,1500.00,HR,South,Software Licenses,Benefits
"""


@pytest.fixture(scope="module")
def store(spark, sf_dir):
    root = scratch_path(spark, "test-store")
    init_load(spark, root, fixtures.raw_transactions(spark, sf_dir), fixtures.raw_budgets(spark, sf_dir),
              fixtures.raw_invoices(spark, sf_dir), submitted_at="2025-01-01 00:00:00")
    return root


def _upload(tmp_path, text, name="financial_upload_test.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_anomalous_upload_rejected(spark, store, tmp_path):
    before = tables.read_table(spark, store, "fact_transactions").count()
    res = ingest_file(spark, _upload(tmp_path, ANOMALOUS.format(neg="-500.00")), store, as_of="2026-11-30",
                      submitted_at="2026-11-30 12:00:00")
    assert res["success"] is False and res["status"] == "Rejected"
    assert res["health_score"] == pytest.approx(0.2)
    assert {"missing_date", "future_dates", "negative_expenses", "null_amounts"} <= set(res["issues"])
    assert tables.read_table(spark, store, "fact_transactions").count() == before
    log = tables.read_table(spark, store, "ingestion_log").orderBy("batch_id").collect()
    assert log[-1]["status"] == "Rejected" and log[-1]["rejected_rows"] == 5 and log[-1]["health_score"] == 20.0


def test_anomalous_upload_after_date(spark, store, tmp_path):
    res = ingest_file(spark, _upload(tmp_path, ANOMALOUS.format(neg="-500.00")), store, as_of="2026-12-01",
                      submitted_at="2026-12-01 12:00:00")
    assert res["status"] == "Rejected" and "future_dates" not in res["issues"]
    assert res["health_score"] == pytest.approx(0.4)


def test_parenthesised_negative_variant_needs_review_and_merges(spark, store, tmp_path):
    before = tables.read_table(spark, store, "fact_transactions").count()
    res = ingest_file(spark, _upload(tmp_path, ANOMALOUS.format(neg="(-500.00)")), store, as_of="2026-12-01",
                      submitted_at="2026-12-02 12:00:00")
    assert res["status"] == "Needs Review" and res["success"] is True
    assert res["health_score"] == pytest.approx(0.6)
    assert "negative_expenses" not in res["issues"]
    fact = tables.read_table(spark, store, "fact_transactions")
    assert fact.count() == before + 5
    depts = {r["dept_name"] for r in tables.read_table(spark, store, "dim_departments").collect()}
    assert {"Sales", "Marketing", "HR"} <= depts
    new = fact.where(f"transaction_id > {before}").orderBy("transaction_id").collect()
    assert [r["transaction_id"] for r in new] == list(range(before + 1, before + 6))
    assert new[0]["client_id"] == "" and new[4]["date"] is None


def test_unsupported_and_empty_uploads(spark, store, tmp_path):
    assert ingest_file(spark, _upload(tmp_path, "x", "book.xlsx"), store)["status"] == "Rejected"
    res = ingest_file(spark, _upload(tmp_path, "Date,Revenue\n", "empty.csv"), store)
    assert res == {"success": False, "msg": "The uploaded file is empty.", "status": "Rejected"}


def test_write_failure_rejects_batch(spark, store, tmp_path, monkeypatch):
    from ledgerline.plans import jobs

    def boom(*a, **k):
        raise OSError("disk full")

    monkeypatch.setattr(jobs.tables, "write_segment", boom)
    good = ANOMALOUS.format(neg="100.00").replace("2026-12-01", "2025-06-18").replace(
        "\n,3400.00", "\n2025-06-19,3400.00").replace(",,,Operations", ",10.00,1.00,Operations")
    res = ingest_file(spark, _upload(tmp_path, good, "good.csv"), store, as_of="2025-12-31",
                      submitted_at="2025-12-31 00:00:00")
    assert res["status"] == "Rejected" and res["success"] is False and res["rejected_rows"] == 5
    last = tables.read_table(spark, store, "ingestion_log").orderBy("batch_id").collect()[-1]
    assert "db_error" in last["issues_json"] and last["status"] == "Rejected"


def test_hot_duplicate_row(spark):
    """One row repeated as a third of the batch: every copy after the first is flagged."""
    hot = (D, 5.0, 1.0, "S", "N", "P", "C", "1")
    rows = [hot if i % 3 == 0 else (D, i + 0.5, 1.0, "S", "N", "P", "C", "1") for i in range(300)]
    dups = quality.duplicate_rows(_rows(spark, rows)).collect()
    assert len(dups) == 99 and {r["first_row_num"] for r in dups} == {1}
