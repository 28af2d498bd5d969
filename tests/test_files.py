"""Initial load from raw CSV files (S1-S3, S6): dims, ids, defaults."""

import datetime as dt

import pytest

from ledgerline.plans.jobs import init_load, init_load_checked
from ledgerline.session import scratch_path
from ledgerline.sources import files, tables

TX = """Date,Revenue,Expenses,Department,Region,Product Line,Expense Category,Client ID
2025-01-03,1000.50,,Sales,North,Software Licenses,Salaries,CL-001
2025-01-04,,200.25,Marketing,South,Consulting Services,Marketing Ads,
2025-02-10,2500.00,300.00,Sales,East,Software Licenses,Salaries,CL-002
2025-02-11,NA,50.00,HR,West,Hardware Systems,Benefits,
"""
BUDGETS = """Month,Department,Region,Budgeted Revenue,Budgeted Expenses
2025-01,Sales,North,1200.00,500.00
2025-01,Engineering,North,900.00,400.00
2025-02,Sales,East,2000.00,800.00
"""


def test_init_load_from_files(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(TX)
    (tmp_path / "budgets.csv").write_text(BUDGETS)
    raw_tx = files.read_transactions(spark, str(tmp_path / "tx.csv"))
    raw_b = files.read_budgets(spark, str(tmp_path / "budgets.csv"))
    raw_i = files.read_invoices(spark, str(tmp_path / "missing_invoices.csv"))  # optional: absent
    root = scratch_path(spark, "test-files")
    star = init_load(spark, root, raw_tx, raw_b, raw_i, submitted_at="2025-03-01 00:00:00")

    depts = [tuple(r) for r in star.dim_departments.orderBy("dept_id").collect()]
    assert depts == [(1, "Engineering"), (2, "HR"), (3, "Marketing"), (4, "Sales")]  # union of both files, sorted
    products = [r["product_name"] for r in star.dim_products.orderBy("product_id").collect()]
    assert products == ["Consulting Services", "Hardware Systems", "Software Licenses"]

    fact = star.fact_transactions.orderBy("transaction_id").collect()
    assert [r["transaction_id"] for r in fact] == [1, 2, 3, 4]                     # file order
    assert [float(r["revenue"]) for r in fact] == [1000.5, 0.0, 2500.0, 0.0]      # missing -> 0
    assert [float(r["expenses"]) for r in fact] == [0.0, 200.25, 300.0, 50.0]
    assert [r["client_id"] for r in fact] == ["CL-001", "", "CL-002", ""]          # no id -> ''
    assert fact[0]["dept_id"] == 4 and fact[1]["dept_id"] == 3

    b = star.fact_budgets.orderBy("budget_id").collect()
    assert [(r["budget_id"], r["month"], r["dept_id"]) for r in b] == [(1, "2025-01", 4), (2, "2025-01", 1),
                                                                      (3, "2025-02", 4)]
    assert star.fact_invoices.count() == 0
    log = tables.read_table(spark, root, "ingestion_log").collect()
    assert len(log) == 1 and log[0]["batch_id"] == 1 and log[0]["row_count"] == 4


def test_amounts_that_cannot_be_stored_stop_the_load(spark, tmp_path):
    for bad in ("12x", "100000000000000.00", "1e20"):
        path = tmp_path / f"{bad}.csv"
        path.write_text(f"Date,Revenue,Expenses\n2025-01-03,{bad},1.00\n")
        with pytest.raises(Exception, match="Not an amount that can be stored"):
            files.read_transactions(spark, str(path)).collect()


def test_dates_with_a_time(spark, tmp_path):
    (tmp_path / "tx.csv").write_text("Date,Revenue,Expenses\n2025-01-05 00:00:00,1.00,\n2025-1-6,  ,2.00\nsoon,1,1\n")
    rows = files.read_transactions(spark, str(tmp_path / "tx.csv")).orderBy("_src_pos").collect()
    assert [r["date"] for r in rows] == [dt.date(2025, 1, 5), dt.date(2025, 1, 6), None]
    assert rows[1]["revenue"] is None and float(rows[0]["revenue"]) == 1.0


def test_records_that_cannot_be_stored_are_kept_as_rejects(spark, tmp_path):
    good = TX.splitlines()
    bad = ["2025-02-12,12x,1.00,Sales,North,Software Licenses,Salaries,CL-003",        # no amount
           "2025-02-12,1e20,x,Sales,North,Software Licenses,Salaries,CL-003",          # two that can't be stored
           "2025-02-13,1.00,2.00,Sales",                                               # too few fields
           "2025-02-14,1.00,2.00,Sales,North,Consulting Services,Salaries,CL-4,more"]  # too many
    (tmp_path / "tx.csv").write_text("\n".join([good[0], bad[0], good[1], bad[1], good[2], bad[2], *good[3:], bad[3]]) + "\n")
    (tmp_path / "budgets.csv").write_text(BUDGETS + "2025-03,Sales,East,much,1.00\n")
    (tmp_path / "inv.csv").write_text("Invoice ID,Client ID,Issue Date,Amount,Status\nI1,CL-001,2025-01-05,10.00,Paid\nI2,CL-001\n")
    root = scratch_path(spark, "test-rejects")
    star = init_load_checked(spark, root, *(str(tmp_path / f) for f in ("tx.csv", "budgets.csv", "inv.csv")),
                             submitted_at="2025-03-01 00:00:00")
    fact = star.fact_transactions.orderBy("transaction_id").collect()
    assert [float(r["revenue"]) for r in fact] == [1000.5, 0.0, 2500.0, 0.0]  # a missing amount is no reject
    assert star.fact_budgets.count() == 3 and star.fact_invoices.count() == 1
    rejects = tables.read_rejects(spark, root)
    ragged = "Wrong number of fields"
    amount = "{} is not an amount that can be stored".format
    assert [(r["input"], r["record"], r["reason"]) for r in rejects.orderBy("input", "_src_pos").collect()] == [
        ("budgets", "2025-03,Sales,East,much,1.00", amount("Budgeted Revenue")),
        ("invoices", "I2,CL-001", ragged),
        ("transactions", bad[0], amount("Revenue")),
        ("transactions", bad[1], f"{amount('Revenue')}; {amount('Expenses')}"),
        ("transactions", bad[2], ragged),
        ("transactions", bad[3], ragged)]
    # each record of the file is either a row or a reject
    assert len(fact) + rejects.where("input = 'transactions'").count() == len(good) - 1 + len(bad)
    # a later load that tells none apart has none
    (tmp_path / "good.csv").write_text(TX)
    (tmp_path / "good_budgets.csv").write_text(BUDGETS)
    init_load(spark, root, files.read_transactions(spark, str(tmp_path / "good.csv")),
              files.read_budgets(spark, str(tmp_path / "good_budgets.csv")), files.read_invoices(spark, None))
    assert tables.read_rejects(spark, root).count() == 0


def test_checked_file_without_rejects_reads_alike(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(TX)
    plain = files.read_transactions(spark, str(tmp_path / "tx.csv"))
    rows, rejects = files.read_checked_transactions(spark, str(tmp_path / "tx.csv"))
    assert rejects.count() == 0 and rows.columns == plain.columns
    assert rows.orderBy("_src_pos").collect() == plain.orderBy("_src_pos").collect()
    (tmp_path / "head.csv").write_text(TX.splitlines()[0] + "\n")
    assert [d.count() for d in files.read_checked_transactions(spark, str(tmp_path / "head.csv"))] == [0, 0]
    assert [d.count() for d in files.read_checked_invoices(spark, str(tmp_path / "none.csv"))] == [0, 0]
