"""File-stream ingestion: one upload is one audit, once."""

import pytest

from ledgerline.plans.jobs import init_load
from ledgerline.session import scratch_path
from ledgerline.sources import files, tables
from ledgerline.streaming import ingest as stream

HEADER = "Date,Revenue,Expenses,Department,Region,Product Line,Expense Category,Client ID\n"
GOOD = HEADER + "2025-06-15,100.00,10.00,Sales,North,Widgets,Rent,C1\n2025-06-16,200.00,20.00,Ops,South,Widgets,Rent,C2\n"
BAD = HEADER + ",100.00,10.00,Sales,North,Widgets,Rent,C1\n,,,Sales,,Widgets,Rent,\n"
BIG = HEADER + "2025-06-15,1000000000000000.00,10.00,Sales,North,Widgets,Rent,C1\n"


@pytest.fixture
def store(spark, tmp_path):
    """A store of two transactions."""
    (tmp_path / "tx.csv").write_text(GOOD)
    (tmp_path / "budgets.csv").write_text("Month,Department,Region,Budgeted Revenue,Budgeted Expenses\n")
    root = scratch_path(spark, "test-stream")
    init_load(spark, root, files.read_transactions(spark, str(tmp_path / "tx.csv")),
              files.read_budgets(spark, str(tmp_path / "budgets.csv")), files.read_invoices(spark, None),
              submitted_at="2025-01-01 00:00:00")
    return root


def drain(spark, folder, root, ckpt, **options):
    stream.start_file_ingest(spark, str(folder), root, ckpt, as_of="2025-12-31",
                             submitted_at="2025-12-31 00:00:00", **options).awaitTermination()


def logged(spark, root):
    log = tables.read_table(spark, root, "ingestion_log").orderBy("batch_id").collect()
    return [(r["filename"], r["row_count"], r["status"]) for r in log[1:]]


def test_ingest_and_restart(spark, store, tmp_path):
    inbox, ckpt = tmp_path / "inbox", scratch_path(spark, "test-stream-ckpt")
    for folder, text in (("a", GOOD), ("b", BAD), ("c", BIG)):  # one name, three uploads
        (inbox / folder).mkdir(parents=True)
        (inbox / folder / "data.csv").write_text(text)
    for _ in range(2):  # the second run has no new files
        drain(spark, inbox / "*", store, ckpt)
    # the oversized amount rejects its own upload only
    assert logged(spark, store) == [("data.csv", 2, "Accepted"), ("data.csv", 2, "Rejected"), ("data.csv", 1, "Rejected")]
    fact = tables.read_table(spark, store, "fact_transactions")
    assert fact.count() == 4
    new = fact.where("transaction_id > 2").orderBy("transaction_id").collect()
    assert [float(r["revenue"]) for r in new] == [100.0, 200.0]
    last = tables.read_table(spark, store, "ingestion_log").orderBy("batch_id").collect()[-1]
    assert "db_error" in last["issues_json"]


def test_folder_upload_is_not_split(spark, store, tmp_path):
    upload, ready = tmp_path / "x.csv", tmp_path / "ready"
    upload.mkdir()
    ready.mkdir()
    (upload / "part-0.csv").write_text(GOOD)
    (upload / "part-1.csv").write_text(BAD)
    (ready / "1.txt").write_text(f"{upload}\n")
    drain(spark, ready, store, scratch_path(spark, "test-stream-ckpt"), max_files_per_trigger=1, announced=True)
    assert logged(spark, store) == [("x.csv", 4, "Needs Review")]
    assert tables.read_table(spark, store, "fact_transactions").count() == 6


def test_headers_are_mapped(spark, store, tmp_path):
    """Files of other spellings and orders, one kind within a folder and across uploads, as ``ingest_file`` maps them."""
    inbox, ckpt = tmp_path / "inbox", scratch_path(spark, "test-stream-ckpt")
    inbox.mkdir()
    (inbox / "a.csv").write_text("revenue,date,category,product,zone,dept\n100,2024-01-02,Rent,Widgets,North,Ops\n")
    (inbox / "b.csv").write_text("\ufeffTurnover,Client,Outflow,Day,Dept,\"Zone, all\",product,type,note\n"
                                 "5.50,C9,2,2024-02-03,Sales,North,\"Widgets, big\",Rent,x\n\n,,1,2024-02-04,Ops\n")
    (inbox / "c.csv").write_text("date,date,revenue,expenses,dept,region,product,category\n"
                                 "2024-03-01,2024-03-09,7,NA,Ops,North,Widgets,Rent\n")
    drain(spark, inbox, store, ckpt)
    fact = tables.read_table(spark, store, "fact_transactions").where("transaction_id > 2").orderBy("transaction_id").collect()
    assert [(str(r["date"]), float(r["revenue"]), float(r["expenses"]), r["client_id"]) for r in fact] == [
        ("2024-01-02", 100.0, 0.0, ""), ("2024-02-03", 5.5, 2.0, "C9"), ("2024-02-04", 0.0, 1.0, ""), ("2024-03-01", 7.0, 0.0, "")]
    products = {r["product_name"] for r in tables.read_table(spark, store, "dim_products").collect()}
    assert "Widgets, big" in products


def test_stream_and_file_job_agree(spark, store, tmp_path):
    from ledgerline.operators import ingest
    from ledgerline.sources.uploads import read_upload

    text = "Txn_Date,Cost_Center,REV,costs here,area\n2024-01-02,Ops,(5.00),$1,North\n1/2/24,, 7 ,nan,South\n"
    (tmp_path / "u.csv").write_text(text)
    want = ingest.mapped(read_upload(spark, str(tmp_path / "u.csv"))).orderBy("row_num").collect()
    uploads, _ = stream.find_uploads(spark, [str(tmp_path / "u.csv")])
    got = stream.mapped_rows(stream._lines(spark, uploads)).orderBy("_u_block", "_u_pos").collect()
    assert [r[4:] for r in got] == [r[3:] for r in want]


def test_poison_uploads_are_logged_and_others_go_on(spark, store, tmp_path):
    ready, ckpt = tmp_path / "ready", scratch_path(spark, "test-stream-ckpt")
    ready.mkdir()
    for name, text in (("good", GOOD), ("bad", BAD)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.csv").write_text(text)
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "part-0.csv.gz").write_bytes(b"\x1f\x8b\x08\x00 this is no gzip file")
    (tmp_path / "none.csv").write_text(HEADER)
    (tmp_path / "book.xlsx").write_text("x")
    names = ["good", "late", "torn", "none.csv", "book.xlsx", "bad"]
    (ready / "1.txt").write_text("".join(f"{tmp_path}/{n}\n" for n in names))
    for _ in range(2):
        drain(spark, ready, store, ckpt, announced=True)
    assert logged(spark, store) == [("bad", 2, "Rejected"), ("good", 2, "Accepted")] + [
        (n, 0, "Rejected") for n in ("book.xlsx", "late", "torn", "none.csv")]
    log = {r["filename"]: r for r in tables.read_table(spark, store, "ingestion_log").collect()}
    assert "does not exist" in log["late"]["issues_json"] and "Unsupported" in log["book.xlsx"]["issues_json"]
    assert "empty" in log["none.csv"]["issues_json"] and "Failed to read" in log["torn"]["issues_json"]
    assert tables.read_table(spark, store, "fact_transactions").count() == 4
    # what was audited is not taken again, under any spelling of its path; what was missing may come later
    (tmp_path / "late").mkdir()
    (tmp_path / "late" / "part-0.csv").write_text(GOOD)
    (ready / "2.txt").write_text(f"{tmp_path}/good/\nfile://{tmp_path}/bad\n{tmp_path}/late\n")
    drain(spark, ready, store, ckpt, announced=True)
    assert logged(spark, store)[6:] == [("late", 2, "Accepted")]
    assert tables.read_table(spark, store, "fact_transactions").count() == 6


def test_failure_after_the_commit(spark, store, tmp_path, monkeypatch):
    inbox, ckpt = tmp_path / "inbox", scratch_path(spark, "test-stream-ckpt")
    inbox.mkdir()
    (inbox / "a.csv").write_text(GOOD)
    commit = tables.commit

    def fails(*args, **kwargs):
        commit(*args, **kwargs)
        raise OSError("connection lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "commit", fails)
        with pytest.raises(Exception):
            drain(spark, inbox, store, ckpt)
    drain(spark, inbox, store, ckpt)  # the epoch is replayed
    assert logged(spark, store) == [("a.csv", 2, "Accepted")]
    assert tables.read_table(spark, store, "fact_transactions").count() == 4


def test_failure_after_the_log_append(spark, store, tmp_path, monkeypatch):
    inbox, ckpt = tmp_path / "inbox", scratch_path(spark, "test-stream-ckpt")
    inbox.mkdir()
    (inbox / "a.csv").write_text(GOOD)
    write_log = tables.write_log

    def fails(*args, **kwargs):
        write_log(*args, **kwargs)
        raise OSError("connection lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "write_log", fails)
        with pytest.raises(Exception):
            drain(spark, inbox, store, ckpt)
    drain(spark, inbox, store, ckpt)  # the epoch is replayed
    assert logged(spark, store) == [("a.csv", 2, "Accepted")]
    assert tables.read_table(spark, store, "fact_transactions").count() == 4
