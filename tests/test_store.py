"""The store's commits: several writers, readers between them, month partitions and slicers."""

import threading

import pytest

from ledgerline.operators import bi
from ledgerline.plans import jobs
from ledgerline.session import scratch_path
from ledgerline.sources import files, tables

HEADER = "Date,Revenue,Expenses,Department,Region,Product Line,Expense Category,Client ID\n"
TX = HEADER + "".join(
    f"{2024 + i % 3}-{1 + i % 12:02d}-05,{i + 1}.00,1.00,{'Sales' if i % 2 else 'Ops'},{'NESW'[i % 4]},Widgets,Rent,C{i % 5}\n"
    for i in range(48)) + ",5.00,1.00,Sales,N,Widgets,Rent,C1\n"


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(TX)
    (tmp_path / "budgets.csv").write_text("Month,Department,Region,Budgeted Revenue,Budgeted Expenses\n")
    root = scratch_path(spark, "test-commits")
    jobs.init_load(spark, root, files.read_transactions(spark, str(tmp_path / "tx.csv")),
                   files.read_budgets(spark, str(tmp_path / "budgets.csv")), files.read_invoices(spark, None),
                   submitted_at="2025-01-01 00:00:00")
    return root


def upload(tmp_path, name, n, product):
    text = HEADER + "".join(f"2024-05-{1 + i:02d},{i + 1}.00,1.00,Sales,N,{product},Rent,C1\n" for i in range(n))
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_two_writers(spark, store, tmp_path):
    """Uploads applied at once: ids are disjoint and without gaps, no row, name or log entry is lost."""
    paths = [upload(tmp_path, f"u{i}.csv", i + 1, f"P{i}") for i in range(4)]
    done, failed = [], []

    def run(path):
        try:
            done.append(jobs.ingest_file(spark, path, store, as_of="2025-12-31", submitted_at="2025-12-31 00:00:00"))
        except Exception as exc:  # noqa: BLE001 - shown by the assertion
            failed.append(exc)

    threads = [threading.Thread(target=run, args=(p,)) for p in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and all(r["status"] == "Accepted" for r in done)
    ids = sorted(r[0] for r in tables.read_table(spark, store, "fact_transactions").select("transaction_id").collect())
    assert ids == list(range(1, 49 + 1 + 10))
    log = tables.read_table(spark, store, "ingestion_log").collect()
    assert sorted(r["batch_id"] for r in log) == [1, 2, 3, 4, 5]
    assert {r["batch_id"] for r in done} == {2, 3, 4, 5}
    products = tables.read_table(spark, store, "dim_products").collect()
    assert sorted(r["product_id"] for r in products) == [1, 2, 3, 4, 5]
    assert {r["product_name"] for r in products} == {"Widgets", "P0", "P1", "P2", "P3"}
    fact = tables.read_table(spark, store, "fact_transactions").where("transaction_id > 49")
    per_product = {r["product_id"]: r["count"] for r in fact.groupBy("product_id").count().collect()}
    assert {r["product_name"]: per_product.get(r["product_id"]) for r in products} == {
        "Widgets": None, "P0": 1, "P1": 2, "P2": 3, "P3": 4}


def test_a_number_is_claimed_once(spark, store):
    base = tables.head(spark, store)
    tables.commit(spark, store, base, next_log_id=7)
    with pytest.raises(tables.CommitConflict):
        tables.commit(spark, store, base, next_log_id=9)
    assert tables.head(spark, store).next_log_id == 7


def test_readers_see_all_or_nothing(spark, store, tmp_path, monkeypatch):
    """At every step of a run the newest commit is whole: the old one until the new one stands."""
    before = {n: sorted(map(str, tables.read_table(spark, store, n).collect())) for n in (*tables.STAR_TABLES, tables.LOG)}
    seen = []

    def watch(f):
        def run(*args, **kwargs):
            out = f(*args, **kwargs)
            seen.append({n: sorted(map(str, tables.read_table(spark, store, n).collect())) for n in before})
            return out
        return run

    for name in ("write_folder", "write_segment", "write_issues", "write_log"):
        monkeypatch.setattr(tables, name, watch(getattr(tables, name)))
    old = tables.read_star(spark, store)
    jobs.ingest_file(spark, upload(tmp_path, "u.csv", 3, "New"), store, as_of="2025-12-31", submitted_at="2025-12-31 00:00:00")
    assert len(seen) >= 4 and all(s == before for s in seen)
    assert tables.read_table(spark, store, "fact_transactions").count() == 52
    assert tables.read_table(spark, store, "dim_products").count() == 2
    assert old.fact_transactions.count() == 49 and old.dim_products.count() == 1  # plans made before keep their commit


def test_a_new_initial_load_replaces(spark, store, tmp_path):
    jobs.ingest_file(spark, upload(tmp_path, "u.csv", 3, "New"), store, as_of="2025-12-31", submitted_at="2025-12-31 00:00:00")
    (tmp_path / "empty.csv").write_text(HEADER)
    (tmp_path / "b.csv").write_text("Month,Department,Region,Budgeted Revenue,Budgeted Expenses\n")
    star = jobs.init_load(spark, store, files.read_transactions(spark, str(tmp_path / "empty.csv")),
                          files.read_budgets(spark, str(tmp_path / "b.csv")), files.read_invoices(spark, None))
    assert star.fact_transactions.count() == 0 and star.dim_products.count() == 0
    assert tables.read_table(spark, store, tables.LOG).count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slicers_prune_partitions_and_push_ids(spark, store):
    star = tables.read_star(spark, store)
    dims = {k: v for k, v in star.tables().items() if k.startswith("dim_")}
    got = bi.measures(star.fact_transactions, dims, by=["department"],
                      slicers={"region": ["N", "nowhere"], "year": [2024], "quarter": [1, 2], "month": ["2024-01", "2024-05"]})
    text = plan(got)
    assert "PartitionFilters" in text
    filters = text.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "period" in filters
    pushed = text.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "region_id" in pushed
    fact = star.fact_transactions.join(star.dim_regions, "region_id").where(
        "region_name = 'N' and date_format(date, 'yyyy-MM') in ('2024-01', '2024-05')")
    want = fact.join(star.dim_departments, "dept_id").groupBy("dept_name").sum("revenue").collect()
    assert want and {r["department"]: r["total_revenue"] for r in got.collect()} == {r[0]: float(r[1]) for r in want}
    read = star.fact_transactions.where(tables.in_months("2024-01", "2024-12"))
    assert len(read.inputFiles()) >= 1 and "period" in plan(read).split("PartitionFilters:")[1].split("PushedFilters")[0]
    none = bi.measures(star.fact_transactions, dims, by=["department"], slicers={"region": ["nowhere"]})
    assert none.count() == 0
    # rows without a date are in no month, and stay in the whole
    assert star.fact_transactions.where("period is null").count() == 1
