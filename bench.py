"""Benchmark: run the query library on one scale factor, print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

The one-time loads are timed first, as their own entries (and counted in
the total): ``load_star`` (initial load: raw joins, dimensions, ids, the
star written as Parquet -- always rebuilt here, never reused from an
earlier run) and ``load_uploads`` (upload rows numbered, cleaned, audited
and written).  Each query is then executed to completion with the ``noop``
sink (the whole plan runs, nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans.catalog import queries  # noqa: E402
from ledgerline.plans.context import Finance  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus=cpus)
    qs = queries()
    names = argv or list(qs)
    times: dict[str, float] = {}
    t_all = time.time()
    fin = Finance.of(spark, sf_dir)
    for name, load in (("load_star", lambda: fin.star),
                       ("load_uploads", lambda: (fin.upload_issues, fin.upload_verdicts))):
        t0 = time.time()
        load()
        times[name] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    wall = round(time.time() - t_all, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "query_library_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "wall_sec": wall,
        "n_queries": len(times),
        "spark": spark.version,
        "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
