import math
import random

import numpy as np

from ledgerline.llm import topk_search
from pyspark.sql import functions as F


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out[i] = [(j, -s_) for s_, j in s]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_ties_nulls_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20)]) for i in range(600)]
    rows += [(600 + i, rows[i % 3][1]) for i in range(60)]  # equal vectors, tied scores
    rows += [(700, None), (750, [1.0, None] + [0.5] * 18), (800, [float("nan")] * 20), (850, [float("inf")] * 20),
             (None, [0.1] * 20), (900, [0.5] * 7), (901, [0.25] * 7), (950, []), (951, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("id", "v", "q", "score", "rank", "block", "width")})
    for block, step in ((2048, 512), (50, 16)):
        monkeypatch.setattr(topk_search, "BLOCK", block)
        monkeypatch.setattr(topk_search, "STEP", step)
        want = {q: s for q, s in brute(rows).items() if s}
        assert result(topk_search.top_k(df, F.col("vec_id") % 50 == 0)) == want
    none = df.limit(0)
    assert topk_search.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-300, 300, (40, 33)).astype("f8"), rng.integers(-300, 300, (50, 33)).astype("f8")
    last = np.full((40, 50), np.inf)
    for s in (1, 2, 4, 8, 16):
        bound = topk_search.statistics(q, s) @ topk_search.statistics(c, s).T
        assert (bound >= q @ c.T - 1e-6).all()
        assert (bound <= last + 1e-6).all() or s > 1
        last = bound


def test_large_components_are_exact():
    q = np.array([[2 ** 30, 2 ** 30 + 1, 3]])
    c = np.array([[2 ** 30, 2 ** 30, 1], [2 ** 30, 2 ** 30, 2], [1, 1, 1]])
    got = list(topk_search.best_of_block(np.array([9]), q, np.array([1, 2, 3]), c, 2))
    assert got == [(9, 2, int(2 ** 60 + (2 ** 30 + 1) * 2 ** 30 + 6)), (9, 1, int(2 ** 60 + (2 ** 30 + 1) * 2 ** 30 + 3))]


def test_query_against_brute_force(spark, sf_dir):
    from ledgerline.llm import catalog

    rows = [(r.vec_id, r.embedding) for r in catalog.table(spark, sf_dir, "embeddings").collect()]
    assert result(catalog.op7_topk_search(spark, sf_dir)) == brute(rows)
