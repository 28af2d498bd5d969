import math

import numpy as np
import pytest
from ledgerline.llm import whitening
from pyspark.sql import functions as F


def brute(rows, k=16):
    """{row number: (id, deviation, whitened)}, values, trace, n by a dense eigensolver, for vectors of one length."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = (np.array(fit, dtype=object) * n - np.array(s, dtype=object)).astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    good = e > 1e-12 * e[0]
    e, u = e[good], u[:, good]
    out = [(i, sum((n * x - t) ** 2 for x, t in zip(v, s)),
            (np.array([(n * x - t) / n for x, t in zip(v, s)]) @ u) / np.sqrt(e)) for i, v in kept]
    return out, e, np.trace(cov), n


def check(df, rows, tolerance=1e-7):
    out, e, trace, n = brute(rows)
    got = {}
    for r in df.collect():
        assert r.n == n and r.identity_error < 1e-8
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-10 * r.explained + 1e-14
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for i, deviation, w in out:
        mine = got[i, deviation]
        assert sorted(mine) == list(range(1, len(e) + 1))
        own = np.array([mine[c][0] for c in sorted(mine)])
        signs = np.ones(len(e)) if signs is None else signs
        for c in range(len(e)):
            if abs(w[c]) > 1e-3 and signs[c] == 1 and own[c] * w[c] < 0:
                signs[c] = -1
        assert np.abs(own * signs - w).max() < tolerance
    assert sum(len(x) for m in got.values() for x in m.values()) == len(out) * len(e)


def test_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 500)] + [rows[3]] * 3  # vectors and whole rows that repeat
    rows += [(600, None), (601, [1.0, None] + [0.5] * 10), (602, [float("nan")] * 12), (603, [float("-inf")] * 12),
             (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns(
        {c: F.lit("clash") for c in ("id", "x", "v", "width", "component", "n", "whitened", "r")})
    check(whitening.whiten(df), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 5")).count() == 0  # no spread
    few = df.where("vec_id < 6")
    counts = {r.vec_id: r["count"] for r in whitening.whiten(few).groupBy("vec_id").count().collect()}
    assert counts == {0: 5, 1: 5, 2: 5, 3: 20, 4: 5, 5: 5}  # 6 vectors span 5 dimensions; one row stands there 4 times


def test_lengths_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(50)] + [(i, rng.normal(size=5).tolist()) for i in range(50, 120)]
    rows += [(200, []), (201, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df)
    check(got.where("vec_id < 50"), rows[:50])
    check(got.where("vec_id between 50 and 119"), rows[50:120])
    assert got.where("vec_id >= 200").count() == 0


def test_blocks_and_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * [1, 1, 5, 9, 0.1, 3, 3, 3]).tolist()) for i in range(900)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)), rows)


def close(r, k):
    values, u = whitening.singular_directions(r, k)
    s = np.linalg.svd(r, compute_uv=False)
    want = s[s > whitening.ZERO * len(r) * s.max(initial=0)][:k] ** 2
    # making a matrix bidiagonal moves its values by the rounding of the largest
    assert len(values) == len(want) and np.allclose(np.sqrt(values), np.sqrt(want), rtol=1e-12, atol=1e-13 * s.max(initial=0))
    assert np.abs(u.T @ u - np.eye(len(values))).max(initial=0) < 1e-9
    # residuals, against the size of the matrix
    assert np.abs(r.T @ (r @ u) - u * values).max(initial=0) < 1e-11 * s.max(initial=0) ** 2 + 1e-300


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64, 130])
def test_singular_directions(d):
    rng = np.random.default_rng(d)
    close(np.triu(rng.normal(size=(d, d))), d)
    close(np.linalg.qr(rng.normal(size=(3 * d, d)) * np.logspace(0, -5, d), mode="r"), d)
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    close(np.linalg.qr(u * np.repeat([5.0, 3.0, 1.0], [d // 3, d // 3, d - 2 * (d // 3)]) @ u.T, mode="r"), d)  # clusters
    close(np.linalg.qr(u * (1 + 1e-9 * np.arange(d)) @ u.T, mode="r"), d)
    close(np.eye(d) * 7, d)
    close(np.diag(np.arange(d, dtype=float)), d)
    close(np.zeros((d, d)), d)
    low = np.linalg.qr(rng.normal(size=(d, max(d // 2, 1))) @ rng.normal(size=(max(d // 2, 1), d)), mode="r")
    close(low, max(d // 2, 1))


def test_query_against_brute_force(spark, sf_dir):
    from ledgerline.llm import catalog

    rows = [(r.vec_id, r.embedding) for r in catalog.table(spark, sf_dir, "embeddings").collect()]
    check(catalog.op12_whitening(spark, sf_dir), rows)
