"""Exact top-k search by inner product with segment statistics of several resolutions.

A vector cut into segments has a mean and a deviation for each.  For a segment
of m components, ``m * mean_q * mean_x + m * dev_q * dev_x`` is no less than the
segment's part of the inner product (what deviates from the means obeys
Cauchy-Schwarz), so the sum over the segments bounds the score from above, and
the distance from below, the tighter the finer the segments.  Candidates are
bounded with one segment first, those that may still enter a query's best are
bounded with more, and the survivors' exact integer scores are computed.

Queries are dealt into blocks of bounded size by a hash of their ids, and
candidates into blocks within their partitions; each pair of blocks is a row
of a join on the block number.  A pair yields k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize

K = 5
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Queries, and candidates, in a block.
BLOCK = 2048
#: Candidates that are bounded at a time; the best so far sets what the next must reach.
STEP = 512
#: Segments of a vector, coarse to fine.
RESOLUTIONS = (1, 4, 16)

_BLOCKS = "ids binary, vectors binary, width int"


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one width as blocks of ids and rows."""
    waiting: dict[int, list] = {}

    def block(width: int) -> pa.RecordBatch:
        ids, rows = zip(*waiting.pop(width))
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate(rows).astype("<i8").tobytes()]),
             pa.array([width], pa.int32())], names=["ids", "vectors", "width"])

    for batch in batches:
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
            row = np.asarray(v.values, "i8")
            waiting.setdefault(len(row), []).append((i, row))
            if len(waiting[len(row)]) >= BLOCK:
                yield block(len(row))
    for width in list(waiting):
        yield block(width)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that two rows' product is the bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        part, m = x[:, a:b], np.sqrt(b - a)
        out += [part.mean(axis=1) * m, part.std(axis=1) * m]
    return np.stack(out, axis=1)


def best_of_block(q_ids, q, c_ids, c, k: int = K) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best candidates in the block, ties to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    if not q.shape[1]:
        q, c = np.zeros((len(q), 1), "i8"), np.zeros((len(c), 1), "i8")
    qf, cf = q.astype("f8"), c.astype("f8")
    # products of floats are exact up to 2**53; beyond that, integers
    exact = np.abs(qf).max() * np.abs(cf).max() * q.shape[1] < 2 ** 53
    levels = [(statistics(qf, s), statistics(cf, s)) for s in RESOLUTIONS]
    slack = 1e-6 * (1 + np.linalg.norm(qf, axis=1) * np.linalg.norm(cf, axis=1).max())
    score = np.full((len(q), k), np.iinfo("i8").min)
    who = np.full((len(q), k), np.iinfo("i8").max)
    for a in range(0, len(c), STEP):
        own, ids = slice(a, a + STEP), c_ids[a:a + STEP]
        must = score[:, -1] - slack  # a tie with a smaller id can only come from before
        alive = None
        for sq, sc in levels:
            if alive is None:
                alive = sq @ sc[own].T >= must[:, None]
            elif alive.mean() < 0.2:  # few pairs: one by one
                i, j = np.nonzero(alive)
                alive[i, j] = np.einsum("ij,ij->i", sq[i], sc[own][j]) >= must[i]
            else:
                alive &= sq @ sc[own].T >= must[:, None]
        alive &= q_ids[:, None] != ids[None, :]
        rows, cols = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
        if not len(rows):
            continue
        found = (qf[rows] @ cf[own][cols].T).astype("i8") if exact else q[rows] @ c[own][cols].T
        found = np.where(alive[np.ix_(rows, cols)], found, np.iinfo("i8").min)
        both = np.hstack([score[rows], found])
        names = np.hstack([who[rows], np.broadcast_to(ids[cols], found.shape)])
        names = np.where(both == np.iinfo("i8").min, np.iinfo("i8").max, names)
        top = np.lexsort((names, -both.astype("f8") if exact else ~both), axis=1)[:, :k]
        score[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
    for i, j in zip(*np.nonzero(who != np.iinfo("i8").max)):
        yield int(q_ids[i]), int(who[i, j]), int(score[i, j])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = (np.frombuffer(r[x], "<i8").reshape(-1, r["width"]) if r["width"] else np.zeros((len(r[y]) // 8, 0), "i8")
                        for x, y in (("q_vectors", "q_ids"), ("vectors", "ids")))
                found = list(best_of_block(np.frombuffer(r["q_ids"], "<i8"), q, np.frombuffer(r["ids"], "<i8"), c, k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)],
                                                     names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row that ``is_query``.

    Scores are inner products of the quantised vectors; ties go to the smaller
    id.  Rows with a null id, a null vector or a component that is null or not
    finite take no part, nor do vectors with each other whose lengths differ.
    A query with fewer than k candidates has fewer rows.  Rows that repeat an id are
    candidates each, but not for their own id.  |scale * x| must stay below 2**31.
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null"))
    rows = materialize(rows, "vectors")
    queries = rows.where("q")
    n = max(1, -(-queries.count() // BLOCK))
    queries = (queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
               .groupBy("block", F.size("v").alias("width"))  # about BLOCK rows each
               .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
               .select("block", "width", F.transform("rows", lambda r: r["id"]).alias("ids"),
                       F.flatten(F.transform("rows", lambda r: r["v"])).alias("vectors"))
               .mapInArrow(_flat, "block int, width int, q_ids binary, q_vectors binary"))
    queries = materialize(queries, "queries")
    blocks = rows.select("id", "v").mapInArrow(_matrices, _BLOCKS)
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = blocks.join(queries, ["block", "width"]).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("block"), part.column("width"),
                 *(pa.array([np.asarray(part.column(c)[0].values, "<i8").tobytes()], pa.binary())
                   for c in ("ids", "vectors"))], names=["block", "width", "q_ids", "q_vectors"])
