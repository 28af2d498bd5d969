"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

The index is cut into shards of documents.  A shard holds its terms' posting
lists in document order; queries are dealt into blocks of bounded size, and a
pair of a shard and a block is a row of a join.  For a query, the shard's short
lists are summed into accumulators first, term by term.  The accumulators, in
document order and with their greatest sum as bound, then stand beside the long
lists as one more list, and windows of documents are gone through in order: a
window whose lists' bounds in it can't reach the query's best so far is skipped,
in others only the lists that can make a difference name candidates, and the
rest are probed for those that still may reach it, the list of the greatest
bound first.  A task carries a query's best from shard to shard.

Scores are integers.  A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, the
document's part ``1000000000 * tf // (1000 * tf + 20 * m)`` with ``m = 50 + 50 * n * N // L``,
where N documents hold L terms and this one n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow, row_hash

K = 50
#: Most documents of a shard, and the terms (with repeats) that close it.
SHARD_DOCS = 4096
SHARD_TERMS = 1 << 19
#: Documents in a window.
WINDOW = 256
#: A list is short with at most this share of a shard's documents.
SHORT = 1 / 16
#: Pairs of a query and a term in a block, and queries whose best a task keeps before it hands them on.
BLOCK_PAIRS = 1 << 17
KEPT = 50_000

#: Bytes between terms to spaces, A-Z to lower case, the rest as it is.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
_LAST = 2 ** 63 - 1

_INDEX = ("shard long, n_docs long, n_terms long, doc_ids binary, sizes binary, terms binary, counts binary, "
          "docs binary, tfs binary")


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _shard(number: int, ids: list[int], found: list[np.ndarray], names: _Numbers) -> pa.RecordBatch:
    order = np.argsort(np.array(ids, "i8"), kind="stable")
    sizes = np.array([len(found[i]) for i in order], "<i8")
    places = np.repeat(np.arange(len(order)), sizes)
    pairs, tfs = np.unique(np.concatenate([found[i] for i in order]) * len(order) + places, return_counts=True)
    counts = np.bincount(pairs // len(order), minlength=len(names))
    values = (number, len(order), int(sizes.sum()), np.array(ids, "<i8")[order].tobytes(), sizes.tobytes(), b"\n".join(names),
              counts.astype("<u4").tobytes(), (pairs % len(order)).astype("<u2").tobytes(), tfs.astype("<u4").tobytes())
    fields = [f.strip().split() for f in _INDEX.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.binary() if t == "binary" else pa.int64()) for v, (_, t) in zip(values, fields)],
        names=[n for n, _ in fields])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, found, names, total = [], [], _Numbers(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                ids.append(_LAST if doc_id is None else doc_id)
                found.append(np.fromiter(map(names.__getitem__, words), "i8", len(words)))
                total += len(words)
                if len(ids) == SHARD_DOCS or total >= SHARD_TERMS:
                    yield _shard(number, ids, found, names)
                    number, ids, found, names, total = number + 1, [], [], _Numbers(), 0
    if ids:
        yield _shard(number, ids, found, names)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of ``docs``, stored; documents without a term are in none."""
    return materialize(narrow(docs, id_col, text_col).mapInArrow(_indexed, _INDEX), "lexical_index")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(names.split(b"\n"), pa.binary()),
                                              pa.array(np.frombuffer(counts, "<u4").astype("i8"))], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            own = sorted(set(terms((part.column("text")[0].as_py() or "").encode())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(c)[0].as_py()] * len(own), pa.int64()) for c in ("item_id", "text_hash")]
                + [pa.array(own, pa.binary())], names=["item_id", "text_hash", "term"])


_BLOCKS = "block int, queries array<struct<item_id:long,text_hash:long>>, ends binary, terms binary, weights binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their pairs as flat lists, a query's terms together."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = sorted(row["pairs"], key=lambda p: (p["item_id"] is None, p["item_id"] or 0, p["text_hash"], p["term"]))
            queries, ends = [], []
            for i, p in enumerate(pairs):
                query = {"item_id": p["item_id"], "text_hash": p["text_hash"]}
                if not queries or query != queries[-1]:
                    queries.append(query)
                    ends.append(i)
                ends[-1] = i + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int32()),
                 pa.array([queries], pa.list_(pa.struct([("item_id", pa.int64()), ("text_hash", pa.int64())]))),
                 pa.array([np.array(ends, "<i4").tobytes()]), pa.array([b"\n".join(p["term"] for p in pairs)], pa.binary()),
                 pa.array([np.array([p["w"] for p in pairs], "<i8").tobytes()])],
                names=["block", "queries", "ends", "terms", "weights"])


class Shard:
    """Posting lists of a shard; what is computed for a list is kept for the next query."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.m = 50 + 50 * sizes * n_docs // n_terms
        self.number = {t: i for i, t in enumerate(row["terms"].split(b"\n"))}
        self.ends = np.cumsum(np.frombuffer(row["counts"], "<u4"), dtype="i8")
        self.docs, self.tfs = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["tfs"], "<u4")
        self.windows = np.arange(0, len(self.doc_ids), WINDOW)
        self.known: dict[int, tuple] = {}

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, their parts of the score, where each window starts, and the greatest part in each window."""
        if i not in self.known:
            own = slice(self.ends[i - 1] if i else 0, self.ends[i])
            docs, tf = self.docs[own].astype("i8"), self.tfs[own].astype("i8")
            parts = 1_000_000_000 * tf // (1000 * tf + 20 * self.m[docs])
            self.known[i] = docs, parts, *self.bounds(docs, parts)
        return self.known[i]

    def bounds(self, docs: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.searchsorted(docs, np.append(self.windows, len(self.doc_ids)))
        most = np.zeros(len(self.windows), "i8")
        full = np.flatnonzero(starts[1:] > starts[:-1])
        if len(full):
            most[full] = np.maximum.reduceat(parts, starts[full])
        return starts, most


class Best:
    """A query's k best (score, doc_id) so far, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, "i8"), np.zeros(0, "i8")

    @property
    def least(self) -> int:
        """What a document must reach; only documents with a score above 0 count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[top], ids[top]


def search(shard: Shard, query: list[tuple[bytes, int]], best: Best) -> None:
    """Bring ``best`` up to date with the shard's documents."""
    lists = [(w, *shard.postings(shard.number[t])) for t, w in query if w and t in shard.number]
    short = [x for x in lists if len(x[1]) <= SHORT * len(shard.doc_ids)]
    iterators = [(docs, w * parts, starts, w * most) for w, docs, parts, starts, most in lists
                 if len(docs) > SHORT * len(shard.doc_ids)]
    if short:  # term at a time
        sums = np.zeros(len(shard.doc_ids), "i8")
        for w, docs, parts, _, _ in short:
            sums[docs] += w * parts  # a list names a document once
        docs = np.flatnonzero(sums)
        iterators.append((docs, sums[docs], *shard.bounds(docs, sums[docs])))
    if not iterators:
        return
    bounds = np.stack([x[3] for x in iterators])  # of each list in each window
    reach = bounds.sum(axis=0)
    for at in np.flatnonzero(reach >= best.least):
        least = best.least
        if reach[at] < least:  # risen since
            continue
        order = np.argsort(bounds[:, at], kind="stable")
        below = np.cumsum(bounds[order, at])  # what the lists up to each can add together
        first = int(np.searchsorted(below, least))  # lists before it can't reach the best by themselves
        scores = np.zeros(WINDOW, "i8")
        for i in order[first:]:
            docs, parts, starts, _ = iterators[i]
            own = slice(starts[at], starts[at + 1])
            scores[docs[own] - shard.windows[at]] += parts[own]
        alive = np.flatnonzero(scores)
        for p in range(first - 1, -1, -1):
            alive = alive[scores[alive] + below[p] >= least]
            if not len(alive):
                break
            docs, parts, starts, _ = iterators[order[p]]
            own = slice(starts[at], starts[at + 1])
            if own.start == own.stop:
                continue
            wanted = alive + shard.windows[at]
            place = np.minimum(np.searchsorted(docs[own], wanted), own.stop - own.start - 1)
            hit = docs[own][place] == wanted
            scores[alive[hit]] += parts[own][place[hit]]
        alive = alive[scores[alive] >= least]
        if len(alive):
            best.add(scores[alive], shard.doc_ids[alive + shard.windows[at]])


def _searched(n_docs: int, n_terms: int, k: int):
    def out(kept: dict) -> Iterator[pa.RecordBatch]:
        for (item_id, text_hash), best in kept.items():
            if len(best.ids):
                n = len(best.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_id] * n, pa.int64()), pa.array([text_hash] * n, pa.int64()),
                     pa.array(best.ids), pa.array(best.scores)], names=["item_id", "text_hash", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, Best] = {}
        number, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if number != row["shard"]:
                    number, shard = row["shard"], Shard(row, n_docs, n_terms)
                names, weights = row["q_terms"].split(b"\n"), np.frombuffer(row["q_weights"], "<i8").tolist()
                start = 0
                for query, end in zip(row["q_queries"], np.frombuffer(row["q_ends"], "<i4").tolist()):
                    best = kept.setdefault((query["item_id"], query["text_hash"]), Best(k))
                    search(shard, list(zip(names[start:end], weights[start:end])), best)
                    start = end
                if len(kept) > KEPT:
                    yield from out(kept)
                    kept = {}
        yield from out(kept)

    return run


def top_documents(shards: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  k: int = K) -> DataFrame:
    """item_id, text_hash, rank (from 1), doc_id, score: the k best documents of ``index(...)`` for each item.

    Documents score above 0; equal scores come by ascending doc_id, null ids
    last.  Items without a term the index holds have no rows.  Items that repeat
    an id and a text are one; other texts under the same id are ranked apart,
    told by ``text_hash``.  Rows that repeat a doc_id are documents each.
    """
    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    queries = narrow(items, id_col, text_col, row_hash(text_col).alias("text_hash")).withColumnRenamed("doc_id", "item_id")
    pairs = materialize(queries.dropDuplicates(["item_id", "text_hash"]).mapInArrow(
        _query_terms, "item_id long, text_hash long, term binary"), "query_terms")
    wanted = pairs.select("term").distinct()
    df = (shards.select("terms", "counts").mapInArrow(_frequencies, "term binary, df long")
          .join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighed = materialize(pairs.join(df, "term").select("item_id", "text_hash", "term", weight.alias("w")), "weights")
    n = max(1, -(-weighed.count() // BLOCK_PAIRS))
    blocks = materialize(
        weighed.withColumn("block", F.pmod(F.xxhash64("item_id", "text_hash"), F.lit(n)).cast("int"))
        .groupBy("block").agg(F.collect_list(F.struct("item_id", "text_hash", "term", "w")).alias("pairs"))
        .mapInArrow(_packed, _BLOCKS), "query_blocks")
    # the blocks, small, go to the shards, and a shard is read once for all of them
    each = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    asked = each.join(blocks, "block").select(
        "shard", *[F.col(c).alias(f"q_{c}") for c in ("queries", "ends", "terms", "weights")])
    found = (shards.drop("n_docs", "n_terms").join(asked, "shard").sortWithinPartitions("shard")
             .mapInArrow(_searched(n_docs, n_terms, k), "item_id long, text_hash long, doc_id long, score long"))
    order = Window.partitionBy("item_id", "text_hash").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "text_hash", "rank", F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "score"))
