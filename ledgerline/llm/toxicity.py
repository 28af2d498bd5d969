"""Toxicity by compression distance.

Two zstandard dictionaries share one trained on ordinary text; one goes on with
single words that toxic documents repeat and ordinary ones hardly hold, the other
with as many zero bytes.  No dictionary is trained on toxic text as a whole, so
toxic phrases of words that are ordinary by themselves are not seen.  Two
dictionaries trained on windows of either class, the plain form of the method,
find next to nothing: what toxic documents repeat is mostly ordinary text
(figures in the README).  A window that is toxic comes out shorter with the first
than with the second.  A document's windows give three numbers (windows whose gain
reaches a threshold, their share, the largest gain), which a logistic
curve, fitted on documents that the dictionaries have not seen, turns into a
probability.

Learning takes whole documents of a bounded sample: at most about
``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` bytes of each class, picked by a
hash of the id.  Every document is scored over its whole text.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, narrow, texts

SAMPLE_DOCS = 1500
SAMPLE_BYTES = 12 << 20
WINDOW, STRIDE = 64, 32
ORDINARY_BYTES = 110 << 10
TOXIC_BYTES = 8 << 10
#: A score from here on predicts label 1.
CUT = 0.7
#: Gains, in bytes, that the threshold is chosen from.
GAINS = (2, 3, 4, 5, 6)


def windows(data: bytes, size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """Overlapping windows over all of ``data``."""
    return [data[i:i + size] for i in range(0, max(1, len(data) - size + stride), stride)]


def _compressor(dictionary: bytes):
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=_PARAMS)
    return zstandard.ZstdCompressor(compression_params=_PARAMS, dict_data=own).compress


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary from ``samples``; those end to end where they are too few to train on."""
    joined = b"".join(samples)
    if len(joined) > size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return joined[-size:]


#: Matches from four bytes on, searched thoroughly: a window holds few.
_PARAMS = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_LAZY2, window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=4,
    write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    gain: int = GAINS[0]
    weights: tuple[float, ...] = (-6.0, 0.0, 0.0, 0.0)

    def gains(self, data: bytes) -> np.ndarray:
        a, b = _pair(self.toxic, self.ordinary)
        return np.array([len(b(w)) - len(a(w)) for w in windows(data)])

    def features(self, gains: np.ndarray, least: int) -> list[float]:
        n = int((gains >= least).sum())
        return [1.0, np.log1p(n), np.log1p(100 * n / len(gains)), max(0, int(gains.max())) / 4]

    def score(self, text: str) -> float:
        x = np.dot(self.weights, self.features(self.gains(text.lower().encode()), self.gain))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


@functools.lru_cache(2)
def _pair(toxic: bytes, ordinary: bytes):
    return _compressor(toxic), _compressor(ordinary)


def _residual(docs: list[bytes], compress) -> list[set[bytes]]:
    """For each document, the words that the ordinary dictionary saves nothing on."""
    empty, saves = len(compress(b"")), {}
    out = []
    for d in docs:
        own = {b" " + w + b" " for w in d.replace(b",", b" ").replace(b".", b" ").split() if 3 < len(w) < 40}
        for w in own:
            if w not in saves:
                saves[w] = len(w) - 1 > len(compress(w)) - empty
        out.append({w for w in own if not saves[w]})
    return out


def _distinct(docs: list[set[bytes]]) -> list[set[bytes]]:
    """Without the documents that share one of four minimum hashes with an earlier one: copies count once."""
    known, out = set(), []
    for d in docs:
        own = {(k, min(zlib.crc32(w, k) for w in d)) for k in range(4)} if d else set()
        if not own & known:
            out.append(d)
        known |= own
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps; the first column, of ones, is not penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (weight * (y - p)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from texts of both classes; ``share`` is the share of label 1 among the labelled rows.

    Without texts of one of the classes every score is that share.
    """
    bad, good = ([t.lower().encode() for t in x] for x in (toxic, ordinary))
    if not bad or not good:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(b"", b"", weights=(float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    part = [[d for i, d in enumerate(x) if len(x) < 12 or i % 3] for x in (bad, good)]
    rest = [[d for i, d in enumerate(x) if len(x) < 12 or i % 3 == 0] for x in (bad, good)]
    common = _trained(ORDINARY_BYTES, [w for d in part[1] for w in windows(d, 256, 256)])
    compress = _compressor(common)
    seen = [_distinct(_residual(x, compress)) for x in part]
    in_bad, in_good = (Counter(w for d in x for w in d) for x in seen)
    # what repeats over toxic documents, and hardly stands in ordinary ones
    often = max(2, min(4, len(part[0]) // 50))
    kept = {w for w, n in in_bad.items() if n >= often
            and in_good[w] / len(seen[1]) < 0.03 * n / len(seen[0])}
    # the trainer picks what repeats; what it leaves out of the rest follows, the most frequent last
    lines = [b"".join(sorted(d & kept)) for d in seen[0] if d & kept]
    words = sorted(kept, key=lambda w: (in_bad[w], w))
    extra = (b"".join(words) if sum(map(len, words)) <= TOXIC_BYTES else _trained(TOXIC_BYTES, lines))
    other = bytes(len(extra))  # of the same size, and matches no text
    model = Model(common + extra, common + other)  # what both share lies at the same distances

    labels = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    weight = np.where(labels == 1, share / len(rest[0]), (1 - share) / len(rest[1])) * len(labels)
    gains = [model.gains(d) for x in rest for d in x]
    best = None
    for g in GAINS:
        x = np.array([model.features(s, g) for s in gains])
        w = logistic(x, labels, weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()
        if best is None or loss < best[0]:
            best = loss, g, w
    model.gain, model.weights = best[1], tuple(best[2])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents that are not held out.

    Null labels and ids teach nothing; an id with both labels counts as label 1.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    rows = narrow(docs, id_col, text_col)
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id")  # no text is shuffled
    totals = {r.toxic: r for r in sizes.groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    share = {k: min(1.0, sample_docs / r.n, sample_bytes / max(1, r.size)) for k, r in totals.items()}
    if not share:
        return fit([], [], 0.0)
    place = (F.xxhash64("doc_id") / F.lit(2.0 ** 64)) + 0.5
    picked = F.lit(False)
    for k, s in share.items():
        picked = picked | ((F.col("toxic") == k) & (place <= s))
    # ids, and then texts, bounded by the sample's documents and bytes
    chosen = F.broadcast(sizes.where(picked).select("doc_id", "toxic").distinct())
    sample = sorted(rows.join(chosen, "doc_id").select("toxic", "doc_id", "text").collect())
    n = {k: totals[k].n if k in totals else 0 for k in (0, 1)}
    return fit(*([r.text for r in sample if r.toxic == k] for k in (1, 0)), n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row; null and empty texts score as one empty window."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for part, values in texts(batches):
            s = np.array([own.score(t) for t in values])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= CUT).astype("i4"))],
                names=["doc_id", "held_out", "score", "predicted"])

    return narrow(docs, id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
