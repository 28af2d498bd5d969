"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  One binary classifier for each bit, a
regularised least-squares fit on hashed byte n-grams, says on which side of
the bit's split of the languages a text lies.  The codeword whose weighted loss
against the classifiers' outputs is least names the language; the weights are
how often a classifier is right on a language's own texts, and outputs and
scores are calibrated on leave-one-out outputs.  A text whose two best codewords lie
close is flagged as ambiguous.

Learning takes a bounded sample (about ``SAMPLE`` documents of each language,
picked by a hash of the id); a document is a fixed-size vector by then.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, narrow, texts

#: Documents of each language to learn from, at most about so many.
SAMPLE = 400
#: Size of the hashed n-gram vector.
BUCKETS = 4096
#: No language: a text without a letter.
NONE = "und"
#: Scores under this are flagged.
AMBIGUOUS = 0.6
_RIDGE = 0.02
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Unit vector of the roots of hashed two- and three-byte counts of the lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode(), "u1").astype("u4")
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    n = np.bincount(((three * np.uint32(2654435761)) >> np.uint32(20)).astype("i4") % BUCKETS, minlength=BUCKETS)
    n += np.bincount(((two * np.uint32(2246822519)) >> np.uint32(20)).astype("i4") % BUCKETS, minlength=BUCKETS)
    v = np.sqrt(n.astype("f4"))
    return v / np.linalg.norm(v)


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages up to six, else random splits, far apart."""
    if n <= 6:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns).reshape(-1, n).T
    rng, best = np.random.default_rng(seed), None
    bits = 10 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i + 1:] != code[i]).sum(axis=1).min()) for i in range(n - 1))
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features and a constant, by bit
    trust: np.ndarray  # language by bit
    heat: float

    def distances(self, outputs: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row's outputs from each codeword."""
        loss = np.exp(-np.clip(outputs[:, None, :] * self.code, -4, 4))
        return (loss * self.trust).sum(axis=2)

    def predict(self, values: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is ambiguous, for each text."""
        out = [(NONE, 0.0, True)] * len(values)
        real = [i for i, t in enumerate(values) if has_letter(t)]
        if not real or not self.languages:
            return out
        x = np.stack([features(values[i]) for i in real])
        p = _shares(self.distances(x @ self.weights[:-1] + self.weights[-1]), self.heat)
        for i, row in zip(real, p):
            best = int(row.argmax())
            out[i] = self.languages[best], float(row[best]), bool(row[best] < AMBIGUOUS)
        return out


def _shares(distances: np.ndarray, heat: float) -> np.ndarray:
    e = np.exp(-heat * (distances - distances.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """A model from unit vectors and their languages; one language is always predicted, none gives ``und``."""
    names = sorted(set(languages))
    k = len(names)
    if k < 2:
        return Model(names, np.zeros((k, 0)), np.zeros((BUCKETS + 1, 0), "f4"), np.zeros((k, 0)), 1.0)
    y = np.array([names.index(c) for c in languages])
    code = codewords(k)
    rows = np.hstack([x, np.ones((len(x), 1), "f4")])
    target = code[y].astype("f4")
    inverse = np.linalg.inv(rows @ rows.T + _RIDGE * np.eye(len(x), dtype="f4"))
    dual = inverse @ target
    out = target - dual / np.diag(inverse)[:, None]  # of each text when it is left out
    trust = np.stack([(out[y == i] * target[y == i] > 0).mean(axis=0) + 1e-3 for i in range(k)])
    trust /= trust.sum(axis=1, keepdims=True)
    weights = (rows.T @ dual).astype("f4")
    model = Model(names, code, weights, trust, 1.0)
    d = model.distances(out)
    model.heat = max((2.0 ** h for h in range(-1, 9)), key=lambda h: np.log(
        np.maximum(_shares(d, h)[np.arange(len(y)), y], 1e-9)).sum())
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, values in texts(batches):
        use = [i for i, t in enumerate(values) if has_letter(t)]
        yield pa.RecordBatch.from_arrays(
            [part.column("lang").take(pa.array(use, pa.int64())),
             pa.array([features(values[i]).tobytes() for i in use], pa.binary())], names=["lang", "vector"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> Model:
    """A model from the texts and languages of the documents that are not held out; nulls teach nothing."""
    lang = F.col(lang_col).cast("string")
    rows = (narrow(docs, id_col, text_col, lang.alias("lang"), held_out(id_col).alias("held_out"))
            .where("lang is not null and not held_out"))
    totals = rows.groupBy("lang").count().collect()  # a row for each language
    place = (F.xxhash64("doc_id") / F.lit(2.0 ** 64)) + 0.5
    picked = F.lit(False)
    for r in totals:
        picked = picked | ((F.col("lang") == r["lang"]) & (place <= min(1.0, sample / r["count"])))
    found = sorted(rows.where(picked).select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect())
    x = np.frombuffer(b"".join(r.vector for r in found), "f4").reshape(-1, BUCKETS)
    return fit(x, [r.lang for r in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; ``und`` and 0 for null texts and those without a letter."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for part, values in texts(batches):
            lang, score, flag = zip(*own.predict(values))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score, pa.float64()),
                 pa.array(flag)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return narrow(docs, id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all columns: ``und`` goes, and scores under ``min_score``.

    A model that has learned no language drops only texts without a letter, whatever ``min_score``.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                if own.languages:
                    keep = [lang != NONE and score >= min_score for lang, score, _ in own.predict(values)]
                else:
                    keep = [has_letter(t) for t in values]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
