import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from ledgerline.llm import lexical_search
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """{item_id: [(doc_id, score)]} by every document's score."""
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = {}
    for item, text in items:
        scores = []
        for d, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out[item] = [(d, -s) for s, _, d in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return {i: x for i, x in out.items() if x}


def result(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("sizes", [None, (7, 300, 3, 20, 2)])
def test_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch, sizes):
    """All rows as documents and items; small shards, windows and blocks give the same."""
    if sizes:
        for name, size in zip(("SHARD_DOCS", "SHARD_TERMS", "WINDOW", "BLOCK_PAIRS", "KEPT"), sizes):
            monkeypatch.setattr(lexical_search, name, size)
    items = [(0, "House river"), (1, None), (2, ""), (3, "nothing-of-the-kind"), (4, edge_rows[0][1]), (4, edge_rows[0][1]),
             (5, "ΣΑΣ 中文 😀 it's na na NA 12"), (None, "cold stone"), (7, edge_rows[46][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("doc_id", "term", "block", "score", "rank", "text_hash", "shard")})
    clash = edge_docs.withColumns({c: F.lit("clash") for c in ("term", "block", "rank", "shard", "item_id", "df")})
    rows = [r[:2] for r in edge_rows]
    got = lexical_search.top_documents(lexical_search.index(clash), asked, k=10)
    assert result(got) == brute(rows, items, 10)
    assert lexical_search.top_documents(lexical_search.index(no_docs), asked).count() == 0
    assert lexical_search.top_documents(lexical_search.index(clash), asked.limit(0)).count() == 0


def test_texts_under_one_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c")], "item_id long, text string")
    got = lexical_search.top_documents(lexical_search.index(docs), items)
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(1, 1), (1, 2)]


def test_skipping_is_exact():
    """One shard after the other, against the plain sums; lists of all lengths."""
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 80)))) for i in range(3000)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 40)))) for i in range(60)]
    want = brute(docs, items, 5)
    found = [(d, plain_terms(t)) for d, t in docs]
    n_terms, df = sum(len(t) for _, t in found), Counter(t for _, x in found for t in set(x))
    shards = []
    for a in range(0, 3000, 1000):
        names = lexical_search._Numbers()
        own = [np.array([names[t.encode()] for t in x]) for _, x in found[a:a + 1000]]
        row = lexical_search._shard(a, [d for d, _ in found[a:a + 1000]], own, names).to_pylist()[0]
        shards.append(lexical_search.Shard(row, 3000, n_terms))
    for item, text in items:
        best = lexical_search.Best(5)
        query = [(t.encode(), math.floor(1000 * math.log(6002 / (2 * df[t] + 1)))) for t in set(plain_terms(text)) if df[t]]
        for shard in shards:
            lexical_search.search(shard, query, best)
        assert list(zip(best.ids.tolist(), best.scores.tolist())) == want.get(item, [])
