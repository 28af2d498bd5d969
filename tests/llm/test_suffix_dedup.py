import hashlib
import random
from collections import Counter

from ledgerline.llm import catalog, suffix_dedup


def brute(texts, size=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in df.collect())


def wanted(rows):
    return sorted((i if i is not None else -1, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def planted(rng):
    alphabet = "abcdefghij é"

    def prose(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    passages = [prose(n) for n in (120, 185, 199, 200, 201, 215, 230, 400, 900)]
    rows = []
    for i in range(160):
        t = prose(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)  # some of the passage only, so ends differ
            t += p[a:len(p) - rng.randint(0, 20)] + prose(rng.randint(0, 300))
        rows.append((i, t))
    base = prose(3000)
    for _ in range(25):  # near copies
        c = list(base)
        for _ in range(rng.randint(0, 8)):
            c[rng.randrange(len(c))] = rng.choice("XYZ")
        rows.append((len(rows), "".join(c)))
    return rows + [(len(rows), "ab" * 900), (len(rows) + 1, "na " * 120 + prose(50)), (len(rows) + 2, "x" * 201)]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = planted(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = wanted(rows)
    assert result(suffix_dedup.remove_repeats(docs)) == want
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 0)
    assert result(suffix_dedup.remove_repeats(docs, keep_text=False)) == want


def test_texts_in_parts(monkeypatch):
    rng = random.Random(8)
    data = "".join(rng.choice("abcd") for _ in range(5000)).encode()
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    suffix_dedup._tables.cache_clear()
    parts = suffix_dedup.anchors(data)
    suffix_dedup._tables.cache_clear()

    def named(found):
        return {s: (k, a) for k, _, a, far, near in zip(*found) for s in range(a - far, a - near + 1)}

    assert named(whole) == named(parts) and len(named(whole)) == 4801


def test_edges(spark, edge_docs, edge_rows, no_docs):
    assert result(suffix_dedup.remove_repeats(edge_docs)) == wanted([(r[0], r[1]) for r in edge_rows])
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    assert result(catalog.op8_suffix_dedup(spark, sf_dir)) == wanted(rows)
