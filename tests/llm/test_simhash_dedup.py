import random
import re

import pytest
import xxhash
from ledgerline.llm import simhash_dedup
from pyspark.sql import functions as F


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Fingerprint -> all that can be reached from it."""
    left, out = set(prints), {}
    while left:
        reached = [left.pop()]
        for f in reached:
            near = {g for g in left if (f ^ g).bit_count() <= 2}
            left -= near
            reached += near
        out.update(dict.fromkeys(reached, reached))
    return out


def check(got, rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    first = {}
    for d, f in prints:
        first[f] = min((x for x in (d, first.get(f)) if x is not None), default=None)
    reached = plain_components(first)
    want = [(d, f"{f:016x}", min((first[g] for g in reached[f] if first[g] is not None), default=None)) for d, f in prints]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def result(df):
    return [tuple(r) for r in df.select("doc_id", simhash_dedup.hexadecimal(F.col("fp")), "component_id").collect()]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    check(result(simhash_dedup.near_duplicates(edge_docs.withColumns({c: F.lit("clash") for c in ("fp", "key", "n")}))),
          [r[:2] for r in edge_rows])
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    kept = simhash_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns and 0 < kept.count() < edge_docs.count()


@pytest.mark.parametrize("crowd", [simhash_dedup.CROWD, 2, 1 << 20])
def test_links_of_dense_balls(spark, monkeypatch, crowd):
    """Balls of fingerprints whose variants are crowded, chains, and others at random."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    rng = random.Random(3)
    prints = {0, 2 ** 64 - 1, 1, 2 ** 63, 2 ** 63 + 2 ** 31 + 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        places = rng.sample(range(64), 12)
        for _ in range(120):
            prints.add(centre ^ sum(1 << p for p in rng.sample(places, rng.randint(0, 5))))
    for _ in range(20):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints.add(f := f ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4))))
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in prints], "fp long").repartition(4)
    found = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash_dedup.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    near = {f: {f} for f in prints}
    for a, b in found:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for f in near[b]:
                near[f] = near[a]
    want = plain_components(prints)
    assert all(near[f] == set(want[f]) for f in prints)


def test_query_against_brute_force(spark, sf_dir):
    from ledgerline.llm import catalog

    rows = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    check([(r.doc_id, r.fingerprint, r.component_id) for r in catalog.op13_simhash_dedup(spark, sf_dir).collect()], rows)


def test_long_text():
    rng = random.Random(5)
    text = " ".join(rng.choice(["Ab", "cd", "É", "x\x1fy"]) for _ in range(70_000))
    assert simhash_dedup.fingerprint(text.encode()) == plain_fingerprint(text)
