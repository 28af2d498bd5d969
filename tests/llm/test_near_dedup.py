import random

from pyspark.sql import functions as F

from ledgerline.llm import near_dedup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.5 else [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.randint(0, 4)
                b.insert(rng.randrange(len(b)), 2)
        want = plain_distance(a, b)
        for limit in (0, 1, 2, 3, 5, 20):
            got = near_dedup.edit_distance(a, b, limit)
            assert got == (want if want <= limit else None), (a, b, limit)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i:i + rng.randint(0, 1)] = rng.choice([["changed"], ["one", "more"], []])
    return out


def test_classes(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows, want = [], {}
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for c in range(rng.randint(1, 12)):
            i = len(rows)
            # links go to a bucket's first member, so any two copies must be similar
            rows.append((i, " ".join(edited(rng, base, len(base) // 50 if c else 0))))
            want[i] = want.get(i - c, i - c)
    for _ in range(60):  # share a long line, and are not similar
        i = len(rows)
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + line + " "
                     + " ".join(rng.choice(vocabulary) for _ in range(60))))
        want[i] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    kept = near_dedup.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_first_member_unlike_two_others(spark):
    """Two texts that only share a bucket whose first member is like neither."""
    words = {b"a": "p q r s t u v w", b"b": "k l m n o p q r s t", b"c": "k l m n o p q r s u"}
    met = spark.createDataFrame([(2, n, len(w.split())) for n, w in words.items()], "key long, node binary, n_words int")
    none = spark.createDataFrame([], "node binary, root binary")
    text = spark.createDataFrame(list(words.items()), "node binary, text string")
    bags = text.mapInArrow(near_dedup._bagged, "node binary, bag binary, total long")
    for closest in (True, False):
        pairs = near_dedup._between(near_dedup._blocks(met, none, bags), 0.8, closest)
        assert [(bytes(r.a), bytes(r.b)) for r in near_dedup._align(pairs, text, 0.8).collect()] == [(b"c", b"b")]
    # buckets of the same members are compared once, and one class not at all
    twice = met.unionByName(met.selectExpr("4L as key", "node", "n_words"))
    assert near_dedup._blocks(twice, none, bags).count() == 1
    one = spark.createDataFrame([(n, b"a") for n in words], "node binary, root binary")
    assert near_dedup._blocks(met, one, bags) is None


def test_bags_never_tell_alike_texts_apart():
    rng = random.Random(8)
    known = near_dedup._Words()
    for _ in range(300):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 700))]
        other = edited(rng, words, rng.randint(0, len(words) // 4))
        a, b = (near_dedup.bag(near_dedup.word_hashes(" ".join(w), known)).astype(int) for w in (words, other))
        if other and near_dedup.similar(words, other):
            d = a - b
            assert max(d[d > 0].sum(), -d[d < 0].sum()) <= int(0.2 * max(len(words), len(other)) + 1e-9)


def test_scattered_edits_are_met():
    """Copies with one-word edits all over, by edit similarity."""
    rng, known = random.Random(6), near_dedup._Words()
    for percent, least in ((80, 0.9), (85, 0.97), (90, 0.99), (95, 1.0)):
        met = 0
        for n in range(200):
            words = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
            other = list(words)
            for i in rng.sample(range(200), 2 * (100 - percent)):
                other[i] = "changed"
            assert near_dedup.similar(words, other)
            a, b = (near_dedup.bucket_keys(near_dedup.sketch(near_dedup.word_hashes(" ".join(w), known)))
                    for w in (words, other))
            met += bool(set(a.tolist()) & set(b.tolist()))
        assert met >= least * 200, (percent, met)


def test_shared_passage_hides_no_pair(spark):
    """Unlike texts of one length that share a passage; their near copies stand anywhere in the passage's buckets."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(78)]
    rows, want = [], {}
    for g in range(400):
        own = [f"g{g}w{i}" for i in range(22)]
        for c in range(2 if g % 4 == 0 else 1):
            i = len(rows)
            # an edit in each run of five own words: the copies only share shingles of the passage
            rows.append((i, " ".join(passage + [f"g{g}c{c}e{n}" if c and n % 4 == 0 else w for n, w in enumerate(own)])))
            want[i] = i - c
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rng.shuffle(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == want


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = near_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[42].class_id == by[44].class_id == by[45].class_id == 42 and by[42].class_size == 4
    assert by[40].class_id == by[41].class_id == by[52].class_id == 40
    assert by[43].class_id == 43 and by[None].class_id is None
    kept = near_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(42) == 1 and ids.count(45) == 0 and ids.count(None) == 1 and 41 not in ids and 52 not in ids
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rng.shuffle(links)
    rows = [(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in links]
    got = near_dedup.components(spark.createDataFrame(rows, "a binary, b binary")).collect()
    assert {(r.node[0] * 256 + r.node[1], r.root[0] * 256 + r.root[1]) for r in got} == {(x, find(x)) for x in list(parent)}
    assert len(got) == len({r.node for r in got})


def test_query_finds_similar_pairs(spark, sf_dir):
    """Against all pairs: no class without a link, and pairs of much the same shingles are together."""
    from ledgerline.llm import catalog

    texts = {r.doc_id: r.text.lower().split() for r in catalog.table(spark, sf_dir, "documents").collect()}
    sets = {i: {tuple(w[n:n + 5]) for n in range(max(1, len(w) - 4))} for i, w in texts.items()}
    got = {r.doc_id: r.class_id for r in catalog.op2_near_dedup(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            shared = len(sets[i] & sets[j])
            if shared / len(sets[i] | sets[j]) >= 0.8 and near_dedup.similar(texts[i], texts[j]):
                assert got[i] == got[j], (i, j)
    for i, c in got.items():
        if c != i:
            assert any(near_dedup.similar(texts[i], texts[j]) for j in got if j != i and got[j] == c)


def test_closest_pairs_grow_with_the_members(spark):
    """Of a bucket of texts that are each a class, all alike, the first round makes at most a pair for each member."""
    n = near_dedup.BLOCK
    members = [(bytes([i]), bytes([i]), 100, bytes([100] + [0] * (near_dedup.BINS - 1)), [2, 4]) for i in range(n)]
    rows = [(key, 0, members, 100, 100) for key in (2, 4)]  # they meet in two buckets
    blocks = spark.createDataFrame(
        rows, "key long, block long, x array<struct<node: binary, root: binary, n_words: int, bag: binary, keys: array<bigint>>>, lo int, hi int")
    assert near_dedup._between(blocks, 0.8, False).count() == n * (n - 1) // 2
    assert n // 2 <= near_dedup._between(blocks, 0.8, True).count() <= n
    made = blocks.select("key", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y")).mapInArrow(
        near_dedup._compared(0.8, False), "a binary, b binary")
    assert made.count() == n * (n - 1) // 2  # each once, not in each bucket


def test_large_group_of_near_copies_is_one_class(spark, monkeypatch):
    """Copies with some words edited each, many unlike the bucket's first: rounds of closest pairs end in one class."""
    monkeypatch.setattr(near_dedup, "MANY", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"e{i}n{n}" if rng.random() < 0.09 else w for n, w in enumerate(base))) for i in range(300)]
    rows += [(1000 + i, f"other{i} text{i} alone{i}") for i in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: t.split() for i, t in rows}
    near = [(i, j) for i in range(300) for j in range(i) if near_dedup.similar(sets[i], sets[j])]
    assert all(got[1000 + i] == 1000 + i for i in range(20))
    assert sum(got[i] != got[j] for i, j in near) <= len(near) // 100


def test_components_end_with_stars(spark, monkeypatch):
    """Links that are stars are components as they stand, without a round of stars to see that nothing changes."""
    written = []
    real = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name="table": written.append(name) or real(df, name))
    links = [(b"b", b"a"), (b"a", b"c"), (b"y", b"x"), (b"c", b"a")]
    got = near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert sorted((bytes(r.node), bytes(r.root)) for r in got) == [
        (b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"x", b"x"), (b"y", b"x")]
    assert written == ["links"]
    chain = spark.createDataFrame([(b"a", b"b"), (b"b", b"c"), (b"d", b"c")], "a binary, b binary")
    assert {bytes(r.root) for r in near_dedup.components(chain).collect()} == {b"a"}


def test_closest_rounds_end_when_few_pairs_are_links(spark, monkeypatch):
    """A large group of texts that share a passage and are not similar: one round of closest pairs, then all pairs."""
    monkeypatch.setattr(near_dedup, "MANY", 20)
    rounds, real = [], near_dedup._between
    monkeypatch.setattr(near_dedup, "_between", lambda blocks, least, closest: rounds.append(closest) or real(blocks, least, closest))
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(78)]
    words = [f"own{i}" for i in range(22)]
    # the same own words in another order: bags never tell them apart, the alignment does
    rows = [(i, " ".join(passage + rng.sample(words, 22))) for i in range(60)]
    # copies that are like the first of the group by less than they are like each other: one link in the closest round
    rows += [(100 + i, " ".join(passage + [f"pair{i // 2}w{n}" if n % 4 or i % 2 else f"e{i}n{n}" for n in range(22)])) for i in range(4)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t.split() for i, t in rows}
    like = [(i, j) for i in texts for j in texts if i < j and near_dedup.similar(texts[i], texts[j])]
    assert all(got[i] == got[j] for i, j in like)
    assert rounds == [True, False]
