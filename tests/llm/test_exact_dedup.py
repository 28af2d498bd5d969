import hashlib
from collections import Counter, defaultdict

from ledgerline.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    return {s: (max(g, key=lambda i: (i is not None, i or 0)), len(g)) for s, g in groups.items()}


def test_groups(edge_docs, edge_rows):
    for counters in (1, 3, 1024):  # most, some and none of the groups through the shuffle
        got = exact_dedup.exact_duplicates(edge_docs, counters=counters).collect()
        assert len(got) == len(edge_rows)
        want = brute([(r[0], r[1]) for r in edge_rows])
        for r in got:
            assert (r.keep_id, r.group_size) == want[r.text_sha256]
            assert not r.kept or r.doc_id == r.keep_id
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(want))


def test_deduplicate_keeps_columns_and_one_of_repeated_rows(edge_docs, edge_rows):
    kept = exact_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    want = brute([(r[0], r[1]) for r in edge_rows])
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in want.values())


def test_empty(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.deduplicate(no_docs).columns == no_docs.columns


def test_misra_gries_keeps_frequent():
    counts = Counter()
    stream = [b"a"] * 400 + [str(i).encode() for i in range(500)] + [b"b"] * 300
    for i in range(0, len(stream), 50):
        counts.update(stream[i:i + 50])
        counts = exact_dedup.misra_gries(counts, 4)
        assert len(counts) <= 4
    assert {b"a", b"b"} <= set(counts)  # more than a fifth of the rows each
    assert counts[b"a"] <= 400
