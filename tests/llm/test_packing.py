import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import catalog, packing

WORDS = catalog.vocabulary("word_bpe_49k.json")


def check(rows, texts, length):
    """Every id in one piece, sequences without gaps; the share of padding."""
    library = Tokenizer.from_file(WORDS)
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in texts)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    return docs, 1 - sum(map(len, want)) / (length * len(seqs))


@pytest.mark.parametrize("length,grain", [(4096, 16), (64, 4), (100, 5)])
def test_edges(spark, edge_docs, edge_rows, length, grain):
    cut = packing.pieces(edge_docs, WORDS, length=length, grain=grain)
    packed = packing.assign(cut, length, grain)
    rows = packed.collect()
    check(rows, [(r[0], r[1]) for r in edge_rows], length)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids


def test_empty(spark, no_docs):
    assert packing.assign(packing.pieces(no_docs, WORDS)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in catalog.table(spark, sf_dir, "documents").collect()}
    docs, padding = check(catalog.op3_packing(spark, sf_dir).collect(), list(texts.items()), 4096)
    assert padding < 0.02
    library = Tokenizer.from_file(WORDS)
    for i, own in list(docs.items())[::7]:
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(1)
    for room, n in ((10, 7), (256, 5000), (256, 40), (31, 1000)):
        demand = np.bincount(rng.integers(1, room + 1, n), minlength=room + 1)[1:]
        plan = packing.plan_patterns(demand, room)
        sizes = np.arange(1, room + 1)
        assert (sum(p * k for p, k in plan) == demand).all()
        assert all((p * sizes).sum() <= room for p, _ in plan)
        assert sum(k for _, k in plan) <= 1.1 * (demand * sizes).sum() / room + 0.5 * room ** 0.5 + 1


def test_columns_reach_the_known_optimum():
    # rolls of 100: 45, 36, 31 and 14 wide; the linear optimum is 452.25 rolls
    demand = np.zeros(100, int)
    demand[[44, 35, 30, 13]] = 97, 610, 395, 211
    _, use = packing.generate_columns(demand, 100, gap=0)
    assert abs(use.sum() - 452.25) < 1e-6


def test_knapsack():
    worth = np.array([0.0, 0.3, 0.5, 0.0, 0.95])
    assert packing.knapsack(worth, 5)[0] == pytest.approx(0.95)
    assert packing.knapsack(worth, 8)[0] == pytest.approx(0.95 + 0.5)


def test_few_kept_chunks_give_the_same_pieces(spark, edge_docs):
    """The pipeline keeps fewer chunks than the operator alone, for memory; the ids are the same."""
    own = ["doc_id", "start", "ids_crc32", "ids"]
    few, all_ = (sorted(packing.pieces(edge_docs, WORDS, kept=k).select(*own).collect(), key=str) for k in (5, None))
    assert few == all_
    from ledgerline.llm.tokens import MAX_CHUNKS, ChunkEncoder
    import corpus_pipeline

    encoder = ChunkEncoder(WORDS, 5)
    for i in range(20):
        encoder.encode([f"first{i} second{i}"])
    assert len(encoder.known) <= 8 and len(encoder.older) <= 8 and corpus_pipeline.KEPT_CHUNKS < MAX_CHUNKS
