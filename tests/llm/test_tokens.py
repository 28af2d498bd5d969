import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe_stream, catalog, token_files, tokens

BYTES, WORDS = (catalog.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
POOL = "ab '\n\t s19é中 　\x1c\x85.,!-½Ⅷʰ́😀<|>\""


def odd_texts(edge_rows):
    rng = random.Random(2)
    out = [r[1] or "" for r in edge_rows] + ["it's" * 2000, "foo\n <|endoftext|> bar<|startoftext|>x", "1" * 3000 + "ab"]
    out += ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return out + ["".join(rng.choice(q) for _ in range(3000)) for q in ("ab", "etaoinsr", "-=", "é中a", " \n", "a'rels")]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_equal_the_library(path, edge_rows):
    library = Tokenizer.from_file(path)
    texts = odd_texts(edge_rows)
    for t, ids in zip(texts, tokens.encoder(path).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("block,long", [(1 << 16, 1024), (7, 5), (50, 20), (333, 64)])
def test_stream_equals_the_library(edge_rows, monkeypatch, block, long):
    monkeypatch.setattr(bpe_stream, "BLOCK", block)
    monkeypatch.setattr(bpe_stream, "LONG", long)
    library = Tokenizer.from_file(BYTES)
    for t in odd_texts(edge_rows)[::1 if block > 99 else 3]:
        ids = library.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert bpe_stream.round_trip(BYTES, t) == want, t[:80]


def test_lookahead_suffices():
    merges, rng = bpe_stream.encoder(BYTES).merges, random.Random(5)

    def ends(data):
        return np.cumsum([len(merges.text[i]) for i in merges.merge(data)])

    for parts in ("etaoin", ["ing", "the", "tion", "er", "ation", "ness", "s"], "a", "-=", " "):
        for _ in range(100):
            data = "".join(rng.choice(parts) for _ in range(600)).encode()
            cut = rng.randint(300, len(data))
            stable = cut - merges.lookahead
            assert [e for e in ends(data) if e <= stable] == [e for e in ends(data[:cut]) if e <= stable]


def test_encode_decode_frames(spark, edge_docs, edge_rows, no_docs):
    back = bpe_stream.decode(bpe_stream.encode(edge_docs, BYTES), BYTES).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r[0] or -1, r[1] or "") for r in edge_rows)
    assert bpe_stream.encode(no_docs, BYTES).count() == bpe_stream.digests(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_files(spark, edge_docs, edge_rows, path):
    library = Tokenizer.from_file(path)
    got = token_files.summarise(spark, token_files.write(edge_docs, path)).collect()
    want = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in edge_rows]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i or -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_files_of_no_documents(spark, no_docs):
    assert token_files.summarise(spark, token_files.write(no_docs, BYTES)).count() == 0


def test_merges_alone_equal_the_library():
    """Chunks of letters, seen and not, go past the splitting; the other vocabulary takes the library's way."""
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x24f) if chr(c).isalpha() and tokens.PLAIN.fullmatch(chr(c))]
    chunks = [rng.choice(["", " "]) + "".join(rng.choice(letters[:52] * 5 + letters) for _ in range(rng.randint(1, 20)))
              for _ in range(5000)] + [" " + "a" * 500]
    encoder = tokens.ChunkEncoder(BYTES)
    assert encoder.merges_alone and not tokens.ChunkEncoder(WORDS).merges_alone
    assert encoder._encode_chunks(chunks) == encoder._encode(chunks)


def test_token_file_query(spark, sf_dir):
    """The registered query against the library, document by document."""
    library, start = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in catalog.op9_token_files(spark, sf_dir).collect()}
    rows = sorted((r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect())
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stream_query(spark, sf_dir):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in catalog.op10_bpe_stream(spark, sf_dir).collect()}
    for r in catalog.table(spark, sf_dir, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
