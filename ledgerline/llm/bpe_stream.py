"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

How far can the text to the right still change the tokens to the left?  Let
the tokens of a prefix and of the whole text agree up to a front.  Applying
rule ``r = (u, v)`` moves the front left only where the last agreed token is
``u`` and the token that starts at the front is ``v``; it then stands before
that ``u``.  The token at the front was built, leftmost parts first, from the
``u'`` of the move before, so ``u'`` lies on the left spine of ``v`` and rule
``r'`` came no later than the rule that made its parent there.  The heaviest
such chain of rules, in bytes of their left sides, is a sufficient lookahead:
tokens that end that far before the last byte seen are final, and encoding can
go on from behind them as if the text began there.

Memory is one block and the lookahead for a word of any length, and a bounded
store of short chunks.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerline.llm.common import narrow, texts
from ledgerline.llm.tokens import CHUNK, MAX_CHUNKS, MAX_KEPT, WHITE, id_bytes

#: Characters taken from a text at a time.
BLOCK = 1 << 16
#: A run of one kind of character is streamed through the merges from this length on.
LONG = 1024

#: Above any rank.
NONE = 1 << 62

# fixed values: the pattern that splits text before the merges
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
                     rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", rf"[^{WHITE}\p{{L}}\p{{N}}]*")]
WHITE_RUN = regex.compile(rf"[{WHITE}]*")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: itself, or 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The rules of a byte-level BPE file, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.text = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.text |= {i: t.encode() for t, i in self.specials.items()}
        self.byte = [0] * 256
        for c, b in alphabet.items():
            self.byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        #: pair -> rank and merged id in one number; the first rule of a pair counts
        self.rank = {a * self.size + b: (r + 1) * self.size + t for r, (a, b, t) in
                     reversed(list(enumerate(self.rules)))}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        made = {}  # token -> (rank, left part) of the first rule that makes it
        for r, (u, _, t) in enumerate(self.rules):
            made.setdefault(t, (r, u))
        heavy: dict[int, tuple[list[int], list[int]]] = {}  # u -> ranks, heaviest chain ending at such a rank or before
        most = 0
        for r, (u, v, _) in enumerate(self.rules):
            best, x, until = 0, v, r - 1
            while True:
                ranks, chains = heavy.get(x, ((), ()))
                if i := bisect_right(ranks, until):
                    best = max(best, chains[i - 1])
                if x not in made:
                    break
                until, x = made[x]
            ranks, chains = heavy.setdefault(u, ([], []))
            ranks.append(r)
            chains.append(max(chains[-1] if chains else 0, len(self.text[u]) + best))
            most = max(most, chains[-1])
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece of text: the lowest rule first, from the left."""
        ids = [self.byte[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, n = self.rank, self.size
        ranks = [rank.get(a * n + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            t = best % n
            ids[i:i + 2] = [t]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] * n + t, NONE)
            if i < len(ranks):
                ranks[i] = rank.get(t * n + ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n, end = self.rank, self.size, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        # of one rule the leftmost place comes first
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(end - 1) if (r := rank.get(ids[i] * n + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            t = r % n
            ids[i], ids[j] = t, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if r := rank.get(t * n + ids[k]):
                    heapq.heappush(heap, (r, i, t, ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] * n + t)):
                heapq.heappush(heap, (r, h, ids[h], t))
        return [x for x in ids if x >= 0]


class WordStream:
    """Ids of one piece of any length, each emitted once no byte to come can change it."""

    def __init__(self, merges: Merges):
        self.merges, self.seen = merges, b""

    def push(self, data: bytes) -> Iterator[int]:
        merges, step = self.merges, 4 * self.merges.lookahead + 1024
        for i in range(0, len(data), step):
            self.seen += data[i:i + step]
            stable, end = len(self.seen) - merges.lookahead, 0
            if stable < merges.lookahead:
                continue
            for t in merges.merge(self.seen):
                if end + len(merges.text[t]) > stable:
                    break
                end += len(merges.text[t])
                yield t
            self.seen = self.seen[end:]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merge(self.seen)
        self.seen = b""


class Encoder:
    """Text in blocks to ids, as little-endian unsigned 32-bit bytes for each block, in order."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, words: Iterable[str]) -> bytes:
        return id_bytes([i for w in words for i in self.merges.merge(w.encode())])

    def _chunk(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._words([chunk] if chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " " else
                                _PRE.findall(chunk))
        if len(chunk) <= MAX_KEPT:
            if len(self.known) > MAX_CHUNKS:
                self.older, self.known = self.known, {}
            self.known[chunk] = found
        return found

    def _chunks(self, chunks: list[str]) -> bytes:
        ids = list(map(self.known.get, chunks))
        if None in ids:
            ids = [self.known.get(c) or self._chunk(c) if x is None else x for c, x in zip(chunks, ids)]
        return b"".join(ids)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text; the strings of special tokens in it are those tokens, as in the library."""
        specials = self.merges.specials
        parts = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text) if any(
            s in text for s in specials) else [text]
        for part in parts:
            if part in specials:
                yield id_bytes([specials[part]])
            else:
                yield from self.stream(part[i:i + BLOCK] for i in range(0, len(part), BLOCK))

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        tail = ""
        run, word = None, None  # an open long run: what continues it, and its encoder
        for block in blocks:
            tail += block
            if run:
                keep = run is WHITE_RUN  # the last white character may belong to what follows
                end = run.match(tail).end()
                if end == len(tail):
                    yield id_bytes(list(word.push(tail[:end - keep].encode())))
                    tail = tail[end - keep:]
                    continue
                end -= keep and end > 0
                yield id_bytes([*word.push(tail[:end].encode()), *word.finish()])
                run, tail = None, tail[end:]
            chunks = CHUNK.findall(tail)
            tail = chunks.pop() if chunks else ""  # may go on in the next block
            yield self._chunks(chunks)
            if len(tail) > LONG:
                words = _PRE.findall(tail)
                if len(words[-1]) > LONG:
                    last = words.pop()
                    run = next(r for r in (*RUNS, WHITE_RUN) if r.match(last[-1]).end())
                    word, keep = WordStream(self.merges), run is WHITE_RUN
                    yield self._words(words)
                    yield id_bytes(list(word.push(last[:len(last) - keep].encode())))
                    tail = last[-1] if keep else ""
                else:  # a contraction may still change the last two
                    yield self._words(words[:-2])
                    tail = "".join(words[-2:])
        if run:
            yield id_bytes([*word.push(tail.encode()), *word.finish()])
        else:
            yield self._chunks(CHUNK.findall(tail))


class Decoder:
    """Bytes of tokens to text as they come: an incomplete character waits for its other bytes."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(Merges(path))


@functools.cache
def _tables(path: str) -> tuple[list[str], dict[int, bytes]]:
    merges = encoder(path).merges
    return list(map(str, range(merges.size))), merges.text


def round_trip(path: str, text: str) -> tuple[int, str, str]:
    """Tokens of a text, SHA-256 of its ids as comma-joined text, and of what decoding the ids gives."""
    names, spelling = _tables(path)
    listed, back, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder()
    for block in encoder(path).encode(text):
        if ids := np.frombuffer(block, "<u4").tolist():
            listed.update(("," * bool(n) + ",".join([names[i] for i in ids])).encode())
            back.update(decoder.push(b"".join([spelling[i] for i in ids])).encode())
            n += len(ids)
    back.update(decoder.finish().encode())
    return n, listed.hexdigest(), back.hexdigest()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches):
            n, ids, back = zip(*(round_trip(path, t) for t in values))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, 64):
            ids = [np.frombuffer(b"".join(encoder(path).encode(t)), "<u4") for t in values]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text, an unknown id an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path).merges.text
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                decoder = Decoder()
                out.append("".join(decoder.push(table[i]) for i in ids.as_py() or []) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())],
                                             names=["doc_id", "text"])

    return tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(
        run, "doc_id long, text string")
