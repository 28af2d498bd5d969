"""Ids of a public tokenizer's file, one chunk of text at a time.

Both vocabularies split a text before they merge: at white space, and between
a letter and most marks.  So the ids of a text are the ids of its chunks in
order.  Chunks repeat, so each distinct one is encoded once by the library and
its ids are kept as bytes, ready to be joined.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

#: Longer chunks are encoded but not kept.
MAX_KEPT = 64
#: Chunks kept in each of two generations; what the older one holds and nobody asks for again is forgotten.
MAX_CHUNKS = 400_000

# fixed values: the white space of Unicode, as the vocabularies' patterns have it, Latin letters, and marks
# that neither pattern joins to a letter before them
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
MARKS = r",.;:!?|\"#$%&*()"
#: A word before white space or a mark; marks before white space; else all up to the next white space; white space.
CHUNK = re.compile(f" ?[{LETTERS}]++(?![^{WHITE}{MARKS}])|[{MARKS}]++(?![^{WHITE}])|"
                   f" ?[^{WHITE}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

WORD = re.compile(f"[{LETTERS}]++(?![^{WHITE}{MARKS}])|[{MARKS}]++(?![^{WHITE}])|[^{WHITE}]++")

#: Chunks of letters only, which a byte-level vocabulary hands whole to its merges.
PLAIN = re.compile(f" ?[{LETTERS}]+")

#: Beyond these characters the library alone decides what is lower case.
BEYOND = re.compile("[^\\x00-\u012f\u0131-\u024f]")


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest
    for 256 and following."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's own."""

    def __init__(self, path: str, kept: int | None = None):
        self.kept = kept or MAX_CHUNKS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # where white space has no ids of its own, chunks go without it
        spaces = any(self._encode([" ", "\n"])) or self._encode([" a"]) != self._encode(["a"])
        self.chunk = CHUNK if spaces else WORD
        self.lower = self._encode(["Aa"]) == self._encode(["aa"])
        self.bytes, self.model = byte_characters(), self.library.model
        probes = [" thonst", "Étée", "ß", " ÿa", "x"]
        self.merges_alone = self.library.normalizer is None and [self._merged(c) for c in probes] == self._encode(probes)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [id_bytes(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, chunk: str) -> bytes:
        """Ids of a chunk of letters by the library's merges alone, without what comes before and after them."""
        text = "".join(map(self.bytes.__getitem__, chunk.encode()))
        return id_bytes([t.id for t in self.model.tokenize(text)])

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if not self.merges_alone:
            return self._encode(chunks)
        plain = [PLAIN.fullmatch(c) is not None for c in chunks]
        others = iter(self._encode([c for c, p in zip(chunks, plain) if not p]))
        return [self._merged(c) if p else next(others) for c, p in zip(chunks, plain)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the chunks that are new in all of them go to the library together."""
        split = [None if any(s in t for s in self.specials) else
                 self.chunk.findall(t.lower() if self.lower and not BEYOND.search(t) else t) for t in texts]
        if len(self.known) > self.kept:
            self.older, self.known = self.known, {}
        known = self.known
        new = set().union(*(c for c in split if c)).difference(known)
        again = {c: self.older[c] for c in new if c in self.older}
        new.difference_update(again)
        known.update(again)
        fresh = list(new)
        known.update(zip(fresh, self._encode_chunks(fresh)))
        out = [self._encode([t])[0]  # a special token's string also splits the white space beside it
               if chunks is None else b"".join(map(known.__getitem__, chunks)) for t, chunks in zip(texts, split)]
        for c in new:
            if len(c) > MAX_KEPT:
                del known[c]
        return out


@functools.cache
def encoder(path: str, kept: int | None = None) -> ChunkEncoder:
    """One encoder for each Python worker and file; the file lies on every node, like the library."""
    return ChunkEncoder(path, kept)
