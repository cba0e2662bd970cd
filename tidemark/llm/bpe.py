"""Byte-level BPE over whole corpora, exactly and in linear time.

A sequence of tokens is what merging would give if and only if each two neighbours are compatible: encoding the two
together gives just these two. So a piece is encoded from left to right by its longest tokens, stepping back to a shorter
one, or over the token before, where neighbours aren't compatible; a position once left for good is never tried again.
Compatibility depends on two ids alone and is remembered. Tokens are found by an Aho-Corasick automaton over the piece's
bytes read as Latin-1."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces to remember per worker, and the longest to be remembered.
CACHE_PIECES, CACHE_CHARS = 200_000, 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """ranks: ids of all tokens, in the order of their merges; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = (rank, rank)
            if len(token) > 1:
                pair = self._last_merge(token, rank, ranks)
                if pair is not None:
                    self.parts[rank] = pair
                    self.merged[pair] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits = lru_cache(maxsize=1 << 20)(self._fits)

    @staticmethod
    def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``: what lower ranks make of its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two would stay as they are side by side: undoing merges from the latest on, none across the
        border may come before those that made the two."""
        parts, merged = self.parts, self.merged
        limit = 1 << 40
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            undo_left = parts[left][0] != left and left > right
            if undo_left or (parts[right][0] == right and parts[left][0] != left):
                limit, left = left, parts[left][1]
            elif parts[right][0] != right:
                limit, right = right + 1, parts[right][0]
            else:
                return True

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.known.get(piece)
        if known is None:
            known = self._encode(piece.encode("utf-8").decode("latin-1"))
            if len(piece) <= CACHE_CHARS:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = known
        return known

    def _encode(self, text: str) -> tuple[int, ...]:
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # of each position, its tokens; shortest first
        for end, (size, rank) in self.automaton.iter(text):
            starts[end - size + 1].append((size, rank))
        dead = bytearray(n + 1)
        path: list[tuple[int, int]] = []  # position, index of the token there
        ids: list[int] = []
        at, k = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            while k >= 0:
                size, rank = starts[at][k]
                if not dead[at + size] and (not ids or self.fits(ids[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                path.append((at, k))
                ids.append(rank)
                at += size
                k = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                at, k = path.pop()
                ids.pop()
                k -= 1
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)] if text else []


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker and vocabulary; its size is the vocabulary's."""
    return Encoder(read_ranks(path), pattern)


def _ids(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    enc = encoder(path or default_vocabulary(), pattern or default_pattern())  # where this worker has them
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids = pa.array([enc.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[batch.schema.names[0], "ids"])


def token_ids(documents: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens, whose strings are plain text here.

    Null and empty texts have an empty list, blank ones have their blanks' tokens. Rows stay where they are: there is no
    shuffle, and repeated keys stay repeated. ``vocabulary`` is a file of base64 tokens and ranks that all workers can read."""
    rows = documents.select(key, text)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(partial(_ids, path=vocabulary, pattern=pattern), f"`{key}` {kind}, ids array<int>")
