"""Byte-level BPE: exact encoding by backtracking, and decoding.

The automaton (Latin-1 characters stand for bytes) gives the longest token at
every place.  Encoding takes the longest match that is compatible with the
token before it, and backtracks to shorter tokens otherwise; two adjacent
tokens are compatible when merging by rank would not join anything across
their border, which a memo answers after the first time.  A place that could
not be continued is never tried again, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Pieces whose encoding is remembered by one worker.
MEMO_PIECES = 400_000
LONG_PIECE = 256
OUT_ROWS = 256


class BytePairEncoder:
    """Encodes and decodes by the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.lengths = [len(piece) for piece in self.token]
        self.pieces = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.trie.add_word(piece.decode("latin-1"), (len(piece) - 1, rank))
        self.trie.make_automaton()
        self.shorter: list[int] = []  # the longest token that begins a token, or -1
        for piece in self.token:
            cut = next((ranks[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in ranks), -1)
            self.shorter.append(cut)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.token))]
        self._learn_merges()
        self.memo = _Memo(self)

    def _learn_merges(self) -> None:
        """Find for every token the one pair whose merge makes it."""
        for rank, piece in enumerate(self.token):
            left = self.shorter[rank]
            while left >= 0:
                right = self.rank.get(piece[len(self.token[left]) :], -1)
                if 0 <= right < rank and left < rank and self._border(left, right):
                    self.joined[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]
        self.compatible.clear()

    def _border(self, left: int, right: int) -> bool:
        """Whether no merge by rank would join something across the border.

        Undoes the merges of both tokens, latest first; a pair that meets at
        the border and merges earlier than what was undone crosses it.
        """
        halves, joined = self.halves, self.joined
        limit = len(self.token) + 1
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            for late in (left > right, left <= right):
                if late:  # undo the left token: its right half touches the border
                    limit, whole = left, left
                    left = halves[left][1]
                    if left != whole:
                        break
                else:
                    limit, whole = right + 1, right
                    right = halves[right][0]
                    if right != whole:
                        break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= 4 * MEMO_PIECES:
                self.compatible.clear()
            known = self.compatible[left, right] = self._border(left, right)
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if raw in self.rank:
            return [self.rank[raw]]
        n, lengths, known = len(raw), self.lengths, self.compatible
        longest = [0] * n
        for end, (before, rank) in self.trie.iter(raw.decode("latin-1")):
            longest[end - before] = rank  # a later end is a longer match
        dead = set()  # places from which no continuation was found
        token = longest[0]
        ids, place, last = [token], lengths[token], token
        while place < n:
            token = longest[place]
            while True:
                end = place + lengths[token]
                if end not in dead:
                    fit = known.get((last, token))
                    if fit or (fit is None and (last < 0 or self.fits(last, token))):
                        break
                token = self.shorter[token]
                while token < 0:  # nothing shorter: give up the token before
                    dead.add(place)
                    token = ids.pop()
                    place -= lengths[token]
                    token = self.shorter[token]
                    last = ids[-1] if ids else -1
            ids.append(token)
            place, last = end, token
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Memo(dict):
    """Encodings of the pieces seen lately; a missing one is made."""

    def __init__(self, bpe: BytePairEncoder):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each vocabulary and Python process."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(path, pattern)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    pattern: str = public_tokenizers.PATTERN,
    path: str | None = None,
    ids: bool = True,
) -> DataFrame:
    """Per document the number of tokens and SHA-256 of ids and of decoded bytes.

    With ``ids`` the token ids follow as array<int>.  One row per input row, in a
    narrow stage.  NULL and empty texts have no ids and decode to no bytes;
    repeated rows and NULL ids are kept as they are; other columns are ignored.
    ``path`` replaces the packaged file of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            for begin in range(0, len(batch), OUT_ROWS):
                some = batch.slice(begin, OUT_ROWS)
                codes = [bpe.encode(text.as_py() or "") for text in some.column(1)]
                columns = {
                    "doc_id": some.column(0),
                    "n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in codes], pa.string()),
                }
                if ids:
                    columns["ids"] = pa.array([np.frombuffer(c, "<i4") for c in codes], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
