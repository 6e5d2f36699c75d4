"""Byte-level BPE encoding and decoding with a SentencePiece model made straight from a rank file.

The vocabulary is written as a serialised SentencePiece BPE model: every byte is mapped to one
printable character, a token of rank ``r`` becomes a piece of score ``-r``, and the normaliser is
the identity. SentencePiece merges the adjacent pair of the highest score, leftmost first, which is
the merge order of the ranks. Texts are cut into pre-tokens first and each is encoded alone; a
pre-token that is a token itself is taken whole, as rank files demand. Decoding maps ids back to the
bytes of their tokens. The split pattern must be one whose pre-tokens hold a space at their start or
in runs of white space only, as those of byte-level vocabularies do.

Everything happens within a task (``mapInArrow``): no row moves and nothing but the text of a few
rows is held. Where ids are decoded again, ``with_round_trip`` does both in one Python worker. The rank file is read on the driver once and shipped with the function; it is a fixed
vocabulary, below ``MAX_RANK_BYTES``.

Defined results: a null or empty text has no tokens; lone surrogates cannot occur in Spark strings;
rows with the same key are encoded one by one; a very long text, or one match of the pattern in it, is
encoded whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from itertools import chain

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType

from .common import append_in_turn, append_values, map_texts

MAX_RANK_BYTES = 64 << 20
CACHE_CHUNKS = 300_000
CACHE_LETTERS = 64  # longer chunks are not kept
FIRST_LETTER = 0x100  # byte b is shown as chr(FIRST_LETTER + b)

# Field numbers and enumeration values of the SentencePiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCAB_SIZE, MODEL_BPE = 3, 4, 2
TRAINER_UNK, TRAINER_BOS, TRAINER_EOS, TRAINER_PAD = 40, 41, 42, 43
NORMALIZER_NAME, NORMALIZER_DUMMY_PREFIX, NORMALIZER_SHRINK_SPACES, NORMALIZER_MARK_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 text and rank."""
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file is larger than {MAX_RANK_BYTES} bytes")
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must count from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def letters(token: bytes) -> str:
    """Bytes as text with one character per byte."""
    return "".join(chr(FIRST_LETTER + b) for b in token)


def serialised_model(tokens: Iterable[bytes]) -> bytes:
    """SentencePiece BPE model whose piece ``i + 1`` is the token of rank ``i``; piece 0 is unknown."""
    tokens = list(tokens)
    parts = [_block(PIECES, _block(PIECE_TEXT, b"<unk>") + _number(PIECE_TYPE, TYPE_UNKNOWN))]
    for rank, token in enumerate(tokens):
        score = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -float(rank))
        parts.append(_block(PIECES, _block(PIECE_TEXT, letters(token).encode()) + score + _number(PIECE_TYPE, TYPE_NORMAL)))
    trainer = (
        _number(TRAINER_MODEL_TYPE, MODEL_BPE)
        + _number(TRAINER_VOCAB_SIZE, len(tokens) + 1)
        + _number(TRAINER_UNK, 0)
        + _number(TRAINER_BOS, -1)
        + _number(TRAINER_EOS, -1)
        + _number(TRAINER_PAD, -1)
    )
    normalizer = (
        _block(NORMALIZER_NAME, b"identity")
        + _number(NORMALIZER_DUMMY_PREFIX, 0)
        + _number(NORMALIZER_SHRINK_SPACES, 0)
        + _number(NORMALIZER_MARK_SPACES, 0)
    )
    return b"".join(parts) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(tokens)}
        self.shown = {b: chr(FIRST_LETTER + b) for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def pieces(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        raw = [p.encode("utf-8", "replace") for p in pre_tokens]
        found = [self.whole.get(r) for r in raw]
        open_ = [i for i, ids in enumerate(found) if ids is None]
        if open_:
            shown = [raw[i].decode("latin-1").translate(self.shown) for i in open_]
            lists = self.model.encode(shown, num_threads=1)
            flat = (np.fromiter(chain.from_iterable(lists), dtype="<u4") - 1).tobytes()
            end = 0
            for i, ids in zip(open_, lists, strict=True):
                start, end = end, end + 4 * len(ids)
                found[i] = flat[start:end]
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, by pre-tokens."""
        parts = [self.split(text) for text in texts]
        new = list(set(chain.from_iterable(parts)))
        ids = dict(zip(new, self.pieces(new), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers.

        A pre-token has a space at its start or in a run of white space only, so a text can be cut
        before every space that no other white space touches on its right. What follows up to the
        next space is encoded once and remembered. Texts where a space is followed by more white
        space (or by the end) have a run that crosses a cut; they are encoded whole.
        """
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        cut = [text.split(" ") for text in texts]
        new = list(set(chain.from_iterable(cut)).difference(cache))
        cache.update(zip(new, self.plain([" " + c for c in new]), strict=True))
        for c in new:
            if not c or c[0].isspace():
                cache[c] = None
        first = self.plain([c[0] for c in cut])
        out, whole = [], []
        for i, chunks in enumerate(cut):
            try:
                out.append(first[i] + b"".join(map(cache.__getitem__, chunks[1:])))
            except TypeError:  # a chunk without ids of its own
                out.append(b"")
                whole.append(i)
        for i, ids in zip(whole, self.plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for c in new:
            if len(c) > CACHE_LETTERS:
                del cache[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(tokens: list[bytes], pattern: str):
    coder = Codec(tokens, pattern)

    def many(texts: list) -> tuple:
        ids = coder.encode_all(texts)
        return [len(i) // 4 for i in ids], ids

    return many


FIELDS = [("n_tokens", LongType()), ("ids", BinaryType())]


def encode(df: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids``: ids of every whole text as little-endian 32-bit integers in a binary column."""
    return map_texts(df, key, text, FIELDS, lambda: _encoder(tokens, pattern))


def with_ids(df: DataFrame, tokens: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens, ids`` to a table that has no such columns."""
    return append_values(df, text, FIELDS, lambda: _encoder(tokens, pattern))


def _decoder(tokens: list[bytes]):
    def many(lists: list) -> tuple:
        found = [b"".join(map(tokens.__getitem__, np.frombuffer(i, dtype="<u4").tolist())) for i in lists]
        return (found,)

    return many


def _refuse(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")


def with_decoded(df: DataFrame, tokens: list[bytes], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes of every id list, the exact inverse of ``encode``; null lists count as empty.

    A table that already has a column ``name`` is refused.
    """
    _refuse(df, name)
    return append_values(df, ids, [(name, BinaryType())], lambda: _decoder(tokens))


def with_round_trip(df: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", name: str = "decoded") -> DataFrame:
    """``with_decoded`` of ``with_ids``: every text is encoded and its ids are decoded, by one Python worker per task.

    A table that already has a column ``name`` is refused.
    """
    _refuse(df, name)
    encoding = (text, FIELDS, lambda: _encoder(tokens, pattern))
    return append_in_turn(df, [encoding, ("ids", [(name, BinaryType())], lambda: _decoder(tokens))])
