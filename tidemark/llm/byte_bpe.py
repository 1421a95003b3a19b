"""Byte-level BPE through a SentencePiece model made straight from a rank file.

Every token of the rank file becomes a piece: its bytes are mapped one to one to
printable characters and it is scored by its negative rank, so that
SentencePiece, which merges the best-scored neighbours first, merges in the
order of ranks.  The model is serialised here, byte by byte, with identity
normalisation; nothing is trained.  Text is cut into pre-tokens, each is encoded
on its own (a pre-token that is a token is that token, whether or not merges
lead to it), and decoding maps pieces back to bytes.

Defined results: null text counts as empty; empty text has no ids and decodes
to nothing; a text of any length is encoded whole, its memory being a few
times its own size.  The rank file is read on every machine, from the path given.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, pieces


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next code point from 256 on."""
    out, spare = [], 256
    for b in range(256):
        prints = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b) if prints else chr(spare))
        spare += not prints
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a SentencePiece model with one piece for each rank, and the unknown piece after them."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    out, unknown = bytearray(), "<unk>"
    pieces_ = {token: "".join(chars[b] for b in token) for token, _ in by_rank}
    while unknown in pieces_.values():  # a token may be spelt like it
        unknown = f"<{unknown}>"
    for token, rank in by_rank:
        out += _field(1, _field(1, pieces_[token].encode()) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, unknown.encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    bpe, size, unk, none = 2, len(ranks) + 1, len(ranks), (1 << 64) - 1
    out += _field(2, _number(3, bpe) + _number(4, size) + _number(40, unk) + b"".join(_number(f, none) for f in (41, 42, 43)))
    out += _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes with one rank file; made once in each worker.

    ``memory`` bounds the number of pre-tokens whose ids are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 120_000):
        import sentencepiece

        self.ranks, self.memory = ranks, memory
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        to_byte = {c: b for b, c in enumerate(chars)}
        self.pieces = [bytes(to_byte[c] for c in self.processor.id_to_piece(i)) for i in range(len(ranks))]
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Remember the ids of pre-tokens: those that are tokens themselves, and all others in one call."""
        if len(self.known) + len(tokens) > self.memory:
            self.known.clear()
        fresh = [t for t in tokens if t not in self.known]
        raw = [t.encode("utf-8", "surrogatepass") for t in fresh]
        rest = []
        for t, r in zip(fresh, raw, strict=True):
            rank = self.ranks.get(r)
            if rank is not None:
                self.known[t] = (rank,)
            else:
                rest.append((t, r.decode("latin-1").translate(self.to_chars)))
        if rest:
            ids = self.processor.encode([chars for _, chars in rest], num_threads=1)
            self.known.update(zip((t for t, _ in rest), map(tuple, ids), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        tokens = set(chain.from_iterable(cut))
        if not tokens <= self.known.keys():
            self._learn(tokens)
        ids = self.known.__getitem__
        return [np.array(list(chain.from_iterable(map(ids, own))), "<u4") for own in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, which every machine has at ``path``."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, columns: list[Column], path: str, pattern: str, text: str = "text", ids: str | None = None, digests: bool = True) -> DataFrame:
    """``columns`` of every row with n_tokens; the ids themselves as ``ids`` (array of int) if named; with ``digests``,
    SHA-256 of the ids and of the decoded bytes.  One pass, no shuffle."""
    shape = docs.select(*columns).schema.add("n_tokens", "long")
    if ids:
        shape = shape.add(ids, T.ArrayType(T.IntegerType()))
    if digests:
        shape = shape.add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        own = codec(path, pattern)
        for batch, raw in pieces(batches, "__text", 1 << 20):
            n, kept, of_ids, of_text = [], [], [], []
            for got in own.encode([t.decode("utf-8", "replace") for t in raw]):
                n.append(len(got))
                if ids:
                    kept.append(got.astype(np.int32))
                if digests:
                    of_ids.append(hashlib.sha256(got.tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(own.decode(got)).hexdigest())
            made = [pa.array(n, pa.int64())]
            if ids:
                made.append(pa.array(kept, pa.list_(pa.int32())))
            if digests:
                made += [pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=shape.names)

    return docs.select(*columns, as_bytes(text).alias("__text")).mapInArrow(run, shape)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for as ``to``; null ids give null."""
    shape = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if x is None else own.decode(np.array(x, "<u4")).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=shape.names)

    return rows.mapInArrow(run, shape)
