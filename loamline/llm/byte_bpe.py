"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The vocabulary of a rank file (base64 token, rank) is serialised directly as a
sentencepiece BPE model: every byte becomes one character, a token of rank r
becomes a piece of score -r, the normaliser is the identity. Merging the best
scored pair first is then merging the lowest rank first. Each pre-token is
encoded on its own; decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamline.llm.words import slices

#: Byte b is written as the character of code FIRST + b.
FIRST = 0x100
MAX_CACHED = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank. Ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"{path}: ranks are not consecutive")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model file: piece i is token i; the unknown piece follows the last token."""
    normal, unknown, bpe, none = 1, 2, 2, 2**64 - 1
    pieces = [_field(1, _field(1, t.decode("latin-1").translate(_TO_CHARS).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


_TO_CHARS = {b: chr(FIRST + b) for b in range(256)}


class Codec(dict):
    """Encoder and decoder of one process. As a dict: pre-token -> its ids as little-endian uint32 bytes."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def __missing__(self, pre: str) -> bytes:
        raw = pre.encode()
        ids = self.whole.get(raw)
        if ids is None:
            ids = np.array(self.sp.encode(raw.decode("latin-1").translate(_TO_CHARS)), "<u4").tobytes()
        if len(pre) <= 64:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[pre] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        n = self.length[i]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[i] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()


_codecs: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per process and model."""
    tokens, model = shared.value
    key = (hash(model), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, model, pattern)
    return _codecs[key]


def _shared(df: DataFrame, ranks_path: str):
    tokens = read_ranks(ranks_path)  # a vocabulary file, bounded: not input data
    return df.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_decoded: bool = False) -> DataFrame:
    """Encode whole texts.

    In: ``doc_id``, ``text``; other columns are ignored. Out, one row per input
    row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian uint32), and with
    ``with_decoded`` also ``decoded``, the bytes that the ids decode to. A null
    or empty text has no ids. A null id or a repeated row is kept as it is.
    """
    shared = _shared(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in slices(batches):
            ids = [codec.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            out = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if with_decoded:
                out.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * with_decoded))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Bytes of the ids of each row: ``doc_id``, ``ids`` -> ``doc_id``, ``decoded``. Null ids give empty bytes."""
    shared = _shared(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, "")
        for batch in slices(batches):
            out = pa.array([codec.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.BinaryType())]))
