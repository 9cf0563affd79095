"""Token ids in files of compressed bit or byte planes.

Documents are dealt into files by ranges of their ids and each file holds its
documents' ids as one stream, cut into blocks of a fixed number of ids. A block
is transposed into planes (all lowest bytes, all second bytes, ..., or the same
by bits), each compressed by zstandard on its own, so the planes that are all
but zero take next to nothing. A chunk index at the end of the file tells where
each plane of each block lies and which ids belong to which document.

A file is a row of records, each ended by one newline (Spark's text writer puts
it there; all places are counted from the index, never searched):

- blocks: the compressed planes, lowest first;
- the index, compressed: little-endian arrays as in ``_INDEX``;
- inside the last record, after the index: ``_TRAILER``.

Files are written and read through Spark, so they can lie in any store, a lost
task's file is written again, and only whole files become visible.
"""

from __future__ import annotations

import array
import contextlib
import json
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm.storage import materialise, sent_if_small
from loamline.llm.words import slices

MAGIC = b"IDPLANE1"
#: Length of the compressed index, blocks, documents, bits of a plane's unit, number of the file, magic.
_TRAILER = struct.Struct("<QQQIQ8s")
#: The arrays of the index: per block its first byte and its ids; per block and plane a length; per document id, whether it has one, and its ids.
_INDEX = (("offset", "<i8"), ("n_ids", "<i8"), ("planes", "<i4"), ("doc_id", "<i8"), ("has_id", "u1"), ("n_tokens", "<i8"))
WORD_BITS = 32
LEVEL = 3


def to_planes(ids: np.ndarray, unit: int = 8) -> list[bytes]:
    """Compressed planes of a block of uint32 ids; ``unit``: bits of an id that a plane has, 1 or 8."""
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == 1:
        rows = np.packbits(np.ascontiguousarray(np.unpackbits(parts, axis=1, bitorder="little").T), axis=1)
    else:
        rows = np.ascontiguousarray(parts.T)
    pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
    return [pack(row.tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int, unit: int = 8) -> np.ndarray:
    """The inverse of ``to_planes`` for a block of ``n`` ids."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if unit == 1:
        rows = np.packbits(np.ascontiguousarray(np.unpackbits(rows, axis=1, count=n).T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


#: White space as any reader of a pattern may see it.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space or newline inside white space: there a cut before it may part what belongs together.
INSIDE = f"[{SPACE}][ \n](?:[{SPACE}]|$)"
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A word that the tokenizer's pattern can only part before its marks.
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
MAX_CACHED = 600_000
LENGTH_BITS = 24


def _byte_characters() -> dict[int, str]:
    """Byte -> the character that byte-level vocabularies write for it: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Piece -> where its ids are in ``store`` (start << LENGTH_BITS | length)."""

    def __init__(self, ids_of, store: array.array):
        super().__init__()
        self.ids_of, self.store = ids_of, store

    def __missing__(self, piece: str) -> int:
        ids = self.ids_of(piece)
        at = self[piece] = len(self.store) << LENGTH_BITS | len(ids)
        self.store.extend(ids)
        return at


class Encoder:
    """Ids of whole texts by a tokenizer file, the same as its library gives without special tokens.

    Byte-level BPE never merges across the tokenizer's pre-tokens. A text is
    cut before spaces and newlines, where pre-tokens always end unless more
    white space surrounds them, and the library encodes each different piece
    once for as long as this worker remembers it. Texts with runs of white
    space are cut with more care. Other kinds of tokenizers encode whole texts.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        pre = spec.get("pre_tokenizer") or {}
        special = all(t.get("special") for t in spec.get("added_tokens", []))
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and special
        if self.by_pieces:
            with contextlib.suppress(AttributeError):
                self.model._resize_cache(0)  # pieces are remembered here
        self.characters = _byte_characters()
        self.forget()

    def forget(self) -> None:
        self.store = array.array("I")
        self.whole = _Pieces(self._ids, self.store)
        self.after_cut = _Pieces(lambda piece: self._ids(piece if piece[:1] == "\n" else " " + piece), self.store)

    def _letters(self, text: str) -> list[int]:
        """Ids of a pre-token."""
        if not text.isascii() or text[0] == " ":
            text = text.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(text)]

    def _ids(self, piece: str) -> list[int]:
        if piece[:1] == "\n" and len(piece) > 1 and not piece[1].isspace():
            return self._ids("\n") + self._ids(piece[1:])
        found = PLAIN.fullmatch(piece)
        if found is None:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        letters = self._letters(found[1] + found[2])
        return letters + self._letters(found[3]) if found[3] else letters

    def _at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at these places, one after the other, and where each place's ids end."""
        n = places & ((1 << LENGTH_BITS) - 1)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        stored = np.frombuffer(self.store, np.uint32) if len(self.store) else np.empty(0, np.uint32)
        return stored[np.repeat((places >> LENGTH_BITS) - ends + n, n) + np.arange(total)], ends

    def _carefully(self, text: str) -> np.ndarray:
        pieces = SAFE_CUT.split(text)
        return self._at(np.fromiter(map(self.whole.__getitem__, pieces), np.int64, len(pieces)))[0]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_pieces:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if len(self.whole) + len(self.after_cut) > MAX_CACHED:
            self.forget()
        careful = pc.match_substring_regex(texts, INSIDE)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(careful, "", texts), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.after_cut.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        starts = split.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        first = coded.indices.to_numpy()[starts[:-1]]
        places[starts[:-1]] = [self.whole[different[i]] for i in first]
        ids, ends = self._at(places)
        out = np.split(ids, ends[starts[1:-1] - 1]) if len(texts) else []
        for i in np.flatnonzero(careful.to_numpy(zero_copy_only=False)):
            out[i] = self._carefully(texts[int(i)].as_py())
        return out


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """One encoder per process."""
    return Encoder(definition)


class _File:
    """Collects a file's blocks and index."""

    def __init__(self, number: int, block_ids: int, unit: int):
        self.number, self.block_ids, self.unit = number, block_ids, unit
        self.rest, self.written = np.empty(0, np.uint32), 0
        self.index: dict[str, list] = {name: [] for name, _ in _INDEX}

    def _block(self, ids: np.ndarray) -> bytes:
        planes = to_planes(ids, self.unit)
        self.index["offset"].append(self.written)
        self.index["n_ids"].append(len(ids))
        self.index["planes"].extend(map(len, planes))
        record = b"".join(planes)
        self.written += len(record) + 1
        return record

    def add(self, doc_ids: list, streams: list[np.ndarray]) -> list[bytes]:
        """Blocks that these documents' ids complete."""
        self.index["doc_id"].extend(d or 0 for d in doc_ids)
        self.index["has_id"].extend(d is not None for d in doc_ids)
        self.index["n_tokens"].extend(map(len, streams))
        ids = np.concatenate([self.rest, *streams])
        whole = len(ids) // self.block_ids * self.block_ids
        self.rest = ids[whole:].copy()
        return [self._block(ids[i : i + self.block_ids]) for i in range(0, whole, self.block_ids)]

    def end(self) -> list[bytes]:
        records = [self._block(self.rest)] if len(self.rest) else []
        index = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(np.array(self.index[name], kind).tobytes() for name, kind in _INDEX))
        return [*records, index + _TRAILER.pack(len(index), len(self.index["offset"]), len(self.index["doc_id"]), self.unit, self.number, MAGIC)]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = 65_536, unit: int = 8, file_bytes: int = 32 << 20) -> None:
    """Write the ids of ``docs``, each text followed by ``end_id``, as files below ``path`` in ascending order of ids.

    In: ``doc_id`` (an integer type), ``text``; other columns are ignored;
    ``tokenizer`` is the text of a tokenizer file. Files hold about
    ``file_bytes`` of text. A null text is an empty one; null ids come last;
    rows of one id come in the order of a hash of their texts, so that neither
    null nor repeated ids make a hot range. An empty table gives a folder
    without documents.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"of": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), "of", "row"]
    dealt = rows.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary, bounded: not input data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = _encoder(shared.value), _File(TaskContext.get().partitionId(), block_ids, unit)
        end = np.array([end_id], np.uint32)
        for batch in slices(batches):
            streams = [np.concatenate([ids, end]) for ids in encoder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(file.add(batch.column("doc_id").to_pylist(), streams), pa.binary())], names=["record"])
        if file.index["doc_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(file.end(), pa.binary())], names=["record"])

    records = dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def _index(content: pa.Buffer) -> tuple[dict[str, np.ndarray], int, int]:
    """Index, unit and number of a file."""
    length, n_blocks, n_docs, unit, number, magic = _TRAILER.unpack(content[len(content) - 1 - _TRAILER.size : len(content) - 1])
    if magic != MAGIC:
        raise ValueError("not a file of id planes")
    raw = zstandard.ZstdDecompressor().decompress(content[len(content) - 1 - _TRAILER.size - length : len(content) - 1 - _TRAILER.size])
    out, at = {}, 0
    for name, kind in _INDEX:
        n = (n_docs if name in ("doc_id", "has_id", "n_tokens") else n_blocks) * (WORD_BITS // unit if name == "planes" else 1)
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out, unit, number


def _documents(content: bytes, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The documents of a file, block after block."""
    view = memoryview(content)
    index, unit, number = _index(view)
    lengths = index["planes"].reshape(-1, WORD_BITS // unit)
    starts = np.cumsum(index["n_tokens"]) - index["n_tokens"]
    blocks, ids = iter(range(len(lengths))), np.empty(0, np.uint32)
    for i in range(0, len(starts), rows):
        n_tokens = index["n_tokens"][i : i + rows]
        got, need = [ids], int(n_tokens.sum()) - len(ids)
        while need > 0:
            b = next(blocks)
            cuts = int(index["offset"][b]) + np.concatenate([[0], np.cumsum(lengths[b])])
            got.append(from_planes([view[s:e] for s, e in zip(cuts, cuts[1:])], int(index["n_ids"][b]), unit))
            need -= len(got[-1])
        flat = np.concatenate(got)
        here = int(n_tokens.sum())
        ids = flat[here:]
        offsets = np.concatenate([[0], np.cumsum(n_tokens * 4)]).astype(np.int64)
        streams = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_tokens), [None, pa.py_buffer(offsets), pa.py_buffer(flat[:here].astype("<u4"))])
        doc_ids = pa.array(index["doc_id"][i : i + rows], mask=index["has_id"][i : i + rows] == 0)
        columns = [pa.array([number] * len(n_tokens), pa.int64()), pa.array(np.arange(i, i + len(n_tokens))), doc_ids, pa.array(starts[i : i + rows]), pa.array(n_tokens), streams.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "nth", "doc_id", "start_in_file", "n_tokens", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files below ``path``: ``file``, ``nth``, ``doc_id``, ``start_in_file``, ``n_tokens``, ``ids`` (little-endian uint32).

    Files come in the order of ``file``, documents in that of ``nth``. A file
    is unpacked block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if len(content.as_buffer()):
                    yield from _documents(content.as_buffer())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "file long, nth long, doc_id long, start_in_file long, n_tokens long, ids binary")


def with_starts(found: DataFrame) -> DataFrame:
    """``found``, a stored table of what ``read`` gives, with ``start``: the ids of all documents before each. One row per file is summed up in order."""
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("file", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("before"))
    return found.join(sent_if_small(before, totals), "file").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")


def round_trip(docs: DataFrame, path: str, tokenizer: str, **layout) -> DataFrame:
    """Write ``docs`` and read the files back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``; rows as in ``write``."""
    write(docs, path, tokenizer, **layout)
    found = read(docs.sparkSession, path).select("file", "nth", "doc_id", "start_in_file", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(materialise(found, "planes-read")).select("doc_id", "start", "n_tokens", "ids_crc32")
