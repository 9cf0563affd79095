"""Words, hashes and folds that several operators share.

A word is a maximal run of bytes other than space and \\x09-\\x0D. That is what
``bytes.split()`` separates, so all Python paths split UTF-8 bytes, not str.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MAX_CACHED = 200_000
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def give_back() -> None:
    """Return what past tasks of this worker have freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep_freed(size: int = 256 << 20) -> None:
    """Let this worker reuse what it frees, up to ``size`` bytes, where the C library can: numpy's temporaries then cost no page faults."""
    with contextlib.suppress(OSError, AttributeError):
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL("libc.so.6").mallopt(option, size)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and about ``size`` bytes of text (one text at least), which bounds what a worker holds as Python objects."""
    give_back()
    for batch in batches:
        ends = None
        if batch.num_rows and "text" in batch.schema.names:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < max(1, batch.num_rows):
            n = rows
            if ends is not None:
                n = max(1, min(rows, int(np.searchsorted(ends, size + (ends[i - 1] if i else 0), "right")) - i))
            yield batch.slice(i, n)
            i += n


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word looked up, with a bounded memory of past words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)
