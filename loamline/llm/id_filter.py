"""A Bloom filter of ids, of a fixed size, that spares rows the way through an exchange.

It only saves work: what passes wrongly is removed by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.words import mix

BITS, PROBES = 1 << 25, 3


def _places(ids: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    for i in range(PROBES):
        yield (h >> np.uint64(20 * i)) % np.uint64(BITS)


def build(ids: DataFrame, column: str | Column, tasks: int = 6) -> Broadcast:
    """Filter of the non-null longs in ``column``; each of ``tasks`` tasks sends the driver 4 MB, one after another, whatever the number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    own = ids.select(F.col(column).alias("id") if isinstance(column, str) else column.alias("id")).where("id is not null")
    for row in own.repartition(tasks).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def build_twice(lists: DataFrame, column: str, tasks: int = 6) -> Broadcast:
    """Filter of the longs that at least two of the lists in ``column`` hold (a list holds each once); each of ``tasks`` tasks sends the driver 8 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BITS, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).flatten().to_numpy(zero_copy_only=False)):
                at, times = np.unique(at, return_counts=True)
                n[at] = np.minimum(n[at] + times, 2)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(n >= x).tobytes()], pa.binary()) for x in (1, 2)], names=["once", "twice"])

    once, twice = np.zeros(BITS // 8, np.uint8), np.zeros(BITS // 8, np.uint8)
    for row in lists.select(column).repartition(tasks).mapInArrow(run, "once binary, twice binary").toLocalIterator():
        more = np.frombuffer(row.once, np.uint8)
        twice |= np.frombuffer(row.twice, np.uint8) | once & more
        once |= more
    return lists.sparkSession.sparkContext.broadcast(twice)


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), bool)
    for at in _places(ids):
        found &= (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return found
