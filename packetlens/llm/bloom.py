"""Partition-merged Bloom filters over 64-bit hashes, each segment kept in one task.

The hash space is cut into segments in proportion to the number of keys, so every filter has
the same fill however many keys there are, and no filter is ever whole anywhere: not on the
driver, not in a broadcast.  What a partition knows of a segment is sparse, so it travels as
its distinct hashes (8 bytes a key) and becomes bits where the partitions of a segment merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of one segment, about; with BITS_PER_KEY that is a filter of 1.5 MB.
SEGMENT_KEYS = 1 << 20
BITS_PER_KEY = 12
PROBES = 4
#: Hashes a task holds before it hands them on.
HELD = 1 << 20


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions (PROBES x n) of 64-bit hashes in a filter of ``bits`` bits."""
    h = hashes.view(np.uint64)
    a = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    b = (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a + i * b) % np.uint64(bits)).astype(np.int64)


class Filter:
    """A packed bit array."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.array = np.zeros(bits // 8 + 1, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        p = positions(hashes, self.bits)
        np.bitwise_or.at(self.array, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        p = positions(hashes, self.bits)
        return ((self.array[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


def merge_parts(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Hashes of one segment that may have been seen repeatedly.

    ``parts`` are, of each partition, its distinct hashes and those among them that it has
    seen more than once.  A hash already in the filter of once-seen keys, or repeated inside
    a partition, goes into the filter of repeatedly-seen keys; no repeat is missed.
    """
    size = max(64, BITS_PER_KEY * sum(len(o) for o, _ in parts))
    once, repeated = Filter(size), Filter(size)
    for seen, more in parts:
        repeated.add(seen[once.has(seen)])
        repeated.add(more)
        once.add(seen)
    return np.unique(np.concatenate([seen[repeated.has(seen)] for seen, _ in parts]))


def repeated_hashes(df: DataFrame, column: str, *, rows: int, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """One column ``h``: the values of ``column`` (64-bit hashes) that may occur repeatedly.

    Every repeated value is among them; a value that occurs once is, with a probability of
    about one in a hundred.  ``rows`` is the number of rows and sets the number of segments.
    A hash that a third of all rows carry is one hash per task.  NULLs are left out; an empty
    table gives no rows.
    """
    segments = max(1, -(-rows // segment_keys))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            segment = ((seen.view(np.uint64) >> np.uint64(24)) % np.uint64(segments)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            seen, times, segment = seen[order], times[order], segment[order]
            found, begin = np.unique(segment, return_index=True)
            ends = np.r_[begin[1:], len(seen)]
            once = [seen[a:b].tobytes() for a, b in zip(begin, ends)]
            more = [seen[a:b][times[a:b] > 1].tobytes() for a, b in zip(begin, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["segment", "once", "more"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= HELD:
                yield from hand_on()
        if held:
            yield from hand_on()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(o, np.int64), np.frombuffer(m, np.int64)) for o, m in zip(pdf["once"], pdf["more"])]
        return pd.DataFrame({"h": merge_parts(parts)})

    keys = df.select(F.col(f"`{column}`").cast("long").alias("h")).where("h is not null")
    parts = keys.mapInArrow(local, "segment long, once binary, more binary")
    return parts.groupBy("segment").applyInPandas(merge, "h long")
