"""Filling fixed-capacity containers: greedy fill, then best two-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.runtime import materialize

CAPACITY = 2048
#: Pieces packed by one task, about.
ITEMS_PER_TASK = 20_000
#: Poorly filled containers that a task hands on, to be packed again with those of as many
#: tasks.  It bounds the next round, whatever the sizes; full containers are never handed on.
HANDED_ON = 64


def cut_items(sizes: DataFrame, *, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity``: only longer items are cut, into full pieces and a rest.
    Items of NULL or no size give no piece.  Returns ``item, piece_no, start, size``."""
    n = F.col(f"`{size}`").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))
    return sizes.where(n > 0).select(
        F.col(f"`{item}`").alias("item"), n.alias("whole"), F.posexplode(starts).alias("piece_no", "start")
    ).select(
        "item", "piece_no", "start", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("start")).cast("int").alias("size")
    )


class Shelf:
    """Unpacked items by size, with a bit mask of the sizes at hand."""

    def __init__(self, capacity: int) -> None:
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.count = np.zeros(capacity + 1, np.int64)

    def put(self, size: int, index: int) -> None:
        self.by_size[size].append(index)
        self.mask |= 1 << size
        self.count[size] += 1

    def take(self, size: int) -> int:
        stack = self.by_size[size]
        index = stack.pop()
        self.count[size] -= 1
        if not stack:
            self.mask ^= 1 << size
        return index

    def largest(self, room: int) -> int:
        """Largest size at hand that fits, 0 if none."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.mask else 0

    def best_two(self, room: int) -> tuple[int, int]:
        """Two sizes at hand with the largest sum that fits."""
        have = self.count[: room + 1] > 0
        sizes = np.flatnonzero(have)
        if not len(sizes):
            return 0, 0
        upto = np.maximum.accumulate(np.where(have, np.arange(room + 1), 0))
        partner = upto[np.minimum(sizes, room - sizes)]
        alone = (partner == sizes) & (self.count[sizes] < 2)
        partner[alone] = upto[sizes[alone] - 1]
        total = np.where(partner > 0, sizes + partner, 0)
        k = int(np.argmax(total))
        return (int(sizes[k]), int(partner[k])) if total[k] else (0, 0)


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the items in each container; sizes are within 1..capacity.

    A container is filled greedily with the largest items that fit.  Then its smallest item
    is replaced by the two unpacked items that fit the widened gap most tightly, as long as
    they fill more than it did.
    """
    shelf = Shelf(capacity)
    for i in range(len(sizes) - 1, -1, -1):
        shelf.put(int(sizes[i]), i)
    bins = []
    while shelf.mask:
        content, room = [], capacity
        while size := max(0, shelf.largest(room)):
            content.append((size, shelf.take(size)))
            room -= size
        while room and shelf.mask:
            small, index = content[-1]
            a, b = shelf.best_two(room + small)
            if a + b <= small:
                break
            content.pop()
            content += [(a, shelf.take(a)), (b, shelf.take(b))]
            shelf.put(small, index)
            content.sort(key=lambda x: -x[0])
            room += small - a - b
        bins.append([i for _, i in content])
    return bins


def _packer(capacity: int, level: int, hand_on: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        items = pd.concat(parts, ignore_index=True)
        # The same order whatever way the rows came, so that a repeated task repeats itself.
        items = items.sort_values(["size", "item", "piece_no"], ignore_index=True)
        size = items["size"].to_numpy(np.int64)
        bins = pack(size, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(items))
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = items.iloc[order].reset_index(drop=True)
        filled = np.bincount(number, weights=size[order], minlength=len(bins))
        poor = np.zeros(len(bins), bool)
        if hand_on:
            worst = np.argsort(filled, kind="stable")[:hand_on]
            poor[worst[filled[worst] < capacity]] = True
        before = np.cumsum(size[order]) - size[order]
        first = np.r_[True, number[1:] != number[:-1]]
        offset = before - np.repeat(before[first], np.bincount(number))
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        out["container_id"] = (np.int64(level) << 58) + (np.int64(task) << 34) + number
        out["container_offset"] = offset.astype(np.int32)
        out["again"] = poor[number]
        yield out

    return run


def fill_containers(
    sizes: DataFrame,
    *,
    item: str,
    size: str,
    capacity: int = CAPACITY,
    items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """Containers of ``capacity`` holding every item once.

    Items are dealt to tasks by hash and packed there; each task hands its few worst
    containers on to the next, smaller round, so only the last round leaves room.  Equal
    sizes, repeated items and empty tables are fine; items of NULL or no size are left out.
    Pieces are written and counted first, as their number sets the number of tasks.
    Returns ``container_id, container_offset, item, piece_no, item_start, size``.
    """
    pieces = materialize(cut_items(sizes, item=item, size=size, capacity=capacity), "pieces")
    kind = dict(pieces.dtypes)["item"]
    schema = f"item {kind}, piece_no int, start long, size int, container_id long, container_offset int, again boolean"
    tasks = max(1, -(-pieces.count() // items_per_task))
    done, level = [], 0
    while True:
        dealt = pieces.repartition(tasks, F.xxhash64("item", "piece_no"))
        packed = dealt.mapInPandas(_packer(capacity, level, HANDED_ON if tasks > 1 else 0), schema)
        if tasks == 1:
            done.append(packed)
            break
        packed = materialize(packed, "containers")
        done.append(packed.where("not again"))
        pieces = packed.where("again").select("item", "piece_no", "start", "size")
        tasks, level = -(-tasks // HANDED_ON), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "container_id", "container_offset", F.col("item").alias(item), "piece_no", F.col("start").alias("item_start"), "size"
    )
