"""Filling fixed-capacity containers with items of varying length.

Only the histogram of item lengths goes to the driver: at most `capacity` numbers, however
many items there are. There, containers are planned as patterns (a multiset of lengths and
how often it is used): combinations of two, three or four lengths that fill a container
exactly are found by the complement of the longest one and consumed as often as their counts
allow; what is left is packed best-fit. The items then get their places in the patterns by
their rank among the items of their length, without any group meeting in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items of one length are ranked in this many blocks, so a frequent length is no single group.
BLOCKS = 256


@dataclass
class Plan:
    """Slots by length: of items ranked `begin` to `end`, `each` go to a container, from `container` on."""

    length: np.ndarray
    begin: np.ndarray
    each: np.ndarray
    container: np.ndarray
    containers: int


class _Stock:
    """How many items of each length are left, and which sums of two they can make."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.copy()
        self._pairs: np.ndarray | None = None

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times
            if self.counts[x] <= 1:
                self._pairs = None

    def times(self, lengths: list[int]) -> int:
        need = np.bincount(lengths)
        used = np.flatnonzero(need)
        return int((self.counts[used] // need[used]).min())

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.counts[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """Two lengths that sum to `gap`, the larger one as large as can be."""
        a = np.arange(1, gap // 2 + 1)
        there = (self.counts[a] > 0) & (self.counts[gap - a] > 0) & ((a != gap - a) | (self.counts[a] > 1))
        hit = np.flatnonzero(there)
        return [gap - int(a[hit[0]]), int(a[hit[0]])] if len(hit) else None

    @property
    def pairs(self) -> np.ndarray:
        """Index of pair sums: whether two items sum to each number (counts of one aside)."""
        if self._pairs is None:
            n = len(self.counts)
            size = 1 << (2 * n - 1).bit_length()
            f = np.fft.rfft((self.counts > 0).astype(float), size)
            self._pairs = np.fft.irfft(f * f, size)[:n] > 0.5
        return self._pairs

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths that sum to `gap`, through the index of pair sums."""
        a = np.flatnonzero(self.counts[: gap - 1] > 0)[::-1]
        for first in a[self.pairs[gap - a]]:
            self.counts[first] -= 1
            rest = self.pair(gap - int(first))
            self.counts[first] += 1
            if rest:
                return [int(first), *rest]
        return None


def plan_containers(counts: np.ndarray, capacity: int) -> Plan:
    """Pack counts[length] items of every length from 1 to `capacity`."""
    stock = _Stock(counts)
    patterns: list[tuple[list[int], int]] = []
    left: list[tuple[int, int]] = []
    for longest in range(capacity, 0, -1):
        while stock.counts[longest] > 0:
            if longest == capacity:
                found: list[int] | None = []
            else:
                stock.counts[longest] -= 1
                gap = capacity - longest
                found = stock.single(gap) or stock.pair(gap) or (stock.triple(gap) if gap > 2 else None)
                stock.counts[longest] += 1
            if found is None:
                left.append((longest, int(stock.counts[longest])))
                stock.take([longest], int(stock.counts[longest]))
                break
            lengths = [longest, *found]
            times = stock.times(lengths)
            patterns.append((lengths, times))
            stock.take(lengths, times)
    patterns += _best_fit(left, capacity)
    return _slots(patterns, capacity)


def _best_fit(left: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counted lengths; alike containers are kept as one group."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        open_.setdefault(gap, []).append((lengths, times))
        gaps[gap] = True

    for length, count in left:
        while count:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                lengths, times = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                some = min(times, count)
                put([*lengths, length], some)
                if times > some:
                    put(lengths, times - some)
                count -= some
            else:
                each = capacity // length
                if count >= each:
                    put([length] * each, count // each)
                if count % each:
                    put([length] * (count % each), 1)
                count = 0
    return [p for group in open_.values() for p in group]


def _slots(patterns: list[tuple[list[int], int]], capacity: int) -> Plan:
    used = np.zeros(capacity + 1, np.int64)
    rows, container = [], 0
    for lengths, times in patterns:
        need = np.bincount(lengths)
        for x in np.flatnonzero(need):
            rows.append((int(x), int(used[x]), int(need[x]), container))
            used[x] += int(need[x]) * times
        container += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], container)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Assign every item to a container: (id, part, start, size, container).

    No container holds more than `capacity`. An item is split only if it alone exceeds the
    capacity: into full containers and one rest, numbered by part from 0, `start` being where
    the part begins in the item. Items of size 0 or null take no space and are spread over
    the containers (over container 0 if there is no other); repeated ids are items of their
    own. An empty table gives no rows.
    """
    kind = items.schema[id_col].dataType.simpleString()
    sized = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)).cast("int")
    parts = sized.select("id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("part")).select(
        "id", "part", (F.col("part").cast("bigint") * capacity).alias("start"),
        F.least(F.col("whole") - F.col("part").cast("bigint") * capacity, F.lit(capacity)).cast("int").alias("size"),
    )
    blocked = parts.withColumn("block", F.pmod(F.xxhash64("id", "part"), F.lit(BLOCKS)).cast("int"))
    # at most (capacity + 1) * BLOCKS rows, whatever the number of items, and no more than there are items
    sums = blocked.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes, n = sums["size"].to_numpy().astype(np.int64), sums["n"].to_numpy().astype(np.int64)
    cells = sizes * BLOCKS + sums["block"].to_numpy()
    order = np.argsort(cells)
    cells, sizes, n = cells[order], sizes[order], n[order]
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, sizes, n)
    counts[0], empty = 0, counts[0]
    plan = plan_containers(counts, capacity)
    counts[0] = empty
    # how many items of a cell's size the blocks before it have
    before = np.cumsum(n) - n - (np.cumsum(counts) - counts)[sizes]
    shared = items.sparkSession.sparkContext.broadcast((plan, cells, before))
    # sorted, so that a recomputed partition ranks its items the same way
    ranked = blocked.repartition("size", "block").sortWithinPartitions("size", "block", "id", "part")

    def place(batches):
        p, known, offsets = shared.value
        keys = p.length << 44 | p.begin
        seen: dict[int, int] = {}
        for batch in batches:
            size = np.asarray(batch.column(3)).astype(np.int64)
            cell = size * BLOCKS + np.asarray(batch.column(4))
            order = np.argsort(cell, kind="stable")
            sorted_ = cell[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(sorted_)])
            runs = np.diff(np.r_[first, len(sorted_)])
            inner = np.arange(len(sorted_)) - np.repeat(first, runs)
            base = np.array([seen.get(int(c), 0) for c in sorted_[first]], np.int64)
            for c, n in zip(sorted_[first], runs):
                seen[int(c)] = seen.get(int(c), 0) + int(n)
            rank = np.empty(len(cell), np.int64)
            rank[order] = inner + np.repeat(base, runs) + offsets[np.searchsorted(known, sorted_)]
            slot = np.maximum(np.searchsorted(keys, size << 44 | rank, side="right") - 1, 0)
            where = rank % max(p.containers, 1)
            full = size > 0
            s = slot[full]
            where[full] = p.container[s] + (rank[full] - p.begin[s]) // p.each[s]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(where, pa.int64())], names=["id", "part", "start", "size", "container"]
            )

    return ranked.mapInArrow(place, f"id {kind}, part int, start bigint, size int, container bigint")


def pack_each(items: DataFrame, id_col: str, size_col: str, capacities: dict[int, int]) -> DataFrame:
    """pack() for each capacity by its limit id: (limit_id, capacity, ...), over sizes computed once."""
    kept = cut(items.select(id_col, size_col), "sizes")
    out = None
    for limit, capacity in sorted(capacities.items()):
        one = pack(kept, id_col, size_col, capacity).select(F.lit(limit).alias("limit_id"), F.lit(capacity).alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    return out
