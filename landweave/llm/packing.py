"""Filling containers of fixed capacity with items of varying length, never splitting one that fits.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity``
counts, whatever the number of items; it is the only thing that reaches the driver. There the
Martello-Toth reduction fixes sets that dominate all others that hold an item: an item alone
where nothing fits beside it, a pair that fills the container exactly, and the largest partner
where no two others fit, or no two that fit hold more than it. What remains goes best-fit
decreasing. Both work on sizes with multiplicities, which gives the same containers as
item by item. Items get their rank among those of their size from counts of salted groups, so a
size that a third of all items share is ranked in many tasks, and a rank's container is read off
a table with a slot for each size of each kind of container, of which there are at most as many as sizes and steps of the filling.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups into which the items of one size are salted for ranking.
SALT = 128

Group = tuple[int, dict[int, int]]


def _reduce(count: dict[int, int], capacity: int) -> list[Group]:
    """Fixes dominating sets and takes their items out of ``count``."""
    sizes = sorted(count)
    fixed: list[Group] = []

    def take(pattern: dict[int, int], m: int) -> None:
        fixed.append((m, pattern))
        for s, t in pattern.items():
            count[s] -= m * t
            if not count[s]:
                sizes.pop(bisect_left(sizes, s))
                del count[s]

    def smallest(k: int, without: int) -> int:
        """Sum of the k least items besides one of size ``without``."""
        total = need = 0
        for s in sizes:
            n = min(k - need, count[s] - (s == without))
            total, need = total + n * s, need + n
            if need == k:
                return total
        return capacity + 1

    def best_pair(room: int, without: int) -> int:
        best, lo, hi = 0, 0, bisect_right(sizes, room) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            spare = count[a] - (a == without), count[b] - (b == without)
            ok = spare[0] > (a == b) and spare[1] > 0
            if a + b <= room:
                best = max(best, a + b) if ok else best
                lo += 1
            else:
                hi -= 1
        return best

    changed = True
    while changed:
        changed = False
        for s in sorted(count, reverse=True):
            while count.get(s):
                room = capacity - s
                fit = bisect_right(sizes, room) - 1
                if fit >= 0 and sizes[fit] == s and count[s] == 1:
                    fit -= 1
                if fit < 0:
                    take({s: 1}, count[s] if room < s else 1)  # beside itself it would fit, but it is the last of its size
                    changed = True
                    continue
                k = sizes[fit]
                pair_ok = k == room or smallest(2, s) > room or (smallest(3, s) > room and best_pair(room, s) <= k)
                if not pair_ok:
                    break
                # What is taken leaves fewer items, so sums of the least only grow and the best pair only
                # shrinks: the test stays true for every further set of these two sizes.
                if k == s:
                    take({s: 2}, count[s] // 2)
                else:
                    take({s: 1, k: 1}, min(count[s], count[k]))
                changed = True
    return fixed


def _best_fit(count: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over sizes with multiplicities; containers alike are kept together."""
    rooms: list[int] = []
    open_: dict[int, list[Group]] = defaultdict(list)

    def put(room: int, group: Group) -> None:
        if room not in open_:
            insort(rooms, room)
        open_[room].append(group)

    for s in sorted(count, reverse=True):
        left = count[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                m, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, m, pattern = capacity, left, {}
            t = room // s
            full = min(m, left // t)
            if full:
                put(room - t * s, (full, {**pattern, s: t}))
                left -= full * t
            elif left:
                put(room - left * s, (1, {**pattern, s: left}))
                full, left = 1, 0
            if m > full and pattern:
                put(room, (m - full, pattern))
    return [g for groups in open_.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """(number, {size: items}) of containers that hold all items of the histogram."""
    count = {s: n for s, n in histogram.items() if n > 0}
    return _reduce(count, capacity) + _best_fit(count, capacity)


def ranked(items: DataFrame, size: str, order: str) -> DataFrame:
    """Adds ``rank``, from 0, among the items of one size, by salted groups and their counts."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALT)).cast("int"))
    groups = salted.groupBy(size, "_salt").agg(F.count("*").alias("_n"))
    # At most SALT rows a size.
    before = groups.withColumn("_before", F.sum("_n").over(Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    local = salted.withColumn("_local", F.row_number().over(Window.partitionBy(size, "_salt").orderBy(order)) - 1)
    return local.join(before.drop("_n"), [size, "_salt"]).withColumn("rank", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_salt", "_local", "_before")


def fill(items: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(key, part, size, container_id): every item of positive length in one container.

    An item longer than the capacity is cut into full parts, each a container of its own, and a
    last part that is packed like any item. Items of null, zero or negative length have no part.
    Keys must be unique; containers are numbered from 0.
    """
    n = F.col(length)
    parts = items.where(n > 0).select(key, F.posexplode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("long"))).alias("part", "_i"), n.alias("_n"))
    parts = parts.select(key, "part", F.least(F.lit(capacity), F.col("_n") - F.col("_i") * capacity).cast("int").alias("size"))
    parts = parts.withColumn("_order", F.struct(key, "part"))
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    groups = plan(histogram, capacity)
    starts: list[tuple[int, int, int, int]] = []  # size, first rank, first container, containers
    used: dict[int, int] = defaultdict(int)
    first = 0
    for m, pattern in groups:
        for s, t in pattern.items():
            starts.append((s, used[s], first, m))
            used[s] += m * t
        first += m
    starts.sort()
    bits = 44  # ranks below 2**44 beside sizes below 2**19
    keys = np.array([(s << bits) + r for s, r, _, _ in starts], dtype=np.int64)
    table = np.array([x[1:] for x in starts], dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        slot = table[np.searchsorted(keys, (size.to_numpy(np.int64) << bits) + rank.to_numpy(np.int64), side="right") - 1]
        return pd.Series(slot[:, 1] + (rank.to_numpy(np.int64) - slot[:, 0]) % slot[:, 2])

    return ranked(parts, "size", "_order").select(key, "part", "size", container("size", "rank").alias("container_id"))


def fill_of(parts: DataFrame, capacity: int) -> DataFrame:
    """Containers, items and unused share over all containers of ``fill``."""
    return parts.agg(
        F.count_distinct("container_id").alias("containers"), F.count("*").alias("parts"), F.sum("size").alias("tokens"),
    ).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * capacity))
