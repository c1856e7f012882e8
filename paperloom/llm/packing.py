"""Filling fixed-capacity containers with items (problem 9).

Best-two-fit: a container is filled greedily with the largest items that fit;
then its smallest item is replaced by two unpacked items that together fit the
gap so widened more tightly, while that gains space.  An item is split only if
it exceeds the capacity: its full pieces are containers of their own and the
rest is packed like any item.

Items are dealt at random (by a hash of their key) into shards of at most
about ``SHARD`` items, so each shard has the size mix of the whole, is one
bounded task, and loses at most about one container.  Only keys and sizes are
shuffled.  A shard is packed by counts per size: the search for the pair is a
vector operation over sizes, not over items.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paperloom.plans.scratch import Scratch

SHARD = 50_000


class Sizes:
    """Multiset of sizes up to ``capacity`` with the largest present size at most x."""

    def __init__(self, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        self.at_most = np.zeros(capacity + 1, np.int64)
        self.total = 0

    def refresh(self) -> None:
        present = np.where(self.count > 0, np.arange(len(self.count)), 0)
        self.at_most = np.maximum.accumulate(present)

    def fill(self, sizes: np.ndarray) -> None:
        self.count += np.bincount(sizes, minlength=len(self.count))
        self.total = len(sizes)
        self.refresh()

    def _span(self, s: int, to: int) -> None:
        """Sizes from ``s`` on that pointed to ``s``, or should now, point to ``to``."""
        e = s
        while e < len(self.at_most) and self.at_most[e] <= s:
            e += 64
        block = self.at_most[s : min(e, len(self.at_most))]
        block[block <= s] = to

    def take(self, s: int) -> None:
        self.count[s] -= 1
        self.total -= 1
        if not self.count[s]:
            self._span(s, int(self.at_most[s - 1]))

    def give(self, s: int) -> None:
        self.count[s] += 1
        self.total += 1
        if self.count[s] == 1:
            self._span(s, s)

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two present items with the largest sum at most ``room``; (0, 0) if there are none."""
        a = np.flatnonzero(self.count[: room // 2 + 1])
        a = a[a > 0]
        if not len(a):
            return 0, 0
        b = self.at_most[room - a]
        same = (b == a) & (self.count[a] < 2)
        b = np.where(same, self.at_most[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        i = int(total.argmax())
        return (int(a[i]), int(b[i])) if total[i] else (0, 0)


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is between 1 and ``capacity``."""
    left = Sizes(capacity)
    left.fill(sizes)
    containers = []
    while left.total:
        inside, gap = [], capacity
        while gap and (s := int(left.at_most[gap])):
            left.take(s)
            inside.append(s)
            gap -= s
        while gap and left.total > 1:
            smallest = inside[-1]
            a, b = left.best_pair(gap + smallest)
            if a + b <= smallest:
                break
            left.take(a)
            left.take(b)
            left.give(smallest)
            inside[-1:] = sorted((a, b), reverse=True)
            inside.sort(reverse=True)
            gap += smallest - a - b
        containers.append(inside)
    return containers


def packed(items: DataFrame, capacities: DataFrame, shard: int = SHARD) -> DataFrame:
    """(capacity_id, container_id, item_id, piece, first_token, n_tokens), one row per piece.

    ``items``: item_id (unique, long) and n_tokens; null sizes count as 0.  An
    item of size 0 takes the container of the first item of its shard.  Rows
    of ``capacities`` without a positive capacity are left out, repeated ones
    count once.  No items or no capacities give no rows.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    caps = capacities.select(F.col("capacity_id").cast("long").alias("capacity_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct()
    items = Scratch(items.sparkSession).put(items)  # sizes cost an encoding of all texts; they are counted and then packed
    shards = max(1, -(-items.count() // shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))).crossJoin(F.broadcast(caps))  # a handful of capacities: rows are copied per capacity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, cap_id, part = int(pdf.capacity.iloc[0]), int(pdf.capacity_id.iloc[0]), int(pdf.shard.iloc[0])
        pdf = pdf.sort_values("item_id")
        ids, n = pdf.item_id.to_numpy(), pdf.n_tokens.to_numpy()
        full, rest = n // capacity, n % capacity
        rows_id, rows_piece, rows_first, rows_n, rows_c = [], [], [], [], []
        container = 0
        for i in np.flatnonzero(full):
            k = int(full[i])
            rows_id += [ids[i]] * k
            rows_piece += range(k)
            rows_first += [p * capacity for p in range(k)]
            rows_n += [capacity] * k
            rows_c += range(container, container + k)
            container += k
        waiting: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(rest)[::-1]:
            waiting[int(rest[i])].append(int(i))
        for inside in pack(rest[rest > 0], capacity):
            for s in inside:
                i = waiting[s].pop()
                rows_id.append(ids[i])
                rows_piece.append(int(full[i]))
                rows_first.append(int(full[i]) * capacity)
                rows_n.append(s)
                rows_c.append(container)
            container += 1
        for i in np.flatnonzero(n == 0):
            rows_id.append(ids[i])
            rows_piece.append(0)
            rows_first.append(0)
            rows_n.append(0)
            rows_c.append(0)
        return pd.DataFrame({"capacity_id": cap_id, "container_id": np.array(rows_c, np.int64) * shards + part, "item_id": np.array(rows_id, np.int64), "piece": np.array(rows_piece, np.int32), "first_token": np.array(rows_first, np.int64), "n_tokens": np.array(rows_n, np.int64)})

    return dealt.groupBy("capacity_id", "shard").applyInPandas(run, "capacity_id long, container_id long, item_id long, piece int, first_token long, n_tokens long")


def use_of_space(pieces: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and share of space used per capacity."""
    caps = capacities.select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    filled = pieces.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    sums = filled.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return sums.join(caps, "capacity_id").select("capacity_id", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))
