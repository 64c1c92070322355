"""Filling fixed-capacity windows by multiway Karmarkar-Karp differencing.

An item above the capacity is cut: its full windows stand alone, the rest is an item like any other. Items are hashed into
groups of bounded size; within a group, the two partial partitions with the widest imbalance are merged, the fullest
slots of one with the emptiest of the other, until one near-equal partition is left. Where its fullest window exceeds the
capacity, the fullest and the emptiest windows are paired and each pair is halved anew, exactly, by subset sums; if
that doesn't bring every window under the capacity, the number of windows rises: what is too much leaves its window for
one with room, or is differenced again into further windows.

Defined results: items of size 0 or null are in no window; equal sizes are ordered by key; an empty table gives no rows;
repeated keys are items of their own (told apart by ``piece`` only if cut).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a group aims at.
GROUP = 4096
PLACED = "window_id string, item_key bigint, piece int, n_tokens int, offset int"


def partition(sizes: np.ndarray, m: int) -> np.ndarray:
    """Slot of each item in a near-equal partition into ``m`` slots, by largest differencing."""
    n = len(sizes)
    left, right = np.full(2 * n * 1, -1), np.full(2 * n * 1, -1)
    made = n
    grow = lambda a: np.concatenate([a, np.full(len(a), -1)])
    heap, parts = [], []
    for i in range(n):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = sizes[i], i
        parts.append((sums, nodes))
        heap.append((-int(sizes[i]) if m > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = parts[a], parts[b]
        parts[a] = parts[b] = None
        sums, nb = sa + sb[::-1], nb[::-1]
        nodes = np.where(na < 0, nb, na)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            while made + len(both) > len(left):
                left, right = grow(left), grow(right)
            ids = np.arange(made, made + len(both))
            left[ids], right[ids], nodes[both] = na[both], nb[both], ids
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]  # only differences matter
        parts.append((sums, nodes))
        heapq.heappush(heap, (-int(sums[0]), len(parts) - 1))
    slots = np.empty(n, np.int64)
    for slot, root in enumerate(parts[heap[0][1]][1]):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                slots[x] = slot
            else:
                stack += [left[x], right[x]]
    return slots


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: items above half the capacity need windows of their own, and the rest must fit."""
    return max(1, math.ceil(sizes.sum() / capacity), int((2 * sizes > capacity).sum()))


def halve(sizes: list[int]) -> list[int]:
    """Places of the items of one side, the sides' sums as near to each other as can be."""
    reach, total = [1], sum(sizes)
    for x in sizes:
        reach.append(reach[-1] | reach[-1] << x)
    below = reach[-1] & ((1 << (total // 2 + 1)) - 1)
    at, side = below.bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            side.append(i)
            at -= sizes[i]
    return side


def even_out(sizes: np.ndarray, slots: np.ndarray, m: int, capacity: int, rounds: int = 12) -> np.ndarray:
    """Pair windows of opposing imbalance and halve each pair, until none exceeds the capacity; each round shifts the partners."""
    slots = slots.copy()
    for r in range(rounds):
        sums = np.bincount(slots, weights=sizes, minlength=m).astype(np.int64)
        order = np.argsort(-sums, kind="stable")
        if sums[order[0]] <= capacity:
            break
        members: dict[int, list[int]] = {int(x): [] for x in order}
        for i, x in enumerate(slots.tolist()):
            members[x].append(i)
        n_over = int((sums > capacity).sum())
        partners = np.roll(order[n_over:][::-1], -r * max(1, n_over // 2))
        for full, empty in zip(order[:n_over].tolist(), partners.tolist()):
            both = members[full] + members[empty]
            side = halve([int(sizes[i]) for i in both])
            part = sum(int(sizes[both[i]]) for i in side)
            if max(part, int(sums[full] + sums[empty]) - part) < sums[full]:
                slots[both] = full
                slots[[both[i] for i in side]] = empty
    return slots


def evict(sizes: np.ndarray, slots: np.ndarray, m: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Take out of each window above the capacity the fewest tokens that bring it under, and put them where room is best used.

    Gives the slots (-1: no room anywhere) and the places of the items left over."""
    slots = slots.copy()
    sums = np.bincount(slots, weights=sizes, minlength=m).astype(np.int64)
    out: list[int] = []
    for w in np.flatnonzero(sums > capacity).tolist():
        own = sorted(np.flatnonzero(slots == w).tolist(), key=lambda i: (sizes[i], i))
        while (excess := sums[w] - capacity) > 0:
            i = next((i for i in own if sizes[i] >= excess), own[-1])
            own.remove(i)
            sums[w] -= sizes[i]
            out.append(i)
    left = []
    for i in sorted(out, key=lambda i: (-sizes[i], i)):
        room = capacity - sums - sizes[i]
        w = int(np.argmin(np.where(room >= 0, room, capacity + 1)))
        if room[w] >= 0:
            slots[i], sums[w] = w, sums[w] + sizes[i]
        else:
            slots[i] = -1
            left.append(i)
    return slots, np.array(left, np.int64)


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item (sizes in descending order); none exceeds the capacity."""
    slots, todo, made = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), 0
    while len(todo):
        part = sizes[todo]
        m = least_windows(part, capacity)
        own = even_out(part, partition(part, m), m, capacity)
        own, left = evict(part, own, m, capacity)
        placed = own >= 0
        slots[todo[placed]] = own[placed] + made
        todo, made = todo[np.sort(left)], made + m
    return slots


def _place(capacity: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("item_key", "ascending"), ("piece", "ascending")])
        sizes = t["n_tokens"].to_numpy().astype(np.int64)
        slots = fill(sizes, capacity)
        order = np.argsort(slots, kind="stable")
        s, z = slots[order], sizes[order]
        before = np.cumsum(z) - z
        starts = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        offset = before - np.repeat(before[starts], np.diff(np.r_[np.flatnonzero(starts), len(s)]))
        group = key[0].as_py()
        t = t.take(order)
        return pa.table({"window_id": pa.array([f"g{group}:{x}" for x in s.tolist()], pa.string()), "item_key": t["item_key"], "piece": t["piece"], "n_tokens": t["n_tokens"], "offset": pa.array(offset.astype(np.int32))})

    return run


def pack(items: DataFrame, n_items: int, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """``items``: (item_key bigint, n_tokens). Gives PLACED rows, one per item or piece of a cut item."""
    items = items.where(F.col("n_tokens") > 0).select("item_key", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    cap = F.lit(capacity).cast("bigint")
    full = F.floor(F.col("n_tokens") / cap).cast("int")
    whole = items.where(F.col("n_tokens") >= capacity).select("item_key", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select(F.concat(F.lit("d"), "item_key", F.lit(":"), "piece").alias("window_id"), "item_key", "piece", F.lit(capacity).alias("n_tokens"), F.lit(0).alias("offset"))
    rest = items.select("item_key", full.alias("piece"), (F.col("n_tokens") % cap).cast("int").alias("n_tokens")).where("n_tokens > 0")
    groups = max(1, math.ceil(n_items / group))
    # sizes are small and filling is not: without a number of partitions of their own, all groups would be put into one task
    placed = rest.withColumn("g", F.pmod(F.xxhash64("item_key", "piece"), F.lit(groups)).cast("int")).repartition(groups, "g").groupBy("g").applyInArrow(_place(capacity), PLACED)
    return placed.unionByName(whole)
