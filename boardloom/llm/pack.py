"""Filling containers of fixed capacity: minimum bin slack over the histogram of lengths.

Per container the fullest feasible combination of available lengths is found by subset-sum dynamic programming over bit
sets, the first remaining length in order always taken; the combination is repeated while its lengths last, then removed. The
plan depends on lengths and their counts alone: the histogram has at most `capacity` rows, and a combination is repeated
until one of its lengths no longer reaches as often, so there are at most capacity * (1 + ln capacity) combinations,
whatever the number of items. Items are then ranked within their length, in salted parts, and looked up in the plan.

Defined results: an item longer than the capacity is cut into full containers and a rest, which is packed as an item; items
of no length (null and empty texts) take no room and come out with container null; equal lengths are told apart by id;
row ids are taken to be unique (rows that repeat an id are items of their own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.tables import written

#: Items in one salted part of a length, about.
PART_ROWS = 100_000


def fullest(counts: dict[int, int], room: int, order=lambda x: -x) -> dict[int, int]:
    """How often to take each length so that the sum comes as near to `room` from below as can be; those first in `order`, longer ones unless told otherwise."""
    full = (1 << (room + 1)) - 1
    goal, reach = 1 << room, 1
    steps: list[tuple[int, int, int]] = []  # (length, how many, reach before)
    for length in sorted((x for x, n in counts.items() if n and x <= room), key=order):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def _longest(left: dict[int, int]):
    return lambda x: -x


def _heaviest(left: dict[int, int]):
    """Lengths that hold the most tokens yet come first, so that all lengths run out together."""
    return lambda x: (-left[x] * x, -x)


_ORDERS = (_longest, _heaviest)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of containers filled with it), until no item is left: of a plan for each order of lengths,
    that of the fewest containers. Where one length holds much of all tokens, longest first would leave it over."""
    return min((_plan(histogram, capacity, order) for order in _ORDERS), key=lambda steps: sum(times for _, times in steps))


def _plan(histogram: dict[int, int], capacity: int, order) -> list[tuple[dict[int, int], int]]:
    left = {x: n for x, n in histogram.items() if n}
    out = []
    while left:
        key = order(left)
        first = min(left, key=key)
        left[first] -= 1
        combination = fullest(left, capacity - first, key)
        left[first] += 1
        combination[first] = combination.get(first, 0) + 1
        times = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((combination, times))
    return out


def segments(steps: list[tuple[dict[int, int], int]], first: int) -> pd.DataFrame:
    """Per length the ranks [start, start + n * times) and the containers they go to, n to each from `base` on."""
    used: dict[int, int] = {}
    rows = []
    for combination, times in steps:
        for x, n in combination.items():
            rows.append((x, used.get(x, 0), first, n))
            used[x] = used.get(x, 0) + n * times
        first += times
    return pd.DataFrame(rows, columns=["tokens", "start", "base", "each"]).sort_values(["tokens", "start"], ignore_index=True)


def _ranked(items: DataFrame, key: list[str], order: list[str], rows: int) -> DataFrame:
    """`items` with `rank` from 0 within `key`: numbered in salted parts, each shifted by the sizes of those before it."""
    items = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(max(1, rows // PART_ROWS))).cast("int"))
    sizes = items.groupBy(*key, "_salt").count()
    shift = sizes.select(*key, "_salt", (F.sum("count").over(Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_shift"))
    own = items.withColumn("_own", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(*order)) - 1)
    return own.join(shift, [*key, "_salt"]).withColumn("rank", F.col("_own") + F.col("_shift")).drop("_own", "_shift", "_salt")


def pack(sizes: DataFrame, row_id: str, size: str, capacity: int) -> DataFrame:
    """(row_id, piece, first_token, tokens, container): piece counts from 0, containers from 0."""
    s = F.coalesce(F.col(size).cast("long"), F.lit(0))
    whole = sizes.select(F.col(row_id).alias("_id"), s.alias("_n"))
    pieces = F.when(F.col("_n") <= capacity, F.array(F.col("_n"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {capacity} as int)")), lambda k: F.least(F.lit(capacity).cast("long"), F.col("_n") - k * capacity))
    )
    items = written(whole.select("_id", F.posexplode(pieces).alias("piece", "tokens")).withColumn("tokens", F.col("tokens").cast("int")), "items")
    counts = {r["tokens"]: r["count"] for r in items.groupBy("tokens").count().collect()}  # at most capacity + 1 rows
    counts.pop(0, None)
    table = segments(plan(counts, capacity), 0)
    rank = _ranked(items.filter("tokens > 0"), ["tokens"], ["_id", "piece"], sum(counts.values()))
    starts = {int(x): (g["start"].to_numpy(), g["base"].to_numpy(), g["each"].to_numpy()) for x, g in table.groupby("tokens")}
    shared = items.sparkSession.sparkContext.broadcast(starts)  # bounded by the capacity, see above

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = np.zeros(len(b), np.int64)
            lengths, ranks = b["tokens"].to_numpy(), b["rank"].to_numpy()
            for x in np.unique(lengths):
                at = lengths == x
                start, base, each = shared.value[int(x)]
                k = np.searchsorted(start, ranks[at], side="right") - 1
                to[at] = base[k] + (ranks[at] - start[k]) // each[k]
            yield b.drop(columns="rank").assign(container=to)

    kind = sizes.schema[row_id].dataType.simpleString()
    filled = rank.select("_id", "piece", "tokens", "rank").mapInPandas(look_up, f"_id {kind}, piece int, tokens int, container long")
    none = items.filter("tokens = 0").withColumn("container", F.lit(None).cast("long"))
    return filled.unionByName(none).select(F.col("_id").alias(row_id), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens", "container")
