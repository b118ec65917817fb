"""References to records that do not exist: missing, already removed, or not there yet at the time of the reference.

Keys are spread by hash and read in its order, a stretch at a time (a key range), within which a dictionary encodes them as
integers. Of each range and day one compressed bitmap holds the keys referred to, one
the keys that hold through the whole day; reference AND-NOT parent leaves the keys that may be orphans, which are
decoded. (Days, not months: a record is mostly younger than its parents by hours, so hardly a key held through its month.) An exact check of the surviving keys at the very times follows, by running sums of starts and ends per key and
day over carried sums of the days before, so that no key, however hot, is one unit of work.

Defined results: null, empty and blank keys are no references, and neither are references without a time; a parent
without a start holds from ever, without an end for ever, one that ends at or before its start never; repeated rows
count once; keys are compared without letter case and outer blanks; extra columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.operators import bitmaps
from boardloom.tables import stripped, written

#: Rows of one key range, about: a range ends where the hash changes next.
RANGE_ROWS = 200_000
EVER, NEVER = -(10**6), 10**6
_KEY = ["rel", "scope", "key"]


def references(df: DataFrame, rel: str, row_id: str, scope, key, at, upper: bool = True) -> DataFrame:
    """(rel, row_id, scope, key, ref_key, at, day) of references; key may be an array of them."""
    if isinstance(df.select(key.alias("k")).schema["k"].dataType.simpleString(), str) and df.select(key.alias("k")).schema["k"].dataType.simpleString().startswith("array"):
        df = df.select(F.col(row_id).alias("_id"), scope.alias("_scope"), at.alias("_at"), F.explode(F.array_distinct(F.transform(key, stripped))).alias("_key"))
    else:
        df = df.select(F.col(row_id).alias("_id"), scope.alias("_scope"), at.alias("_at"), stripped(key).alias("_key"))
    df = df.filter(F.col("_key").isNotNull() & (F.col("_key") != "") & F.col("_at").isNotNull())
    return df.select(
        F.lit(rel).alias("rel"), F.col("_id").cast("long").alias("row_id"), F.coalesce("_scope", F.lit("")).alias("scope"), F.upper("_key").alias("key"),
        (F.upper("_key") if upper else F.col("_key")).alias("ref_key"), F.col("_at").alias("at"), _day(F.col("_at")).alias("day"),
    )


def parents(df: DataFrame, rel: str, scope, key, start, end) -> DataFrame:
    """(rel, scope, key, start, end) of the rows that references of `rel` must find."""
    df = df.select(F.lit(rel).alias("rel"), F.coalesce(scope, F.lit("")).alias("scope"), F.upper(stripped(key)).alias("key"), start.alias("start"), end.alias("end"))
    return df.filter(F.col("key").isNotNull() & (F.col("key") != "") & (F.col("end").isNull() | F.col("start").isNull() | (F.col("end") > F.col("start"))))


def _day(t) -> F.Column:
    return F.unix_date(F.to_date(t))


def _ranges(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Stretches of rows in order of their hash, of `rows` rows and more, no hash in two of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        h = t.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _left(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The (rel, scope, key, day) of a key range that are referred to and not held through the day."""
    ref = t.column("is_ref").to_numpy()
    if not ref.any():
        return
    names = pc.binary_join_element_wise(*(t.column(c) for c in _KEY), "\0").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64)
    a, b = t.column("a").to_numpy().astype(np.int64), t.column("b").to_numpy().astype(np.int64)
    # codes are given in order of first appearance
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    low, high = a[ref].min(), a[ref].max()
    o = ~ref & (b > low) & (a <= high)
    # starts and ends of cover by whole days, swept in ascending order of days
    steps = np.concatenate([np.stack([np.maximum(a[o], low), code[o], np.ones(o.sum(), np.int64)], 1), np.stack([b[o], code[o], -np.ones(o.sum(), np.int64)], 1)])
    steps = steps[np.argsort(steps[:, 0], kind="stable")]
    held, at = np.zeros(len(first), np.int32), 0
    order = np.argsort(a[ref], kind="stable")
    days, codes = a[ref][order], code[ref][order]
    for day in np.unique(days):
        to = np.searchsorted(steps[:, 0], day, side="right")
        np.add.at(held, steps[at:to, 1], steps[at:to, 2].astype(np.int32))
        at = to
        asked = bitmaps.pack(codes[np.searchsorted(days, day) : np.searchsorted(days, day, side="right")])
        left = bitmaps.unpack(bitmaps.and_not(asked, bitmaps.pack(np.flatnonzero(held > 0))))
        if len(left):
            rows = t.select(_KEY).take(pa.array(first[left])).append_column("day", pa.array(np.full(len(left), day, np.int32)))
            yield from rows.combine_chunks().to_batches()


def candidates(refs: DataFrame, owners: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(rel, scope, key, day) referred to on the day and not held through the whole of it, by bitmaps per key range and day."""
    pairs = refs.select(*_KEY, F.lit(True).alias("is_ref"), F.col("day").alias("a"), F.col("day").alias("b")).distinct()
    begins, full = _day(F.col("start")), F.date_trunc("day", "start") == F.col("start")
    whole = owners.select(*_KEY, F.lit(False).alias("is_ref"), F.coalesce(F.when(full, begins).otherwise(begins + 1), F.lit(EVER)).alias("a"), F.coalesce(_day(F.col("end")), F.lit(NEVER)).alias("b"))
    both = pairs.unionByName(whole.filter("a < b").distinct()).withColumn("h", F.xxhash64(*_KEY))
    # a number of partitions of its own: rows are few bytes but much work, and would be put together
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = both.repartition(n, "h").sortWithinPartitions("h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _ranges(batches, rows):
            yield from _left(t)

    return spread.mapInArrow(work, "rel string, scope string, key string, day int")


def orphans(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """(rel, row_id, ref_key, at) of each reference with no row of its key holding at its time; repeated rows once."""
    maybe = written(candidates(refs, owners), "maybe")
    asked = written(refs.join(maybe, [*_KEY, "day"], "left_semi").distinct(), "asked")
    keys = maybe.select(*_KEY).distinct()
    owned = owners.join(keys, _KEY, "left_semi")
    events = [
        asked.select(*_KEY, "day", "at", F.lit(0).alias("d"), F.lit(1).alias("q")),
        owned.select(*_KEY, F.coalesce(_day(F.col("start")), F.lit(EVER)).alias("day"), F.col("start").alias("at"), F.lit(1).alias("d"), F.lit(0).alias("q")),
        owned.filter("end is not null").select(*_KEY, _day(F.col("end")).alias("day"), F.col("end").alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("q")),
    ]
    each = events[0].unionByName(events[1]).unionByName(events[2]).groupBy(*_KEY, "day", "at").agg(F.sum("d").alias("d"), F.max("q").alias("q"))
    each = written(each, "events")
    daily = each.groupBy(*_KEY, "day").agg(F.sum("d").alias("d"))
    carried = daily.select(*_KEY, "day", (F.sum("d").over(Window.partitionBy(*_KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("base"))
    inside = each.withColumn("now", F.sum("d").over(Window.partitionBy(*_KEY, "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    lost = inside.filter("q = 1").join(carried, [*_KEY, "day"]).filter("base + now <= 0").select(*_KEY, "at")
    return asked.join(lost, [*_KEY, "at"], "left_semi").select("rel", "row_id", "ref_key", "at").distinct()
