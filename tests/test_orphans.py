import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardloom.operators import bitmaps, orphans


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=300), st.sets(st.integers(0, 300_000), max_size=300), st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a, b = a | set(range(70_000, 80_000)), b | set(range(75_000, 90_000, 2))
    x, y = bitmaps.pack(np.array(sorted(a), dtype=np.int64)), bitmaps.pack(np.array(sorted(b), dtype=np.int64))
    assert set(bitmaps.unpack(x).tolist()) == a
    assert set(bitmaps.unpack(bitmaps.and_not(x, y)).tolist()) == a - b


def _run(spark, refs, owners):
    r = spark.createDataFrame(refs, "id long, board string, name string, at timestamp, rel string")
    o = spark.createDataFrame(owners, "board string, name string, a timestamp, b timestamp, key string")
    got = orphans.orphans(orphans.references(r, "t", "id", F.col("board"), F.col("name"), F.col("at")), orphans.parents(o, "t", F.col("board"), F.col("name"), F.col("a"), F.col("b")))
    return sorted((x["row_id"], x["ref_key"], x["at"]) for x in got.collect())


def _brute(refs, owners):
    out = set()
    for i, board, name, at, _ in refs:
        key = (name or "").strip().upper()
        if key and at and not any((ob or "") == (board or "") and (on or "").strip().upper() == key and (a is None or a <= at) and (b is None or b > at) for ob, on, a, b, _ in owners):
            out.add((i, key, at))
    return sorted(out)


def test_against_brute_force(spark):
    r, t0 = random.Random(4), datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=r.randint(0, 24 * 200))
    name = lambda: r.choice(["U1", "u1 ", "R2", " r2", "C3", "hot", "HOT", None, "", "  "])
    refs = [(i % 900, r.choice(["a", "b", None]), name(), r.choice([when(), when(), when(), None]), "x") for i in range(1500)]
    owners = [(r.choice(["a", "b", None]), name(), r.choice([when(), None]), r.choice([when(), when(), None]), "x") for _ in range(12)]
    owners += [("a", "U1", t0, t0, "x"), ("a", "R2", t0 + timedelta(days=31), t0 + timedelta(days=60), "x")]
    assert _run(spark, refs, owners) == _brute(refs, owners)


def test_edges(spark):
    t = datetime(2024, 3, 1)
    owners = [("a", "U1", t, t + timedelta(days=31), "x")]
    refs = [(1, "a", "U1", t, "x"), (2, "a", "U1", t + timedelta(days=31), "x"), (3, "a", "U1", t - timedelta(microseconds=1), "x"), (4, "b", "U1", t, "x")]
    assert [x[0] for x in _run(spark, refs, owners)] == [2, 3, 4]
    assert [x[0] for x in _run(spark, refs, [])] == [1, 2, 3, 4]
    assert _run(spark, [], owners) == []


def test_key_ranges_of_any_size():
    """Stretches hold each hash whole, in order, and all rows."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    h = np.sort(np.concatenate([r.integers(0, 40, 500), np.full(300, 17)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["h"]) for x in np.array_split(h, 23)]
    for rows in (1, 50, 10_000):
        got = [t.column("h").to_numpy() for t in orphans._ranges(iter(batches), rows)]
        assert np.array_equal(np.concatenate(got), h) and all(a[-1] < b[0] for a, b in zip(got, got[1:]))
    assert list(orphans._ranges(iter([]), 5)) == []
