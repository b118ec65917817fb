import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from boardloom.llm.pack import fullest, pack, plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 60))
def test_fullest_is_optimal(items, room):
    got = fullest(dict(Counter(items)), room)
    assert all(n <= items.count(x) for x, n in got.items())
    best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
    assert sum(x * n for x, n in got.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=30))
def test_plan_uses_every_item_once(histogram):
    used = Counter()
    for combination, times in (steps := plan(histogram, 50)):
        assert sum(x * n for x, n in combination.items()) <= 50
        for x, n in combination.items():
            used[x] += n * times
    assert used == Counter(histogram) and len(steps) <= 50 * (1 + 4)


def test_little_room_is_left():
    r = random.Random(1)
    h = Counter(min(2048, max(1, int(r.lognormvariate(5.2, 1)))) for _ in range(50_000))
    bins = sum(t for _, t in plan(dict(h), 2048))
    assert bins <= sum(x * n for x, n in h.items()) / 2048 * 1.001 + 1


def test_operator(spark):
    r = random.Random(2)
    rows = [(i, 700 if i % 3 == 0 else r.randint(1, 900)) for i in range(2000)] + [(9000, 0), (9001, None), (9002, 5000), (9003, 2048), (9004, 2049), (9005, 4096)]
    got = pack(spark.createDataFrame([(*x, "y") for x in rows], "id long, n int, container string"), "id", "n", 2048).collect()
    by, room = {}, Counter()
    for x in got:
        by.setdefault(x["id"], []).append(x)
        room[x["container"]] += x["tokens"]
    none = room.pop(None)
    assert none == 0 and max(room.values()) <= 2048 and sum(room.values()) == sum(n or 0 for _, n in rows)
    assert all(sum(p["tokens"] for p in by[i]) == (n or 0) for i, n in rows)
    assert [p["tokens"] for p in sorted(by[9002], key=lambda p: p["piece"])] == [2048, 2048, 904] and len(by[9003]) == 1 and len(by[9004]) == 2
    assert all(len(by[i]) == 1 for i, n in rows if (n or 0) <= 2048)  # never split what fits
    assert sorted(room) == list(range(len(room))) and len(room) <= sum(room.values()) / 2048 * 1.1  # a third of all items has one length
    assert pack(spark.createDataFrame([], "id long, n int"), "id", "n", 2048).count() == 0
