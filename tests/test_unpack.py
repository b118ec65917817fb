import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardloom.operators import unpack as module
from boardloom.operators.unpack import NONE, PART, SPAN, source_readings, unpack, unpack_cell

CASES = [
    ("R7-9", "R7 R8 R9"), ("MOD-1", "MOD-1"), ("MOD-1, MOD-2", "MOD-1 MOD-2"), ("MOD-1-3", "MOD-1 MOD-2 MOD-3"), ("MOD-1 - MOD-3", "MOD-1 MOD-2 MOD-3"), ("L10+12", "L10 L12"), ('"R7, R8"', "R7 R8"),
    ('["C1","C2"]', "C1 C2"), ("{L2; L3}", "L2 L3"), ("R20 to R22", "R20 R21 R22"), ("Q5,Q2 thru Q4", "Q5 Q2 Q3 Q4"), ("C8, C9, and C11", "C8 C9 C11"), ("C1…C3", "C1 C2 C3"), ("R1:R3, R5", "R1 R2 R3 R5"),
    ("R1–R3", "R1 R2 R3"), ("C1602/C1603 C1604,,C1605", "C1602 C1603 C1604 C1605"), ("J1，J2,", "J1 J2"), ("r8\r\nr9", "R8 R9"), ("'L1' 'L3'", "L1 L3"), ("C1 & C2", "C1 C2"), ("LED2402-2404", "LED2402 LED2403 LED2404"),
    ("R9-R6", "R9 R8 R7 R6"), ("R4815,R4809-4811", "R4815 R4809 R4810 R4811"), ("R14 and 15", "R14 R15"), ("R3,\xa0R2", "R3 R2"), ("Q6806/6804/6809", "Q6806 Q6804 Q6809"), ("DNP", ""), ("", ""), (None, ""), ("C1-R5", "C1 R5"), ("R1, R1", "R1 R1"),
]


@pytest.mark.parametrize("cell,want", CASES)
def test_cells(cell, want):
    assert unpack_cell(cell) == want.split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["R", "C", "LED", "MOD-"]), st.integers(1, 9999)), min_size=2, max_size=30), st.sampled_from([",", ", ", "; ", ";", "|", " | ", "/", "+", "\n", "\t", "、", " & ", " "]), st.sampled_from(["{}", '"{}"', "[{}]", " {} ", "{},"]))
def test_any_list_comes_back(names, mark, around):
    want = [f"{a}{n}" for a, n in names]
    assert unpack_cell(around.format(mark.join(want))) == want


def test_spans_and_long_cells():
    assert len(unpack_cell("R1-R1200000")) == 1_200_000
    assert len(list(zip(range(3), module.names(module.runs(*module.pieces("R1-R" + "9" * 40), module.prior))))) == 3
    many = ",".join(f"C{n}" for n in range(20_000))
    assert len(unpack_cell(many)) == 20_000
    assert unpack_cell(" " * 100_000) == []


def test_readings_decide():
    assert unpack_cell("R1-R4", {"-": PART}) == ["R1", "R4"]
    assert unpack_cell("R1,R4", {",": SPAN}) == ["R1", "R2", "R3", "R4"]
    assert unpack_cell("U1.3", {".": NONE}) == ["U1"] and unpack_cell("U1.3") == ["U1", "U3"]


def test_long_span_in_spark(spark):
    df = spark.createDataFrame([(1, "b", "R1-R200001", None)], "id long, src string, cell string, qty string")
    got = unpack(df, "id", "src", "cell", "qty")
    assert got.count() == 200_001 and got.filter("pos = 200001").first().refdes == "R200001"


def test_sources_teach_their_marks(spark):
    """A source that parts with a mark others span with, one that spans with a mark of its own, and one that follows all others."""
    rows = [("parts", f"R{n}:R{n + 7}", 2) for n in range(40)] + [("spans", f"C{n} ff C{n + 4}", 5) for n in range(40)] + [("few", "L1:L3", None)] + [("none", f"U{n}.{n + 3}", 1) for n in range(40)]
    rows += [("usual", f"R{n}:R{n + 2}", 3) for n in range(200)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, src string, cell string, qty int")
    how = {r["_source"]: r["_how"] for r in source_readings(df.selectExpr("src as _source", "cell as _cell", "qty as _qty")).collect()}
    assert how == {"parts": {":": PART}, "spans": {"FF": SPAN}, "none": {".": NONE}}
    got = {}
    for r in unpack(df, "id", "src", "cell", "qty", least=1).collect():
        got.setdefault(rows[r.row_id][0], []).append(r)
    assert len(got["parts"]) == 80 and len(got["spans"]) == 200 and len(got["few"]) == 3 and len(got["none"]) == 40 and len(got["usual"]) == 600


def test_operator(spark):
    rows = [(1, "b", "R1,R2", "2", "x"), (1, "b", "R1,R2", "2", "x"), (2, None, "C5", "1", "x"), (3, "b", None, None, "x"), (4, "b", "", None, "x"), (5, "c", "L1-3", None, "x"), (None, "b", "R1,R2", "2", "x")]
    df = spark.createDataFrame(rows, "id long, src string, cell string, qty string, _scores string")
    got = sorted(map(tuple, unpack(df, "id", "src", "cell", "qty").collect()))
    assert got == [(1, 1, "R1"), (1, 2, "R2"), (5, 1, "L1"), (5, 2, "L2"), (5, 3, "L3")]
    assert unpack(df.limit(0), "id", "src", "cell", "qty").count() == 0
    assert unpack(df, "id", "src", "cell", least=1).count() == 6


def test_hot_source(spark):
    """One source with almost all rows."""
    r = random.Random(1)
    rows = [(i, "hot" if i % 20 else "cold", f"R{r.randint(1, 99)};R{r.randint(1, 99)}", "2") for i in range(3000)]
    assert unpack(spark.createDataFrame(rows, "id long, src string, cell string, qty string"), "id", "src", "cell", "qty").count() == 6000
