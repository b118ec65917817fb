from hypothesis import given, settings
from hypothesis import strategies as st

from boardloom.llm.split import spans, split

TEXT = st.lists(st.sampled_from(["word ", "A sentence ends. ", "line\n", "\n\n", "\r\n", "2.1 Heading here\n", "HEADING\n", "漢字。", "x" * 90, "é", " ", "​"]), max_size=400).map("".join)


@settings(max_examples=120, deadline=None)
@given(TEXT, st.integers(60, 300))
def test_pieces(text, limit):
    t, overlap = text.strip(), limit // 6
    got = spans(t, limit, overlap)
    if not t:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(t) and all(0 < e - s <= limit for s, e in got)
    for (s0, e0), (s1, e1) in zip(got, got[1:]):
        assert s1 == max(0, e0 - overlap) and e1 > e0  # nothing lost, the overlap as asked
    assert (len(got) == 1) == (len(t) <= limit)


def test_natural_boundaries():
    para = "First things happen here. " * 20
    t = (para + "\n\n") * 8 + "3 NEXT PART\n" + (para + "\n\n") * 8
    got = spans(t.strip(), 1800, 250)
    assert all(t[e - 1] == "\n" for _, e in got[:-1])
    assert any(t[e:].startswith("3 NEXT PART") for _, e in got)
    prose = "Something is said. " * 400
    assert all(prose[:e].rstrip().endswith(".") for _, e in spans(prose.strip(), 1800, 250))


def test_without_boundaries():
    assert all(e - s <= 1800 for s, e in spans("x" * 100_000, 1800, 250))
    t = "e\u0301" * 3000
    assert all(t[e] != "\u0301" for _, e in spans(t, 1800, 250)[:-1])
    assert len(spans("a b " * 500_000, 1800, 250)) > 1000


def test_operator(spark):
    rows = [("a", "x" * 2000, ["h"], 1), ("a", "x" * 2000, ["h"], 1), ("b", "short", None, 2), ("c", None, [], 3), ("d", "  \n ", [], 4), ("e", " " * 3000 + "y", [], 5), (None, "z" * 2000, [], 6), ("f", "y" * 1800, [], 7)]
    df = spark.createDataFrame(rows, "id string, text string, heading_path array<string>, piece int")
    got = split(df, "id", "text", keep=("heading_path", "piece"))
    assert got.columns == ["id", "heading_path", "piece", "piece_1", "pieces", "start", "end", "piece_text"]
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a": 2, "b": 1, "e": 1, "f": 1} and by["a"][0]["heading_path"] == ["h"]
    assert {r["id"] for r in split(df, "id", "text", long_only=True).collect()} == {"a"}
    assert split(df.limit(0), "id", "text").count() == 0
