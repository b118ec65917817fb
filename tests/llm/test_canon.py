import pytest

from boardloom.llm.canon import Names, Parts, deletes, distance, resolve

MAKERS = [(1, "Drecra Optics GmbH", None), (2, "Gambrymox Power Co., Ltd.", "GBP"), (3, "Rudjorvik Interconnect", "RJI"), (4, "Fenwexpli Electronics", "FWE"), (5, "Zimgro Devices AG", None), (6, "Limfen Passives", None)]
PARTS = [(10, "AAG3621XEA"), (11, "AAG3621XEX"), (12, "TF3335WL"), (13, "YU0209-CHN"), (14, "BGC38564-NDC"), (15, "WY2945/LFK"), (16, "HC23056/ZLH1"), (17, "YP68105HAY2")]


@pytest.mark.parametrize("value,want", [
    ("drecra optics", 1), ("Optics, Drecra", 1), ("Drecra Opt...", 1), ("Drеcra Optics", 1), ("Drecrá Optics", 1), ("DRCERA OPTICS GMBH", 1), ("Gambrymox", 2), ("GBP Power", 2), ("GBP", 2), ("GambrymoxPower", 2), ("by Rudjorvik Interconnect", 3),
    ("Rudjrvik Interconnect", 3), ("FENWEXPLI_ELECTRONICS", 4), ("FWE Electronics - see note", 4), ("Zimgro Devices, Inc.", 5), ("Limfen  Passives [AVL 2]", 6), ("n/a", -1), ("TBD", -1), ("Vorfenrud Power", -1), ("any", -1), ("Drecra Power", -1), ("?", -1), ("x" * 10_000, -1),
])
def test_names(value, want):
    assert Names(MAKERS, {}).resolve(value) == want


@pytest.mark.parametrize("value,want", [
    ("aag3621xea", 10), ("AAG3621XEX", 11), ("AAG3621XEQ", -1), ("TF333-5WL", 12), ("yu0209–chn", 13), ("YU0209-CHN,118", 13), ("BGC38564 NDC", 14), ("WY2945_LFK T/R", 15), ("WY2945/LFK (cut tape)", 15), ("HOBVIKVOR-HC23056/ZLH1", 16), ("YP681O5HAY2", 17),
    ("YP68I05HAY2", 17), ("P/N TF3335WL", 12), ("TF3353WL", 12), ("TF33335WL", 12), ("ＴＦ３３３５ＷＬ", 12), ("TF3335\u200bWL?", 12), ("QQ1234AB", -1), ("-", -1), ("see AVL", -1), ("9" * 10_000, -1),
])
def test_parts(value, want):
    assert Parts(PARTS, {}, {"HOBVIKVOR"}).resolve(value) == want


def test_two_edits_in_long_names():
    names = Names([(1, "Microchip Technology", None), (2, "Drecrafen Optics", None), (3, "Limfen Passives", None)], {})
    assert names.resolve("Mirochp") == 1 and names.resolve("Drekrafon") == 2 and names.resolve("L1mf3n") == -1
    parts = Parts([(1, "AAG36219XEA"), (2, "QQW70714LFM")], {}, set())
    assert parts.resolve("AAG3629XEAA") == 1 and parts.resolve("QQW7O7I4LFM") == 2 and parts.resolve("AAX36219XXB") == -1
    assert parts.resolve("AAG36219XEA–TR") == 1 and parts.resolve("QQW70714LFM—T&R") == 2
    family = Parts([(1, "AAG36219XEA"), (2, "AAG36219XEB")], {}, set())
    assert family.resolve("AAG3621XEC") == -1


def test_long_lists_are_joined(spark):
    """Lists beyond the bound give the rows that broadcast ones do."""
    values = ["drecra optics", "Optics, Drecra", "GBP Power", "GambrymoxPower", "RudjorvikIntercon", "Rud jorvik", "FWE", "Zimgr0 Devices", "Limfen", "nobody", "n/a", "Drecra Optics GmbH", None, ""]
    numbers = ["aag3621xea", "AAG3621XEQ", "TF333-5WL", "HOBVIKVOR-HC23056/ZLH1", "Drecra: TF3335WL", "YP68I05HAY2", "TF33335WL", "QQ1234AB", "tbd", "TF3335WL", "AAG3621XEX–TR", None, "BGC38564 NDC", "9" * 500]
    df = spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(zip(values, numbers))] * 2, "id long, m string, p string")
    makers, parts = spark.createDataFrame(MAKERS, "mfr_id long, name string, short_name string"), spark.createDataFrame(PARTS, "part_id long, part_number string")
    a, b = (sorted(map(tuple, resolve(df, "id", "m", "p", makers, parts, most).collect())) for most in (500_000, 3))
    assert a == b and sum(r[2] > 0 for r in a) >= 15


def test_ties_are_misses():
    assert Parts([(1, "ABC123X"), (2, "ABC124X")], {}, set()).resolve("ABC12X") == -1
    assert Names([(1, "Grofen Optics", None), (2, "Grofan Optics", None)], {}).resolve("Grofn Optics") == -1


def test_symmetric_deletes_find_all_neighbours():
    words = ["abcd", "abce", "abdc", "bcd", "abcde", "xyz"]
    for a in words:
        for b in words:
            if distance(a, b) <= 1:
                assert deletes(a) & deletes(b)
    assert distance("AB0", "ABO") == 0.3 and distance("abcd", "abdc") == 0.7 and distance("a" * 50, "b") > 3


def test_operator(spark):
    rows = [(1, "Drecra Optics GmbH", "TF3335WL", "x"), (2, "drecra", " ", "x"), (3, None, "tbd", "x"), (2, "drecra", " ", "x"), (None, "drecra", "q", "x"), (4, "", None, "x")]
    df = spark.createDataFrame(rows, "id long, m string, p string, ref_id string")
    makers, parts = spark.createDataFrame(MAKERS, "mfr_id long, name string, short_name string"), spark.createDataFrame(PARTS, "part_id long, part_number string")
    assert sorted(map(tuple, resolve(df, "id", "m", "p", makers, parts).collect())) == [(2, "manufacturer", 1), (3, "part_number", -1)]
    assert resolve(df.limit(0), "id", "m", "p", makers, parts).count() == 0
    assert sorted(r["ref_id"] for r in resolve(df, "id", "m", "p", makers.limit(0), parts.limit(0)).collect()) == [-1] * 4
