import pytest

from boardloom.operators import units

MEASURES = [
    ("120Ω@0.1 GHz", {"resistance": 120_000_000, "frequency": 100_000_000_000}), ("120pf 2.5V", {"capacitance": 120_000, "voltage": 2_500_000}), ("1/16 watt", {"power": 62_500}), ("rev 3 / 0.1W", {"power": 100_000}), ("0402 / 1/8 W / no. 7 / 50Vdc", {"power": 125_000, "voltage": 50_000_000}), ("rev 3 / 2W", {"power": 2_000_000}), ("18nF/16V", {"capacitance": 18_000_000, "voltage": 16_000_000}), ("2.0E-9F", {"capacitance": 2_000_000}),
    ("20 000pF 25 000mVDC", {"capacitance": 20_000_000, "voltage": 25_000_000}), ("max. 125 °C", {"temperature": 125_000}), ("Tmax 378.15 K", {"temperature": 105_000}), ("158 degF", {"temperature": 70_000}), ("150 deg C", {"temperature": 150_000}),
    ("+/-0,1%", {"tolerance": 1000}), ("+-100000 PPM", {"tolerance": 100_000}), ("± 2 percent", {"tolerance": 20_000}), ("P=0.381 cm", {"length": 3810}), ('pitch 0.2"; gold', {"length": 5080}), ("200mil", {"length": 5080}), ("0.05 inch", {"length": 1270}),
    ("X7R; V2 process; reel 4k; C0G; 0805", {}), ("0.062mfd", {"capacitance": 62_000_000}), ("24mOhm", {"resistance": 24_000}), ("24MOHM", {"resistance": 24 * 10**12}), ("16 Mhz", {"frequency": 16 * 10**9}), ("3microhenries", {"inductance": 3_000_000}),
    ("20 000 μA", {"current": 20_000}), ("16,000 mV", {"voltage": 16_000_000}), ("62,5 mW", {"power": 62_500}), ("-40 °C", {"temperature": -40_000}), ("no. 7; lot 2231; series 2; MSL3; 2x5; 10 way", {}), ("", {}), (None, {}),
]


@pytest.mark.parametrize("text,want", MEASURES)
def test_measures(text, want):
    assert {q: a for q, a, *_ in units.measures(text)} == want


BARE = [
    ("430", "R", None, 430_000_000), ("4R3", "R", "", 4_300_000), ("R13", "R", "", 130_000), ("M43", "R", "", 430 * 10**9), ("m011", "L", "", 11_000_000), ("910n", "L", "", 910_000), ("24.576M", "Y", "", 24_576_000_000), ("1600", "C", "", 1_600_000),
    ("82", "C", "Value column is microfarad", 82 * 10**9), ("7 500", "C", "value in picofarad | tol. 20%", 7_500_000), ("1.8E3", "R", "", 1_800_000_000), ("0.0011meg", "R", "", 1_100_000_000), ("36u/4 VAC", "C", "", 36 * 10**9), ("150", "R", "unit: kΩ", 150 * 10**9),
    ("LDO 3", "U", "", None), ("4R7", "L", "", 4_700_000), ("75", "Q", "", None), ("910K", "R", "", 910 * 10**9),
]


@pytest.mark.parametrize("value,kind,spec,want", BARE)
def test_numbers_without_unit(value, kind, spec, want):
    assert not [m for m in units.measures(value, kelvin=False) if m[0] == units.MISSING.get(kind, ("",))[0]]
    n = units.bare(value)
    c = n and units.by_convention(kind, n[1], spec)
    assert (c and units._whole(n[0] * c[1])) == want


def _lines() -> list[tuple]:
    rows = [(i, f"C{i}", f"{i % 90 + 1}pF", "X7R; 16V", "x") for i in range(400)] + [(1000 + i, f"R{i}", f"{i % 90 + 1}kohm", "thin film", "x") for i in range(400)]
    return rows + [(2000 + i, f"C{i}", f"{i % 90 + 1}", "X7R", "x") for i in range(300)] + [(3000 + i, f"R{i}", f"{i % 90 + 1}k", "thin film", "x") for i in range(300)]


def test_operator(spark):
    rows = _lines() + [(5000, "C9", "47", "X7R", "x"), (5001, None, "47", "", "x"), (5002, "R1", None, None, "x"), (5003, "R1", "", "", "x"), (5000, "C9", "47", "X7R", "x"), (None, "R1", "4k7", "", "x")]
    df = spark.createDataFrame(rows, "id long, d string, v string, s string, found string")
    got = {(r["row_id"], r["field"], r["quantity"]): r for r in units.convert(df, "id", "d", "v", "s", source="found").collect()}
    r = got[(5000, "value", "capacitance")]
    assert r["amount"] == 47_000 and r["unit_from"] == "forest" and r["route"] == "convert" and r["confirmed"] and units.CONFIDENT <= r["confidence"] <= 1
    assert got[(1, "value", "capacitance")]["amount"] == 2000 and got[(1, "specification", "voltage")]["amount"] == 16_000_000
    lone = [r for k, r in got.items() if k[0] == 5001]
    assert len(lone) == 1 and lone[0]["unit_from"] == "forest" and 0 < lone[0]["confidence"] <= 1 and lone[0]["confirmed"] is None
    assert not any(k[0] in (5002, 5003, None) for k in got)
    assert units.convert(df.limit(0), "id", "d", "v", "s").count() == 0


def test_forest_decides(spark, monkeypatch):
    """Without a forest, or with one that is wrong, no number without a unit is converted by the convention alone."""
    df = spark.createDataFrame(_lines(), "id long, d string, v string, s string, src string")
    lone = lambda: units.convert(df, "id", "d", "v", "s").filter("unit_from = 'forest'")
    assert lone().filter("route = 'convert' and confirmed").count() >= 590
    monkeypatch.setattr(units, "fit", lambda parsed, rows: None)
    assert lone().filter("route = 'convert'").count() == 0 and lone().count() == 600


def test_forest_on_held_out_rows(spark):
    rows = [(i, f"{'RCLY'[i % 4]}{i}", ["{}kohm", "{}nF", "{}uH", "{}MHz"][i % 4].format(i % 95 + 1), "") for i in range(1200)]
    parsed = units.read(spark.createDataFrame(rows, "id long, d string, v string, s string"), "id", "d", "v", "s")
    forest, isotonic, share, n, classes = units.fit(parsed)
    steps = isotonic.predictions.toArray().tolist()
    assert set(classes) == {"kresistance", "ncapacitance", "uinductance", "Mfrequency"} and share > 0.85 and 300 < n < 500 and steps == sorted(steps) and steps[-1] > 0.9
