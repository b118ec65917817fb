import base64
import random

import numpy as np
import pytest

from boardloom.llm.quality import BOUNDS, FACETS, KINDS, Kinds, Profiles, facets, quality, shares
from boardloom.llm.train_quality import by_lines, fit, jsd, loops, repeated

COMMON = {
    "en": set("a about after again an and are as at be because been both but by do each for from has if in is it no not of on only or our see so still than that the their then there this to was we what when which while who with would".split()),
    "de": set("auf aus bei bitte das dem den der die dieser ein eine einen es gibt haben im ist keinen mit nicht noch nur obwohl solange und von weil wenn werden wir wird zu".split()),
    "zh": {"一", "上", "不", "了", "会", "其他", "如果", "当", "时", "有", "没有", "的", "请", "这", "都", "和", "在"},
}
R = random.Random(9)
PROSE = "We measured the drop over the fuse while the fan was still on, and it is not clear why the rail falls. There is no other part on this sheet that would do it, so we asked the lab. "
ITEMS = ["check SPI_MOSI", "R12 sense line", "codec under the shield", "GND", "quiet op amp", "fuel gauge next to the connector", "LED_A", "TP4 snubber", "VBAT", "spare isolator"]
ROWS = [[R.choice(["GND", "input", "4.7 nF", "codec", "11.32", "U14", "analog"]) for _ in range(4)] for _ in range(12)]
CASES = [
    (PROSE, "prose"), (PROSE * 4, "prose"), (PROSE.lower().replace(".", " and"), "prose"), ("Wenn der Akku fast leer ist, gibt es auf dieser Seite keinen weiteren Widerstand, der die Leitung treibt.", "prose"), ("当电池快没电时，请不要移除旁边的电阻。如果外壳关闭，这一页没有其他的电容。", "prose"),
    (PROSE + "\n- one thing\n- two things\n" + PROSE, "prose"), (PROSE.upper(), "prose"),
    ("\n".join(f"- {x}" for x in ITEMS), "list"), ("\n".join(ITEMS), "list"), ("; ".join(ITEMS * 2), "list"), ("Agenda\n" + "\n".join(f"{n}. {x}" for n, x in enumerate(ITEMS, 1)), "list"), ("Both of the parts are on this sheet.\n\n" + "\n".join(f"[x] {x}" for x in ITEMS * 2), "list"),
    (", ".join(f"R{n}" for n in range(60)), "list"), ("\n".join(f"NET{n}: U1-{n} C2-1 R3-{n}" for n in range(9)), "list"),
    ("\n".join(" | ".join(r) for r in ROWS), "table"), ("\n".join(";".join(r) for r in ROWS), "table"), ("\n".join("\t".join(r) for r in ROWS), "table"), ("\n".join("".join(f"{c:<20}" for c in r) for r in ROWS), "table"), ("\n".join(",".join(f'"{c}"' for c in r) for r in ROWS), "table"),
    ("<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in ROWS) + "\n</table>", "table"), ("See what is in the table, which we made for the lab.\n\n" + "\n".join("│ " + " │ ".join(r) + " │" for r in ROWS), "table"),
    ("codec " * 60, "junk"), (base64.b64encode(R.randbytes(600)).decode(), "junk"), ("\n".join("".join(R.choice("01 ") for _ in range(60)) for _ in range(8)), "junk"), ("".join(R.choice("<>{}[]()/\\@%&") for _ in range(300)), "junk"), ("#####-----=====~~~~~....." * 9, "junk"),
    ("\n".join(f"{n * 16:08x}  " + " ".join(f"{R.randrange(256):02x}" for _ in range(16)) for n in range(9)), "junk"), (" ".join("".join(R.choice("qjölkwäpxz") for _ in range(9)) for _ in range(40)), "junk"), (PROSE.replace("e", "Ã©").replace("a", "ï¿½"), "junk"), ("".join(R.choice("^`~|!") if R.random() < 0.25 else c for c in PROSE * 2), "junk"),
]


def kind_of(text: str) -> str:
    return KINDS[Kinds.load().nearest(shares([facets(text, Profiles(COMMON))[0]]))[0][0]]


@pytest.mark.parametrize("text,kind", CASES)
def test_kinds(text, kind):
    assert by_lines(text, Profiles(COMMON)) == kind
    assert kind_of(text) == kind


def test_figures():
    x, (n, mean, symbols, ended, common, lang) = facets("The rail is on.\nIs it?", Profiles(COMMON))
    assert (n, ended, lang) == (6, 1.0, "en") and abs(symbols - 2 / 17) < 1e-9 and abs(mean - 15 / 6) < 1e-9 and abs(common - 5 / 6) < 1e-9
    for text in ("The rail is on.\nIs it?", "x", "当电池快没电时", "-" * 50, "\x00", "\ud800 odd", "😀 " * 9):
        x = shares([facets(text, Profiles(COMMON))[0]])[0]
        assert np.allclose([x[a:b].sum() for a, b in zip(BOUNDS, BOUNDS[1:])], 1.0, atol=1e-5) and len(x) == sum(FACETS.values())


def test_divergence():
    assert jsd((1.0, 0.0), (0.0, 1.0)) == 1.0 and jsd((0.5, 0.5), (0.5, 0.5)) == 0.0
    two = Kinds(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0, 1]))
    got = two.divergences(np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], np.float32))
    want = [[jsd(p, q) for q in ((1.0, 0.0), (0.5, 0.5))] for p in ((1.0, 0.0), (0.5, 0.5), (0.0, 1.0))]
    assert np.allclose(got, want, atol=1e-5)


def test_profiles_decide(spark, monkeypatch):
    """Other profiles, other kinds: no rule beside them decides."""
    known = Kinds.load()
    assert {tuple(p.round(4)) for p in known.profiles[known.kinds == 0]}.isdisjoint({tuple(p.round(4)) for p in known.profiles[known.kinds != 0]})
    df = spark.createDataFrame([(1, PROSE), (2, "\n".join(ITEMS))], "id long, text string")
    assert {r["id"]: r["kind"] for r in quality(df, "id", "text", COMMON).collect()} == {1: "prose", 2: "list"}
    texts = [PROSE, "\n".join(ITEMS)]
    x = shares([facets(t, Profiles(COMMON))[0] for t in texts])
    swapped = Kinds(x, np.array([1, 0]))
    assert [KINDS[k] for k in swapped.nearest(x)[0]] == ["list", "prose"]


def test_fit_on_held_out_texts():
    """Profiles fitted to generated texts tell others of their like."""
    r, words = random.Random(2), "the a is on we it of to and rail fuse probe codec sheet limit antenna regulator".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    make = [lambda: " ".join(say(12).capitalize() + "." for _ in range(8)), lambda: "\n".join(f"- {say(3)}" for _ in range(12)), lambda: "\n".join("\t".join(say(1) for _ in range(4)) for _ in range(9)), lambda: "".join(r.choice("01 ") for _ in range(400))]
    kinds = np.array([i % 4 for i in range(240)])
    got = [facets(make[k](), Profiles(COMMON)) for k in kinds]
    x, langs = shares([f for f, _ in got]), [s[5] for _, s in got]
    near = fit(x[:160], kinds[:160], langs[:160])
    assert (near.nearest(x[160:])[0] == kinds[160:]).mean() >= 0.97
    assert all(len(t.split()) > 20 for t in loops([PROSE * 3], 5))


def test_operator(spark):
    rows = [(1, PROSE, "a"), (1, PROSE, "a"), (2, None, "a"), (3, "", "a"), (4, " \n\t ", "a"), (5, "-" * 200_000, "a"), (6, "word " * 100_000, "a"), (None, PROSE, "a")]
    got = {r["id"]: r for r in quality(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", COMMON).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[1]["kind"] == "prose" and got[5]["kind"] == got[6]["kind"] == "junk" and got[2]["kind"] is got[3]["kind"] is got[4]["kind"] is None and got[2]["words"] == 0
    assert quality(spark.createDataFrame([], "id long, text string"), "id", "text", {}).count() == 0


def test_long_passages_repeated():
    words = [f"{a}{b}" for a in ("board", "rail", "clock", "probe", "sheet", "hook", "limit", "pin") for b in ("ing", "ed", "er", "s", "al", "ic", "or", "ly", "y", "ous")]
    for n in (40, 61, 80):  # distinct words of the passage: under and over 60 trigrams
        assert repeated(" ".join(words[:n] * 8)) and not repeated(" ".join(words[:n] * 2))
    r = random.Random(4)
    said = [" ".join(r.sample(words, 10)) + "." for _ in range(30)]
    prose = " ".join(r.choice(said) for _ in range(900))
    grams = prose.replace(".", "").split()
    assert 60 <= len(set(zip(grams, grams[1:], grams[2:]))) < 0.2 * (len(grams) - 2)  # few trigrams, but in no order that recurs
    assert not repeated(prose)
