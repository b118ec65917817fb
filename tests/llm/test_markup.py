import random

import numpy as np
import pytest

from boardloom.llm import markup, train_markup

MARKED = [
    "<b>x</b>", "a <i>typ", "<td align=left>x", "V<sub>DD</sub>", "x<br/>y", "<!-- old -->x", "a&nbsp;b", "10 k&#937;", "R&amp;D", "# Title\nx", "- a\n- b", "1. a\n2. b", "> said so", "**x**", "**x", "__x__ only", "*x y*", "~~x~~ y", "`x` mode", "```\nx\n```",
    "[see](#t)", "![s](i.png) x", "x[^1]", "'''x'''", "''x'' node", "[[Pinout|x]]", "{{pin|x}}", "== x ==", "{| class=x\n|-\n| x\n|}", "|| a || b", "\\textbf{x}", "\\emph{low}", "$V_{DD}$", "$$I = \\frac{V}{R}$$", "\\(t_{pd}\\)", "10\\,k\\Omega", "\\SI{3.3}{\\volt}", "x \\\\ \\hline", "\\_RESET\\_", "\\section*{x}",
]
PLAIN = [
    "x -> y", "x <-> host", "<1 mA", "10 % < x < 90 %", "when VIN > 2.7 V and IOUT < 1 A", "bus DATA[7:0]", "[note 3]", "3 * C1 + 2 * C2", "4 * n clocks", "5*VDD", "R1 || R2", "C:\\lib\\part", "#2", "~50 k to VDD", "= low {default}", "{0, 1}", "2^N steps", "(= pin 3)", "a - see b",
    "x_min_val", "CLK_OUT_2 and CLK_OUT_3", "/ nWAKE_IN", "50 Ω & shield", "(see R&D note)", "$ grade", "'1' or '0'", "(pad 'A')", "x\nsecond function: wake", "a == b", ">= 3 V", "", "   ", "plain words", "-40 °C", "3.3 V",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert train_markup.pieces(text)
    (_, _, p), = markup.label([(text, False)])
    assert p.max() >= markup.MARKUP


@pytest.mark.parametrize("text", PLAIN)
def test_signs_that_are_none(text):
    assert not train_markup.pieces(text) and not train_markup.pieces(f"AIN0 | {text} | output", True)
    assert markup.clean(f"x {text}", False).replace(" ", "") == f"x {text}".strip().replace(" ", "")


def test_cells():
    for cell in ("- a", "# a", "> a", "== a ==", "1. a", "* a"):
        assert train_markup.pieces(f"AIN0 | {cell} | out", True) and not train_markup.pieces(f"AIN0 | {cell} | out", False)
    assert train_markup.pieces("A & b c & out \\\\", True) and not train_markup.pieces("AIN0 |  | out", True)


@pytest.mark.parametrize("text,want", [
    ("<h3>Top</h3> rest", "# Top\n rest"), ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"), ("<pre>a\n  b</pre>", "```\na\n  b\n```"), ("**a** and `b`", "a and `b`"), ("$V_{DD}$ in", "$V_{DD}$ in"), ("10\\,k\\Omega", "$10\\,k\\Omega$"), ("[[P|x]] {{pin|y}}", "x y"), ("a&nbsp;&lt; b", "a < b"),
    ("\\begin{itemize}\\item a\\end{itemize}", "- a"), ("== T ==", "# T"), ("V<sub>DD</sub>", "V_DD"), ("\\section*{T} x", "# T\n x"), ("* a\n* b", "- a\n- b"),
])
def test_clean(text, want):
    assert markup.clean(text, False) == want


def test_clean_rows():
    assert markup.clean("`CLK` | <b>x</b> | [[gpio]]", True) == "`CLK` | x | gpio" and markup.clean("|| A || b || c", True) == "A | b | c" and markup.clean("A & b & c \\\\", True) == "A | b | c"


def test_labeller_on_held_out_texts():
    r, right, total, found, marked = random.Random(77), 0, 0, 0, 0
    for _ in range(300):
        text, cells, marks = train_markup.sample(r)
        (seq, role, p), = markup.label([(text, cells)])
        for (a, _, sign, _), k, q in zip(seq, role, p):
            own = next((m for m in marks if m[0] <= a < m[1]), None)
            if own:
                total += 1
                right += markup.ROLES[k] == ("mark" if sign and own[3] else own[2])
        if any(m[3] for m in marks):
            marked += 1
            found += p.max() >= markup.MARKUP
    assert right >= 0.97 * total and found >= 0.99 * marked


def test_labels_decide(monkeypatch):
    """Another labeller, other results: no rule beside it finds or cleans markup."""
    text = "**a** and <b>x</b>\n- y"
    assert markup.clean(text, False) == "a and x\n- y"
    off = {k: np.zeros_like(v) for k, v in markup.weights().items()} | {"c": np.full(len(markup.ROLES) + 1, -9, np.float32)}
    monkeypatch.setattr(markup, "weights", lambda: off)
    (_, _, p), = markup.label([(text, False)])
    assert p.max() < markup.MARKUP and markup.clean(text, False) == text


def test_stretches_agree():
    """A sequence in stretches of any size has the labels of the whole."""
    r = random.Random(3)
    text = "\n".join(train_markup.sample(r)[0] for _ in range(120))
    (seq, role, p), = markup.label([(text, False)])
    assert len(seq) > 400
    for stretch in (7, 64, 333):
        (_, role2, p2), = markup.label([(text, False)], stretch=stretch)
        assert (role == role2).all() and np.abs(p - p2).max() < 1e-4


def test_long_values_are_read_whole():
    """What stands far behind in a leaf, a sign or a text counts."""
    words = "supply input " * 4000
    (_, _, p), = markup.label([(words, False)])
    assert not (p >= markup.MARKUP).any()
    (_, _, p), = markup.label([(words + "<b>x</b>", False)])
    assert p.max() >= markup.MARKUP
    assert markup.clean(f"<a title=\"{'x' * 3000}\">in</a> {words}", False) == f"in {words}".strip()
    short, long = markup.vector("a b c", False, "", True, 0, 0), markup.vector("a b c " + "d " * 500 + "end", False, "", True, 0, 0)
    other = markup.vector("a b c " + "d " * 500 + "last", False, "", True, 0, 0)
    assert (long != other).any() and np.abs(long).max() <= 12 * 0.3 + 1 and short.shape == long.shape
    many = "a <b>x</b> - y\n" * 3000
    (seq, _, p), = markup.label([(many, False)])
    assert len(seq) > markup.STRETCH and np.isfinite(p).all() and markup.clean(many, False) == ("a x - y\n" * 3000).strip()


@pytest.mark.parametrize("text,want", [
    ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"), ("{| class=x\n! A !! B\n|-\n| 1 || 2\n|}", "A | B\n1 | 2"), ("Title\n=====\nbody text", "# Title\nbody text"), ("<section>Some text</section> end", "Some text\n end"), ("<video src=x>clip", "clip"),
    ("<figure><b>x</b> in</figure>", "x in"), ("\\begin{tabular}{ll} a & b \\\\ \\hline 1 & 2 \\\\ \\end{tabular}", "a | b\n\n 1 | 2"), ("# Head\ntext\n## Two", "# Head\ntext\n# Two"), ("> quoted text\n> again", "quoted text\nagain"), ("term\n: definition of it", "term\ndefinition of it"),
    ("R1 || R2 and **bold** text", "R1 || R2 and bold text"), ("when VIN > 2 and <b>x</b> < 3", "when VIN > 2 and x < 3"), ("```\nx = 1\n```", "```\nx = 1\n```"),
])
def test_structure_kept(text, want):
    assert markup.clean(text, False) == want


def test_operator(spark):
    rows = [(1, "<b>x</b>", "A | x | o", "q"), (1, "<b>x</b>", "A | x | o", "q"), (2, None, "", "q"), (3, "plain", "A | - x | o", "q"), (None, "<b>x</b>", None, "q"), (4, "[" * 50_000, "<" * 50_000, "q")]
    df = spark.createDataFrame(rows, "id long, d string, r string, field string")
    got = sorted((x["id"], x["field"], x["clean_text"]) for x in markup.residue(df, "id", {"d": False, "r": True}).collect() if x["id"] != 4)
    assert got == [(1, "d", "x"), (3, "r", "A | - x | o")]
    assert markup.residue(df.limit(0), "id", {"d": False, "r": True}).count() == 0


def test_unmarked_values_come_out_as_they_are(spark):
    rows = [(1, "<b>x</b>", "A | x | o"), (1, "<b>x</b>", "A | x | o"), (2, None, " "), (3, "plain", "A | - x | o"), (4, "a < b", ""), (None, "x", "y")]
    df = spark.createDataFrame(rows, "id long, d string, r string")
    got = {(x["id"], x["field"]): (x["clean_text"], bool(x["roles"])) for x in markup.residue(df, "id", {"d": False, "r": True}, whole=True).collect()}
    assert got == {(1, "d"): ("x", True), (1, "r"): ("A | x | o", False), (2, "d"): (None, False), (2, "r"): (" ", False), (3, "d"): ("plain", False), (3, "r"): ("A | - x | o", True), (4, "d"): ("a < b", False), (4, "r"): ("", False)}
