"""Markup residue in texts: HTML, Markdown, wiki and LaTeX turned into clean text that keeps headings, lists, code and formulas.

A text is cut into leaves: signs that may be markup, and the words between them, each with the path of what is open around
it. A bidirectional LSTM (numpy; weights from `train_markup.py`) reads the whole sequence, tag paths and hashed words, and
labels every leaf: sign or word of markup, heading, list, code, formula, table, quote or plain text. The labels decide: a value has
markup if a leaf is held for it at MARKUP and above; in its clean text signs that are not held for markup are left alone, and
structure is written out only where its role was given (`clean`).

Defined results: null, empty and blank texts have no markup and come out as they are (`residue(whole=True)`); comparison signs, bus ranges, signal
names, arithmetic, paths, arrows and the " | " between cells are no markup; texts are read whole, all words of a leaf
and all leaves of a text: longer sequences are computed in stretches that hand their state on, in both directions, with the
same result; repeated rows count once, rows without an id are left out.
"""

from __future__ import annotations

import html
import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import spread

ROLES = ["text", "heading", "list", "code", "formula", "table", "quote", "mark"]
#: Probability from which on a leaf is markup.
MARKUP = 0.5
#: Characters of values whose labels a task keeps, about; what falls out is labelled again.
MEMO_CHARS = 20_000_000



def starts(text: str, cells: bool) -> list[int]:
    """Where lines begin, and cells where `cells`; behind white space."""
    pattern = r"(?:^|(?<=\n)|(?<=\r)| \| )[^\S\n]*" if cells else r"(?:^|(?<=\n)|(?<=\r))[^\S\n]*"
    return [m.end() for m in re.finditer(pattern, text)]


# --- leaves ------------------------------------------------------------------------------------------------------------

_SIGN = re.compile(
    r"</?[A-Za-z!][^<>\n]*>|<!--|<|&#?\w{1,30};?|\\[A-Za-z]+\*?|\\.|`+|\*+|_{2,}|(?<!\w)_(?=[^\s_])|(?<=[^\s_])_(?!\w)|~+|'{2,}|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|\|-|\$+|!?\[[^\[\]\n]*\]\(?|[_^]\{|[|{}#=>+-]+|\d{1,3}[.)](?=\s)|(?:^|(?<=\n)|(?<=\| ))[:;]{1,4}(?=\s*[A-Za-z])"
)
WORDS_DIM, SIGN_DIM = 24, 40
DIM = 12 + WORDS_DIM + SIGN_DIM
_LEAF_WORD = re.compile(r"[^\W\d_]+|\d")


@lru_cache(maxsize=4096)
def _class(c: str) -> int:
    return 0 if not c or c == "\n" else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


@lru_cache(maxsize=65_536)
def _bucket(word: str, dim: int) -> tuple[int, float]:
    h = crc32(word.encode("utf-8", "replace"))
    return h % dim, 1.0 if h >> 31 & 1 else -1.0


def leaves(text: str, cells: bool) -> list[tuple[int, int, bool, str]]:
    """(start, end, is a sign, path) over the whole text; path names what is open: html tag, wiki, formula, code or nothing."""
    out, at, path = [], 0, ""
    for m in _SIGN.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), False, path))
        s = m[0]
        out.append((m.start(), m.end(), True, path))
        if s[0] == "<" and (t := re.match(r"</?\s*(\w+)", s)):
            path = "" if s[1:2] == "/" else t[1].lower()
        elif s[0] in "`$" or s in ("[[", "{{"):
            path = "" if path == s else s
        elif s in ("]]", "}}"):
            path = ""
        at = m.end()
    if at < len(text):
        out.append((at, len(text), False, path))
    return out


class Vectors:
    """The vectors of leaves, each distinct leaf made once; forgotten all together when there are MOST of them."""

    MOST = 100_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[tuple, int] = {}
        self.rows = np.zeros((1024, DIM), np.float32)

    def ids(self, text: str, cells: bool, seq: list[tuple[int, int, bool, str]]) -> np.ndarray:
        opens, around = set(starts(text, cells)), f"\n{text}\n"
        # all that a leaf's vector depends on
        keys = [(text[a:b], sign, path, a in opens, _class(around[a]), _class(around[b + 1])) for a, b, sign, path in seq]
        out = np.empty(len(seq), np.int64)
        for i, key in enumerate(keys):
            k = self.at.get(key)
            if k is None:
                k = self.at[key] = len(self.at)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = vector(*key)
            out[i] = k
        return out


def vectors(text: str, cells: bool, seq: list[tuple[int, int, bool, str]]) -> np.ndarray:
    """One row per leaf: place and neighbours, hashed words, hashed signs and path."""
    v = Vectors()
    return v.rows[v.ids(text, cells, seq)]


def vector(s: str, sign: bool, path: str, opens: bool, before: int, after: int) -> np.ndarray:
    """Of one leaf. All its words count; beyond twelve they weigh less, so that a long leaf is no louder than a short one."""
    row = np.zeros(DIM, np.float32)
    row[0], row[1], row[2 + before], row[7 + after] = sign, opens, 1.0, 1.0
    words = _LEAF_WORD.findall(s.lower())
    weight = 0.3 * min(1.0, 12 / max(1, len(words)))
    for w in words:
        k, v = _bucket(w, WORDS_DIM)
        row[12 + k] += v * weight
    marks = [f"p:{path}"] if path else []
    if sign:
        marks += [f"s:{re.sub(r'[0-9]+', '9', s.lower())}", f"h:{s[:1]}", f"t:{s[-1:]}", f"n:{s[:1]}{before}{after}{int(opens)}"]
    for w in marks:
        k, v = _bucket(w, SIGN_DIM)
        row[12 + WORDS_DIM + k] += v
    return row


# --- the labeller ------------------------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False, state: tuple[np.ndarray, np.ndarray] | None = None):
    """Hidden states of a batch (n, time, dim), in order of time; live: (n, time), where a sequence has ended its state stays.
    state: what to begin with; (hidden, cell) of the last step comes back beside the states where one is given."""
    n, time, _ = x.shape
    size = u.shape[0]
    h, c = state if state is not None else (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
    out, kept = np.zeros((n, time, size), np.float32), []
    wx = x.reshape(n * time, -1) @ w + b
    wx = wx.reshape(n, time, 4 * size)
    for t in range(time):
        z = wx[:, t] + h @ u
        z[:, size : 2 * size] += 1.0
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        m = live[:, t : t + 1]
        c1 = f * c + i * g
        h1 = o * np.tanh(c1)
        if keep:
            kept.append((h, c, i, f, o, g, c1, m))
        c, h = m * c1 + (1 - m) * c, m * h1 + (1 - m) * h
        out[:, t] = h
    if state is not None:
        return out, (h, c)
    return (out, kept) if keep else out


def reversed_in(x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Each sequence turned round within its own length."""
    lengths = live.sum(1).astype(int)
    at = np.arange(x.shape[1])[None, :]
    order = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, order[:, :, None], 1)


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    data = pkgutil.get_data("boardloom.llm", "markup_lstm.npz")
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


#: Leaves that are computed at a time: of one text (a stretch), and of all texts of a batch.
STRETCH, AT_ONCE = 4096, 60_000


def label(texts: list[tuple[str, bool]], stretch: int = STRETCH, known: Vectors | None = None) -> list[tuple[list[tuple[int, int, bool, str]], np.ndarray, np.ndarray]]:
    """Per (text, cells): its leaves, their roles (indices of ROLES) and their probability of being markup."""
    w, known = weights(), known or Vectors()
    seqs = [leaves(t, c) for t, c in texts]
    out: list = [None] * len(texts)
    part: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: len(seqs[i])):
        n = len(seqs[i])
        if not n:
            out[i] = (seqs[i], np.zeros(0, int), np.zeros(0))
        elif n > stretch:
            out[i] = (seqs[i], *_label_long(known.rows[_ids(known, texts[i], seqs[i])], stretch, w))
        else:
            # of rising length: little of a batch is padding
            if part and (n * (len(part) + 1) > AT_ONCE or n > 1.3 * len(seqs[part[0]]) + 2):
                _label(texts, seqs, part, out, known, w)
                part = []
            part.append(i)
    if part:
        _label(texts, seqs, part, out, known, w)
    return out


def _ids(known: Vectors, text: tuple[str, bool], seq: list) -> np.ndarray:
    if len(known.at) > Vectors.MOST:
        known.clear()
    return known.ids(*text, seq)


def _read(h: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    z = h @ w["v"] + w["c"]
    return z[..., : len(ROLES)].argmax(-1), _sigmoid(z[..., -1])


def _label(texts: list, seqs: list, part: list[int], out: list, known: Vectors, w: dict[str, np.ndarray]) -> None:
    time = len(seqs[part[-1]])
    x, live = np.zeros((len(part), time, DIM), np.float32), np.zeros((len(part), time), np.float32)
    for r, i in enumerate(part):
        ids = _ids(known, texts[i], seqs[i])
        x[r, : len(ids)], live[r, : len(ids)] = known.rows[ids], 1.0
    h = np.concatenate([lstm(x, live, w["wf"], w["uf"], w["bf"]), reversed_in(lstm(reversed_in(x, live), live, w["wb"], w["ub"], w["bb"]), live)], 2)
    role, p = _read(h, w)
    for r, i in enumerate(part):
        n = len(seqs[i])
        out[i] = (seqs[i], role[r, :n], p[r, :n])


def _label_long(x: np.ndarray, stretch: int, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence in stretches, each direction handing its state on: as if it were read at once."""
    n, size = len(x), w["uf"].shape[0]
    h = np.zeros((n, 2 * size), np.float32)
    for side, (wx, u, b), order in ((slice(0, size), ("wf", "uf", "bf"), 1), (slice(size, None), ("wb", "ub", "bb"), -1)):
        state = (np.zeros((1, size), np.float32), np.zeros((1, size), np.float32))
        firsts = range(0, n, stretch)
        for a in firsts if order == 1 else reversed(firsts):
            got, state = lstm(x[None, a : a + stretch][:, ::order], np.ones((1, min(stretch, n - a)), np.float32), w[wx], w[u], w[b], state=state)
            h[a : a + stretch, side] = got[0, ::order]
    return _read(h, w)


# --- clean text --------------------------------------------------------------------------------------------------------

_B = r"[^\S\n]*"
#: (role whose label asks for the step, pattern, what to write); "mark" asks for signs alone. Within one line but for what
#: opens and closes over several.
_STEPS: list[tuple[str, re.Pattern, str]] = [
    ("mark", re.compile(r"(?s)<!--.*?(?:-->|$)"), ""),
    ("code", re.compile(r"(?is)<pre[^<>]*>\n?(.*?)\n?(?:</pre>|$)"), "\n```\n\\1\n```\n"),
    ("heading", re.compile(r"(?is)<h([1-6])[^<>]*>\s*(.*?)\s*</h\1>"), "\n# \\2\n"),
    ("heading", re.compile(rf"(?i)<h[1-6][^<>]*>{_B}"), "\n# "),
    ("list", re.compile(rf"(?i)<li[^<>]*>{_B}"), "\n- "),
    ("table", re.compile(r"(?i)</t[dh]>\s*<t[dh][^<>]*>"), " | "),
    ("code", re.compile(r"(?is)<(code|tt|samp|kbd)[^<>]*>(.*?)</\1>"), "`\\2`"),
    ("mark", re.compile(r"(?is)<sub[^<>]*>(.*?)</sub>"), "_\\1"),
    ("mark", re.compile(r"(?is)<sup[^<>]*>(.*?)</sup>"), "^\\1"),
    ("mark", re.compile(r"(?is)<ref\b[^<>]*>.*?(?:</ref>|$)"), ""),
    ("mark", re.compile(r"(?i)<(?:br|hr|/?p|/?tr|/?table|/ul|/ol|/dl|/?d[ltd]|/?div|/?section|/?article|/?figure|/?figcaption|/?blockquote|/h[1-6])\b[^<>]*>"), "\n"),
    ("mark", re.compile(r"</?[A-Za-z!?][^<>\n]*>|</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z-]+\s*=[^<>\n]*)?$"), ""),
    ("heading", re.compile(rf"(?m)^{_B}={{2,6}}{_B}([^=\n](?:.*?[^=\s])?){_B}=*{_B}$"), "# \\1"),
    ("heading", re.compile(rf"(?m)^({_B}[^\s|`>#-].*)\n{_B}(?:=+|-{{3,}}){_B}$"), "# \\1"),
    ("heading", re.compile(rf"(?m)^{_B}#{{1,6}}[^\S\n]+(.*?){_B}#*{_B}$"), "# \\1"),
    ("heading", re.compile(r"\\(?:chapter|paragraph|(?:sub)*section)\*?\{([^{}]*)\}"), "\n# \\1\n"),
    ("code", re.compile(r"(?s)\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\n?\\end\{(?:verbatim|lstlisting)\}"), "\n```\n\\1\n```\n"),
    ("table", re.compile(r"\\begin\{(?:tabular|array|longtable)\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*|\\end\{(?:tabular|array|longtable)\*?\}"), "\n"),
    ("list", re.compile(rf"\\item\b(?:\[([^\]\n]*)\])?{_B}"), "\n- \\1"),
    ("mark", re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}"), "\n"),
    ("mark", re.compile(r"\\(?:textbf|textit|emph|texttt|textrm|mathrm|mathbf|underline|mbox|hbox)\{([^{}]*)\}"), "\\1"),
    ("mark", re.compile(r"\\(?:hline|centering|newline)\b|\\\\(?=\s|$)"), "\n"),
    ("mark", re.compile(r"\\([_#&%{}~^*])"), "\\1"),
    ("table", re.compile(rf"(?m)^{_B}(?:\{{\|.*|\|[-}}].*)\n?"), ""),
    ("table", re.compile(rf"(?m)^{_B}\|\+{_B}"), ""),
    ("table", re.compile(rf"(?m)^{_B}!{{1,2}}{_B}(?=.*!!)"), ""),
    ("table", re.compile(rf"{_B}(?:\|\||!!){_B}(?=\S)"), " | "),
    ("table", re.compile(rf"(?m)^{_B}(?=[|:-]*[|-])[|: -]*-{{3,}}[|: -]*(?:\n|$)"), ""),
    ("table", re.compile(rf"(?m)^{_B}\|{_B}|{_B}\|{{1,2}}{_B}$"), ""),
    ("table", re.compile(r"[^\S\n]&[^\S\n]"), " | "),
    ("mark", re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)?"), "\\1"),
    ("mark", re.compile(r"\[\^[^\]\s]+\]"), ""),
    ("mark", re.compile(r"\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]"), "\\1"),
    ("mark", re.compile(r"\{\{(?:[^|{}\n]*\|)?([^{}\n]*)\}\}"), "\\1"),
    ("mark", re.compile(r"(?<!\d)'{2,5}"), ""),
    ("mark", re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])"), "\\2"),
    ("mark", re.compile(r"(?<!\w)__(?=\S)([^\n]+?)(?<=\S)__(?!\w)"), "\\1"),
    ("mark", re.compile(r"(?<![\w\ue001])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w\ue000])"), "\\1"),
    ("mark", re.compile(r"~~(?=\S)([^~\n]+)~~"), "\\1"),
    ("list", re.compile(rf"(?m)^({_B})[*+][^\S\n]+"), "\\1- "),
    ("list", re.compile(rf"(?m)^{_B}[:;]+{_B}(?=[A-Za-z])"), ""),
    ("quote", re.compile(rf"(?m)^{_B}(?:>{_B})+"), ""),
]
_FORMULA = re.compile(r"(?s)\$\$(.+?)\$\$|\\[(\[](.+?)\\[)\]]|\$(?=[^\s$])([^$\n]*?[^\s$])\$(?!\d)")
_LOOSE = re.compile(r"[\w.]*\\(?:[,;!]|[A-Za-z]+\*?)[^\s\ue000-\uf8ff]*")
#: Signs that stand for themselves while the others are rewritten, and what is done with already.
_HELD = re.compile("\ue000(\\d+)\ue001")


def clean(text: str, cells: bool, labelled: tuple[list, np.ndarray, np.ndarray] | None = None) -> str:
    """The text without markup: headings as `# `, items as `- `, code between backticks, formulas between `$`, cells parted by " | ".

    The labels tell what is done: signs held for no markup stand as they are; headings, items, code, formulas, tables and
    quotes are written out as such where a leaf of the text was given that role; other marks are dropped."""
    seq, role, p = labelled or label([(text, cells)])[0]
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\ue000{len(held) - 1}\ue001"

    marked = p >= MARKUP
    if not marked.any():
        return text
    asked = {ROLES[r] for r in role[marked].tolist()} | {"mark"}
    signs = {text[a:b] for (a, b, sign, _), m in zip(seq, marked) if sign and m}
    # a pipe, a dollar sign, a fence or a command that is held for markup tells of its structure, whatever its words were taken for
    asked |= {r for r, has in (("table", any(s.strip("|-}{") == "" or s in ("&", "!!") for s in signs)), ("formula", any(s[0] in "$\\_^" for s in signs)), ("code", any(s[0] == "`" for s in signs))) if has}
    out = "".join(text[a:b] if m or not sign else hold(text[a:b]) for (a, b, sign, _), m in zip(seq, marked))
    if cells and " | " in text:
        # cells are parted by a sign that is no markup
        bars = [f"\ue000{k}\ue001" for k, s in enumerate(held) if s == "|"]
        return " | ".join(_unhold(_rewritten(c, asked, held, hold), held) for c in re.split(f" (?:{'|'.join([*bars, re.escape('|')])}) ", out))
    return _unhold(_rewritten(out, asked, held, hold), held)


def _rewritten(out: str, asked: set[str], held: list[str], hold) -> str:
    if "formula" in asked:
        out = _FORMULA.sub(lambda m: hold(f"${(m[1] or m[2] or m[3]).strip()}$"), out)
    for role, pattern, to in _STEPS:
        if role in asked:
            out = pattern.sub(to, out)
    if "formula" in asked:
        # what is left of commands is a formula outside dollar signs
        out = _LOOSE.sub(lambda m: hold(f"${m[0]}$"), out)
    out = html.unescape(out).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+\n", "\n", out)).strip()


def _unhold(out: str, held: list[str]) -> str:
    while _HELD.search(out):
        out = _HELD.sub(lambda m: held[int(m[1])], out)
    return out


def residue(df: DataFrame, row_id: str, fields: dict[str, bool], with_text: bool = True, whole: bool = False) -> DataFrame:
    """(row_id, field, roles, clean_text) of each value with markup; fields: name -> whether it is a row of cells.
    roles: the structure that the labeller found, in order, without repeats; with_text=False leaves clean_text null;
    whole: values without markup too, null and empty ones included, with their text as it is and no roles."""
    kind = df.schema[row_id].dataType.simpleString()
    names = list(fields)
    rows = df.select(F.col(row_id).alias("_id"), F.posexplode(F.array(*map(F.col, names))).alias("_field", "_text")).filter("_id is not null")
    # a value without any sign that markup is made of has none; where cells begin, lines do
    text = F.when(F.element_at(F.array(*map(F.lit, fields.values())), F.col("_field") + 1), F.regexp_replace("_text", r" \| ", "\n")).otherwise(F.col("_text"))
    signs = F.coalesce(text.rlike(r"""[<&`*_~\[\]{}|$\\#]|''|(?m)^\s*(?:[-+:;=>!]|\d{1,3}[.)])"""), F.lit(False))
    plain, rows = rows.filter(~signs), rows.filter(signs)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, done, held = Vectors(), {}, 0
        for b in batches:
            texts = [(t, fields[names[f]]) for t, f in zip(b["_text"], b["_field"])]
            if held > MEMO_CHARS:
                done, held = {}, 0
            new = list({*texts}.difference(done))
            for (t, c), own in zip(new, label(new, known=known)):
                _, role, p = own
                held += len(t) + 100
                if not len(p) or p.max() < MARKUP:
                    done[t, c] = ([], t) if whole else None
                else:
                    done[t, c] = (list(dict.fromkeys(ROLES[r] for r in role.tolist() if ROLES[r] != "mark")), clean(t, c, own) if with_text else None)
            out = [(i, names[f], *got) for i, f, x in zip(b["_id"], b["_field"], texts) if (got := done[x]) is not None]
            yield pd.DataFrame(out, columns=["_id", "field", "roles", "clean_text"])

    found = spread(rows, "_id", "_field").mapInPandas(work, f"_id {kind}, field string, roles array<string>, clean_text string")
    if whole:
        found = found.unionByName(plain.select("_id", F.element_at(F.array(*map(F.lit, names)), F.col("_field") + 1).alias("field"), F.array().cast("array<string>").alias("roles"), F.col("_text").alias("clean_text")))
    return found.dropDuplicates(["_id", "field"]).withColumnRenamed("_id", row_id)
