"""Text quality figures of each document, and its structural kind: prose, list, table or junk.

A text is described by FACETS, each a distribution: its character classes, its letters, its function words and other kinds of
words, what its lines open and end with, the cells of its lines, the length of its parts, and what it says again. These are
set against structural profiles - the mean facets of groups of texts of one kind and language, prose profiles of each
language among them - by Jensen-Shannon divergence; the kind of the nearest profile is the kind of the text. The profiles
are fitted by `train_quality.py` on a bounded sample.

Defined results: null and blank texts have word count 0, null shares and kind null; a heading or a sentence that opens a list
or table, and a short list within prose, move the facets little and do not change the kind; one row out per row in (repeated
rows of an id once, rows without an id left out); texts are read whole.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import spread

KINDS = ("prose", "list", "table", "junk")
#: Words of a stretch that is longer than a sentence.
LOOP = 24
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|(?<![\w+./-])[\w+./-]*\d[\w+./-]*")
HAN = re.compile(r"[㐀-鿿]")
END = re.compile(r"[.!?…:。！？：]['\"”’»)\]]*\s*$")
_LETTER = re.compile(r"[^\W\d_]")


class Profiles:
    """Function words by language, and what is known of words: each distinct one is looked at once (at most MOST at a time)."""

    MOST = 300_000

    def __init__(self, common: dict[str, set[str]]):
        self.common, self.names = common, sorted(common)
        self.any = set().union(*common.values()) if common else set()
        self.han = sorted((w for w in common.get("zh", ()) if HAN.match(w)), key=len, reverse=True)
        self.han_re = re.compile("|".join(map(re.escape, self.han))) if self.han else None
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.kind, self.size, self.hash = np.zeros(1024, np.int8), np.zeros(1024, np.int32), np.zeros(1024, np.uint64)
        self.langs = np.zeros((1024, max(1, len(self.names))), np.int8)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > self.MOST:
            self.clear()
        known = self.ids
        for w in {*words}.difference(known):
            k = known[w] = len(known)
            if k >= len(self.kind):
                self.kind, self.size, self.hash, self.langs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.size, self.hash, self.langs))
            low = w.lower()
            self.kind[k], self.size[k], self.hash[k] = _kind_of_word(w, low in self.any), len(w) if w.isalpha() else 0, hash(low) & 0xFFFFFFFFFFFFFFFF
            self.langs[k] = [low in self.common[n] for n in self.names] or 0
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _kind_of_word(w: str, common: bool) -> int:
    """0 function word, 1 to 5 other words by length, 6 capitals, 7 numbers, 8 codes, 9 blobs (10: characters of Chinese, counted apart)."""
    if common:
        return 0
    if w.isalpha():
        n = len(w)
        return 6 if n > 1 and w.isupper() else 1 if n < 2 else 2 if n < 4 else 3 if n < 9 else 4 if n < 15 else 5
    return 9 if len(w) >= 32 else 7 if w[0].isdigit() and w[-1].isdigit() and not _LETTER.search(w) else 8


# --- distributions ------------------------------------------------------------------------------------------------------

_COARSE = ("lower", "upper", "digit", "blank", "line end", "han", "letter", "stop", "cell", "pair", "sign", "broken")
#: Facets of a text, each a distribution, with their number of shares.
FACETS = {"classes": 30, "letters": 28, "words": 11, "lines": 12, "cells": 8, "parts": 6, "again": 2, "loop": 2}
BOUNDS = np.cumsum([0, *FACETS.values()])
_FINE_SIGNS = ".,;:!?-|/\\_=+*#&%@~^$'\""


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point of the basic plane: fine class, coarse class, letter."""
    fine, coarse, letter = (np.zeros(65537, np.uint8) for _ in range(3))
    for c in range(65536):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or ch in "\ufffdÃÂ¿½\xad" or c < 9 or 13 < c < 32 or 0x7F <= c < 0xA0:
            k, f = 11, 7
        elif "a" <= ch <= "z":
            k, f = 0, 0
        elif "A" <= ch <= "Z":
            k, f = 1, 1
        elif ch.isdigit():
            k, f = 2, 2
        elif ch in "\n\r\x0b\x0c\x85\u2028\u2029":
            k, f = 4, 4
        elif ch == "\t":
            k, f = 8, 5
        elif ch.isspace():
            k, f = 3, 3
        elif 0x3400 <= c <= 0x9FFF:
            k, f = 5, 6
        elif ch.isalpha():
            k, f = (0 if ch.islower() else 6), 6
        elif ch in ".!?:,;。！？，、；：…":
            k, f = 7, 8 + _FINE_SIGNS.find(ch) if ch in _FINE_SIGNS else 8
        elif ch in "|│┃║¦":
            k, f = 8, 8 + _FINE_SIGNS.find("|")
        elif ch in "()[]{}<>\"'“”‘’«»„「」『』（）":
            k, f = 9, 28
        else:
            k, f = 10, 8 + _FINE_SIGNS.find(ch) if ch in _FINE_SIGNS else 29
        coarse[c], fine[c] = k, f
        letter[c] = ord(ch.lower()) - 97 if "a" <= ch.lower() <= "z" and len(ch.lower()) == 1 else 26 if ch.isalpha() and not 0x3400 <= c <= 0x9FFF else 27
    coarse[65536], fine[65536], letter[65536] = 10, 29, 27
    return fine, coarse, letter


_FINE, _KIND, _LETTER_OF = _tables()
_CELL_CODES = np.zeros(65537, np.uint8)
for _k, _marks in enumerate(("\t", "|│┃║¦", ";；", ",，", "&", ":", "~"), 1):
    for _c in _marks:
        _CELL_CODES[ord(_c)] = _k
_MARKS_AT = re.compile(r"(?:[-*•·–—+▪◦‣○●>☐☑✓✗]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\])\s")
_LINE_ENDS = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


def _two(x: float) -> tuple[float, float]:
    x = min(1.0, max(0.0, x))
    return x, 1.0 - x


def facets(text: str, profiles: Profiles) -> tuple[np.ndarray, tuple]:
    """(the counts of all facets of a text, one after the other; (words, mean word length, symbol ratio, share of lines ended,
    share of function words, language))."""
    row = np.zeros(BOUNDS[-1])
    out = [row[a:b] for a, b in zip(BOUNDS, BOUNDS[1:])]
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
    coarse = _KIND[codes]
    out[0][:] = np.bincount(_FINE[codes], minlength=30)
    out[1][:27] = np.bincount(_LETTER_OF[codes], minlength=28)[:27]
    # words
    words = WORD.findall(text)
    ids = profiles.look_up(words)
    kinds = np.bincount(profiles.kind[ids], minlength=11).astype(float)
    han, n, f, lang = int(np.count_nonzero(coarse == 5)), float(len(words)), kinds[0], ""
    if han and profiles.han_re and han >= len(words) / 2:
        own = min(han, sum(map(len, profiles.han_re.findall(text))))
        f, n, lang = own / 2, han / 2 + kinds[6:9].sum(), "zh"
        kinds[0], kinds[1:6], kinds[10] = kinds[0] + own / 2, 0.0, (han - own) / 2
    elif f:
        lang = profiles.names[int(profiles.langs[ids].sum(0, dtype=np.int64).argmax())]
    out[2][:] = kinds
    # lines: how they open and end, and how long they are
    ended, lines = 0, [x for x in _LINE_ENDS.split(text) if x and not x.isspace()]
    for x in lines:
        s = x.strip()
        e = END.search(s) is not None
        ended += e
        out[3][(6 if _MARKS_AT.match(s) else 0) + (3 if e else 0) + (0 if len(s) <= 20 else 1 if len(s) <= 60 else 2)] += len(s)
    out[4][:] = _cells(codes, coarse) if len(lines) > 1 else [1.0] + [0.0] * 7
    # parts between commas, semicolons and the like: how many words they have
    out[5][:] = np.bincount([min(5, len(p.split())) for p in _PARTS.split(text)], minlength=6)
    out[5][0] = 0.0
    # what is said again
    h = profiles.hash[ids]
    if len(h) < 12 and han >= 24:
        h = codes[coarse == 5].astype(np.uint64) * _ODD
    out[6][:], out[7][:] = _two(_distinct(h, 3)), _two(_distinct(h, LOOP))
    size = profiles.size[ids]
    letters = np.count_nonzero(size)
    blank = (coarse == 3) | (coarse == 4) | (codes == 9)
    symbols = int(np.count_nonzero((coarse >= 7) & (codes != 9)))
    stats = (int(n), float(size.sum() / letters) if letters else 0.0, symbols / max(1, len(codes) - int(np.count_nonzero(blank))), ended / max(1, len(lines)), float(f / n) if n else 0.0, lang)
    return row, stats


def shares(counts: list[np.ndarray]) -> np.ndarray:
    """Rows of counts with each facet as a distribution; one without any count is even."""
    x = np.stack(counts)
    sizes = np.array(list(FACETS.values()))
    total = np.repeat(np.add.reduceat(x, BOUNDS[:-1], 1), sizes, 1)
    return np.where(total > 0, x / np.where(total > 0, total, 1.0), 1.0 / np.repeat(sizes, sizes)).astype(np.float32)


def _cells(codes: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Characters of lines by the mark that parts their cells: one that a neighbouring line bears as often; 0 without."""
    at = np.cumsum(coarse == 4)
    rows = int(at[-1]) + 1
    marks = _CELL_CODES[codes]
    on = np.flatnonzero(marks)
    count = np.bincount(at[on] * 8 + marks[on], minlength=rows * 8).reshape(rows, 8)
    blank = codes == 32
    gap = np.flatnonzero(blank[1:-1] & blank[:-2] & ~blank[2:]) + 1
    if len(gap):
        count[:, 0] = np.bincount(at[gap], minlength=rows)
    size = np.bincount(at, minlength=rows)
    full = np.bincount(at[(coarse != 3) & (coarse != 4)], minlength=rows) > 0
    count, size = count[full], size[full]
    same = np.zeros(count.shape, bool)
    if len(size) > 1:
        pair = (count[1:] == count[:-1]) & (count[1:] >= np.array([2, 1, 2, 2, 2, 1, 2, 2]))
        same[1:] |= pair
        same[:-1] |= pair
    first = np.where(same.any(1), np.array([1, 2, 3, 4, 5, 6, 7, 7])[same[:, [1, 2, 0, 3, 4, 5, 6, 7]].argmax(1)], 0)
    return np.bincount(first, weights=size, minlength=8)


_PARTS = re.compile(r"[,;，；、·•]\s|\s[/|-]\s|[.!?。！？]\s|\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the multiplier and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_ODD, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_POWERS = _power_table(4096)


def _distinct(h: np.ndarray, size: int) -> float:
    """Share of different ones among all stretches of `size` words (by a rolling hash); 1 where there are none."""
    n = len(h) - size + 1
    if n < 2:
        return 1.0
    up, down = _POWERS if len(h) <= 4096 else _power_table(len(h))
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=s[1:])
    x = np.sort((s[size:] - s[:-size]) * down[:n])
    return (1 + np.count_nonzero(x[1:] != x[:-1])) / n


_TINY, _NAT = np.float32(1e-9), np.float32(1 / np.log(2))


def _minus_entropy(p: np.ndarray) -> np.ndarray:
    """The sum of p log p (natural) over the last axis; no share is 0."""
    return np.einsum("...k,...k->...", p, np.log(p))


class Kinds:
    """Structural profiles: mean facets of groups of texts of one kind and language."""

    def __init__(self, profiles: np.ndarray, kinds: np.ndarray):
        self.profiles, self.kinds = profiles.astype(np.float32) + _TINY, kinds.astype(int)
        self.own = _minus_entropy(self.profiles)

    @classmethod
    @lru_cache(maxsize=1)
    def load(cls) -> "Kinds":
        with np.load(io.BytesIO(pkgutil.get_data("boardloom.llm", "quality_profiles.npz"))) as z:
            return cls(z["profiles"], z["kinds"])

    def divergences(self, x: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Jensen-Shannon divergence (bits, summed over facets) of each row of facets to each profile."""
        x = x.astype(np.float32) + _TINY
        out, mine = np.empty((len(x), len(self.profiles)), np.float32), _minus_entropy(x)
        for k in range(0, len(x), at_once):
            m = (x[k : k + at_once, None, :] + self.profiles[None]) * np.float32(0.5)
            out[k : k + at_once] = (mine[k : k + at_once, None] + self.own[None]) * np.float32(0.5) - _minus_entropy(m)
        return np.maximum(out, 0.0) * _NAT

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind of the nearest profile, least divergence to each kind) of each row; ties go to the earlier of KINDS."""
        d = self.divergences(x)
        by = np.stack([d[:, self.kinds == k].min(1, initial=np.inf) for k in range(len(KINDS))], 1)
        return by.argmin(1), by


def quality(df: DataFrame, row_id: str, text: str, common: dict[str, set[str]]) -> DataFrame:
    """(row_id, words, mean_word_length, symbol_ratio, lines_ended, common_words, language, prose_jsd, kind); prose_jsd is the
    divergence from the nearest profile of prose."""
    id_kind = df.schema[row_id].dataType.simpleString()
    names = ["words", "mean_word_length", "symbol_ratio", "lines_ended", "common_words", "language"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, known = Profiles(common), Kinds.load()
        for b in batches:
            there = [t is not None and not t.isspace() and t != "" for t in b["_text"]]
            got = [facets(t, profiles) for t, ok in zip(b["_text"], there) if ok]
            rows = iter([s for _, s in got])
            out = pd.DataFrame([next(rows) if ok else (0, *[None] * 5) for ok in there], columns=names)
            kind, prose = np.full(len(b), None, object), np.full(len(b), np.nan)
            if got:
                nearest, by = known.nearest(shares([f for f, _ in got]))
                kind[there], prose[there] = np.array(KINDS, object)[nearest], by[:, 0]
            out["prose_jsd"], out["kind"] = prose, kind
            out["prose_jsd"] = out["prose_jsd"].astype(object).where(np.array(there), None)
            out.insert(0, "_id", b["_id"].to_numpy())
            yield out

    rows = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).filter("_id is not null")
    got = spread(rows, "_id").mapInPandas(work, f"_id {id_kind}, words int, mean_word_length double, symbol_ratio double, lines_ended double, common_words double, language string, prose_jsd double, kind string")
    return got.dropDuplicates(["_id"]).withColumnRenamed("_id", row_id)
