"""Fits the structural profiles of `quality.py`: python -m boardloom.llm.train_quality FOLDER.

The sample is at most FIT_ROWS texts of FOLDER/documents.parquet (lowest hashes of their ids first), beside it half as many
passages of them said again and again, and an eighth as many with letters decoded wrongly; its labels are told line by line (`by_lines`), which no query runs. Per kind
and language the texts fall into groups (k-means by Jensen-Shannon divergence); the mean facets of a group are a profile.
Every fourth text is held out, and agreement on those is printed.
"""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from hashlib import blake2b
from pathlib import Path

import numpy as np

from boardloom.llm.quality import END as _END
from boardloom.llm.quality import HAN as _HAN
from boardloom.llm.quality import KINDS, LOOP, Kinds, Profiles, facets, shares
from boardloom.llm.quality import WORD as _WORD

FIT_ROWS, GROUPS, ROUNDS = 10_000, 20, 10
#: Shares of function words, other words, numbers and codes in running text of a language, and in items.
PROSE_WORDS = {"en": (0.46, 0.44, 0.04, 0.06), "de": (0.42, 0.46, 0.04, 0.08), "fr": (0.46, 0.42, 0.04, 0.08), "zh": (0.27, 0.50, 0.10, 0.13)}
ITEM_WORDS = (0.08, 0.62, 0.10, 0.20)
# Per mille of each letter in running text.
LETTERS = {
    "en": dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1))),
    "de": dict(zip("abcdefghijklmnopqrstuvwxyzäöüß", (65, 19, 27, 51, 164, 17, 30, 46, 66, 3, 14, 34, 25, 98, 26, 7, 1, 70, 73, 62, 42, 8, 19, 1, 1, 11, 6, 4, 10, 3))),
    "fr": dict(zip("abcdefghijklmnopqrstuvwxyzéàèêçù", (76, 9, 33, 37, 147, 11, 9, 7, 75, 6, 1, 55, 30, 71, 58, 25, 14, 67, 79, 72, 63, 18, 1, 4, 1, 3, 19, 5, 3, 2, 1, 1))),
}
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_MARK = re.compile(r"\s*(?:[-*•·–—+▪◦‣○●>]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\]|[☐☑✓✗])\s+\S")
_NET = re.compile(r"\s*[\w+.\-]+\s*[:=]\s*(?:[A-Za-z]+\d+(?:-\w+)?(?:[\s,;]+|$))+$")
_INNER = re.compile(r"[a-zà-ÿ)\d][.!?] +[A-ZÀ-Þ]|[。！？]")
_HEX = re.compile(r"\s*(?:0x)?[0-9a-fA-F]{4,16}[:\s]+(?:[0-9a-fA-F]{2,8}\s+){3,}")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
_BROKEN = re.compile(r"[ÃÂ�¿½]|â€|Å[\x80-\xbf]|[\x00-\x08\x0e-\x1f\x80-\x9f]")
_GAPS = re.compile(r"\S(?: {2,}|\t+ *)(?=\S)")
_HTML_ROW = re.compile(r"<\s*/?\s*(?:table|thead|tbody|tr|td|th)\b", re.I)
_ROW_MARKS = ("\t", "|", "│", "┃", "║", "¦", ";", "\",\"", ",", " & ", "::", "~")




def jsd(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence of two distributions, in bits."""
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0.0) + (b * math.log2(b / m) if b else 0.0)
    return out / 2


def letters_jsd(counts: Counter) -> float:
    """The least divergence of letter counts from the letters of a language."""
    total = sum(counts.values())
    best = 1.0
    for table in LETTERS.values():
        keys = {*counts, *table}
        norm = sum(table.values())
        best = min(best, jsd(tuple(counts.get(k, 0) / total for k in keys), tuple(table.get(k, 0) / norm for k in keys)))
    return best


def word_shares(profiles: Profiles, text: str) -> tuple[tuple[float, ...], int, str]:
    """((function words, other words, numbers, codes), number of words, language of most function words)."""
    words = _WORD.findall(text)
    han = len(_HAN.findall(text))
    if han and profiles.han_re and han >= len(words) / 2:
        f = sum(len(m) for m in profiles.han_re.findall(text))
        n = max(1, han)
        digits = sum(1 for w in words if w[0].isdigit())
        codes = sum(1 for w in words if not w[0].isdigit() and not _HAN.match(w))
        total = n / 2 + digits + codes
        return ((min(f, n) / 2 / total, (n - min(f, n)) / 2 / total, digits / total, codes / total), int(total), "zh")
    if not words:
        return ((0.0, 0.0, 0.0, 1.0), 0, "")
    f = o = d = c = 0
    loud = not re.search(r"[a-z]{2}", text)
    langs: Counter = Counter()
    for w in words:
        low = w.lower()
        if low in profiles.any:
            f += 1
            for lang, own in profiles.common.items():
                if low in own:
                    langs[lang] += 1
        elif w.isalpha():
            if len(w) > 1 and not loud and w.isupper():
                c += 1
            else:
                o += 1
        elif not _DIGIT.search(w):
            o += 1
        elif w[0].isdigit() and w[-1].isdigit() and not _LETTER.search(w):
            d += 1
        else:
            c += 1
    n = len(words)
    return ((f / n, o / n, d / n, c / n), n, langs.most_common(1)[0][0] if langs else "")


def is_prose(shares: tuple[float, ...], lang: str) -> bool:
    near = min(jsd(shares, PROSE_WORDS[x]) for x in ([lang] if lang in PROSE_WORDS else PROSE_WORDS))
    return near < jsd(shares, ITEM_WORDS)


def _row_counts(line: str) -> dict[str, int]:
    """How often each cell mark parts the line."""
    out = {}
    for m in _ROW_MARKS:
        if m in line:
            out[m] = line.count(m)
    if ";" in out:
        out[";"] -= line.count("; ")
    if "," in out:
        out[","] -= line.count(", ") + len(re.findall(r"\d,\d{3}\b", line))
    gaps = len(_GAPS.findall(line.strip()))
    if gaps:
        out["gap"] = gaps
    return {m: n for m, n in out.items() if n > 0}


def units(text: str, profiles: Profiles) -> tuple[dict[str, float], dict[str, float]]:
    """(characters in sentences, items, rows and noise; figures found on the way)."""
    lines = [x for x in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text) if x.strip()]
    weight = {"sentence": 0.0, "item": 0.0, "row": 0.0, "noise": 0.0}
    marks = [_row_counts(x) for x in lines]
    kinds: list[str] = []
    for i, x in enumerate(lines):
        s = x.strip()
        body = re.sub(r"\s", "", s)
        letters = sum(map(str.isalpha, body))
        # noise by its characters
        if _HEX.match(x) or (len(body) >= 3 and len(set(body)) <= 2 and set(body) <= set("01")):
            kinds.append("noise")
            continue
        blob = sum(len(m) for m in _BLOB.findall(s) if not re.fullmatch(r"[-=_]+", m) and (re.search(r"\d", m) or re.search(r"[a-z][A-Z]", m)))
        if blob > len(s) / 2 or (len(_BROKEN.findall(s)) > 0.05 * len(body) + 1):
            kinds.append("noise")
            continue
        # rows: a mark that the neighbours bear as often
        near = [marks[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        row = bool(_HTML_ROW.search(x))
        for m, n in marks[i].items():
            same = any(o.get(m) == n for o in near)
            if m in ("\t", "│", "┃", "║", "¦"):
                row |= same or n >= 2
            elif m == "|":
                row |= (n >= 2 and (same or s[0] == "|" or " | " in s)) and sum(map(str.isalnum, body)) > 0.25 * len(body) or bool(re.fullmatch(r"[|+:\s=-]+", s)) and n > 1
            elif m == "gap":
                row |= same and n >= 2
            elif m == "~":
                row |= same and n >= 2 and letters > 0.5 * len(body)
            else:
                row |= same and n >= (1 if m in ('","', " & ", "::") else 2)
        if re.fullmatch(r"\+?(?:[-=─]{2,}[+┼┬┴]?)+", body) and near and any(o for o in near):
            row = True
        symbols = len(body) - letters - sum(map(str.isdigit, body))
        if row and not (symbols > 0.6 * len(body) and not re.fullmatch(r"[|+:\s=─┼-]+", s)):
            kinds.append("row")
            continue
        if body and not letters and symbols > 0.5 * len(body) and len(body) > 5 or (len(body) >= 3 and symbols > 0.55 * len(body) and not (len(body) < 8 and re.search(r"[^\W\d_]{2}", s))):
            kinds.append("noise")
            continue
        if _MARK.match(x) or _NET.match(x):
            # an item whose line runs on into sentences
            on = len(s) > 90 and len(_INNER.findall(s)) > 0 and is_prose(*word_shares(profiles, s)[::2])
            kinds.append("sentence" if on else "item")
            continue
        # items run together: many short parts of few function words
        shares, n, lang = word_shares(profiles, s)
        for mark in ("; ", ", ", " / ", " · ", " • ", " - ", " | ", "；", "、", "，"):
            parts = s.split(mark)
            if len(parts) >= 5 and sorted(len(p.split()) for p in parts)[len(parts) // 2] <= 7 and not is_prose(shares, lang):
                kinds.append("item")
                break
        else:
            if len(s) <= 60 and not (_END.search(s) and (n > 4 or is_prose(shares, lang))) and not _INNER.search(s) and lang != "zh":
                kinds.append("short")
            elif is_prose(shares, lang):
                kinds.append("sentence")
            else:
                kinds.append("sentence" if shares[0] >= 0.12 or _INNER.search(s) or _END.search(s) else "item")
    at = 0
    while at < len(kinds):
        end = at
        while end < len(kinds) and kinds[end] == "short":
            end += 1
        if end > at:
            # a run of short lines that end no sentence: items, unless they are as long as wrapped text, or the rest of it
            sizes = sorted(len(x.strip()) for x in lines[at:end])
            rest = at > 0 and kinds[at - 1] == "sentence" and not _END.search(lines[at - 1]) and len(lines[at - 1]) > 40
            before = end < len(kinds) and kinds[end] == "sentence" and (len(lines[end - 1]) > 45 or end - at == 1)
            wrapped = sizes[len(sizes) // 2] > 45 or (rest and end - at <= 2) or (before and end - at == 1)
            kinds[at:end] = ["sentence" if wrapped else "item"] * (end - at)
        at = max(end, at + 1)
    # a heading or a sentence that opens a list or table weighs little
    opening = 0
    while opening < len(kinds) and kinds[opening] == "sentence" and (not opening or not _END.search(lines[opening - 1])):
        opening += 1
    if sum(len(x.strip()) for x in lines[:opening]) > 200 or opening == len(kinds):
        opening = 0
    for i, (k, x) in enumerate(zip(kinds, lines)):
        weight[k] += len(x.strip()) * (0.15 if i < opening or (not i and len(x) < 60 and len(lines) > 1) else 1.0)
    return weight, {"lines": len(lines), "ended": sum(bool(_END.search(x)) for x in lines)}




def repeated(text: str) -> bool:
    """Whether the text says the same few words, or one longer passage, again and again. Prose made from few sentences has as
    few trigrams, but hardly a stretch of LOOP words comes again in it; in a loop most do, however long the passage."""
    words = re.findall(r"\w+", text.lower())
    if len(words) < 12:
        han = "".join(_HAN.findall(text))
        return len(han) >= 24 and len({han[i : i + 4] for i in range(len(han) - 3)}) < 0.2 * (len(han) - 3)
    grams = len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    if grams >= 0.2 * (len(words) - 2):
        return False
    n = len(words) - LOOP + 1
    return grams < 60 or len({tuple(words[i : i + LOOP]) for i in range(n)}) < 0.2 * n


def garbled(body: str) -> bool:
    """Whether signs of bad recognition stand all over the text."""
    n = [body.count(c) for c in "^`~|!"]
    return sum(x > 0 for x in n) >= 3 and sum(n) > 0.03 * len(body)


def by_lines(text: str, profiles: Profiles) -> str:
    """The kind of a text told line by line: what profiles are fitted to."""
    shares = word_shares(profiles, text)[0]
    words = re.findall(r"[^\W\d_]+", text)
    body = "".join(text.split())
    weight, _ = units(text, profiles)
    letters = Counter("".join(words).lower()) if shares[0] < 0.12 else Counter()
    letters = Counter({c: k for c, k in letters.items() if not _HAN.match(c)})
    total = sum(weight.values()) or 1.0
    if repeated(text) or garbled(body) or (sum(letters.values()) >= 60 and shares[0] < 0.12 and weight["row"] < 0.5 * total and letters_jsd(letters) > 0.13 and sum(letters.values()) > 0.6 * len(body)):
        return "junk"
    return max(KINDS, key=lambda k: (weight[dict(zip(KINDS, ("sentence", "item", "row", "noise")))[k]], -KINDS.index(k)))


def _groups(x: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Mean facets of at most `most` groups."""
    r = np.random.default_rng(seed)
    n = max(1, min(most, len(x) // 8))
    centres = x[r.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = Kinds(centres, np.zeros(n)).divergences(x).argmin(1)
        centres = np.array([x[own == k].mean(0) if (own == k).any() else x[r.integers(len(x))] for k in range(n)])
    return centres


def fit(x: np.ndarray, kinds: np.ndarray, langs: list[str]) -> Kinds:
    """Profiles of each kind and language that has five texts and more; a third as many of what is marked with a plus sign."""
    got, of, langs = [], [], np.array(langs)
    for k in range(len(KINDS)):
        for lang in sorted(set(langs)):
            own = x[(kinds == k) & (langs == lang)]
            if len(own) >= 5:
                got.append(_groups(own, GROUPS // 3 if "+" in lang else GROUPS))
                of += [k] * len(got[-1])
    return Kinds(np.concatenate(got), np.array(of))


def loops(texts: list[str], n: int, seed: int = 7) -> list[str]:
    """Passages of texts, of a few words to a few sentences, said again and again."""
    r, out = random.Random(seed), []
    while len(out) < n:
        words = r.choice(texts).split()
        if len(words) > 12:
            size = r.choice([r.randint(3, 12), r.randint(12, 60), r.randint(60, 200)])
            a = r.randint(0, max(0, len(words) - size))
            out.append(" ".join(words[a : a + size] * (r.randint(12, 60) if r.random() < 0.6 else r.randint(2, 5))))
    return out


_READ_WRONG = ["Ã©", "Ã¼", "ï¿½", "Â°", "â€™", "\ufffd"]


def broken(texts: list[str], n: int, seed: int = 8) -> list[str]:
    """Texts some of whose letters were decoded wrongly, from hardly any to many."""
    r, out = random.Random(seed), []
    for _ in range(n):
        of = {c: r.choice(_READ_WRONG) for c in r.sample("aeiourstnl", r.randint(1, 4))}
        share = r.random()
        out.append("".join(of[c] if c in of and r.random() < share else c for c in r.choice(texts)[:3000]))
    return out


def main(folder: str) -> None:
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    common: dict[str, set[str]] = {}
    for r in pq.read_table(f"{folder}/common_words.parquet").to_pylist():
        common.setdefault(r["lang"], set()).add(r["word"].lower())
    texts = {r["doc_id"]: r["text"] for r in rows if r["text"] and r["text"].strip()}
    order = sorted(texts, key=lambda i: blake2b(str(i).encode()).digest())[:FIT_ROWS]
    sample = [texts[i] for i in order]
    sample += loops(sample[: len(order)], len(order) // 2) + broken(sample[: len(order)], len(order) // 8)
    profiles = Profiles(common)
    got = [facets(t, profiles) for t in sample]
    # loops and broken texts are groups of their own
    x, langs = shares([f for f, _ in got]), [s[5] + "+" * ((i >= len(order)) + (i >= len(order) + len(order) // 2)) for i, (_, s) in enumerate(got)]
    kinds = np.array([KINDS.index(by_lines(t, profiles)) for t in sample])
    held = np.arange(len(x)) % 4 == 3
    near = fit(x[~held], kinds[~held], [lang for lang, h in zip(langs, held) if not h])
    right = near.nearest(x[held])[0] == kinds[held]
    own = np.arange(len(x))[held] < len(order)
    print(f"{len(near.kinds)} profiles; held out, as the lines tell: {right[own].sum()} of {own.sum()} texts, {right[~own].sum()} of {(~own).sum()} loops and broken texts")
    np.savez_compressed(Path(__file__).with_name("quality_profiles.npz"), profiles=near.profiles.astype(np.float16), kinds=near.kinds.astype(np.int8))


if __name__ == "__main__":
    main(sys.argv[1])
