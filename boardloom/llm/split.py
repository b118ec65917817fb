"""Splitting oversized texts at natural boundaries, by recursive bisection, with an overlap attached afterwards.

A stretch that is too long is cut at its strongest boundary near the midpoint: before a heading, at a blank line, at a line
end, at a sentence end, at white space, in this order; within the middle half first, then anywhere. Both halves are cut
again while they exceed the limit less the overlap. Then every piece but the first is begun `overlap` characters earlier.

Lengths are counted in Unicode code points, of the text without white space at both ends. Defined results: null and blank
texts have no pieces; a text within the limit is one piece; a text without any boundary is cut in the middle, never within
a CR LF pair or before a combining mark; repeated rows of one id count once, rows without an id are left out; all other columns may be carried along.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import clear_name

HEADING, PARAGRAPH, LINE, SENTENCE, SPACE = 5, 4, 3, 2, 1
_LINE = re.compile(r"\r\n|[\n\r]")
_BREAK = re.compile(r"(?:\r\n|[\n\r])[^\S\n\r]*(?:(?:\r\n|[\n\r])[^\S\n\r]*)*")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s)|[。！？；][”’」』）]*")
_NUMBERED = re.compile(r"(?:#{1,6} \S|\d+(?:\.\d+)*\.? +[^\W\d_])")


def is_heading(line: str) -> bool:
    """A line of 3 to 80 characters, all upper case, numbered, marked, or opening with table, figure or section."""
    s = line.strip()
    if not 3 <= len(s) <= 80:
        return False
    return s.isupper() or bool(_NUMBERED.match(s)) and s[-1] not in ".;,:" or s[:8].lower().startswith(("table ", "figure ", "section "))


def boundaries(text: str) -> tuple[list[list[int]], list[int]]:
    """Ascending places of each strength, SPACE first in the list of lists (index = strength - 1)."""
    by: list[list[int]] = [[] for _ in range(HEADING)]
    for m in _BREAK.finditer(text):
        at = m.end()
        if at >= len(text) or not m.start():
            continue
        nxt = text[at : at + 82].splitlines()[0] if text[at : at + 82].strip() else ""
        ends = len(_LINE.findall(m[0]))
        by[(HEADING if is_heading(nxt) else PARAGRAPH if ends > 1 else LINE) - 1].append(at)
    for m in _SENTENCE.finditer(text):
        by[SENTENCE - 1].append(m.end())
    by[SPACE - 1] = [m.end() for m in re.finditer(r"(?<![^\S\n\r])[^\S\n\r]++(?=\S)", text)]
    return by, []


def _nearest(places: list[int], a: int, b: int, mid: float) -> int | None:
    """The place in (a, b) nearest to mid."""
    i = bisect.bisect_left(places, mid)
    near = [p for p in places[max(0, i - 1) : i + 1] if a < p < b]
    return min(near, key=lambda p: (abs(p - mid), p)) if near else None


def _cut(text: str, by: list[list[int]], a: int, b: int) -> int:
    mid, quarter = (a + b) / 2, (b - a) / 4
    for low, high, least in ((a + quarter, b - quarter, SENTENCE), (a, b, SENTENCE), (a + quarter, b - quarter, SPACE), (a, b, SPACE)):
        for strength in range(HEADING, least - 1, -1):
            p = _nearest(by[strength - 1], low, high, mid)
            if p is not None:
                return p
    p = (a + b) // 2
    while p > a + 1 and (unicodedata.combining(text[p]) or text[p - 1 : p + 1] == "\r\n" or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces with overlap, in the text without outer white space; [] for blank texts."""
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n)]
    by, _ = boundaries(text)
    stack, cores = [(0, n)], []
    while stack:
        a, b = stack.pop()
        if b - a <= limit - overlap:
            cores.append((a, b))
            continue
        p = _cut(text, by, a, b)
        stack += [(p, b), (a, p)]
    return [(max(0, a - overlap), b) for a, b in cores]


def split(df: DataFrame, row_id: str, text: str, keep: tuple[str, ...] = (), limit: int = 1800, overlap: int = 250, long_only: bool = False, with_text: bool = True) -> DataFrame:
    """(row_id, keep..., piece, pieces, start, end, piece_text): piece counts from 0; start and end are places in the
    text without outer white space. long_only: of texts beyond the limit alone, which are told apart before Python sees them."""
    rows = df.select(row_id, *keep, F.col(text).alias(clear_name([row_id, *keep], "_text")))
    body = rows.columns[-1]
    rows = rows.filter(F.col(row_id).isNotNull())
    rows = rows.filter(F.length(body) > limit) if long_only else rows.filter(F.length(body) > 0)
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (row_id, *keep)]
    names = [clear_name([row_id, *keep], x) for x in ("piece", "pieces", "start", "end", "piece_text")][: 5 if with_text else 4]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own in b.itertuples(index=False, name=None):
                t = own[-1].strip()
                got = spans(t, limit, overlap)
                if long_only and len(got) < 2:
                    continue
                out += [(*own[:-1], k, len(got), s, e, *([t[s:e]] if with_text else [])) for k, (s, e) in enumerate(got)]
            yield pd.DataFrame(out, columns=[row_id, *keep, *names])

    kinds = ["int", "int", "long", "long", "string"][: len(names)]
    return rows.mapInPandas(cut, ", ".join([*fields, *(f"`{n}` {k}" for n, k in zip(names, kinds))])).dropDuplicates([row_id, names[0]])
