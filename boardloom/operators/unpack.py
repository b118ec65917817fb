"""Several values packed in one field: infer each source's delimiters, split, explode with position.

A cell such as ``R1, R2 & R3``, ``["C1","C2"]``, ``R7-9`` or ``Q1/2/5`` stands for several designators. Whatever stands
between two designators (or numbers that go on from one) is a candidate; none is listed in advance. Each candidate of a
source is scored in three readings - it parts two pieces, it spans from one to the other, or what follows is no piece of
its own - on how often the number of pieces is then the quantity typed beside the cell (piece-count consistency) and how
regular the pieces on both sides are (piece type). Scores of a source are drawn towards those of all sources, and those
towards a weak prior (PRIOR), so that a rare mark is read as elsewhere. The best reading cuts the cells of that source.

Defined results: rows without an id, null, empty and blank cells and cells without a designator give no rows; extra columns
never enter; the same designator typed twice gives two rows; repeated rows of one id give one set of rows (they count in the
scores as often as they stand); a span whose ends differ in their letters, or one of a chain of spans, gives its ends; spans
of any length are written out, row by row, never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import blank

PART, SPAN, NONE = "part", "span", "none"
#: Marks that are taken for spans unless scores say otherwise; all others are taken to part.
PRIOR = {"-", "..", "~", ":", "TO", "THRU", "THROUGH", "BIS"}
#: Cells that the prior, and the scores of all sources, count for beside the cells of a source.
PRIOR_CELLS, COMMON_CELLS = 4.0, 8.0
#: Rows handed on at a time.
AT_ONCE = 20_000
_QUOTES = re.compile(r"[\"'`“”‘’„«»\[\]{}()<>]")
_SPACE = "\r\v\f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))
_TO_SPACE = str.maketrans(dict.fromkeys(_SPACE, " ") | {"\r": "\n", "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-", "…": "~", "～": "~"})
_TOKEN = re.compile(r"([A-Z]+-?)?(\d+)")
_AGAIN = re.compile(r"([^\w\s])\s*(?:\1\s*)+")


def pieces(cell: str | None) -> tuple[list[tuple[str, str]], list[str]]:
    """([(letters or "", digits)], [mark before each piece but the first]) of a cell, in reading order."""
    if not cell:
        return [], []
    text = _QUOTES.sub(" ", cell.translate(_TO_SPACE)).upper()
    out, marks, end = [], [], 0
    for m in _TOKEN.finditer(text):
        if out:
            marks.append(_mark(text[end : m.start()]))
        out.append((m[1] or "", m[2]))
        end = m.end()
    return out, marks


def _mark(between: str) -> str:
    """What stands between two pieces, in one spelling: repeats as one (full stops as two), blanks only where nothing else stands."""
    bare = between.strip()
    if not bare:
        return "\n" if "\n" in between else "\t" if "\t" in between else " "
    if len(bare) > 1:
        bare = _AGAIN.sub(lambda m: ".." if m[1] == "." else m[1], bare)
        bare = re.sub(r"\s+", " ", bare).strip()
    return bare


def prior(mark: str) -> str:
    return SPAN if mark in PRIOR else PART


def runs(out: list[tuple[str, str]], marks: list[str], reading) -> list[tuple[str, int, int, int]]:
    """(letters, first number, last number, width of padded digits) in reading order; reading: mark -> how it is read."""
    how = [reading(m) for m in marks]
    got: list[tuple[str, int, int, int]] = []
    letters, k = "", 0
    while k < len(out):
        end = k
        while end < len(how) and how[end] == SPAN:
            end += 1
        head, a = out[k]
        head = head or letters
        if end == k + 1:
            tail, b = out[end]
            if tail and head and tail.endswith("-") and not head.endswith("-") and tail[:-1] == head:
                tail = head
            if head and (not tail or tail == head):
                got.append((head, int(a), int(b), len(a) if a[0] == "0" else 0))
                letters, k = head, end + 1
            else:
                got += [(x, int(n), int(n), len(n)) for x, n in ((head, a), (tail or head, b)) if x]
                letters, k = tail or head or letters, end + 1
        else:
            for x, n in out[k : end + 1]:
                letters = x or letters
                if letters:
                    got.append((letters, int(n), int(n), len(n)))
            k = end + 1
        # pieces that are none of their own belong to the one before
        while k < len(out) and how[k - 1] == NONE:
            k += 1
    return got


def names(got: list[tuple[str, int, int, int]]) -> Iterator[str]:
    """The designators of runs, written out one after the other."""
    for letters, a, b, width in got:
        step = 1 if b >= a else -1
        for n in range(a, b + step, step):
            yield f"{letters}{n:0{width}d}"


def size(got: list[tuple[str, int, int, int]]) -> int:
    return sum(abs(b - a) + 1 for _, a, b, _ in got)


def unpack_cell(cell: str | None, readings: dict[str, str] | None = None) -> list[str]:
    """The designators of one cell, upper case, spans written out, in reading order; readings: mark -> reading, where it is not the prior's."""
    readings = readings or {}
    return list(names(runs(*pieces(cell), lambda m: readings.get(m) or prior(m))))


def evidence(cell: str | None, quantity: int | None) -> Iterator[tuple[str, float, float, float]]:
    """(mark, scores of the readings PART, SPAN and NONE) of each different mark in a cell."""
    out, marks = pieces(cell)
    for mark in dict.fromkeys(marks):
        at = [k for k, m in enumerate(marks) if m == mark]
        # piece types: a span goes up within the same letters, by more than one, and ends there
        rising = sum(out[k + 1][0] in ("", out[k][0]) and int(out[k][1]) + 1 < int(out[k + 1][1]) and k + 1 not in at and k - 1 not in at for k in at) / len(at)
        regular = {PART: 1.0 - 0.5 * rising, SPAN: rising, NONE: 0.0}
        score = []
        for how in (PART, SPAN, NONE):
            same = 0.5 if quantity is None else float(size(runs(out, marks, lambda m: how if m == mark else prior(m))) == quantity)
            score.append(0.7 * same + 0.3 * regular[how])
        yield mark, *score


_READINGS = (PART, SPAN, NONE)


def source_readings(cells: DataFrame) -> DataFrame:
    """(_source, _how: map of mark -> reading) for each source with marks that are not read as the prior would; cells:
    _source, _cell, _qty. Cells are counted where they lie; what moves is one row for each source and mark of a batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str | None, str], list[float]] = {}
            for source, cell, q in zip(b["_source"], b["_cell"], b["_qty"]):
                for mark, *score in evidence(cell, None if pd.isna(q) else int(q)):
                    own = sums.setdefault((source, mark), [0.0] * 4)
                    own[0] += 1.0
                    for k in range(3):
                        own[k + 1] += score[k]
            yield pd.DataFrame([(*key, *v) for key, v in sums.items()], columns=["_source", "mark", "n", *_READINGS])

    sums = ["n", *_READINGS]
    own = cells.mapInPandas(count, "_source string, mark string, n double, part double, span double, none double")
    own = own.groupBy("_source", "mark").agg(*(F.sum(c).alias(c) for c in sums))
    spans = F.col("mark").isin(*sorted(PRIOR))
    weight = {PART: F.when(spans, 0.3).otherwise(0.8), SPAN: F.when(spans, 0.8).otherwise(0.3), NONE: F.lit(0.2)}
    every = own.groupBy("mark").agg(*(F.sum(c).alias(f"a_{c}") for c in sums))
    mean = {r: (F.col(f"a_{r}") + PRIOR_CELLS * weight[r]) / (F.col("a_n") + PRIOR_CELLS) for r in _READINGS}
    score = [((F.col(r) + COMMON_CELLS * mean[r]) / (F.col("n") + COMMON_CELLS)).alias(f"s_{r}") for r in _READINGS]
    scored = own.join(every, "mark").select("_source", "mark", *score)
    best = F.greatest(*(F.col(f"s_{r}") for r in _READINGS))
    how = F.when(F.col("s_part") == best, PART).when(F.col("s_span") == best, SPAN).otherwise(NONE)
    other = scored.withColumn("how", how).filter(F.col("how") != F.when(spans, SPAN).otherwise(PART))
    return other.groupBy("_source").agg(F.map_from_entries(F.collect_list(F.struct("mark", "how"))).alias("_how"))


def unpack(df: DataFrame, row_id: str, source: str, cell: str, quantity: str | None = None, least: int = 2) -> DataFrame:
    """(row_id, pos, refdes) of every cell that holds at least `least` designators; pos counts from 1 in reading order."""
    want = F.regexp_extract(F.coalesce(F.col(quantity).cast("string"), F.lit("")), r"([0-9]+)", 1).try_cast("int") if quantity else F.lit(None).cast("int")
    rows = df.select(F.col(row_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(cell).alias("_cell"), want.alias("_qty"))
    rows = rows.filter(F.col("_id").isNotNull() & ~blank(F.col("_cell")))
    readings = source_readings(rows.select("_source", "_cell", "_qty"))
    # re-delivered rows repeat id and cell; the state of the aggregate is one row per id
    once = rows.groupBy("_id").agg(F.min_by(F.struct("_source", "_cell"), F.struct("_cell", "_source")).alias("_r")).select("_id", "_r.*")
    told = once.join(readings, once["_source"].eqNullSafe(readings["_source"]), "left").select("_id", "_cell", "_how")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, pos, out = [], [], []
        for b in batches:
            for i, c, how in zip(b["_id"], b["_cell"], b["_how"]):
                other = dict(how) if how is not None else {}
                got = runs(*pieces(c), lambda m: other.get(m) or prior(m))
                if size(got) < least:
                    continue
                for k, name in enumerate(names(got), 1):
                    ids.append(i)
                    pos.append(k)
                    out.append(name)
                    if len(out) >= AT_ONCE:
                        yield pd.DataFrame({"row_id": ids, "pos": pos, "refdes": out})
                        ids, pos, out = [], [], []
        yield pd.DataFrame({"row_id": pd.Series(ids, dtype=object if not ids else None), "pos": pd.Series(pos, dtype="int64"), "refdes": pd.Series(out, dtype=object)})

    kind = df.schema[row_id].dataType.simpleString()
    return told.mapInPandas(cut, f"row_id {kind}, pos long, refdes string")
