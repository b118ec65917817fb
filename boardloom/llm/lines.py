"""Lines repeated across the documents of one source: found by locality-sensitive hashing, counted exactly, removed.

Numbers, dates and names of each line are masked; lines of five words and more get MinHash values over their five-word
shingles, in BANDS bands of ROWS (a pair of similarity 0.8 shares a band with probability 0.97, one of 0.4 with 0.28), every line also a bucket of
its own masked form. Buckets are counted per source, map-side first; those of high document frequency are the clusters of
repeated lines. The lines in such a cluster, by their bands or their form, as a bit set of fixed size tells, are then counted
exactly (`found`); those of a cluster that are only near each other are told by `near`.

Two lines are the same if they differ only in letter case, white space or the digits 0-9. A line counts if it has a letter
and stands in at least `least` and at least `share` of all distinct documents of its source, those without text included.

Near-duplicate clusters (`near`) are the connected components of the lines of a source: every two different lines of a band
bucket are compared, pairs of shingle similarity SIMILAR and more are linked, and only the merged cluster is held against
the limit. The work in a bucket grows with the square of its different masked lines.

No group is gathered: what moves are bucket numbers and, of the lines in repeated clusters, fixed-size hashes. The
bit set has 2 ** BITS bits whatever the input; where it fills up it lets more lines through to the exact count, none is lost.

Defined results: null and empty texts have no lines but count as documents; rows without a source or an id are left out;
repeated rows count once; extra columns never enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import clear_name, written

WORDS, BANDS, ROWS, BITS, SIMILAR = 5, 5, 3, 23, 0.8
#: Characters of text that are worked on at a time.
AT_ONCE = 1_000_000

_rng = np.random.default_rng(11_400_714)
_T1, _T2 = (_rng.integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1 for _ in range(2))
_A = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * 2 + 1
_MA, _MB = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * 2 + 1, _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACES = [chr(c) for c in (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_KEPT, _NO_DIGIT, _GAP = np.ones(256, bool), np.ones(256, bool), np.zeros(256, bool)
_NO_DIGIT[48:58] = False
_GAP[[10, 32]] = True
_KEPT[[10, 32, *range(48, 58)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xCA5A826395121157)


def _hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each stretch data[starts[i]:starts[i + 1]] (none empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    return _mix(np.add.reduceat(table[data] * _powers(base, int(sizes.max()))[at], starts))


def _stretches(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, owners) of runs of equal owner."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return starts, owner[starts]


def _month_hashes() -> np.ndarray:
    data = [np.frombuffer(m.encode(), np.uint8) for m in _MONTHS]
    return np.sort(_hashes(np.concatenate(data), np.cumsum([0, *map(len, data)])[:-1], _T1, _P2))


_MONTH_HASHES = _month_hashes()


def hash_forms(text: str, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per line of `text` one or two hashes of its masked form (letter case, white space and digits taken out); 0 where nothing is left."""
    n = text.count("\n") + 1
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    kept = _KEPT[data]
    own, at = data[kept], np.cumsum(data == 10, dtype=np.int32)[kept]
    starts, who = _stretches(own, at)
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    k1[who] = _hashes(own, starts, _T1, _P1)
    if second:
        k2[who] = _hashes(own, starts, _T2, _P2)
    return k1, k2


def hash_bands(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line of `text` BANDS bucket hashes over its five-word shingles, numbers, dates and names masked; which lines have
    them; and the shingles of all lines, in order, with the line of each.
    A name is a capitalised word that neither opens its line nor stands among capitals only."""
    n = text.count("\n") + 1
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    data = data[_NO_DIGIT[data]]
    gap = _GAP[data]
    kept = ~gap
    first = kept.copy()
    first[1:] &= gap[:-1]
    own, starts = data[kept], np.flatnonzero(first[kept])
    of = np.cumsum(data == 10, dtype=np.int32)[kept][starts]
    bands, has = np.zeros((n, BANDS), np.uint64), np.zeros(n, bool)
    m = len(starts) - WORDS + 1
    if m <= 0:
        return bands, has, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _hashes(_LOWER[own], starts, _T1, _P2)
    small = np.zeros(n, bool)
    small[of[np.logical_or.reduceat((own >= 97) & (own <= 122), starts)]] = True
    opens = np.diff(of, prepend=-1) != 0
    capital = (own[starts] >= 65) & (own[starts] <= 90)
    month = _MONTH_HASHES[np.minimum(np.searchsorted(_MONTH_HASHES, h), len(_MONTH_HASHES) - 1)] == h
    h[(capital & ~opens & small[of]) | month] = 1
    shingle = np.zeros(m, np.uint64)
    for k in range(WORDS):
        shingle += h[k : k + m] * _A[k]
    whole = of[:m] == of[WORDS - 1 :]
    shingle, at = shingle[whole], of[:m][whole]
    if len(shingle):
        starts, who = _stretches(shingle, at)
        for b in range(BANDS):
            h = np.full(len(who), b + 1, np.uint64)
            for j in range(b * ROWS, (b + 1) * ROWS):
                h = _mix(h * _P1 + np.minimum.reduceat(_mix(shingle * _MA[j] + _MB[j]), starts))
            bands[who, b] = h
        has[who] = True
    return bands, has, shingle, at


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(number of the first row, texts) of stretches of AT_ONCE characters, about."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(b.column("_text").to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size > AT_ONCE:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def _buckets(texts: list[str], source: np.ndarray, near: bool, second: bool, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(row, line number, k1, k2, buckets (lines x 1, or x 1 + BANDS), mask, shingles, their first and last + 1 by line) over all
    lines that have something left when masked. near: with the bands; second: with k2; whole: with the shingles."""
    text = "\n".join(texts)
    for s in _SPACES:
        if s in text:
            text = text.replace(s, " ")
    k1, k2 = hash_forms(text, second)
    counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    src = source.view(np.uint64)[row]
    local, mask = k1[:, None], np.ones((len(row), 1), bool)
    shingles, low, high = np.zeros(0, np.uint64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    if near:
        bands, has, shingles, at = hash_bands(text)
        if whole:
            low, high = np.searchsorted(at, np.arange(len(row))), np.searchsorted(at, np.arange(len(row)), side="right")
        local, mask = np.concatenate([local, bands], 1), np.concatenate([mask, np.repeat(has[:, None], BANDS, 1)], 1)
    # 24 bits of the source in front, so that a bucket tells whose it is
    ids = ((src[:, None] & np.uint64(0xFFFFFF)) << np.uint64(40)) | (_mix(local ^ _mix(src)[:, None]) >> np.uint64(24))
    there = k1 != 0
    return row[there], number[there], k1[there], k2[there], ids[there], mask[there], shingles, low[there], high[there]


def _place(ids: np.ndarray) -> np.ndarray:
    return ((ids ^ (ids >> np.uint64(41))) & np.uint64(2**BITS - 1)).astype(np.int64)


def _sets(source: np.ndarray, shingles: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Per line a hash of its source and its set of shingles, and the set where it comes first; null without shingles."""
    n, size = len(low), high - low
    line = np.repeat(np.arange(n), size)
    each = shingles[np.repeat(low, size) + np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)]
    order = np.lexsort((each, line))
    line, each = line[order], each[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (each[1:] != each[:-1])
    line, each = line[new], each[new]
    starts, who = _stretches(each, line)
    known = np.zeros(n, np.uint64)
    if len(starts):
        # order does not matter to a sum; twice mixed, it tells sets apart as well as 64 bits can
        known[who] = _mix(np.add.reduceat(_mix(each ^ np.uint64(0x5851F42D4C957F2D)), starts) + _mix(source[who].view(np.uint64)))
    first = np.zeros(n, bool)
    first[who[np.unique(known[who], return_index=True)[1]]] = True
    held = first[line]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(line[held], minlength=n))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(each[held].view(np.int64)), mask=pa.array(~first))
    return pa.array(known.view(np.int64), mask=size == 0), lists


_LATIN = re.compile("[A-Za-z]")


def _with_letter(texts: list[str], row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether each of the given lines (in order of rows) has a letter."""
    out, at, own = np.zeros(len(row), bool), -1, []
    for k, (r, n) in enumerate(zip(row.tolist(), number.tolist())):
        if r != at:
            at, own = r, texts[r].split("\n")
        line = own[n - 1]
        out[k] = _LATIN.search(line) is not None or any(map(str.isalpha, line))
    return out


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node of `links` (a, b; a > b) but the least of its connected component, and that least one. Large and small
    stars by turns until no link changes; each step is written."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    was, now = None, mark(links)
    while was != now:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        links = written(small, "small-stars")
        was, now = now, mark(links)
    return links


class Repeated:
    """Repeated lines of `df` (columns source, doc_id, text); see the module."""

    def __init__(self, df: DataFrame, source: str, doc_id: str, text: str, least: int = 4, share: float = 0.25):
        self.rows = df.select(F.col(source).alias("_src"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter("_src is not null and _doc is not null")
        self.rows = self.rows.withColumn("_fh", F.xxhash64("_src"))
        docs = self.rows.groupBy("_fh", F.xxhash64("_doc").alias("_d")).agg(F.lit(1).alias("_one"))
        self.limits = docs.groupBy("_fh").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).cast("long").alias("_limit"))

    def clusters(self, near: bool = False) -> DataFrame:
        """(bucket): per source, buckets of lines with high document frequency, near: of two lines and more; a line that stands
        twice in a document may count twice here."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                source = b.column("_fh").to_numpy()
                for first, texts in _parts(b):
                    *_, ids, mask, _, _, _ = _buckets(texts, source[first : first + len(texts)], near=True, second=False)
                    got, n = np.unique(ids[mask], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int32))], names=["bucket", "n"])

        counted = self.rows.select("_fh", "_text").filter("_text <> ''").mapInArrow(emit, "bucket long, n int").groupBy("bucket").agg(F.sum("n").alias("n"))
        if near:
            return counted.filter("n > 1").select("bucket")
        limits = self.limits.groupBy(F.col("_fh").bitwiseAND(F.lit(0xFFFFFF)).alias("_s")).agg(F.min("_limit").alias("_limit"))
        often = counted.filter("n > 1").withColumn("_s", F.shiftrightunsigned("bucket", 40))
        return often.join(limits, "_s").filter("n >= _limit").select("bucket")

    def lines(self, near: bool = False) -> DataFrame:
        """(_fh, _doc, line_no, k1, k2, letter) of the lines in clusters (and some more, as the bit set tells); near: of the lines
        that share a bucket with any other, with the band buckets shared, the hash `set` of their shingles (null without), and
        the shingles, these once for each set of a batch."""
        clusters = written(self.clusters(near), "line-clusters")
        place = F.col("bucket").bitwiseXOR(F.shiftrightunsigned("bucket", 41)).bitwiseAND(F.lit(2**BITS - 1))
        bits = clusters.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
        found = np.zeros(2**BITS, bool)
        for r in bits.toLocalIterator():  # 2 ** BITS bits at most
            found[r["part"] * 32768 : (r["part"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        shared = self.rows.sparkSession.sparkContext.broadcast(np.packbits(found))
        kind = self.rows.schema["_doc"].dataType.simpleString()

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(shared.value).astype(bool)
            for b in batches:
                source, docs = b.column("_fh").to_numpy(), b.column("_doc")
                for first, texts in _parts(b):
                    row, number, k1, k2, ids, mask, shingles, low, high = _buckets(texts, source[first : first + len(texts)], near=True, second=True, whole=near)
                    hit = bits[_place(ids)] & mask
                    at = np.flatnonzero(hit.any(1))
                    letter = _with_letter(texts, row[at], number[at])
                    cols = [pa.array(source[first + row[at]]), docs.take(pa.array(first + row[at])), pa.array(number[at]), pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(letter, pa.bool_())]
                    if near:
                        bands = hit[at, 1:]
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bands.sum(1))]).astype(np.int32)), pa.array(ids[at, 1:][bands].view(np.int64))))
                        cols += _sets(source[first + row[at]], shingles, low[at], high[at])
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        columns = f"_fh long, _doc {kind}, line_no long, k1 long, k2 long, letter boolean" + (", buckets array<long>, set long, shingles array<long>" if near else "")
        names = [c.split()[0] for c in columns.split(", ")]
        return self.rows.select("_fh", "_doc", "_text").filter("_text <> ''").mapInArrow(emit, columns)

    def near(self) -> DataFrame:
        """(_doc, line_no, cluster) of the lines in near-duplicate clusters of high document frequency. Two lines of equal form,
        or of one bucket with SIMILAR and more of five-word shingles in common, are in one cluster, and so are those that
        others link; a cluster counts if its lines stand in as many documents as repeated lines must."""
        each = written(self.lines(near=True).filter("letter").withColumn("form", F.xxhash64("_fh", "k1", "k2")).drop("k1", "k2", "letter"), "near-lines")
        label = components(written(self._links(each), "line-links"))
        members = each.select("_fh", "_doc", "line_no", "form").join(label, each["form"] == label["a"], "left")
        members = members.select("_fh", "_doc", "line_no", F.coalesce("b", "form").alias("cluster"))
        often = members.select("_fh", "cluster", F.xxhash64("_doc").alias("_d")).distinct().groupBy("_fh", "cluster").count()
        often = often.join(self.limits, "_fh").filter("count >= _limit").select("_fh", "cluster")
        return members.join(often, ["_fh", "cluster"], "left_semi").groupBy("_doc", "line_no").agg(F.min("cluster").alias("cluster"))

    @staticmethod
    def _links(each: DataFrame) -> DataFrame:
        """(a, b): pairs of forms, a > b, whose lines have equal shingles, or share a bucket and are alike."""
        sets = each.filter("shingles is not null").select("set", "shingles", F.explode("buckets").alias("bucket"))
        busy = sets.groupBy("bucket").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high").select("bucket")
        sets = written(sets.join(busy, "bucket", "left_semi").dropDuplicates(["bucket", "set"]), "line-sets")
        one, two = sets.select("bucket", F.col("set").alias("s1"), F.col("shingles").alias("x")), sets.select("bucket", F.col("set").alias("s2"), F.col("shingles").alias("y"))
        # c / (x + y - c) >= p / q in whole numbers, with the costly c named once
        p, q = Fraction(str(SIMILAR)).as_integer_ratio()
        x, y = F.size("x"), F.size("y")
        both = one.join(two, "bucket").filter("s1 < s2").filter(F.least(x, y) * q >= F.greatest(x, y) * p)
        alike = both.filter(F.size(F.array_intersect("x", "y")) * (p + q) >= (x + y) * p).select("s1", "s2").distinct()
        forms = each.filter("set is not null").select("set", "form").distinct()
        least = forms.groupBy("set").agg(F.min("form").alias("b"))
        equal = forms.join(least, "set").select(F.col("form").alias("a"), "b")
        linked = alike.join(least.select(F.col("set").alias("s1"), F.col("b").alias("a")), "s1").join(least.withColumnRenamed("set", "s2"), "s2").select("a", "b")
        return equal.unionByName(linked).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def found(self) -> DataFrame:
        """(_doc, line_no) of the lines that are furniture of their source, counted exactly."""
        lines = written(self.lines().filter("letter"), "lines")
        key = ["_fh", "k1", "k2"]
        often = lines.select(*key, F.xxhash64("_doc").alias("_d")).distinct().groupBy(*key).count()
        often = often.join(self.limits, "_fh").filter("count >= _limit").select(*key)
        return lines.join(often, key, "left_semi").select("_doc", "line_no").distinct()


def without_lines(df: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """`df` with the found lines (_doc, line_no) taken out of its text; other columns as they are; a text that loses all lines is empty."""
    out, key = clear_name(df.columns, "_gone"), clear_name(df.columns, "_doc")
    gone = found.groupBy(F.col("_doc").alias(key)).agg(F.collect_set(F.col("line_no").cast("int")).alias(out))
    lines = F.split(F.col(text), "\n")
    # places that stay, by one pass over a hash set; in their order
    keep = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(out)), lambda i: F.element_at(lines, i))
    joined = df.join(gone, df[doc_id] == gone[key], "left")
    return joined.withColumn(text, F.when(F.col(out).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))).select(*df.columns)
