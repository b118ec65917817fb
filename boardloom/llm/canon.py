"""Values typed by hand mapped to the entry of a reference list that is meant, or to none.

The reference list becomes a symmetric-delete dictionary: every key with up to EDITS characters taken out of its first PREFIX
points to its entries, so all entries within a bounded edit distance are found by look-up (`allowed`: none for short keys,
one, two for long ones and only where no key is one away). They are ranked by a weighted Damerau-Levenshtein distance (look-alike characters and swaps cost
less), then by how often the entry occurs, as written, in the table itself, then by key. Where members of a family differ
in one character, that character decides: a value that differs from an entry just there names another part, not that one.

The dictionary of lists of up to MOST_ENTRIES is broadcast, and values are looked up where they lie, each distinct one once a
worker process. Longer lists are never held whole: entries and distinct values meet by a join on all keys that a look-up could
use (`entry_keys`, `asked_keys`), and each value is resolved among the entries it met, with the same result. Defined results: null and blank values and exact spellings are no cases; fillers (`n/a`, `any`,
...) and values near no entry, or equally near to several, map to -1; repeated rows of one id count once, rows without an id are left out.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import blank, spread, written

MOST_ENTRIES = 500_000
#: Edits at most, and the stretch of a key that deletions are taken from.
EDITS, PREFIX = 2, 8
MEMO = 200_000

# Look-alike letters, fillers, words around names.
_LOOKS = dict(zip("аеорсхуіјѕԁԛһкмтвнАВЕКМНОРСТУХІЈЅαορνιτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdqhkmtbhABEKMHOPCTYXIJSaopvitkABEZHIKMNOPTYX"))
_FILLERS = {"", "na", "none", "null", "nil", "any", "generic", "tbd", "tba", "tbc", "unknown", "various", "seenote", "seeavl", "avl", "see", "note", "notknown", "asabove", "same", "ditto", "other", "misc", "std", "standard", "nopreference", "open", "x", "xx", "xxx", "dnp", "seebom", "tobedefined", "anybrand", "noname", "oem", "default", "variousmanufacturers"}
_LEGAL = {"co", "ltd", "inc", "corp", "gmbh", "ag", "bv", "b", "v", "sa", "s", "a", "llc", "limited", "company", "corporation", "kg", "plc", "oy", "ab", "srl", "spa", "pte", "pty", "nv", "incorporated"}
_AROUND = {"by", "oem", "avl", "see", "note", "or", "equal", "equiv", "equivalent", "mfr", "mfg", "manufacturer", "from", "the", "brand", "approved", "only", "preferred", "alt", "ex", "via", "made", "and", "per", "original"}
_PACKING = r"(?:T ?[/&] ?R|TR|REEL|TAPE|CUT TAPE|RL|TUBE|TRAY|BULK|CT|ND|DKR)"


def fold(text: str) -> str:
    """Compatibility forms, look-alike letters and accents as plain letters; invisible characters out; upper case."""
    if text.isascii():
        return text.upper()
    text = "".join("-" if unicodedata.category(c) == "Pd" or c == "\u2212" else _LOOKS.get(c, c) for c in unicodedata.normalize("NFKC", text))
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.translate({0xF8: "o", 0xD8: "O", 0xDF: "ss", 0x142: "l", 0x131: "i", 0x111: "d"}).upper()


def allowed(size: int) -> float:
    """Edits that two keys, the longer of so many characters, may be apart: none below 5, one below 9, then two."""
    return 0.0 if size < 5 else 1.0 if size < 9 else 2.0


def deletes(key: str, edits: int = EDITS, prefix: int = PREFIX) -> set[str]:
    """The first `prefix` characters of a key with up to `edits` of them taken out."""
    key = key[:prefix]
    out, last = {key}, {key}
    for _ in range(edits):
        last = {k[:i] + k[i + 1 :] for k in last for i in range(len(k))}
        out |= last
    return out


def found_by(key: str) -> set[str]:
    """All that a key is found by: within one edit of the whole, within two by its beginning (the latter holds the former)."""
    return deletes(key)


_ALIKE = {frozenset(p) for p in ("0O", "1I", "1L", "5S", "8B", "2Z", "IL", "0D", "6G", "UV", "0Q", "OQ")}


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Weighted Damerau-Levenshtein (restricted): look-alikes 0.3, swaps 0.7, doubled or dropped double letters 0.7, else 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.3 if frozenset((x, y)) in _ALIKE else 1.0
            drop = 0.7 if i > 1 and x == a[i - 2] else 1.0
            add = 0.7 if j > 1 and y == b[j - 2] else 1.0
            v = min(before[j] + drop, row[j - 1] + add, before[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                v = min(v, older[j - 2] + 0.7)
            row.append(v)
        if min(row) > most:
            return most + 1
    return row[-1]


class Dictionary:
    """Keys with their ids, found by bounded edit distance."""

    def __init__(self):
        self.ids: dict[str, set[int]] = defaultdict(set)
        #: keys by what is left with one character out, and by their beginning with EDITS characters out
        self.one: dict[str, list[str]] = defaultdict(list)
        self.near: dict[str, list[str]] = defaultdict(list)

    def add(self, key: str, ref_id: int) -> None:
        if key not in self.ids:
            for d in deletes(key, 1, len(key)):
                self.one[d].append(key)
            for d in deletes(key):
                self.near[d].append(key)
        self.ids[key].add(ref_id)

    def find(self, key: str) -> list[tuple[float, str]]:
        """(distance, key) of the keys within the edits allowed, nearest first; two edits only where no key is one away."""
        if not allowed(len(key)):
            return [(0.0, key)] if key in self.ids else []
        got = {k for d in deletes(key, 1, len(key)) for k in self.one.get(d, ())}
        if near := sorted((d, k) for k in got if (d := distance(key, k, 1.0)) <= 1.01):
            return near
        if allowed(len(key) + EDITS) < EDITS:
            return []
        got = {k for d in deletes(key) for k in self.near.get(d, ()) if abs(len(k) - len(key)) <= EDITS}
        return sorted((d, k) for k in got if (d := distance(key, k, EDITS)) <= allowed(max(len(key), len(k))) + 0.01)


#: How much farther the runner-up must be: of a match by two edits, and of any other.
FAR, NEAR = 0.45, 0.05


def margin(d: float) -> float:
    return FAR if d > 1.01 else NEAR


def _crc(text: str) -> str:
    return f"{len(text)}:{crc32(text.encode('utf-8', 'replace'))}"


def _prefix_keys(kind: str, text: str) -> list[tuple[str, int]]:
    """(key, length) of each beginning of a text, told by checksums (equal ones only mean one entry more to look at)."""
    out, crc = [], 0
    for n, c in enumerate(text, 1):
        crc = crc32(c.encode("utf-8", "replace"), crc)
        out.append((f"{kind}:{n}:{crc}", n))
    return out


class Names:
    """The list of manufacturers: (id, name, short name)."""

    def __init__(self, rows: list[tuple[int, str, str | None]], frequency: dict[str, int]):
        self.brands, self.wholes = Dictionary(), Dictionary()
        self.shorts: dict[str, set[int]] = defaultdict(set)
        self.kinds: dict[int, list[str]] = {}
        self.brand_of: dict[int, str] = {}
        self.count = {i: frequency.get(n, 0) for i, n, _ in rows}
        self.sorted: list[str] | None = None
        for i, name, short in rows:
            words = self.core(name)
            if not words:
                continue
            self.brands.add(words[0], i)
            self.wholes.add("".join(words), i)
            self.kinds[i], self.brand_of[i] = words[1:], words[0]
            if short:
                self.shorts[fold(short)].add(i)

    @classmethod
    def entry_keys(cls, name: str, short: str | None) -> set[str]:
        """What an entry can be found by."""
        words = cls.core(name)
        if not words:
            return set()
        whole = "".join(words)
        out = {f"bd:{d}" for d in found_by(words[0])} | {f"wd:{d}" for d in found_by(whole)} | {f"b:{_crc(words[0])}"}
        out |= {key for key, n in _prefix_keys("p", whole) if n >= 5}
        return out | ({f"s:{fold(short)}"} if short else set())

    @classmethod
    def asked_keys(cls, value: str) -> set[str]:
        """What a value looks up, all rules together."""
        words = cls.core(value)
        squeezed = "".join(words)
        out = {f"s:{w}" for w in words} | {f"bd:{d}" for w in words if len(w) > 3 for d in found_by(w)} | {f"wd:{d}" for d in found_by(squeezed)}
        out |= {f"bd:{d}" for a, b in zip(words, words[1:]) for d in found_by(a + b)} | {key for key, n in _prefix_keys("b", squeezed) if n >= 5}
        return out | ({f"p:{_crc(squeezed)}"} if len(squeezed) >= 5 else set())

    @staticmethod
    def core(text: str) -> list[str]:
        """The words of a name without its legal form and what stands around it."""
        text = re.sub(r"[\[(].*?[\])]|[\[(].*$", " ", fold(text))
        text = re.sub(r"\s(?:-|/|;)\s.*$|/.*$", " ", text)
        words = re.findall(r"[A-Z0-9]+", re.sub(r"(?<=\b[A-Z])\.(?=[A-Z]\b)", "", text))
        out = [w for w in words if w.lower() not in _AROUND]
        while len(out) > 1 and out[-1].lower() in _LEGAL:
            out.pop()
        return [w for k, w in enumerate(out) if not k or w.lower() not in _LEGAL or len(w) > 3]

    def _suits(self, ref: int, rest: list[str]) -> bool:
        """Whether the words beside the brand are, cut short or abbreviated or mistyped, the kind of business in the name."""
        kinds = "".join(self.kinds[ref])
        text = "".join(rest)
        if not text or kinds.startswith(text) or text.startswith(kinds):
            return True
        if distance(text, kinds) <= 1.01 or (len(text) < len(kinds) and len(text) > 3 and distance(text, kinds[: len(text)]) <= 1.01):
            return True
        # abbreviation: first letter the same, the others in order
        it = iter(kinds)
        return len(text) >= 2 and text[0] == kinds[0] and all(c in it for c in text)

    def resolve(self, value: str) -> int:
        if "".join(re.findall(r"[a-z0-9]", fold(value).lower())) in _FILLERS:
            return -1
        words = self.core(value)
        if not words:
            return -1
        squeezed = "".join(words)
        best: list[tuple[float, int, str, int]] = []
        for k, w in enumerate(words):
            rest = words[:k] + words[k + 1 :]
            if w in self.shorts:
                best += [(0.2, -self.count[i], self.brand_of[i], i) for i in self.shorts[w] if self._suits(i, rest)]
            for d, key in self.brands.find(w) if len(w) > 3 else []:
                best += [(d, -self.count[i], key, i) for i in self.brands.ids[key] if self._suits(i, rest)]
        for d, key in self.wholes.find(squeezed):
            best += [(d, -self.count[i], key, i) for i in self.wholes.ids[key]]
        if not best:
            best = self._cut_short(squeezed) or self._parted(words)
        if not best:
            return -1
        best.sort()
        near = {i for d, _, _, i in best if d <= best[0][0] + margin(best[0][0])}
        return best[0][3] if len(near) == 1 or best[0][0] == 0 and best[0][1] < best[1][1] else -1

    def _cut_short(self, squeezed: str) -> list[tuple[float, int, str, int]]:
        """A name run together or cut off: the one whose beginning it is."""
        if len(squeezed) < 5:
            return []
        if self.sorted is None:
            self.sorted = sorted(self.wholes.ids)
        got = []
        for k in self.sorted[bisect_left(self.sorted, squeezed) :]:
            if not k.startswith(squeezed):
                break
            got += [(0.5, -self.count[i], k, i) for i in self.wholes.ids[k]]
        if got:
            return got if len({i for *_, i in got}) == 1 else []
        for n in range(5, len(squeezed) + 1):
            brand = squeezed[:n]
            got += [(0.5 - n / 1000, -self.count[i], brand, i) for i in self.brands.ids.get(brand, ()) if self._suits(i, [squeezed[n:]])]
        return got

    def _parted(self, words: list[str]) -> list[tuple[float, int, str, int]]:
        """A blank typed within the brand."""
        out = []
        for k in range(len(words) - 1):
            for d, key in self.brands.find(words[k] + words[k + 1]):
                out += [(d + 0.3, -self.count[i], key, i) for i in self.brands.ids[key] if self._suits(i, words[:k] + words[k + 2 :])]
        return out


class _Any(set):
    """A set that holds everything."""

    def __contains__(self, x: object) -> bool:
        return True


class Parts:
    """The catalogue of part numbers: (id, part number)."""

    def __init__(self, rows: list[tuple[int, str]], frequency: dict[str, int], brands: set[str], live: dict[str, set[int]] | None = None):
        #: places where an entry's family has several characters, where told from outside (rows are not the whole list)
        self.live = live
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.tight = Dictionary()
        self.count = {i: frequency.get(n, 0) for i, n in rows}
        self.brands = brands
        #: form with one place left open -> the characters that members of the family have there
        self.families: dict[str, set[str]] = defaultdict(set)
        for i, number in rows:
            key = self.squeeze(fold(number))
            self.exact[key].add(i)
            self.tight.add(key, i)
        for key in self.exact:
            for k in range(len(key)):
                self.families[f"{key[:k]}\x00{key[k + 1 :]}"].add(key[k])
        self.looks: dict[str, set[str]] = defaultdict(set)
        for key in self.exact:
            self.looks[self.plain(key)].add(key)

    @classmethod
    def entry_keys(cls, number: str) -> set[str]:
        key = cls.squeeze(fold(number))
        return {f"e:{key}", f"l:{cls.plain(key)}"} | {f"d:{d}" for d in found_by(key)}

    @classmethod
    def asked_keys(cls, value: str) -> tuple[set[str], set[str]]:
        """(keys of parts, keys of the makers whose names may stand before a number)."""
        forms = cls([], {}, _Any()).forms(value)
        keys = {k for f in forms for k in (f"e:{f}", f"l:{cls.plain(f)}")} | {f"d:{d}" for f in forms if len(f) >= 6 for d in found_by(f)}
        return keys, {f"b:{_crc(w)}" for w in re.findall(r"[A-Z]{3,}", fold(value))}

    @staticmethod
    def squeeze(text: str) -> str:
        return "".join(re.findall(r"[A-Z0-9]", text))

    @staticmethod
    def plain(key: str) -> str:
        """Characters that are taken for one another as one."""
        return key.translate(str.maketrans("OIQDSBZL", "01005821"))

    def forms(self, value: str) -> list[str]:
        """The value, and what is left of it when packing, marks and makers around it are taken off; squeezed, likeliest first."""
        text = re.sub(r"\s+", " ", fold(value)).strip(" \"'`*?!.,;")
        out = [text]
        # what is known to stand around part numbers
        t = re.sub(r"^(?:P ?/ ?N|PN|MPN|PART|P\.N\.)\s*[:.#]?\s*", "", text)
        t = re.sub(r"\s*\((?:[^)]*)\)?$|\s+(?:OR EQUIV.*|OR EQUAL.*|REV\.? .*|ALT\.? .*|\[.*)$", "", t).strip(" []\"'*?")
        out.append(t)
        t2 = re.sub(rf"(?:[\s\-/#,]+{_PACKING}|,\d{{3}}|#\w{{1,4}})$", "", t).strip()
        out.append(t2)
        for x in (t, t2):
            m = re.match(r"([A-Z]{3,})(?:\s*[:\s/]\s*|\s*-\s*)(?=.*\d)(.+)$", x)
            if m and (m[1] in self.brands or len(m[1]) >= 5 or ":" in x):
                out.append(m[2])
        return list(dict.fromkeys(s for x in out if (s := self.squeeze(x))))

    def _deviates(self, key: str, entry: str) -> bool:
        """Whether key differs from entry by another character where entry's family has several."""
        if len(key) != len(entry):
            return False
        diff = [k for k in range(len(key)) if key[k] != entry[k]]
        return len(diff) <= EDITS and any(k in self.live.get(entry, ()) if self.live is not None else len(self.families.get(f"{entry[:k]}\x00{entry[k + 1 :]}", ())) > 1 for k in diff)

    def resolve(self, value: str) -> int:
        forms = self.forms(value)
        if not forms or forms[-1].lower() in _FILLERS or forms[0].lower() in _FILLERS:
            return -1
        for f in forms:
            if len(self.exact.get(f, ())) == 1:
                return next(iter(self.exact[f]))
        for f in forms:
            # characters taken for one another
            same = self.looks.get(self.plain(f), ())
            if len(same) == 1 and len(f) >= 6:
                key = next(iter(same))
                if len(self.exact[key]) == 1 and not self._deviates_unlike(f, key):
                    return next(iter(self.exact[key]))
        best: list[tuple[float, int, str]] = []
        for f in reversed(forms):
            if len(f) < 6:
                continue
            got = [(d, -min(self.count[i] for i in self.exact[k]), k) for d, k in self.tight.find(f) if not self._deviates(f, k)]
            if got:
                best = sorted(got)
                break
        if not best or (len(best) > 1 and best[1][0] <= best[0][0] + margin(best[0][0])):
            return -1
        ids = self.exact[best[0][2]]
        return next(iter(ids)) if len(ids) == 1 else -1

    @staticmethod
    def _deviates_unlike(a: str, b: str) -> bool:
        return sum(x != y for x, y in zip(a, b)) > 3


_BUILT: dict[str, tuple] = {}


def _dictionaries(token: str, shared) -> tuple[Names, Parts, dict[str, set[str]], dict[tuple[str, str], int]]:
    """The dictionaries of a broadcast list, and what values were found to be: built once in each worker process, the last list's alone kept."""
    if token not in _BUILT:
        makers, parts, often_makers, often_parts = shared.value
        names = Names(makers, often_makers)
        _BUILT.clear()
        _BUILT[token] = (names, Parts(parts, often_parts, set(names.brands.ids)), {"manufacturer": {n for _, n, _ in makers}, "part_number": {n for _, n in parts}}, {})
    return _BUILT[token]


def frequencies(df: DataFrame, entries: DataFrame, key: str) -> dict[str, int]:
    """How often each entry stands in the values (_v), as written; as many rows as there are entries, at most."""
    own = df.join(entries.select(F.col(key).alias("_v")).distinct(), "_v", "left_semi")
    return {r["_v"]: r["count"] for r in own.groupBy("_v").count().collect()}


def _counted(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(_v) of the column's values; re-delivered rows count once: a row is its id and its value."""
    return df.select(F.col(row_id).alias("_i"), F.col(column).alias("_v")).filter("_i is not null and _v is not null").distinct().select("_v")


def resolve(df: DataFrame, row_id: str, manufacturer: str, part_number: str, makers: DataFrame, parts: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(row_id, field, ref_id) of every value that is no exact entry; makers: mfr_id, name, short_name; parts: part_id, part_number."""
    makers = makers.select("mfr_id", "name", "short_name").filter("name is not null").distinct()
    parts = parts.select("part_id", "part_number").filter("part_number is not null").distinct()
    pick = [F.col(row_id).alias("_id"), F.explode(F.array(F.struct(F.lit("manufacturer").alias("field"), F.col(manufacturer).alias("value")), F.struct(F.lit("part_number").alias("field"), F.col(part_number).alias("value")))).alias("_v")]
    rows = df.select(*pick).select("_id", "_v.*").filter(F.col("_id").isNotNull() & ~blank(F.col("value")))
    few = makers.limit(most + 1).count() <= most and parts.limit(most + 1).count() <= most
    got = _by_broadcast(df, row_id, manufacturer, part_number, makers, parts, rows) if few else _by_join(df, row_id, manufacturer, part_number, makers, parts, rows)
    return got.dropDuplicates(["_id", "field"]).withColumnRenamed("_id", row_id)


def _by_broadcast(df: DataFrame, row_id: str, manufacturer: str, part_number: str, makers: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    maker_rows, part_rows = [tuple(r) for r in makers.collect()], [tuple(r) for r in parts.collect()]  # at most MOST_ENTRIES each
    often_makers, often_parts = frequencies(_counted(df, row_id, manufacturer), makers, "name"), frequencies(_counted(df, row_id, part_number), parts, "part_number")
    shared, token = df.sparkSession.sparkContext.broadcast((maker_rows, part_rows, often_makers, often_parts)), uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, numbers, exact, memo = _dictionaries(token, shared)
        for b in batches:
            out = []
            for i, field, value in zip(b["_id"], b["field"], b["value"]):
                if value in exact[field]:
                    continue
                ref = memo.get((field, value))
                if ref is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    ref = memo[field, value] = (names if field == "manufacturer" else numbers).resolve(value)
                out.append((i, field, ref))
            yield pd.DataFrame(out, columns=["_id", "field", "ref_id"])

    kind = df.schema[row_id].dataType.simpleString()
    return spread(rows, "_id", "field").mapInPandas(work, f"_id {kind}, field string, ref_id long")


def _by_join(df: DataFrame, row_id: str, manufacturer: str, part_number: str, makers: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    often = lambda c: _counted(df, row_id, c).groupBy("_v").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long")).alias("n")
    # places of a part where its family has several characters, over the whole list
    squeezed = F.udf(lambda x: Parts.squeeze(fold(x)), "string")
    keyed = parts.select("part_id", "part_number", squeezed("part_number").alias("k"))
    at = keyed.select("k").distinct().filter("k <> ''").select("k", F.explode(F.sequence(F.lit(0), F.length("k") - 1)).alias("p"))
    family = at.select("k", "p", F.concat(F.expr("substring(k, 1, p)"), F.lit("\0"), F.expr("substring(k, p + 2)")).alias("w"), F.expr("substring(k, p + 1, 1)").alias("c"))
    several = family.groupBy("w").agg(F.count_distinct("c").alias("m")).filter("m > 1").select("w")
    live = family.join(several, "w", "left_semi").groupBy("k").agg(F.collect_set("p").alias("live"))
    none = F.lit(None)
    a = makers.join(often(manufacturer), makers["name"] == F.col("_v"), "left").select(F.lit("m").alias("list"), F.col("mfr_id").cast("long").alias("ref"), "name", F.col("short_name").alias("short"), n, none.cast("array<int>").alias("live"))
    b = keyed.join(often(part_number), keyed["part_number"] == F.col("_v"), "left").join(live, "k", "left").select(F.lit("p").alias("list"), F.col("part_id").cast("long").alias("ref"), F.col("part_number").alias("name"), none.cast("string").alias("short"), n, "live")
    entries = written(a.unionByName(b), "entries")

    def entry_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([(f"{k}:{key}", k, r) for k, r, name, short in zip(x["list"], x["ref"], x["name"], x["short"]) for key in (Names.entry_keys(name, short) if k == "m" else Parts.entry_keys(name))], columns=["key", "list", "ref"])

    def asked_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for field, value in zip(x["field"], x["value"]):
                if field == "manufacturer":
                    out += [(field, value, f"m:{k}") for k in Names.asked_keys(value)]
                else:
                    own, of_makers = Parts.asked_keys(value)
                    out += [(field, value, f"p:{k}") for k in own] + [(field, value, f"m:{k}") for k in of_makers]
            yield pd.DataFrame(out, columns=["field", "value", "key"])

    exact = makers.select(F.lit("manufacturer").alias("field"), F.col("name").alias("value")).union(parts.select(F.lit("part_number"), "part_number"))
    open_rows = rows.join(exact.distinct(), ["field", "value"], "left_anti")
    values = written(open_rows.select("field", "value").distinct(), "values")
    keys = entries.select("list", "ref", "name", "short").mapInPandas(entry_keys, "key string, list string, ref long")
    met = values.mapInPandas(asked_keys, "field string, value string, key string").join(keys, "key").select("field", "value", "list", "ref").distinct()
    met = met.join(entries, ["list", "ref"])

    def decide(x: pd.DataFrame) -> pd.DataFrame:
        field, value = x["field"].iloc[0], x["value"].iloc[0]
        own = x[x["list"] == "m"]
        names = Names([(r, n, s if isinstance(s, str) else None) for r, n, s in zip(own["ref"], own["name"], own["short"])], dict(zip(own["name"], own["n"])))
        if field == "manufacturer":
            ref = names.resolve(value)
        else:
            p = x[x["list"] == "p"]
            live = {Parts.squeeze(fold(n)): set(at) if at is not None else set() for n, at in zip(p["name"], p["live"])}
            ref = Parts(list(zip(p["ref"], p["name"])), dict(zip(p["name"], p["n"])), set(names.brands.ids), live).resolve(value)
        return pd.DataFrame({"field": [field], "value": [value], "ref_id": [int(ref)]})

    found = written(met.groupBy("field", "value").applyInPandas(decide, "field string, value string, ref_id long"), "resolved")
    return open_rows.join(found, ["field", "value"], "left").select("_id", "field", F.coalesce("ref_id", F.lit(-1).cast("long")).alias("ref_id"))
