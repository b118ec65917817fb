"""Quantities recorded in different units: find each measure in a text, convert it to a common unit.

Measures with a unit are read by a grammar. For a number without one, a random forest with calibrated confidence predicts the
unit from magnitude, source, kind of component, prefix letter and neighbouring text. It is fitted on a bounded sample of
labelled rows: measures whose unit is written (the unit hidden), and numbers that the written convention (MISSING, or a unit
that the specification names) labels; a third of the sample is held out for an isotonic calibration of its vote. A prediction
is converted at CONFIDENT and above, else routed to review; `confirmed` tells whether the convention says the same.

Defined results: null, empty and blank texts have no measures; a row id that comes again counts once; of several measures
of one quantity in one field, the first counts; amounts are rounded half up; extra columns never enter;
rows without an id are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the forest is fitted and calibrated on, at most (lowest hashes first).
FIT_ROWS = 20_000
CONFIDENT = 0.9

# Units, prefixes and common units.
COMMON = {"resistance": -6, "capacitance": -15, "inductance": -12, "frequency": -3, "voltage": -6, "current": -6, "power": -6}
PREFIX = {"p": -12, "n": -9, "u": -6, "m": -3, "k": 3, "M": 6, "G": 9, "": 0}
WORDS = {"pico": "p", "nano": "n", "micro": "u", "milli": "m", "kilo": "k", "mega": "M", "giga": "G", "meg": "M"}
#: A bare number: kind of component -> quantity, and the exponent where not even a prefix stands.
MISSING = {"R": ("resistance", 0), "C": ("capacitance", -12), "L": ("inductance", -6), "Y": ("frequency", 0)}
BASES = {
    "ohm": "resistance", "ohms": "resistance", "r": "resistance",
    "f": "capacitance", "fd": "capacitance", "farad": "capacitance", "farads": "capacitance",
    "h": "inductance", "henry": "inductance", "henries": "inductance", "henrys": "inductance",
    "hz": "frequency", "hertz": "frequency",
    "v": "voltage", "volt": "voltage", "volts": "voltage", "vdc": "voltage", "vac": "voltage", "v dc": "voltage", "v ac": "voltage",
    "a": "current", "amp": "current", "amps": "current", "ampere": "current", "amperes": "current",
    "w": "power", "watt": "power", "watts": "power",
}
#: Unit -> (quantity, factor to the common unit, offset before it).
OTHER = {
    "%": ("tolerance", Fraction(10_000), 0), "percent": ("tolerance", Fraction(10_000), 0), "pct": ("tolerance", Fraction(10_000), 0), "ppm": ("tolerance", Fraction(1), 0),
    "°c": ("temperature", Fraction(1000), 0), "degc": ("temperature", Fraction(1000), 0),
    "°f": ("temperature", Fraction(5000, 9), -32), "degf": ("temperature", Fraction(5000, 9), -32),
    "kelvin": ("temperature", Fraction(1000), Fraction(-27315, 100)), "kelvins": ("temperature", Fraction(1000), Fraction(-27315, 100)),
    "mm": ("length", Fraction(1000), 0), "millimetre": ("length", Fraction(1000), 0), "millimetres": ("length", Fraction(1000), 0), "millimeter": ("length", Fraction(1000), 0), "millimeters": ("length", Fraction(1000), 0),
    "cm": ("length", Fraction(10_000), 0), "centimetre": ("length", Fraction(10_000), 0), "centimetres": ("length", Fraction(10_000), 0),
    "um": ("length", Fraction(1), 0), "micron": ("length", Fraction(1), 0), "microns": ("length", Fraction(1), 0), "micrometre": ("length", Fraction(1), 0), "micrometres": ("length", Fraction(1), 0),
    "in": ("length", Fraction(25_400), 0), "inch": ("length", Fraction(25_400), 0), "inches": ("length", Fraction(25_400), 0), '"': ("length", Fraction(25_400), 0), "″": ("length", Fraction(25_400), 0),
    "mil": ("length", Fraction(254, 10), 0), "mils": ("length", Fraction(254, 10), 0), "thou": ("length", Fraction(254, 10), 0),
}

_BLANKS = "".join(map(chr, [0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF]))
_CLEAN = str.maketrans({"µ": "u", "μ": "u", "Ω": "ohm", "Ω": "ohm", "℃": "°C", "℉": "°F", "−": "-", "％": "%", "º": "°", "，": ","} | dict.fromkeys(_BLANKS, " "))
_NUM = r"(?:\d{1,3}(?: \d{3})+(?![\d])(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)(?:[eE][-+]?\d+)?"
_MEASURE = re.compile(rf"(?<![A-Za-z0-9.,_])(?P<sign>(?<![\d/+A-Za-z±])-)?(?P<top>\d+/(?=\d+ ?[A-Za-z\"]))?(?P<num>{_NUM}) ?(?P<unit>°[CFcf]|deg\.? ?[CFcf]\b|[%\"″]|[VvAa] ?[DdAa][Cc]\b|[A-Za-z]+)(?![A-Za-z0-9_])")
_LEAD = re.compile(rf"^[\s~≈<>≤≥=±]*(?P<num>{_NUM}) ?(?P<pre>[pPnNuUmkKMGR]|meg|MEG|Meg)?(?=\s*$|\s*(?:,(?!\d)|[;/|@])|\s+[\d.±+(])")
_SIGN = re.compile(r"^[\s~≈<>≤≥=±]*(?P<whole>\d*)(?P<pre>[pPnNuUmkKMGRr])(?P<part>\d+)(?=$|[\s,;/|@])")
_NAMED = re.compile(r"(?i)\b(?:unit|units|values?|value column)\s*(?::|=|in|is|are in|is in)\s*(°?[A-Za-z]+)")


def number(text: str) -> Fraction:
    """A written number: a comma before exactly three last digits parts thousands, any other is the decimal sign; blanks part thousands."""
    mantissa, _, power = text.lower().partition("e")
    mantissa = mantissa.replace(" ", "")
    if mantissa.count(",") and ("." in mantissa or re.search(r"\d,\d{3}$", mantissa) or mantissa.count(",") > 1):
        mantissa = mantissa.replace(",", "")
    mantissa = mantissa.replace(",", ".")
    return Fraction(mantissa if mantissa[0] != "." else f"0{mantissa}") * Fraction(10) ** int(power or 0)


@lru_cache(maxsize=4096)
def unit_of(word: str) -> tuple[str, Fraction, Fraction, str] | None:
    """(quantity, factor, offset, unit in one spelling) of a unit as written, or None."""
    flat = word.translate(_CLEAN)
    low = re.sub(r"^deg\.? ?", "deg", flat.lower().strip())
    if low in OTHER:
        q, factor, offset = OTHER[low]
        return q, factor, Fraction(offset), low
    if flat == "K":
        return "temperature", Fraction(1000), Fraction(-27315, 100), "kelvin"
    if low == "mfd":
        return "capacitance", Fraction(10) ** 9, Fraction(0), "ucapacitance"
    low = low.replace(" ", "")
    for word_, letter in sorted(WORDS.items(), key=lambda x: -len(x[0])):
        if low.startswith(word_) and low[len(word_) :] in BASES:
            q = BASES[low[len(word_) :]]
            return q, Fraction(10) ** (PREFIX[letter] - COMMON[q]), Fraction(0), letter + q
    if low in BASES:
        q = BASES[low]
        return q, Fraction(10) ** -COMMON[q], Fraction(0), q
    if len(flat) > 1 and low[1:] in BASES:
        q, p = BASES[low[1:]], prefix(flat[0], BASES[low[1:]])
        if p is not None:
            return q, Fraction(10) ** (PREFIX[p] - COMMON[q]), Fraction(0), p + q
    return None


def prefix(letter: str, quantity: str) -> str | None:
    """The prefix meant: m is milli and M mega where both occur for the quantity; the others in either case."""
    if letter.lower() in ("m", "meg"):
        both = quantity in ("resistance", "voltage", "power")
        return "M" if quantity == "frequency" or len(letter) > 1 or (both and letter == "M") else "m"
    low = letter.lower()
    return low if low in "pnuk" else "G" if low == "g" else None


def _whole(x: Fraction) -> int:
    return int((2 * x + 1) // 2) if x >= 0 else -int((-2 * x + 1) // 2)


def measures(text: str | None, kelvin: bool = True) -> list[tuple[str, int, str, float]]:
    """(quantity, amount in the common unit, unit, number as written) of each measure with a unit, the first of each quantity.
    kelvin: a lone K is kelvin; in a value field it is kilo."""
    out: dict[str, tuple[str, int, str, float]] = {}
    for m in _MEASURE.finditer((text or "").translate(_CLEAN)):
        u = unit_of(m["unit"])
        if u is None or (m["unit"] == "K" and not kelvin):
            continue
        x = number(m["num"])
        if m["top"]:
            if u[0] == "power" and x:
                x = Fraction(int(m["top"].strip("/"))) / x
            elif u[0] == "length" and x:
                x = Fraction(int(m["top"].strip("/"))) / x
        if m["sign"] and u[0] == "temperature":
            x = -x
        out.setdefault(u[0], (u[0], _whole((x + u[2]) * u[1]), u[3], float(x)))
    return list(out.values())


def kind_of(designator: str | None) -> str:
    m = re.search(r"[A-Za-z]+", designator or "")
    return m[0].upper() if m else ""


def bare(text: str | None) -> tuple[Fraction, str, bool] | None:
    """(number, prefix letter or "", the letter stood for the decimal sign) where the text opens with a number without a unit."""
    flat = (text or "").translate(_CLEAN)
    if m := _SIGN.match(flat):
        return Fraction(f"{m['whole'] or 0}.{m['part']}"), m["pre"], True
    if m := _LEAD.match(flat):
        return number(m["num"]), m["pre"] or "", False
    return None


def by_convention(kind: str, prefix_letter: str, specification: str | None) -> tuple[str, Fraction, str] | None:
    """(quantity, factor, unit) that the written convention gives a number without a unit, or None."""
    if kind not in MISSING:
        return None
    q, lone = MISSING[kind]
    if prefix_letter in ("R", "r"):
        # the decimal sign itself: 4R7 is 4.7 ohm on a resistor, and 4.7 without a prefix on any other
        prefix_letter = ""
        if kind == "R":
            return q, Fraction(10) ** -COMMON[q], q
    if prefix_letter:
        p = prefix(prefix_letter, q)
        return None if p is None else (q, Fraction(10) ** (PREFIX[p] - COMMON[q]), p + q)
    if (m := _NAMED.search((specification or "").translate(_CLEAN))) and (u := unit_of(m[1])) and not u[2]:
        return u[0], u[1], u[3]
    p = {v: k for k, v in PREFIX.items()}[lone]
    return q, Fraction(10) ** (lone - COMMON[q]), p + q


# --- the classifier of missing units -----------------------------------------------------------------------------------

_KINDS = ["R", "C", "L", "Y", "FB", "F", "D", "LED", "Q", "U", "J", "SW", "TP", "MOD", "SB"]
_LETTERS = ["", "p", "n", "u", "m", "k", "M", "G", "R"]
_CLUES = ["film", "X7R", "X5R", "NP0", "C0G", "Y5V", "DCR", "Isat", "Irms", "CL", "load", "ppm", "volt", "watt"]
_UNITS = [p + q for q in ("resistance", "capacitance", "inductance", "frequency", "voltage", "current") for p in ("", "p", "n", "u", "m", "k", "M", "G")]


def features(x: float, letter: str, sign: bool, kind: str, spec: str | None, source: str | None = None) -> list[float]:
    """Magnitude, prefix letter, kind of component, clues of the specification, and source; of fixed length."""
    spec = spec or ""
    named = _NAMED.search(spec.translate(_CLEAN))
    u = unit_of(named[1]) if named else None
    letter = letter if letter in ("m", "M") else letter.lower() if letter.lower() in "pnuk" else letter.upper()
    return [
        math.log10(abs(x)) if x else -20.0, float(len(f"{x:g}")), float(sign),
        float(_LETTERS.index(letter) if letter in _LETTERS else len(_LETTERS)), float(_KINDS.index(kind) if kind in _KINDS else len(_KINDS)),
        float(_UNITS.index(u[3]) + 1 if u and u[3] in _UNITS else 0), float(crc32((source or "").encode("utf-8", "replace")) % 64), *(float(c in spec) for c in _CLUES),
    ]


def read(df: DataFrame, row_id: str, designator: str, value: str, specification: str, source: str | None = None) -> DataFrame:
    """One row per id: measures with unit of both fields; of a number without one, its features and what the convention says."""
    src = F.col(source).cast("string") if source else F.lit(None).cast("string")
    rows = df.select(F.col(row_id).alias("_id"), F.col(designator).alias("_d"), F.col(value).alias("_v"), F.col(specification).alias("_s"), src.alias("_src")).filter("_id is not null")
    once = rows.groupBy("_id").agg(F.min_by(F.struct("_d", "_v", "_s", "_src"), F.struct("_v", "_s", "_d", "_src")).alias("_r")).select("_id", "_r.*")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, d, v, s, src in zip(b["_id"], b["_d"], b["_v"], b["_s"], b["_src"]):
                kind, found = kind_of(d), [("value", *m) for m in measures(v, kelvin=False)]
                given = next((f for f in found if f[1] == MISSING.get(kind, ("",))[0]), None)
                # where no convention tells what the number should be, a measure that is written is what it is
                n = None if given or (found and kind not in MISSING) else bare(v)
                if n:
                    c = by_convention(kind, n[1], s)
                    shown = c[2] if c and c[2] in _UNITS else None
                    row = (features(float(n[0]), n[1], n[2], kind, s, src), c and c[0], c and c[2], c and _whole(n[0] * c[1]), f"{n[0].numerator}/{n[0].denominator}")
                elif given and given[3] in _UNITS and (letter := given[3].removesuffix(given[1])):
                    # the unit as written is hidden but for its prefix letter
                    shown, row = given[3], (features(given[4], letter, False, kind, s, src), None, None, None, None)
                else:
                    shown, row = None, (None, None, None, None, None)
                found += [("specification", *m) for m in measures(s)]
                # one labelled row in five is shown without its kind, for the forest to learn how far the rest tells the unit
                hidden = [*row[0][:4], float(len(_KINDS)), *row[0][5:]] if shown and crc32(str(i).encode()) % 5 == 0 else None
                out.append((i, [f[:3] for f in found], shown, *row, hidden))
            yield pd.DataFrame(out, columns=["_id", "found", "label", "features", "c_quantity", "c_unit", "c_amount", "number", "shown"]).astype({"c_amount": "Int64"})

    kind = df.schema[row_id].dataType.simpleString()
    return once.mapInPandas(parse, f"_id {kind}, found array<struct<field:string,quantity:string,amount:long>>, label string, features array<double>, c_quantity string, c_unit string, c_amount long, number string, shown array<double>")


def _none() -> F.Column:
    """Stands in where a filter on features is moved behind the step to vectors."""
    return F.array(*[F.lit(0.0)] * len(features(1.0, "", False, "", "")))


def fit(parsed: DataFrame, rows: int = FIT_ROWS):
    """(forest, isotonic model of how often its vote is right, share right and rows of the third held out, the units that its
    classes are), of at most `rows` labelled rows; None where there are not labels enough."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = parsed.filter(F.col("features").isNotNull() & F.col("label").isNotNull()).select("_id", "label", F.coalesce("shown", "features").alias("features"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    got = sample.withColumn("_x", array_to_vector(F.coalesce("features", _none())))
    part = F.pmod(F.xxhash64(F.lit("held out"), "_id"), F.lit(3))
    got = got.cache()  # `rows` rows at most
    try:
        units = sorted(r["label"] for r in got.filter(part > 0).select("label").distinct().collect())  # of _UNITS
        if len(units) < 2:
            return None
        got = got.withColumn("_y", F.array_position(F.array(*map(F.lit, units)), F.col("label")).cast("double") - 1)
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=20, maxDepth=12, maxBins=64, featureSubsetStrategy="0.7", subsamplingRate=0.9, seed=7, probabilityCol="_p", predictionCol="_g", rawPredictionCol="_raw").fit(got.filter((part > 0) & (F.col("_y") >= 0)))
        held = forest.transform(got.filter(part == 0)).select((F.col("_g") == F.col("_y")).cast("double").alias("ok"), F.array_max(vector_to_array("_p")).alias("vote"))
        share, n = held.agg(F.avg("ok"), F.count("*")).first()
        if not n:
            return None
        isotonic = IsotonicRegression(featuresCol="vote", labelCol="ok", predictionCol="_conf").fit(held)
    finally:
        got.unpersist()
    return forest, isotonic, share, n, units


def convert(df: DataFrame, row_id: str, designator: str, value: str, specification: str, fit_rows: int = FIT_ROWS, source: str | None = None) -> DataFrame:
    """(row_id, field, quantity, amount, unit_from, confidence, route, confirmed): unit_from is `written` or `forest`; route is
    `convert` or, for a number whose unit is not written and not predicted with confidence, `review`; confirmed: whether a
    unit is written, or the convention says what the forest does (null where there is no convention)."""
    from boardloom.tables import written

    parsed = written(read(df, row_id, designator, value, specification, source), "units")
    given = parsed.select("_id", F.inline("found")).select("_id", "field", "quantity", "amount", F.lit("written").alias("unit_from"), F.lit(1.0).alias("confidence"), F.lit("convert").alias("route"), F.lit(True).alias("confirmed"))
    lone = parsed.filter(F.col("number").isNotNull())
    model = fit(parsed, fit_rows)
    if model is None:
        lone = lone.withColumn("_conf", F.lit(0.0)).withColumn("_unit", F.lit(None).cast("string"))
    else:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        got = model[0].transform(lone.withColumn("_x", array_to_vector(F.coalesce("features", _none())))).withColumn("vote", F.array_max(vector_to_array("_p")))
        lone = model[1].transform(got).withColumn("_unit", F.element_at(F.array(*map(F.lit, model[4])), F.col("_g").cast("int") + 1))
    ratio = F.split("number", "/")
    factor = F.element_at(F.create_map(*[F.lit(x) for p, e in PREFIX.items() for q in COMMON for x in (p + q, 10.0 ** (e - COMMON[q]))]), F.col("_unit"))
    guessed = F.floor(ratio[0].cast("double") / ratio[1].cast("double") * factor + 0.5).cast("long")
    same = F.col("c_unit") == F.col("_unit")
    lone = lone.select(
        "_id", F.lit("value").alias("field"), F.regexp_replace("_unit", "^[pnumkMG](?=resist|capac|induct|frequ|volt|curr|power)", "").alias("quantity"),
        F.when(same, F.col("c_amount")).otherwise(guessed).alias("amount"), F.lit("forest").alias("unit_from"), F.col("_conf").alias("confidence"),
        F.when(F.col("_conf") >= CONFIDENT, "convert").otherwise("review").alias("route"), same.alias("confirmed"),
    )
    return given.unionByName(lone).withColumnRenamed("_id", "row_id")
