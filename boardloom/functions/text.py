"""Scalar rules as column expressions: names, pins, tokens, classifiers. All stay inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
POWER_HINTS = ["VBUS", "VBAT", "VDD", "VCC", "1V8", "2V8", "3V3", "5V", "GND", "PMID", "VSS"]
BUS_HINTS = {"swd": ["SWD", "RESET"], "i2c": ["SCL", "SDA", "I2C"], "spi": ["MOSI", "MISO", "SCLK", "CS", "SPI"], "uart": ["UART", "TX", "RX"], "usb": ["USB", "VBUS", "D+", "D-", "J4"]}
COMPONENT_TYPES = ["module", "ic", "resistor", "capacitor", "inductor", "diode_led", "connector", "header", "test_point", "switch", "crystal", "other"]
INTENTS = {
    "protocol_debug_validation": ["jtag", "swd", "programming header", "vtref", "nreset", "debug header"],
    "anomaly_check": ["floating", "misconnect", "wrong connection", "short", "disconnect"],
    "pin_validation": ["pin", "vdd", "vddio", "connected correctly", "is connected"],
    "net_trace": ["net", "which pins are on", "trace", "path"],
    "relationship_trace": ["communicate", "interface", "between", "how does"],
}
UNRELATED = ["weather", "distance between", "dogs bark", "cats meow", "shopping list", "egg mcmuffin"]
PRECISION = ["pin", "net", "value of", "resistor", "capacitance", "bypass", "voltage across", "connected correctly", "check all pins", "equation"]
PRIORITY_ORDER = {"DSN": 1, "schematic": 2, "datasheet": 3, "BOM": 4, "inference": 5}
TOKEN = "[A-Za-z0-9_./+-]+"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds_any(c: Column, hints: list[str]) -> Column:
    return any_of(*(c.contains(h) for h in hints))


def canonical_net_name(c: Column) -> Column:
    """Escapes out, runs of other characters as one underscore, upper case."""
    return F.upper(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("")), "[^A-Za-z0-9_.-]+", "_"))


def pin_refdes(token: Column) -> Column:
    """All before the last dash, or the whole token without one."""
    return F.regexp_replace(token, r"(?s)-[^-]*$", "")


def pin_number(token: Column) -> Column:
    """All behind the last dash, or nothing without one."""
    return F.when(token.contains("-"), F.regexp_extract(token, r"(?s)^.*-([^-]*)$", 1)).otherwise("")


def tokenize(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def hash_bucket(token: Column, dims: int = 512) -> Column:
    """First eight hex digits of the MD5 of a token, modulo dims."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def letters(refdes: Column) -> Column:
    return F.regexp_replace(F.upper(refdes), "[^A-Z]", "")


def _by_prefix(alpha: Column, rules: list[tuple[str, str]]) -> Column:
    out = F
    for prefix, name in rules:
        out = out.when(alpha.startswith(prefix), name)
    return out.otherwise("other")


def component_type(refdes: Column) -> Column:
    """The kinds of the search tools: first prefix in this order."""
    rules = [("MOD", "module"), ("U", "ic"), ("R", "resistor"), ("C", "capacitor"), ("L", "inductor"), ("D", "diode_led"), ("J", "connector"), ("P", "header"), ("TP", "test_point"), ("SW", "switch"), ("X", "crystal")]
    return _by_prefix(letters(refdes), rules)


def component_class(refdes: Column) -> Column:
    """The kinds of the knowledge graph: another order, no headers."""
    rules = [("MOD", "module"), ("U", "ic"), ("J", "connector"), ("TP", "test_point"), ("R", "resistor"), ("C", "capacitor"), ("L", "inductor"), ("D", "diode"), ("SW", "switch"), ("X", "crystal")]
    return _by_prefix(letters(refdes), rules)


def is_power_net(name: Column) -> Column:
    return holds_any(canonical_net_name(name), POWER_HINTS)


def classify_intent(question: Column) -> Column:
    q, out = F.lower(question), F
    for name, terms in INTENTS.items():
        out = out.when(holds_any(q, terms), name)
    return out.otherwise("system_function")


def classify_route(question: Column) -> Column:
    """struct(route, confidence) by terms alone."""
    q = F.lower(question)
    return (
        F.when(holds_any(q, UNRELATED), F.struct(F.lit("irrelevant_general").alias("route"), F.lit("high").alias("confidence")))
        .when(holds_any(q, PRECISION), F.struct(F.lit("precision").alias("route"), F.lit("medium").alias("confidence")))
        .otherwise(F.struct(F.lit("relevant_general").alias("route"), F.lit("medium").alias("confidence")))
    )


def explicit_refs(text: Column) -> Column:
    """Whole words of one to four letters and one to three digits, upper case, each once, sorted."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(r"^[A-Za-z]{1,4}[0-9]{1,3}$")), F.upper)))


def symbols(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.\\/-]*"), F.lit(0)), lambda s: (F.length(s) >= 2) & s.rlike("[A-Za-z]"))


def sheet_hint(text: Column) -> Column:
    """The first sheet name, else the first page count. A fixed part is looked for first: names are costly to try at every place."""
    first = lambda part, p: F.when(text.contains(part), F.nullif(F.regexp_extract(text, p, 0), F.lit("")))
    return F.coalesce(first(".SchDoc", r"[A-Za-z0-9_]+\.SchDoc"), first("--", r"--\s*\d+\s+of\s+\d+\s*--"), F.lit("unknown_sheet"))


def stripped_line(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: What a heading of 3 to 80 characters opens with, unless it is all upper case.
_HEADING = r"^(?:\d+(?:\.\d+)*\s+[A-Za-z]|(?i:table|figure|section) )"
_OPENS_HEADING = re.compile(_HEADING)


def is_heading(line: Column) -> Column:
    """A stripped line of 3 to 80 characters: upper case, numbered, or opening with table, figure or section."""
    s = stripped_line(line)
    loud = (F.upper(s) == s) & (F.lower(s) != s)
    return F.length(s).between(3, 80) & (loud | s.rlike(_HEADING))


def heading(line: str) -> bool:
    """The same rule for one text."""
    s = line.strip()
    return 2 < len(s) < 81 and (s.isupper() or _OPENS_HEADING.match(s) is not None)


def source_priority(kind: Column) -> Column:
    return F.when(kind.isin("net", "anomaly", "component", "pin"), "DSN").when(kind.isin("function_block", "schematic"), "schematic").when(kind == "datasheet", "datasheet").otherwise("inference")


def source_confidence(kind: Column) -> Column:
    return F.when(kind.isin("net", "anomaly", "component", "pin"), "exact").when(kind.isin("schematic", "function_block", "datasheet"), "high").otherwise("low")


def normal_priority(c: Column) -> Column:
    """The source order's spelling of a priority in any case; inference where unknown."""
    low, out = F.lower(F.trim(c)), F
    for name in PRIORITY_ORDER:
        out = out.when(low == name.lower(), name)
    return out.otherwise("inference")


def priority_rank(c: Column) -> Column:
    out = F
    for name, rank in PRIORITY_ORDER.items():
        out = out.when(c == name, rank)
    return out.otherwise(999)


def default_confidence(priority: Column) -> Column:
    return F.when(priority == "DSN", "exact").when(priority.isin("schematic", "datasheet"), "high").when(priority == "BOM", "medium").otherwise("low")


def part_class(refdes: Column) -> Column:
    return F.when(F.upper(refdes).rlike(r"^(R|C|L|FB|RT)\d+"), "passive").when(F.upper(refdes).rlike(r"^U\d+"), "ic").otherwise("other")


def file_stem(part_number: Column) -> Column:
    return F.replace(F.lower(F.trim(part_number)), F.lit("/"), F.lit("_"))


def normal_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r'[<>:"/\\|?*\s]+', "_")


def page_mention(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)page\s+(\d+)", 1).try_cast("int")


def response_time(file_name: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(file_name, r"response_(\d{8}_\d{6})\.md", 1), F.lit("yyyyMMdd_HHmmss"))
