"""Connectivity: pins of nets, pins of components, parts of designators; and look-ups over them. Keys carry a board."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions import text as T


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: one aggregation with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def net_pins(nets: DataFrame) -> DataFrame:
    """One row per pin token of each net, with its place; nets: board_id, net_ord, net_name_raw, net_name_canonical, pins_raw."""
    keep = [c for c in ("board_id", "net_id", "net_ord", "net_name_raw", "net_name_canonical") if c in nets.columns]
    return nets.select(*keep, F.posexplode("pins_raw").alias("pin_ord", "token")).withColumns({"refdes": T.pin_refdes(F.col("token")), "pin": T.pin_number(F.col("token"))})


def pin_to_net(pins: DataFrame) -> DataFrame:
    """The net of each pin token; of several the last in file order."""
    return pins.groupBy("board_id", "token").agg(F.max_by(F.struct("net_name_raw", "net_name_canonical"), F.struct("net_ord", "net_id", "pin_ord")).alias("n")).select("board_id", "token", "n.*")


def pin_lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """The net of each asked (board_id, refdes, pin); a pin on no net is a row that is not connected."""
    asked = requests.withColumn("token", F.concat_ws("-", F.upper("refdes"), F.col("pin")))
    return asked.join(index, ["board_id", "token"], "left").withColumn("connected", F.col("net_name_canonical").isNotNull())


def net_members(pins: DataFrame) -> DataFrame:
    """Per net and component the sorted pins, repeats kept; tokens without a dash are left out."""
    return pins.filter(F.col("token").contains("-")).groupBy("board_id", "net_id", "net_name_canonical", F.upper("refdes").alias("refdes")).agg(F.array_sort(F.collect_list("pin")).alias("pins"), F.count("*").alias("pin_count"))


def alias_lookup(nets: DataFrame) -> DataFrame:
    """alias (canonical form of any spelling) -> canonical name; the last wins."""
    each = nets.select("board_id", "net_ord", "net_id", "net_name_canonical", F.explode(F.array_distinct(F.concat(F.coalesce("aliases", F.array()), F.array("net_name_raw", "net_name_canonical")))).alias("a")).filter("a is not null")
    return each.groupBy("board_id", T.canonical_net_name(F.col("a")).alias("alias")).agg(F.max_by("net_name_canonical", F.struct("net_ord", "net_id")).alias("net_name_canonical"))


def connected_pins(pins: DataFrame) -> DataFrame:
    return pins.groupBy("board_id", F.upper("refdes").alias("refdes")).agg(F.array_sort(F.collect_set("pin")).alias("connected_pins"))


def component_pins(images: DataFrame, components: DataFrame, connected: DataFrame) -> DataFrame:
    """All, connected and floating pins of each component.

    images: board_id, image_name, pin; components: board_id, ord, token. A token names its image whole or without its
    part behind the last underscore; of both the image with more pins counts, the former on a tie. Components that only
    nets know have all their pins connected."""
    split = components.filter(F.col("token").contains("_")).select("board_id", "ord", "token", F.upper(F.regexp_extract("token", r"^.*_([^_]*)$", 1)).alias("refdes"), F.regexp_replace("token", "_[^_]*$", "").alias("image"))
    split = split.filter("refdes <> ''")
    names = split.select("board_id", "ord", "refdes", F.posexplode(F.array("token", "image")).alias("which", "image_name"))
    sizes = images.groupBy("board_id", "image_name").agg(F.array_sort(F.collect_set("pin")).alias("all_pins"))
    found = names.join(sizes, ["board_id", "image_name"], "left").withColumn("all_pins", F.coalesce("all_pins", F.array().cast("array<string>")))
    best = found.groupBy("board_id", "refdes").agg(F.max_by(F.struct("image_name", "all_pins"), F.struct(F.size("all_pins"), -F.col("ord"), -F.col("which"))).alias("i"))
    both = best.join(connected, ["board_id", "refdes"], "full_outer")
    linked = F.coalesce("connected_pins", F.array().cast("array<string>"))
    every = F.coalesce("i.all_pins", linked)
    return both.select("board_id", "refdes", F.coalesce("i.image_name", F.lit("")).alias("image_name"), every.alias("all_pins"), linked.alias("connected_pins"), F.array_except(F.filter(every, lambda p: p != ""), linked).alias("floating_pins"))


def floating_pins(index: DataFrame) -> DataFrame:
    """Pins of the image that no net connects, one row each."""
    return index.select("board_id", "refdes", F.explode(F.array_except("all_pins", "connected_pins")).alias("pin"))


def parts_by_refdes(lines: DataFrame) -> DataFrame:
    """The part of each designator; of several lines the last. lines: board_id, line_ord, designators and fields."""
    keep = [c for c in ("part_number", "manufacturer", "value", "footprint", "specification") if c in lines.columns]
    each = lines.select("board_id", "line_ord", F.explode("designators").alias("refdes"), *keep).filter("refdes <> ''")
    return latest(each, ["board_id", "refdes"], ["line_ord"]).drop("line_ord")


#: Length of the stretches that texts are joined on.
GRAM = 3


def held_in(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """(needle, text), distinct, where the text holds the needle: an equi-join on the needle's rarest stretch of GRAM characters
    (itself, where it is shorter), then an exact check. Rows grow with the length of the texts, not with its square. Joins are
    by sorting: of exploded rows the planner expects as few as there were before, and would send all of them through the driver."""
    a = needles.select(F.col(needle).alias("a")).filter("a <> ''").distinct()
    b = texts.select(F.col(text).alias("b")).filter("b <> ''").distinct()

    def stretches(c: str, n: int) -> F.Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(c: str, sizes: range) -> F.Column:
        return F.array_distinct(F.concat(*(stretches(c, n) for n in sizes)))

    held = b.select("b", F.explode(grams("b", range(1, GRAM + 1))).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    own = a.select("a", F.explode(F.when(F.length("a") > GRAM, grams("a", range(GRAM, GRAM + 1))).otherwise(F.array("a"))).alias("g"))
    # a needle with a stretch that no text has is in none
    rarest = own.join(often.hint("merge"), "g", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "g")).alias("k")).filter("k.n > 0").select("a", F.col("k.g").alias("g"))
    return held.join(rarest.hint("merge"), "g").filter(F.col("b").contains(F.col("a"))).select(F.col("a").alias(needle), F.col("b").alias(text))


def containment(parts: DataFrame, part: str, stems: DataFrame, stem: str) -> DataFrame:
    """(part, stem), distinct, where either holds the other, exact, without a nested loop."""
    return held_in(parts, part, stems, stem).unionByName(held_in(stems, stem, parts, part)).distinct()


def nets_of(pins: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct nets that touch the asked (board_id, refdes)."""
    return pins.join(asked.select("board_id", "refdes").distinct(), ["board_id", "refdes"], "left_semi").select("board_id", "refdes", "net_name_canonical").distinct()


def first_match(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
