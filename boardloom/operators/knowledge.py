"""The knowledge graph over connectivity: power domains, buses, blocks, anomalies, edges, sheets. Keys carry a board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.functions import text as T
from boardloom.operators import connect

BLOCKS = ["power_path", "compute_control", "io_debug"]


def power_domains(nets: DataFrame) -> DataFrame:
    name = F.col("net_name_canonical")
    return nets.filter(T.is_power_net(name)).select("board_id", "net_id", F.concat(F.lit("power:"), name).alias("domain_id"), name.alias("net_name"), F.size(F.coalesce("pins_raw", F.array())).alias("pin_count"), F.when(name == "GND", "ground").otherwise("supply").alias("category"))


def bus_nets(nets: DataFrame) -> DataFrame:
    """One row per net and bus that a hint in its name puts it on."""
    name = F.col("net_name_canonical")
    buses = F.array_compact(F.array(*(F.when(T.holds_any(name, hints), F.lit(bus)) for bus, hints in T.BUS_HINTS.items())))
    return nets.select("board_id", name.alias("net_name"), F.explode(buses).alias("bus_type")).distinct()


def interface_buses(nets: DataFrame) -> DataFrame:
    """Buses with their nets as sorted arrays: for boards whose netlist was itself one row."""
    return bus_nets(nets).groupBy("board_id", "bus_type").agg(F.array_sort(F.collect_list("net_name")).alias("nets"))


def block_members(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(board_id, block, kind component|net, member), distinct."""
    blob = F.upper(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("refdes", "part_number", "manufacturer", "specification", "value"))))
    kind = T.component_class(F.col("refdes"))
    of = F.array_compact(F.array(
        F.when(kind.isin("ic", "module"), "compute_control"), F.when(kind.isin("connector", "test_point", "switch") | blob.contains("SWD"), "io_debug"),
        F.when(kind.isin("inductor", "capacitor", "diode") | blob.contains("CHARG") | blob.contains("REGUL"), "power_path")))
    name = F.upper("net_name_canonical")
    port = name.rlike(r"^P[012]\.")
    on = F.array_compact(F.array(F.when(T.is_power_net(name), "power_path"), F.when(port | name.startswith("SWD") | name.startswith("RESET"), "io_debug"), F.when(port | name.startswith("XL"), "compute_control")))
    a = parts.select("board_id", F.explode(of).alias("block"), F.lit("component").alias("kind"), F.upper("refdes").alias("member"))
    b = nets.select("board_id", F.explode(on).alias("block"), F.lit("net").alias("kind"), F.col("net_name_canonical").alias("member"))
    return a.unionByName(b).distinct()


def blocks_of(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(board_id, block): the three blocks of every board."""
    return nets.select("board_id").union(parts.select("board_id")).distinct().select("board_id", F.explode(F.array(*map(F.lit, BLOCKS))).alias("block"))


def block_rows(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(board_id, block, kind, member): the three blocks of every board member by member, an empty one as one row without a
    member. No block is gathered, however large its board is."""
    return blocks_of(nets, parts).join(block_members(nets, parts), ["board_id", "block"], "left")


def function_blocks(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """The three blocks of every board with their members as sorted arrays: for boards whose netlist was itself one row."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("member"))))
    return block_rows(nets, parts).groupBy("board_id", "block").agg(of("component").alias("component_refs"), of("net").alias("nets"))


def anomalies(index: DataFrame, nets: DataFrame) -> DataFrame:
    """Floating pins of ICs and modules, repeated members and stub nets; a net may show as two."""
    some = F.slice("floating_pins", 1, 20)
    a = index.filter(T.component_class(F.col("refdes")).isin("ic", "module") & (F.size("floating_pins") > 0)).select("board_id", F.concat(F.lit("floating:"), "refdes").alias("anomaly_id"), F.lit("high").alias("severity"), F.lit("floating_required_pin").alias("kind"), "refdes", F.lit(None).cast("string").alias("net_name"), F.array_join(some, ",").alias("pins"), F.size(some).alias("n"))
    pins = F.coalesce("pins_raw", F.array())
    rest = nets.select("board_id", F.col("net_name_canonical").alias("net_name"), (F.size(pins) - F.size(F.array_distinct(pins))).alias("twice"), F.size(F.array_distinct(pins)).alias("unique"), F.size(F.filter(F.array_distinct(pins), lambda t: ~F.upper(t).startswith("TP"))).alias("real"))
    none = [F.lit(None).cast("string").alias("refdes"), "net_name", F.lit(None).cast("string").alias("pins")]
    b = rest.filter("twice > 0").select("board_id", F.concat(F.lit("duplicate_members:"), "net_name").alias("anomaly_id"), F.lit("medium").alias("severity"), F.lit("duplicate_pin_membership").alias("kind"), *none, F.col("twice").alias("n"))
    c = rest.filter("real <= 1 and net_name <> 'GND'").select("board_id", F.concat(F.lit("orphan:"), "net_name").alias("anomaly_id"), F.lit("low").alias("severity"), F.lit("orphan_or_stub_net").alias("kind"), *none, F.col("unique").alias("n"))
    return a.unionByName(b).unionByName(c)


def net_graph_edges(pins: DataFrame) -> DataFrame:
    """Four directed edges per pin occurrence, repeats kept."""
    net, pin, comp = F.concat(F.lit("net:"), "net_name_canonical"), F.concat(F.lit("pin:"), "token"), F.concat(F.lit("component:"), "refdes")
    edge = lambda a, b, t: F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    four = F.array(edge(pin, net, "pin_to_net"), edge(net, pin, "net_to_pin"), edge(comp, pin, "component_to_pin"), edge(pin, comp, "pin_to_component"))
    return pins.select("board_id", "net_ord", "net_id", "pin_ord", F.posexplode(four).alias("edge_no", "e")).select("board_id", "net_ord", "net_id", "pin_ord", "edge_no", "e.*")


def net_graph_nodes(pins: DataFrame, nets: DataFrame) -> DataFrame:
    node = lambda kind, c: F.struct(F.concat(F.lit(f"{kind[0]}:"), c).alias("id"), F.lit(kind[1]).alias("type"))
    of_pins = pins.select("board_id", F.inline(F.array(node(("pin", "component_pin"), F.col("token")), node(("component", "component"), F.col("refdes")))))
    return of_pins.union(nets.select("board_id", F.concat(F.lit("net:"), "net_name_canonical"), F.lit("net"))).distinct()


def typed_graph(nets: DataFrame, parts: DataFrame, pins: DataFrame) -> DataFrame:
    """Blocks, domains, buses and components to what they hold or touch; repeated pins kept."""
    no_pin = F.lit(None).cast("string").alias("pin")
    m = block_members(nets, parts)
    a = m.select("board_id", F.concat(F.lit("block:"), "block").alias("src"), F.concat_ws(":", "kind", "member").alias("dst"), F.concat(F.lit("contains_"), "kind").alias("relation"), no_pin)
    b = power_domains(nets).select("board_id", F.col("domain_id").alias("src"), F.concat(F.lit("net:"), "net_name").alias("dst"), F.lit("domain_net").alias("relation"), no_pin)
    c = bus_nets(nets).select("board_id", F.concat(F.lit("bus:"), "bus_type").alias("src"), F.concat(F.lit("net:"), "net_name").alias("dst"), F.lit("bus_member").alias("relation"), no_pin)
    d = pins.filter(F.col("token").contains("-")).select("board_id", F.concat(F.lit("component:"), F.upper("refdes")).alias("src"), F.concat(F.lit("net:"), "net_name_canonical").alias("dst"), F.lit("connected_to").alias("relation"), "pin")
    return a.unionByName(b).unionByName(c).unionByName(d)


# How many tokens of a chunk tell the tags of its sheet, and the nets that make a sheet one of power.
TAG_TOKENS = 300
POWER_NETS = ["VBUSIN", "VBAT", "1V8", "2V8_SW", "GND"]


def sheet_semantics(chunks: DataFrame) -> DataFrame:
    """Per schematic file and page: headings (each different path once) and tags of the first TAG_TOKENS tokens of each chunk."""
    tokens = F.transform(F.slice(T.tokenize(F.coalesce("text", F.lit(""))), 1, TAG_TOKENS), F.upper)
    has = lambda f: F.bool_or(F.exists("t", f))
    return (
        chunks.filter("source_type = 'schematic'").select("source_file", F.col("page_start").alias("page_number"), "heading_path", tokens.alias("t"))
        .groupBy("source_file", "page_number")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("heading_path")))).alias("sheet_hints"), has(lambda t: t.rlike("^(SWD|JTAG)")).alias("debug"),
             has(lambda t: t.isin(*POWER_NETS)).alias("power"), has(lambda t: t.contains("IMU") | t.contains("ICM")).alias("sensor"), has(lambda t: t.rlike(r"^J\d+$")).alias("connector"))
    )


def pages_of(names: list[str], name: str, pages: DataFrame, page: list[str], text: str) -> DataFrame:
    """(name, page...), distinct, for the few names of a question: one scan of the pages."""
    upper = F.upper(text)
    held = F.array_compact(F.array(*(F.when(upper.contains(n), F.lit(n)) for n in names))) if names else F.array().cast("array<string>")
    return pages.select(F.explode(held).alias(name), *page).distinct()


#: Names of up to NAME characters are looked up whole in stretches of STRETCH characters of a word, of which any NAME characters stand in one.
NAME, STRETCH = 32, 96
_STRETCHES = rf"(?=(\S{{1,{STRETCH}}}))\S{{1,{STRETCH - NAME + 1}}}"


def entity_pages(names: DataFrame, name: str, pages: DataFrame, page: list[str], text: str, spaced: bool = True) -> DataFrame:
    """(name, page...), distinct, where the upper-case text of a page holds the name.

    A name stands within one word of the text (a stretch without white space), so names are looked up in the distinct words of
    all pages (`connect.held_in`), long words in overlapping stretches (rows of grams grow with a word's length, not with its
    square), and these joined back to their pages. A name with white space is looked up by its longest word, one of more than
    NAME characters by as many, and then checked against the text; spaced=False: there are none with white space (canonical
    names), and only texts with a word of that length are checked. No side of a join goes through the driver: the planner
    takes exploded rows for as many as there were before."""
    asked = names.select(F.col(name).alias("_n")).filter("_n is not null and trim(_n) <> ''").distinct()
    words = F.filter(F.split("_n", r"\s+"), lambda w: w != "")
    longest = F.try_element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    asked = asked.withColumn("_w", longest if spaced else F.col("_n"))
    asked = asked.select("_n", F.substring("_w", 1, NAME).alias("_w"), (F.col("_n").rlike(r"\s") | (F.length("_w") > NAME)).alias("_check"))
    upper = F.upper(text)
    on = pages.filter(F.col(text).isNotNull()).select(*page, F.explode(F.array_distinct(F.regexp_extract_all(upper, F.lit(_STRETCHES), F.lit(1)))).alias("_word"))
    met = connect.held_in(asked, "_w", on.select("_word").distinct(), "_word")
    held = met.join(asked.hint("merge"), "_w").select("_n", "_word", "_check")
    hits = on.join(held.hint("merge"), "_word").select("_n", *page, "_check").distinct()
    sure = hits.filter("not _check").select("_n", *page)
    texts = pages.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(page)), upper.alias("_t"))
    if not spaced:
        texts = texts.filter(F.col("_t").rlike(rf"\S{{{NAME + 1}}}"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(page)]
    maybe = hits.filter("_check").join(texts.hint("merge"), [*same, F.col("_t").contains(F.col("_n"))]).select("_n", *page)
    return sure.unionByName(maybe.distinct()).withColumnRenamed("_n", name)
