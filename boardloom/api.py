"""The evidence tools by name over a project folder, with the schema of their arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import get_args, get_type_hints

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom import sinks
from boardloom.catalog import Catalog
from boardloom.functions import text as T
from boardloom.operators import connect, neighborhood, search

TOOLS: dict[str, Callable[..., DataFrame | dict]] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


def _rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise KeyError(what)
    return df


#: Count of the summary -> table it counts.
SUMMARY = {
    "nets": "nets", "pin_mappings": "pin_to_net", "components_with_pins": "component_pins", "components_bom": "refdes_to_part", "pdf_chunks": "pdf_chunks", "schematic_images": "page_images", "function_blocks": "function_blocks", "power_domains": "power_domains",
    "interface_buses": "interface_buses", "connectivity_anomalies": "anomalies", "protocol_obligations": "protocol_obligations", "sheet_semantics": "sheet_semantics", "component_facts": "component_facts", "component_pin_functions": "component_pin_functions",
}


@tool
def list_project_summary(cat: Catalog) -> dict:
    """Counts of the tables of the project."""
    return {name: connect.pin_to_net(connect.net_pins(cat.table("nets"))).count() if t == "pin_to_net" else cat.table(t).count() for name, t in SUMMARY.items()}


@tool
def search_components(cat: Catalog, query: str, component_type: str | None = None) -> DataFrame:
    return search.search_components(cat.table("refdes_to_part"), query, component_type).orderBy(F.desc("score"), F.desc("refdes"))


@tool
def get_component(cat: Catalog, refdes: str) -> DataFrame:
    part = _rows(cat.table("refdes_to_part").filter(F.col("refdes") == refdes.upper()), f"unknown component: {refdes}")
    pins = cat.table("component_pins").select("board_id", "refdes", *(F.size(c).alias(f"{c}_count") for c in ("all_pins", "connected_pins", "floating_pins")))
    return part.join(pins, ["board_id", "refdes"], "left").withColumn("component_type", T.component_type(F.col("refdes")))


@tool
def get_component_pins(cat: Catalog, refdes: str) -> DataFrame:
    own = _rows(cat.table("component_pins").filter(F.col("refdes") == refdes.upper()), f"unknown component: {refdes}")
    asked = own.select("board_id", "refdes", F.explode("connected_pins").alias("pin"))
    return connect.pin_lookup(asked, connect.pin_to_net(connect.net_pins(cat.table("nets")))).select("board_id", "refdes", "pin", "net_name_canonical")


@tool
def get_pin_net(cat: Catalog, refdes: str, pin: str) -> DataFrame:
    asked = cat.table("nets").select("board_id").distinct().withColumns({"refdes": F.lit(refdes), "pin": F.lit(pin)})
    return connect.pin_lookup(asked, connect.pin_to_net(connect.net_pins(cat.table("nets"))))


@tool
def search_nets(cat: Catalog, query: str) -> DataFrame:
    return search.search_nets(cat.table("nets"), query).orderBy(F.desc("score"), F.desc("net_name_canonical"))


def _resolved(cat: Catalog, name: str) -> DataFrame:
    """The first net of the name, or of a name that it is an alias of."""
    nets = cat.table("nets")
    asked = nets.select("board_id").distinct().withColumn("alias", T.canonical_net_name(F.lit(name)))
    wanted = asked.join(connect.alias_lookup(nets), ["board_id", "alias"], "left").select("board_id", F.coalesce("net_name_canonical", "alias").alias("net_name_canonical"))
    return _rows(connect.first_match(nets.join(wanted, ["board_id", "net_name_canonical"], "left_semi"), ["board_id"], ["net_ord", "net_id"]), f"unknown net: {name}")


@tool
def get_net(cat: Catalog, net_name: str) -> DataFrame:
    return _resolved(cat, net_name)


@tool
def get_net_members(cat: Catalog, net_name: str) -> DataFrame:
    return connect.net_members(connect.net_pins(_resolved(cat, net_name)))


@tool
def trace_net_neighborhood(cat: Catalog, seed_nets=(), seed_pins=(), seed_components=(), depth: int = 1, max_nodes: int = 250, board: str = "board") -> dict:
    lookup = connect.alias_lookup(cat.table("nets")).filter(F.col("board_id") == board)
    asked = [r["n"] for r in cat.spark.range(1).select(F.explode(F.array(*(T.canonical_net_name(F.lit(n)) for n in seed_nets)) if seed_nets else F.array().cast("array<string>")).alias("n")).collect()]
    known = {r["alias"]: r["net_name_canonical"] for r in lookup.filter(F.col("alias").isin(asked or [""])).collect()}
    seeds = [f"net:{known.get(n, n)}" for n in asked]
    # a pin given as PIN:... stays upper case and is no node; others are looked up in upper case
    seeds += [p.upper() if p.upper().startswith("PIN:") else f"pin:{p.upper()}" for p in seed_pins] + [f"component:{c.upper()}" for c in seed_components]
    nodes, truncated, edges = neighborhood.trace(cat.table("graph_edges"), board, seeds, depth, max_nodes)
    log = [(r["src"], r["dst"]) for r in edges.orderBy("place").toLocalIterator()]
    return {"seed_nodes": seeds, "depth": depth, "max_nodes": max_nodes, "truncated": truncated, "nodes": nodes, "edges": log}


@tool
def search_pdf_chunks(cat: Catalog, query: str, source_type: str = "any", refdes: str | None = None, mpn: str | None = None, max_results: int = 8) -> DataFrame:
    allow = None
    if refdes:
        files = cat.table("refdes_to_part").filter(F.col("refdes") == refdes.upper()).select(F.explode("datasheet_candidates").alias("source_file"))
        allow = None if files.isEmpty() else files
    return search.search_chunks(cat.table("pdf_chunks"), ["chunk_id"], "text", query, max_results, source_type, allow, mpn)


@tool
def search_datasheet_chunks(cat: Catalog, refdes: str, query: str, max_results: int = 8) -> DataFrame:
    get_component(cat, refdes)
    return search_pdf_chunks(cat, query, "datasheet", refdes, None, max_results)


@tool
def get_pdf_chunk(cat: Catalog, chunk_id: str) -> DataFrame:
    return _rows(cat.table("pdf_chunks").filter(F.col("chunk_id") == chunk_id).limit(1), f"unknown chunk: {chunk_id}")


@tool
def find_datasheets_for_component(cat: Catalog, refdes: str) -> DataFrame:
    part = _rows(cat.table("refdes_to_part").filter(F.col("refdes") == refdes.upper()), f"unknown component: {refdes}")
    return part.select("board_id", "refdes", F.explode("datasheet_candidates").alias("source_file"))


@tool
def get_schematic_pages(cat: Catalog, query: str = "", refdes: str = "", net_name: str = "", max_results: int = 8) -> DataFrame:
    """Pages found by up to three searches, each with its reason."""
    out = None
    for text, reason in ((query, "query"), (refdes, "refdes"), (net_name, "net")):
        if text:
            got = search_pdf_chunks(cat, text, "schematic", None, None, max_results).select("source_file", F.col("page_start").alias("page_number"), F.lit(reason).alias("reason"))
            out = got if out is None else out.unionByName(got)
    if out is None:
        return cat.table("pdf_chunks").limit(0).select("source_file", F.col("page_start").alias("page_number"), F.array().cast("array<string>").alias("reasons"))
    return out.groupBy("source_file", "page_number").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).orderBy("source_file", "page_number")


@tool
def get_function_blocks(cat: Catalog) -> DataFrame:
    return cat.table("function_blocks")


@tool
def get_power_domains(cat: Catalog) -> DataFrame:
    return cat.table("power_domains").orderBy("net_name")


@tool
def get_interface_buses(cat: Catalog) -> DataFrame:
    return cat.table("interface_buses").orderBy("bus_type")


@tool
def get_component_datasheet_facts(cat: Catalog, refdes: str) -> DataFrame:
    facts = _rows(cat.table("component_facts").filter(F.upper("refdes") == refdes.upper()), f"no facts: {refdes}")
    pins = cat.table("component_pin_functions").filter(F.upper("refdes") == refdes.upper()).groupBy("board_id", "refdes").agg(F.collect_list(F.struct("pin_name", "description", "function")).alias("pin_functions"))
    return facts.join(pins, ["board_id", "refdes"], "left")


@tool
def search_pin_functions(cat: Catalog, query: str, refdes: str | None = None, max_results: int = 20) -> DataFrame:
    return search.search_pin_functions(cat.table("component_pin_functions"), query, refdes).orderBy(F.desc("score"), "refdes", "pin_name", "raw_row").limit(max_results)


@tool
def get_connectivity_anomalies(cat: Catalog, severity: str | None = None, refdes: str | None = None) -> DataFrame:
    df = cat.table("anomalies")
    df = df.filter(F.lower("severity") == severity.strip().lower()) if severity else df
    return df.filter(F.upper("refdes") == refdes.strip().upper()) if refdes else df


@tool
def rank_schematic_images_for_obligations(cat: Catalog, required_nets: list = (), required_components: list = (), terms: list = (), intent: str = "system_function", seen_pages: list = (), max_results: int = 4) -> DataFrame:
    """Schematic pages ranked by what a question needs: its nets and components, terms that evidence speaks of, tags; pages seen weigh less."""
    page = ["source_file", "page_number"]
    chunks = cat.table("pdf_chunks").filter("source_type = 'schematic'").withColumn("page_number", F.col("page_start"))
    sheets = cat.table("sheet_semantics")
    tagged = sheets.filter(F.col("debug") if intent == "protocol_debug_validation" else F.col("power") & F.lit(intent in ("system_function", "relationship_trace")))
    weight, why = (1.5, "sheet_tag:debug") if intent == "protocol_debug_validation" else (0.8, "sheet_tag:power")
    seen = sheets.filter(F.col("page_number").isin(list(seen_pages) or [-1]))
    about = sorted({x.upper() for x in (*required_nets, *required_components, *terms)} - {""})
    got = search.rank_pages(cat.table("entity_pages"), [n.upper() for n in required_nets], chunks, about, tagged.withColumns({"w": F.lit(weight), "why": F.lit(why)}), seen, page)
    return got.orderBy(F.desc("score"), *page).limit(max_results)


@tool
def get_schematic_page_image(cat: Catalog, page_number: int) -> DataFrame:
    """The drawn page as base64, where page images were written."""
    got = cat.table("page_images").filter(F.col("page_number") == page_number).orderBy("source_file").limit(1)
    return _rows(got.select("source_file", "page_number", "width", "height", F.base64("image").alias("image_base64")), f"unknown page: {page_number}")


@tool
def get_circuit_summary(cat: Catalog) -> DataFrame:
    return sinks.circuit_summary(cat.table("function_blocks"), cat.table("power_domains"), cat.table("interface_buses")).orderBy("board_id", "section", "line")


@tool
def get_component_context_bundle(cat: Catalog, refdes: str) -> dict:
    """Part, pins, datasheet chunks, pages and nets of a component, each a table."""
    part = get_component(cat, refdes)
    pins = get_component_pins(cat, refdes)
    about = part.select(F.concat_ws(" ", "refdes", "part_number")).first()[0]
    return {"component": part, "pins": pins, "top_datasheet_chunks": search_datasheet_chunks(cat, refdes, about, 4), "related_schematic_pages": get_schematic_pages(cat, refdes=refdes), "related_nets": pins.select("board_id", "net_name_canonical").distinct()}


_JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", tuple: "array", list: "array"}


def schemas() -> list[dict]:
    """Name, description and JSON schema of the arguments of every tool, from its signature."""
    out = []
    for name, f in TOOLS.items():
        given = list(inspect.signature(f).parameters.values())[1:]
        hints = get_type_hints(f)
        fields = {}
        for p in given:
            kinds = [k for k in (get_args(hints[p.name]) or (hints[p.name],) if p.name in hints else (type(p.default),)) if k is not type(None)]
            kind = _JSON_TYPES.get(kinds[0], "string")
            fields[p.name] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})
        need = [p.name for p in given if p.default is inspect.Parameter.empty]
        out.append({"type": "function", "name": name, "description": (inspect.getdoc(f) or name.replace("_", " ").capitalize()).split("\n")[0], "parameters": {"type": "object", "properties": fields, "required": need, "additionalProperties": False}})
    return out
