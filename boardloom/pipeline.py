"""Ingest: netlist, bill of materials and documents to the tables of a project folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.catalog import Catalog
from boardloom.functions import text as T
from boardloom.operators import connect, knowledge, texts
from boardloom.ship import ship
from boardloom.enrich import enrich
from boardloom.sinks import bom_overview, circuit_summary, counts, image_manifest, write_json, write_lines, write_markdown, write_table
from boardloom.sources import dsn, tabular


def _keep(df: DataFrame, cat: Catalog, name: str) -> DataFrame:
    write_table(df, cat.root, name)
    cat._tables.pop(name, None)
    return cat.table(name)


def ingest(spark: SparkSession, root: str, netlist: str, bom: str, schematic: str, datasheets: str, glob: str = "*.pdf", board: str = "board", extract=None, render=None, model=None) -> dict:
    """Reads the four inputs, writes all tables under `root`, returns their counts. The files are those of one board.
    extract: bytes -> page texts; render: bytes -> drawn pages of the schematic; model: see `enrich`; each a plug-in."""
    tabular.required(netlist, bom, schematic, datasheets)
    ship(spark)
    cat, one = Catalog(spark, root), F.lit(board)
    files = dsn.read(spark, netlist).withColumn("board_id", one)
    nets = _keep(dsn.nets(files), cat, "nets")
    pins = connect.net_pins(nets)
    index = _keep(connect.component_pins(dsn.images(files), dsn.components(files), connect.connected_pins(pins)), cat, "component_pins")
    _keep(knowledge.net_graph_edges(pins), cat, "graph_edges")

    lines = _keep(tabular.read_bom(spark, bom).withColumn("board_id", one), cat, "bom_lines")
    stems = tabular.file_names(spark, datasheets, glob).withColumn("low", F.lower("stem"))
    parts = connect.parts_by_refdes(lines).withColumn("mpn", T.file_stem(F.col("part_number")))
    held = connect.containment(parts, "mpn", stems, "low").join(stems, "low").groupBy("mpn").agg(F.array_sort(F.collect_set("file")).alias("datasheet_candidates"))
    parts = parts.join(held, "mpn", "left").drop("mpn").withColumn("datasheet_candidates", F.coalesce("datasheet_candidates", F.array().cast("array<string>")))
    parts = _keep(parts, cat, "refdes_to_part")

    pages = tabular.read_pages(spark, datasheets, extract, glob)
    chunks = _keep(tabular.pdf_chunks(tabular.read_pages(spark, schematic, extract, "*"), pages), cat, "pdf_chunks")
    sheets = _keep(texts.datasheet_markdown(pages, "source_file", "page", "text"), cat, "datasheet_markdown")
    facts, functions = component_facts(parts, sheets)
    _keep(facts, cat, "component_facts")
    _keep(functions, cat, "component_pin_functions")

    _keep(knowledge.power_domains(nets), cat, "power_domains")
    _keep(knowledge.interface_buses(nets), cat, "interface_buses")
    _keep(knowledge.function_blocks(nets, parts), cat, "function_blocks")
    _keep(knowledge.anomalies(index, nets), cat, "anomalies")
    _keep(knowledge.typed_graph(nets, parts, pins), cat, "typed_graph")
    _keep(knowledge.sheet_semantics(chunks), cat, "sheet_semantics")
    drawn = chunks.filter("source_type = 'schematic'").select("source_file", F.col("page_start").alias("page_number"), "text")
    _keep(knowledge.entity_pages(nets.select(F.col("net_name_canonical").alias("net_name")), "net_name", drawn, ["source_file", "page_number"], "text", spaced=False), cat, "entity_pages")
    images = _keep(tabular.page_images(spark, schematic, render, "*"), cat, "page_images") if render else cat.table("page_images")
    write_json(image_manifest(images), f"{root}/schematic_page_images.json")
    write_markdown(sheets, f"{root}/datasheets")
    write_lines(bom_overview(lines), ["line_ord"], "row", f"{root}/bom_overview.md")
    write_lines(circuit_summary(cat.table("function_blocks"), cat.table("power_domains"), cat.table("interface_buses")), ["section", "line"], "line", f"{root}/circuit_summary.md")
    added = enrich(cat, model)
    summary = {"enriched": added, "inputs": {"netlist": netlist, "bom": bom, "schematic": schematic, "datasheets": datasheets}, "counts": counts({n: cat.table(n) for n in ("nets", "component_pins", "bom_lines", "pdf_chunks", "component_pin_functions", "anomalies", "typed_graph")})}
    write_json(summary, f"{root}/ingest_summary.json")
    return summary


def component_facts(parts: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per component its first candidate with a datasheet, that sheet's description and pin rows; parsed once per sheet."""
    rows = texts.pin_table_rows(sheets, ["source_file"], "markdown")
    about = sheets.select("source_file", texts.first_description("markdown").alias("part_description")).join(rows.select("source_file").distinct().withColumn("_t", F.lit(True)), "source_file", "left")
    each = parts.select("board_id", "refdes", F.posexplode("datasheet_candidates").alias("pos", "source_file")).join(sheets.select("source_file"), "source_file", "left_semi")
    first = each.groupBy("board_id", "refdes").agg(F.min_by("source_file", "pos").alias("source_file"))
    base = parts.select("board_id", "refdes", "part_number", "manufacturer").join(first, ["board_id", "refdes"])
    facts = base.join(about, "source_file").select("board_id", "refdes", "part_number", "manufacturer", "source_file", "part_description", F.coalesce("_t", F.lit(False)).alias("has_pin_table"))
    functions = base.join(rows, "source_file").select("board_id", "refdes", "part_number", "pin_name", "description", "function", "raw_row")
    return facts, functions
