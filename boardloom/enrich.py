"""Enrichment of a project's tables by a model: a plug-in model(kind, context) -> dict; kind is `blocks`, `protocols` or `facts`.

Without a model nothing is enriched. What a model returns is added to the tables, never put in place of their rows; answers
that are no dict, or lack a field, add nothing. One project at a time: contexts are bounded, and so are the calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from boardloom.catalog import Catalog
from boardloom.operators import texts
from boardloom.schemas import TABLES
from boardloom.sinks import write_table

Model = Callable[[str, dict], dict]
#: Windows of a datasheet that are read for missing facts, at most, and names in a context.
WINDOWS, NAMES = 8, 400


def _add(cat: Catalog, name: str, rows: list[dict]) -> int:
    """Adds rows to a table of the project; fields it lacks are null."""
    if rows:
        new = cat.spark.createDataFrame([], TABLES[name]).schema
        more = cat.spark.createDataFrame([tuple(r.get(f.name) for f in new) for r in rows], new)
        kept = [tuple(r) for r in cat.table(name).collect()]  # a table of one project that is written anew
        write_table(cat.spark.createDataFrame(kept, new).unionByName(more), cat.root, name)
        cat._tables.pop(name, None)
    return len(rows)


def blocks(cat: Catalog, model: Model, board: str = "board") -> int:
    """Blocks and buses that the model sees in the names of nets and components."""
    nets = [r[0] for r in cat.table("nets").select("net_name_canonical").distinct().orderBy("net_name_canonical").limit(NAMES).collect()]
    parts = [r.asDict() for r in cat.table("refdes_to_part").select("refdes", "part_number", "specification").orderBy("refdes").limit(NAMES).collect()]
    got = model("blocks", {"nets": nets, "components": parts}) or {}
    named = [{"board_id": board} | b for b in got.get("blocks", []) if isinstance(b, dict) and b.get("block")]
    buses = [{"board_id": board} | b for b in got.get("buses", []) if isinstance(b, dict) and b.get("bus_type")]
    return _add(cat, "function_blocks", named) + _add(cat, "interface_buses", buses)


def protocols(cat: Catalog, model: Model) -> int:
    """What protocols on the board must have connected."""
    buses = [r.asDict() for r in cat.table("interface_buses").limit(NAMES).collect()]
    got = model("protocols", {"buses": buses}) or {}
    return _add(cat, "protocol_obligations", [p for p in got.get("protocols", []) if isinstance(p, dict) and p.get("protocol")])


def facts(cat: Catalog, model: Model, windows: int = WINDOWS) -> int:
    """Descriptions and pins that rules did not find, window by window of a component's datasheet until both are there."""
    lacking = cat.table("component_facts").filter("coalesce(part_description, '') = '' or not has_pin_table").orderBy("board_id", "refdes")
    added = 0
    for row in lacking.toLocalIterator():
        sheet = cat.table("datasheet_markdown").filter(F.col("source_file") == row["source_file"])
        seen = {"description": row["part_description"] or "", "pins": []}
        for w in texts.windows(sheet, ["source_file"], "markdown").orderBy("window_no").limit(windows).toLocalIterator():
            got = model("facts", {"refdes": row["refdes"], "part_number": row["part_number"], "text": w["window_text"]}) or {}
            seen["description"] = seen["description"] or got.get("part_description", "")
            seen["pins"] += [p for p in got.get("pins", []) if isinstance(p, dict) and p.get("pin_name")]
            if seen["description"] and (seen["pins"] or row["has_pin_table"]):
                break
        base = {k: row[k] for k in ("board_id", "refdes", "part_number", "manufacturer", "source_file")}
        if seen["description"] and not row["part_description"]:
            added += _add(cat, "component_facts", [base | {"part_description": seen["description"], "has_pin_table": bool(seen["pins"])}])
        added += _add(cat, "component_pin_functions", [base | p for p in seen["pins"]])
    return added


def enrich(cat: Catalog, model: Model | None) -> dict[str, int]:
    """Rows added by each kind of enrichment."""
    return {"blocks": blocks(cat, model), "protocols": protocols(cat, model), "facts": facts(cat, model)} if model else {}
