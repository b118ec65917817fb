"""Writing tables and documents: parquet, JSON lines, and the readable summaries."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_table(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_calls(df: DataFrame, path: str) -> None:
    """Tool calls are only ever added."""
    df.write.mode("append").json(path)


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str))


# What a bill of materials opens with.
BOM_HEAD = ["# Bill of Materials Overview", "", "| Designators | Quantity | Value | Manufacturer | Part Number | Footprint |", "| --- | --- | --- | --- | --- | --- |"]


def bom_overview(lines: DataFrame) -> DataFrame:
    """(board_id, line_ord, row): title and head of each board, numbered below 0, and one markdown row per line, in order."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.array(*(F.struct(F.lit(k - len(BOM_HEAD)).cast("long").alias("line_ord"), F.lit(s).alias("row")) for k, s in enumerate(BOM_HEAD)))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.array_join("designators", ", "), *(cell(c) for c in ("quantity", "value", "manufacturer", "part_number", "footprint"))), F.lit(" |"))
    return lines.select("board_id").distinct().select("board_id", F.inline(head)).unionByName(lines.select("board_id", "line_ord", row.alias("row")))


def circuit_summary(blocks: DataFrame, domains: DataFrame, buses: DataFrame) -> DataFrame:
    """(board_id, section, line): what each board's summary says, with a line where a section has nothing."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
    a = blocks.select("board_id", F.lit(1).alias("section"), F.concat(F.lit("- "), "block", F.lit(": components "), listed("component_refs"), F.lit("; nets "), listed("nets")).alias("line"))
    b = domains.select("board_id", F.lit(2).alias("section"), F.concat(F.lit("- "), "net_name", F.lit(" ("), "category", F.lit(", pins "), F.col("pin_count").cast("string"), F.lit(")")).alias("line"))
    c = buses.select("board_id", F.lit(3).alias("section"), F.concat(F.lit("- "), "bus_type", F.lit(": "), listed("nets")).alias("line"))
    boards = blocks.select("board_id").distinct()
    none = []
    for n, df, text in ((2, domains, "No power domains detected."), (3, buses, "No interface buses detected.")):
        none.append(boards.join(df.select("board_id").distinct(), "board_id", "left_anti").select("board_id", F.lit(n).alias("section"), F.lit(text).alias("line")))
    return a.unionByName(b).unionByName(c).unionByName(none[0]).unionByName(none[1])


def component_facts_markdown(facts: DataFrame, pins: DataFrame, most: int = 200) -> DataFrame:
    """(board_id, refdes, markdown): facts and the first `most` rows of the pin table."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "pin_name", "description", "function"), F.lit(" |"))
    table = pins.groupBy("board_id", "refdes").agg(F.slice(F.array_sort(F.collect_set(row)), 1, most).alias("rows"))
    head = F.concat(F.lit("# "), "refdes", F.lit("\n\n"), F.coalesce("part_number", F.lit("")), F.lit(", "), F.coalesce("manufacturer", F.lit("")), F.lit("\n\n"), F.coalesce("part_description", F.lit("")), F.lit("\n\n"))
    return facts.join(table, ["board_id", "refdes"], "left").select("board_id", "refdes", F.concat(head, F.coalesce(F.array_join("rows", "\n"), F.lit(""))).alias("markdown"))


def image_manifest(images: DataFrame) -> dict:
    """How many pages are drawn, and which, without their bytes."""
    rows = [r.asDict() for r in images.select("source_file", "page_number", "width", "height").orderBy("source_file", "page_number").toLocalIterator()]
    return {"page_count": len(rows), "images": rows}


def write_markdown(sheets: DataFrame, folder: str) -> dict:
    """One file for each datasheet of a project (source_file, markdown), one at a time, and a manifest of them beside."""
    at, items = Path(folder), []
    at.mkdir(parents=True, exist_ok=True)
    for r in sheets.orderBy("source_file").toLocalIterator():
        path = at / f"{Path(r['source_file']).stem}.md"
        path.write_text(r["markdown"])
        items.append({"pdf_name": r["source_file"], "markdown_path": str(path)})
    write_json({"items": items}, str(at / "manifest.json"))
    return {"items": items}


def write_lines(rows: DataFrame, order: list[str], column: str, path: str) -> None:
    """A document of rows in order, row by row."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows.orderBy(*order).select(column).toLocalIterator():
            f.write(r[0] + "\n")


def answer_path(folder: str, now: datetime | None = None) -> str:
    return f"{folder}/response_{(now or datetime.now()):%Y%m%d_%H%M%S}.md"


def write_answer(text: str, folder: str, now: datetime | None = None) -> str:
    path = answer_path(folder, now)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return path


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}


