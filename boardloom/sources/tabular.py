"""Bills of materials, pages of documents, JSON tables, folders of files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.functions import text as T
from boardloom.schemas import TABLES

#: Column as exported -> column here.
BOM_COLUMNS = {"Designator": "designator", "Quantity": "quantity", "Value": "value", "Manufacturer": "manufacturer", "Part Number": "part_number", "Note": "note", "Specification": "specification", "Footprint": "footprint"}


def split_designators(c: F.Column) -> F.Column:
    return F.filter(F.transform(F.split(c, ","), T.stripped_line), lambda x: x != "")


def read_bom(spark: SparkSession, path: str, need: tuple[str, ...] = ("Designator",)) -> DataFrame:
    """Lines with a designator (a file without one of the columns `need` is an error), in order, fields trimmed, designators cut at commas. A line shorter than the header has
    empty fields; header names are matched without letter case; the file's name names the board."""
    # enforceSchema=False would fail on reordered headers: columns are taken by name instead
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    low = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    missing = [c for c in need if c.lower() not in low]
    if missing:
        raise ValueError(f"no column {missing} in {path}")
    take = [T.stripped_line(F.coalesce(F.col(f"`{low[c.lower()]}`"), F.lit(""))).alias(n) if c.lower() in low else F.lit("").alias(n) for c, n in BOM_COLUMNS.items()]
    df = df.select(F.monotonically_increasing_id().alias("line_ord"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("board_id"), *take)
    return df.filter("designator <> ''").withColumn("designators", split_designators(F.col("designator"))).drop("designator")


def read_pages(spark: SparkSession, path: str, extract=None, glob: str = "*.pdf") -> DataFrame:
    """(source_file, page, text) of a folder of documents. extract(bytes) -> list of page texts; the default reads PDF with
    pypdf where that is installed, and text files with form feeds between pages (glob="*.txt") without it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for where, content in zip(b["path"], b["content"]):
                texts = (extract or extract_pages)(bytes(content))
                rows += [(where.rsplit("/", 1)[-1], n, t or "") for n, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page", "text"])

    return files.select("path", "content").mapInPandas(pages, "source_file string, page int, text string")


def extract_pages(content: bytes) -> list[str]:
    if content[:5] == b"%PDF-":
        import io

        from pypdf import PdfReader  # optional: only where PDF is read

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return content.decode("utf-8", "replace").split("\f")


def pdf_chunks(schematic: DataFrame, datasheets: DataFrame) -> DataFrame:
    """Chunks of both kinds of pages; headings are hinted by the page for schematics, by the chunk for datasheets."""
    from boardloom.operators.texts import chunk_pages

    out = []
    for kind, pages in (("schematic", schematic), ("datasheet", datasheets)):
        got = chunk_pages(pages.withColumn("hint", T.sheet_hint(F.col("text"))), ["source_file", "page", "hint"], "text")
        stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
        number = F.concat_ws(":", F.col("page").cast("string"), F.col("chunk_no").cast("string"))
        name = F.concat(F.lit("schematic:"), number) if kind == "schematic" else F.concat(F.lit("datasheet:"), stem, F.lit(":"), number)
        hint = F.col("hint") if kind == "schematic" else T.sheet_hint(F.col("chunk_text"))
        parts = F.lit(None).cast("array<string>") if kind == "schematic" else F.array(F.lower(stem), F.lower("source_file"))
        out.append(got.select(name.alias("chunk_id"), F.lit(kind).alias("source_type"), "source_file", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.array(hint).alias("heading_path"), parts.alias("part_number_candidates"), T.tokenize(F.col("chunk_text")).alias("tokens"), F.col("chunk_text").alias("text")))
    return out[0].unionByName(out[1])


def page_images(spark: SparkSession, path: str, render, glob: str = "*.pdf") -> DataFrame:
    """(source_file, page_number, width, height, image) of drawn pages. render(bytes) -> list of (width, height, PNG bytes)
    is a plug-in: nothing here draws pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(where.rsplit("/", 1)[-1], n, *image) for where, content in zip(b["path"], b["content"]) for n, image in enumerate(render(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "width", "height", "image"])

    return files.select("path", "content").mapInPandas(draw, "source_file string, page_number int, width int, height int, image binary")


def file_names(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(file, stem) of a folder, without reading contents."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return df.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table kept as JSON lines, with its fixed schema; blank lines are skipped."""
    return spark.read.schema(TABLES[table]).json(path)


def required(*paths: str) -> None:
    gone = [p for p in paths if not Path(p).exists()]
    if gone:
        raise FileNotFoundError(f"missing inputs: {', '.join(gone)}")


def default_inputs(folder: str) -> dict[str, str]:
    """The four inputs of a folder by their endings: one *.dsn, one *.csv, one file that starts with `schematic`, and `datasheets`."""
    at = Path(folder)
    one = lambda pattern: next(iter(sorted(map(str, at.glob(pattern)))), str(at / pattern))
    found = {"netlist": one("*.dsn"), "bom": one("*.csv"), "schematic": one("schematic*"), "datasheets": str(at / "datasheets")}
    required(*found.values())
    return found
