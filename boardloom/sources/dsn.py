"""Netlist text (.dsn) as tables. One file is one row; files are parsed where they lie, in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.functions import text as T

_NET = r"\(net\s+([^\s()]+)\s*\(pins\s+([^)]*)\)"


def balanced(text: str, marker: str, start: int = 0) -> str:
    """From the first `marker` to the bracket that closes it; quotes are not looked at."""
    at = text.find(marker, start)
    if at < 0:
        raise ValueError(f"no {marker} in the text")
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return text[at : m.end()]
    raise ValueError(f"{marker} is never closed")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(board_id, text): the file's name without ending names the board."""
    df = spark.read.text(path, wholetext=True).withColumn("board_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    return df.select("board_id", F.col("value").alias("text"))


def nets(files: DataFrame) -> DataFrame:
    """Nets of each file in order, with aliases (raw and canonical spelling) and pins."""

    def network(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"board_id": b["board_id"], "network": [balanced(t, "(network") for t in b["text"]]})

    part = files.select("board_id", "text").mapInPandas(network, "board_id string, network string")
    raws = F.regexp_extract_all("network", F.lit(f"(?s){_NET}"), F.lit(1))
    pins = F.regexp_extract_all("network", F.lit(f"(?s){_NET}"), F.lit(2))
    each = part.select("board_id", F.posexplode(F.arrays_zip(raws.alias("raw"), pins.alias("pins"))).alias("net_ord", "n"))
    tokens = F.filter(F.split(F.col("n.pins"), r"\s+"), lambda t: t != "")
    name = T.canonical_net_name(F.col("n.raw"))
    token = lambda t: F.struct(t.alias("token"), T.pin_refdes(t).alias("refdes"), T.pin_number(t).alias("pin"))
    return each.select("board_id", F.col("net_ord").cast("long").alias("net_ord"), F.col("net_ord").cast("long").alias("net_id"), F.col("n.raw").alias("net_name_raw"), name.alias("net_name_canonical"), F.array_sort(F.array_distinct(F.array(F.col("n.raw"), name))).alias("aliases"), tokens.alias("pins_raw"), F.transform(tokens, token).alias("pins"))


def components(files: DataFrame) -> DataFrame:
    """(board_id, ord, token) of every placed component."""
    return files.select("board_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\(component\s+([^\s)]+)"), F.lit(1))).alias("ord", "token"))


def images(files: DataFrame) -> DataFrame:
    """(board_id, image_name, pin) of every image."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for board, text in zip(b["board_id"], b["text"]):
                for m in re.finditer(r"\(image ([^\s)]*)", text):
                    block = balanced(text, "(image ", m.start())
                    rows += [(board, m[1], pin) for pin in re.findall(r"\(pin\s+[^\s)]+\s+([^\s)]+)", block)]
            yield pd.DataFrame(rows, columns=["board_id", "image_name", "pin"])

    return files.select("board_id", "text").mapInPandas(parse, "board_id string, image_name string, pin string")
