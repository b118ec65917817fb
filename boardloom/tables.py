"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named parquet table, cut down to `columns` where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table_once(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The named table with each key once (the first of re-delivered rows, in order of file and row; rows without a key as
    they are). Only keys move: those that come again, with the place of the row to keep, are written first; being few, they
    are then broadcast under Spark's own threshold, and wide rows stay where they lie. Were they many, the join would shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    again = df.select(F.col(key).alias("_key"), at.alias("_at")).filter("_key is not null").groupBy("_key").agg(F.count("*").alias("_n"), F.min("_at").alias("_keep")).filter("_n > 1").drop("_n")
    again = _once(spark, f"{sf_dir}/{name}.parquet", key, lambda: written(again, f"again-{name}"))
    rows = df.select(key, *(c for c in columns if c != key), at.alias("_at"))
    kept = rows.join(again, rows[key] == again["_key"], "left").filter(F.col("_keep").isNull() | (F.col("_keep") == F.col("_at")))
    return kept.select(key, *(c for c in columns if c != key))


def _once(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, made once a session for each state of the files at `path` (their time and length), and again where
    what was made is gone from the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    state = (shared_dir(spark), path, key, fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength())
    known = spark.__dict__.setdefault("_boardloom_once", {})
    if state not in known or not all(_there(spark, f) for f in known[state].inputFiles()[:1]):
        known[state] = make()
    return known[state]


def _there(spark: SparkSession, file: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where it is unset, a local session (one machine, as
    in tests) gets a folder of its own; on a cluster that is an error, since no folder of one machine is shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="boardloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boardloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """`df`, its rows dealt out by key where the input has fewer splits than there are cores (one small file): what follows
    is bound by Python's time. An input of many splits stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


#: One character that is no white space in the Unicode sense (Java regular expression).
NOT_BLANK = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


_EDGE = NOT_BLANK.replace("[^", "[")


def stripped(c) -> F.Column:
    """The text without outer white space, Unicode white space included."""
    return F.regexp_replace(c, f"^{_EDGE}+|{_EDGE}+$", "")


def blank(c) -> F.Column:
    """True for null and for text of white space only (Unicode white space included)."""
    return c.isNull() | ~c.rlike(NOT_BLANK)


def clear_name(taken: list[str], wanted: str) -> str:
    """`wanted`, or the first of wanted_1, wanted_2, ... that no column has."""
    low, k, name = {t.lower() for t in taken}, 0, wanted
    while name.lower() in low:
        k += 1
        name = f"{wanted}_{k}"
    return name
