"""Desk helpers: datasheets mapped to parts in stages, first-wins parts, conversations, signatures of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.functions import text as T
from boardloom.operators.connect import containment


def first_parts(lines: DataFrame, part: str, order: list[str]) -> DataFrame:
    """One line per normalized part number, the first in order."""
    key = T.normal_token(F.col(part))
    rest = lines.columns
    got = lines.filter(key != "").groupBy(key.alias("part_key")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select("part_key", "_r.*")


def map_datasheets(parts: DataFrame, part: str, stems: DataFrame, stem: str) -> DataFrame:
    """(part, stem, how): exact stem, else normalized stem, else the first stem that holds it or that it holds; how is
    `unmatched` and stem null where there is none."""
    p = parts.select(F.col(part).alias("p")).filter("p is not null and p <> ''").distinct().withColumns({"low": F.lower("p"), "norm": T.normal_token(F.col("p"))})
    s = stems.select(F.col(stem).alias("s")).filter("s is not null and s <> ''").distinct().withColumns({"slow": F.lower("s"), "snorm": T.normal_token(F.col("s"))})
    hits = p.join(s, p["low"] == s["slow"]).select("p", "s", F.lit(1).alias("k")).unionByName(p.join(s, (p["norm"] == s["snorm"]) & (p["norm"] != "")).select("p", "s", F.lit(2).alias("k")))
    near = containment(p, "norm", s, "snorm")
    hits = hits.unionByName(near.join(p, "norm").join(s, "snorm").select("p", "s", F.lit(3).alias("k")))
    best = hits.groupBy("p").agg(F.min(F.struct("k", "s")).alias("b"))
    how = F.when(F.col("b.k") == 1, "exact").when(F.col("b.k") == 2, "normalized").when(F.col("b.k") == 3, "fuzzy").otherwise("unmatched")
    return p.join(best, "p", "left").select(F.col("p").alias(part), F.col("b.s").alias(stem), how.alias("how"))


def conversation_summary(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, summary): the first words of the user and the last of the assistant, the latter cut to 120 characters."""
    last = F.max_by(F.when(F.col(role) == "assistant", F.col(text)), F.when(F.col(role) == "assistant", F.col(turn)))
    got = messages.groupBy(key).agg(F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(turn))).alias("q"), last.alias("a"))
    short = F.when(F.length("a") > 120, F.concat(F.left(F.col("a"), F.lit(117)), F.lit("..."))).otherwise(F.col("a"))
    return got.select(key, F.concat_ws(" -> ", "q", short).alias("summary"))


def carry_over(conversations: DataFrame, current, key: str, updated: str, k: int = 3) -> DataFrame:
    """The k latest other conversations."""
    return conversations.filter(F.col(key) != current).orderBy(F.desc(updated), key).limit(k)


def carried_lines(conversations: DataFrame, current, key: str, title: str, summary: str, updated: str, k: int = 3) -> DataFrame:
    """The same conversations as lines of `title: summary`, the latest first."""
    line = F.concat_ws(": ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit("")))
    return carry_over(conversations, current, key, updated, k).select(key, updated, line.alias("line"))


def response_files(files: DataFrame, name: str) -> DataFrame:
    """Answers by the time in their file's name, the latest first; other files are left out."""
    return files.withColumn("answered_at", T.response_time(F.col(name))).filter("answered_at is not null").orderBy(F.desc("answered_at"), name)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def signature(files: DataFrame) -> DataFrame:
    """One text over path, length and time of all files (a folder of inputs), in order of path; of a `binaryFile` scan."""
    one = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    return files.agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("signature"))


def unmatched_groups(parts: DataFrame, refdes: str, part: str) -> DataFrame:
    """Parts with their group, in order of group, designator and part."""
    name = F.when(T.part_class(F.col(refdes)) == "ic", "ICs").when(T.part_class(F.col(refdes)) == "passive", "Passives").otherwise("Other")
    return parts.withColumn("part_group", name).orderBy("part_group", refdes, part)
