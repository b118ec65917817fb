"""Scored search: hash-vector and lexical scores over sparse terms, component, net and pin-function search, ranking of pages."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions import text as T

DIMS = 512
#: Tokens whose buckets a task keeps.
MEMO = 500_000


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall(T.TOKEN, query)]


def query_vector(tokens: list[str], dims: int = DIMS) -> dict[int, float]:
    """Sparse unit vector of hashed token counts."""
    n = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims for t in tokens)
    norm = math.sqrt(sum(v * v for v in n.values()))
    return {k: v / norm for k, v in n.items()} if norm else {}


def chunk_terms(chunks: DataFrame, key: list[str], text: str, dims: int = DIMS) -> DataFrame:
    """(key, bucket, tf) of each text: the sparse form of its hash vector, worth keeping where many queries run."""
    return chunks.select(*key, F.explode(T.tokenize(F.coalesce(text, F.lit(""))))).withColumn("bucket", T.hash_bucket(F.col("col"), DIMS)).groupBy(*key, "bucket").agg(F.count("*").alias("tf"))


def scored(chunks: DataFrame, text: str, query: str, dims: int = DIMS, weight: float = 0.35) -> DataFrame:
    """`chunks` with lex, cos and score against the query; one narrow pass, no shuffle: a text is scored where it lies.

    Arrow batches rather than lambdas over arrays: those are interpreted token by token, MD5 included (measured thirty times
    slower); here each distinct token is hashed once a task and counts are bincounts."""
    tokens = query_tokens(query)
    asked = frozenset(tokens)
    q = np.zeros(dims)
    for k, v in query_vector(tokens, dims).items():
        q[k] = v

    @F.pandas_udf("lex double, cos double")
    def score(texts: pd.Series) -> pd.DataFrame:
        find, memo = re.compile(T.TOKEN).findall, {}
        lex, cos = np.zeros(len(texts)), np.zeros(len(texts))
        for i, t in enumerate(texts):
            buckets = []
            for raw, n in Counter(find(t or "")).items():
                own = memo.get(raw)
                if own is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    low = raw.lower()
                    own = memo[raw] = (int(hashlib.md5(low.encode()).hexdigest()[:8], 16) % dims, low in asked)
                buckets.append((own[0], n))
                lex[i] += n if own[1] else 0
            if buckets:
                at, n = np.array(buckets).T
                v = np.bincount(at, n, dims)
                cos[i] = v @ q / math.sqrt(v @ v)
        return pd.DataFrame({"lex": lex, "cos": cos})

    # not deterministic, as far as the optimizer is told: it would score once for the filter and once for the output
    df = chunks.withColumn("_s", score.asNondeterministic()(F.col(text))).select("*", "_s.*").drop("_s")
    return df.withColumn("score", F.col("lex") + weight * F.col("cos"))


def search_chunks(chunks: DataFrame, key: list[str], text: str, query: str, k: int, source_type: str = "any", allow: DataFrame | None = None, part_number: str | None = None) -> DataFrame:
    """The k best chunks; allow: source files to keep to (the caller passes none where a component has none); part_number:
    keeps to files whose name holds it, which may be none."""
    df = chunks if source_type == "any" else chunks.filter(F.col("source_type") == source_type)
    if allow is not None:
        df = df.join(allow.select("source_file").distinct(), "source_file", "left_semi")
    elif part_number:
        df = df.filter(F.lower("source_file").contains(part_number.lower()))
    got = scored(df, text, query).filter("score > 0").withColumn("score", F.round("score", 6))
    return got.withColumn("snippet", F.left(F.col(text), F.lit(400))).orderBy(F.desc("score"), *key).limit(k)


def top_by(df: DataFrame, group: list[str], score: str, order: list[str], k) -> DataFrame:
    """The k best of each group, by two ranks: within salted parts first, so that no group is ranked whole by one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = Window.partitionBy(*group, "_salt").orderBy(F.desc(score), *order)
    few = salted.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).drop("_n", "_salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *order))).filter(F.col("rank") <= k)


def search_components(parts: DataFrame, query: str, component_type: str | None = None) -> DataFrame:
    """All components that match, best first; wildcards and unknown types are errors."""
    q, tokens = query.strip().lower(), sorted(set(query_tokens(query)))
    if "*" in q or "?" in q:
        raise ValueError("wildcards are not supported in component queries; use plain text")
    kind = (component_type or "").strip().lower()
    if kind and kind not in T.COMPONENT_TYPES:
        raise ValueError(f"unknown component type {component_type!r}; one of {T.COMPONENT_TYPES}")
    df = parts.withColumn("component_type", T.component_type(F.col("refdes")))
    if kind:
        df = df.filter(F.col("component_type") == kind)
    fields = ["refdes", "part_number", "manufacturer", "value", "footprint", "specification"]
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in fields), F.array_join(F.coalesce("datasheet_candidates", F.array()), " ")))
    score = F.when(F.lower("refdes") == q, 4.0).otherwise(0.0) + (F.when(blob.contains(q), 2.0).otherwise(0.0) if q else F.lit(0.0))
    for t in tokens:
        score = score + F.when(blob.contains(t), 0.3).otherwise(0.0)
    return df.withColumn("score", F.round(score, 3)).filter("score > 0")


def search_nets(nets: DataFrame, query: str) -> DataFrame:
    """All nets that match: exact name, exact alias, or either holding the other."""
    needle = re.sub(r"[^A-Za-z0-9_.-]+", "_", query.replace("\\", "")).upper()
    name = F.col("net_name_canonical")
    alias = F.exists(F.concat(F.coalesce("aliases", F.array()), F.array(F.coalesce("net_name_raw", F.lit("")))), lambda a: T.canonical_net_name(a) == needle)
    part = (name.contains(needle) | F.lit(needle).contains(name)) if needle else F.lit(False)
    how = F.when(name == needle, F.struct(F.lit(4.0).alias("score"), F.lit("exact_canonical").alias("match_reason"))).when(alias, F.struct(F.lit(3.0).alias("score"), F.lit("exact_alias").alias("match_reason"))).when(part, F.struct(F.lit(2.0).alias("score"), F.lit("partial_match").alias("match_reason")))
    return nets.withColumn("_h", how).filter("_h is not null").select("*", "_h.*").drop("_h")


def search_pin_functions(rows: DataFrame, query: str, refdes: str | None = None) -> DataFrame:
    """Rows that hold the query; every row where it is empty."""
    needle = query.strip().lower()
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("pin_name", "description", "function", "raw_row", "part_number"))))
    df = rows.filter(F.upper("refdes") == refdes.upper().strip()) if refdes else rows
    if not needle:
        return df.withColumn("score", F.lit(0.1))
    return df.filter(blob.contains(needle)).withColumn("score", F.lit(1.3 if refdes else 1.0))


def rank_pages(net_pages: DataFrame, required_nets: list[str], chunks: DataFrame, terms: list[str], tagged: DataFrame, seen: DataFrame, page: list[str]) -> DataFrame:
    """(page..., score, reasons): nets 2.5 each, chunks that hold terms 1.2 and 0.2 for each of up to six, tags, and less for
    pages already seen. net_pages: page..., net_name; tagged: page..., tag weight and reason; seen: page...."""
    a = net_pages.filter(F.col("net_name").isin(required_nets or [""])).select(*page, F.lit(2.5).alias("w"), F.concat(F.lit("net_match:"), "net_name").alias("why"))
    upper = F.upper("text")
    hits = F.array_compact(F.array(*(F.when(upper.contains(t), F.lit(t)) for t in sorted(set(terms)) if t))) if terms else F.array().cast("array<string>")
    b = chunks.select(*page, hits.alias("h")).filter(F.size("h") > 0).select(*page, (1.2 + 0.2 * F.least(F.size("h"), F.lit(6))).alias("w"), F.array_join(F.transform(F.slice("h", 1, 6), lambda t: F.concat(F.lit("ref_match:"), t)), ",").alias("why"))
    c = tagged.select(*page, "w", "why")
    total = a.unionByName(b).unionByName(c).groupBy(*page).agg(F.sum("w").alias("score"), F.array_join(F.array_sort(F.collect_list("why")), ",").alias("reasons"))
    less = seen.select(*page).distinct().withColumn("_seen", F.lit(0.4))
    return total.join(less, page, "left").withColumn("score", F.round(F.col("score") - F.coalesce("_seen", F.lit(0.0)), 4)).drop("_seen")


def nets_touching(nets: DataFrame, refs: list[str]) -> DataFrame:
    """(board_id, net_name_canonical) of nets with a pin of one of the components."""
    starts = F.array(*(F.lit(f"{r.upper()}-") for r in refs)) if refs else F.array().cast("array<string>")
    hit = F.exists(F.coalesce("pins_raw", F.array()), lambda t: F.exists(starts, lambda s: F.upper(t).startswith(s)))
    return nets.filter(hit).select("board_id", "net_name_canonical").distinct()


# Nets that a broad question begins with, and how many seeds are enough.
BREADTH, SEEDS = ["VBUS", "VBAT", "1V8", "2V8", "SWD", "RESET", "P0.", "P1.", "P2."], 14


def seed_nets(nets: DataFrame, asked: DataFrame, breadth: bool, refs: list[str] = (), hints: list[str] = BREADTH, budget: int = SEEDS) -> DataFrame:
    """(board_id, net_name_canonical, pins, asked, score): asked nets and those of the asked components, then, for broad
    questions, nets with a hint in their name in file order until there are `budget` per board. Of several rows of one name the last tells its pins."""
    key = ["board_id", "net_name_canonical"]
    once = nets.groupBy(*key).agg(F.min(F.struct("net_ord", "net_id")).alias("_o"), F.max_by(F.size(F.coalesce("pins_raw", F.array())), F.struct("net_ord", "net_id")).alias("pins"))
    wanted = asked.select(*key).union(nets_touching(nets, list(refs))).distinct()
    own = once.join(wanted, key, "left_semi").select(*key, "pins", F.lit(True).alias("asked"))
    if breadth:
        count = wanted.groupBy("board_id").agg(F.count("*").alias("_have"))
        more = once.filter(T.holds_any(F.col("net_name_canonical"), hints)).join(wanted, key, "left_anti")
        more = top_by(more.select(*key, "pins", F.col("_o.net_ord").alias("_a"), F.col("_o.net_id").alias("_b"), F.lit(0).alias("_z")), ["board_id"], "_z", ["_a", "_b", "net_name_canonical"], budget)
        more = more.join(count, "board_id", "left").filter(F.col("rank") <= budget - F.coalesce("_have", F.lit(0)))
        own = own.unionByName(more.select(*key, "pins", F.lit(False).alias("asked")))
    return own.withColumn("score", F.round(2.0 + F.least(F.lit(1.5), 0.05 * F.col("pins")), 4))


def block_evidence(members: DataFrame, boards: DataFrame, refs: list[str], nets: list[str], breadth: bool, most: int = 6) -> DataFrame:
    """(board_id, block, overlap, score): blocks that share components or nets with the question, all of them for broad
    questions; the best `most` of a board. members: (board_id, block, kind, member), as rows: no block is gathered."""
    hit = ((F.col("kind") == "component") & F.upper("member").isin([r.upper() for r in refs] or [""])) | ((F.col("kind") == "net") & F.upper("member").isin([n.upper() for n in nets] or [""]))
    got = members.filter(hit).groupBy("board_id", "block").agg(F.count_distinct("kind", F.upper("member")).alias("overlap"))
    df = boards.join(got, ["board_id", "block"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long"))) if breadth else got
    return top_by(df.withColumn("score", 1.0 + F.col("overlap") + (0.6 if breadth else 0.0)), ["board_id"], "score", ["block"], most).drop("rank")


def anomaly_evidence(anomalies: DataFrame, refs: list[str], nets: list[str], aggressive: bool) -> DataFrame:
    """(board_id, anomaly_id, n, score): those about an asked component or net, all of them where `aggressive`; the best 12 or 6
    of a board, equal ones in order of their kind and id."""
    match = F.coalesce(F.upper("refdes").isin([r.upper() for r in refs] or [""]), F.lit(False)) | F.coalesce(F.upper("net_name").isin([n.upper() for n in nets] or [""]), F.lit(False))
    df = anomalies.select("board_id", "anomaly_id", "n", match.alias("m"))
    df = df if aggressive else df.filter("m")
    return top_by(df.select("board_id", "anomaly_id", "n", F.when(F.col("m"), 2.1).otherwise(1.1).alias("score")), ["board_id"], "score", ["anomaly_id", "n"], 12 if aggressive else 6).drop("rank")


def component_evidence(parts: DataFrame, refs: list[str]) -> DataFrame:
    """The asked components that have a part."""
    return parts.filter(F.upper("refdes").isin([r.upper() for r in refs] or [""])).withColumn("score", F.lit(2.0))


def pdf_evidence(chunks: DataFrame, key: list[str], text: str, question: str, files: DataFrame, k: int = 8) -> DataFrame:
    """(source_type, key..., score, rank): the k best chunks of datasheets and half as many, three at least, of schematics.
    files: source_file of the asked components' datasheets; where there are any, no other datasheet counts."""
    some = files.select(F.col("source_file").alias("_f")).filter("_f is not null").distinct()
    df = chunks.join(some, chunks["source_file"] == some["_f"], "left").withColumn("_any", some.limit(1).agg(F.count("*").alias("_any")).scalar())
    df = df.filter((F.col("source_type") != "datasheet") | (F.col("_any") == 0) | F.col("_f").isNotNull()).drop("_f", "_any")
    got = scored(df.select("source_type", *key, text), text, question).withColumn("score", F.round("score", 6)).filter("score > 0.05").select("source_type", *key, "score")
    return top_by(got.filter(F.col("source_type").isin("datasheet", "schematic")), ["source_type"], "score", key, F.when(F.col("source_type") == "datasheet", k).otherwise(max(3, k // 2)))


def referenced_terms(evidence: DataFrame, group: list[str], data: str) -> DataFrame:
    """(group..., term): what evidence rows (JSON) speak of, upper case: their component and net, components and nets of blocks,
    nets of connected pins, components among a net's members."""
    kind = "refdes string, net_name_canonical string, component_refs array<string>, nets array<string>, connected_pin_nets map<string,string>, members struct<component_to_pins: map<string,array<string>>>"
    none = F.array().cast("array<string>")
    d = evidence.select(*group, F.from_json(data, kind).alias("d"))
    terms = F.concat(F.array("d.refdes", "d.net_name_canonical"), *(F.coalesce(c, none) for c in (F.col("d.component_refs"), F.col("d.nets"), F.map_values("d.connected_pin_nets"), F.map_keys("d.members.component_to_pins"))))
    return d.select(*group, F.explode(F.transform(terms, F.upper)).alias("term")).filter("term <> ''").distinct()


# Intents that ask broadly, and those that look at every anomaly.
BROAD, AGGRESSIVE = ("system_function", "relationship_trace"), ("anomaly_check", "pin_validation")


def retrieve(nets: DataFrame, parts: DataFrame, members: DataFrame, boards: DataFrame, anomalies: DataFrame, chunks: DataFrame, question: str, refs: list[str], asked: list[str], intent: str, k: int = 8) -> DataFrame:
    """(board_id, kind, source_id, score): evidence of all kinds for a question's entities, each kind bounded per board (chunks in
    all); texts belong to no board."""
    broad, every = intent in BROAD, intent in AGGRESSIVE
    board = lambda df, kind, i: df.select("board_id", F.lit(kind).alias("kind"), F.col(i).alias("source_id"), "score")
    wanted = nets.filter(F.col("net_name_canonical").isin(asked or [""]))
    out = board(seed_nets(nets, wanted, broad, refs), "net", "net_name_canonical")
    out = out.unionByName(board(component_evidence(parts, refs), "component", "refdes"))
    out = out.unionByName(board(block_evidence(members, boards, refs, asked, broad), "function_block", "block"))
    out = out.unionByName(board(anomaly_evidence(anomalies, refs, asked, every), "anomaly", "anomaly_id"))
    files = parts.filter(F.upper("refdes").isin([r.upper() for r in refs] or [""])).select(F.explode("datasheet_candidates").alias("source_file"))
    texts = pdf_evidence(chunks, ["chunk_id"], "text", question, files, k)
    return out.unionByName(texts.select(F.lit(None).cast("string").alias("board_id"), F.col("source_type").alias("kind"), F.col("chunk_id").alias("source_id"), "score"))
