"""The queries of the language-model data problems (1, 3 and 6 to 10), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardloom.llm import canon, encode, lines, markup, pack, quality, split
from boardloom.tables import stripped, table, table_once

CAPACITY = 2048


def _repeated(spark: SparkSession, sf_dir: str) -> lines.Repeated:
    return lines.Repeated(table(spark, sf_dir, "pdf_chunks", "source_file", "chunk_id", "text"), "source_file", "chunk_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).found().select(F.col("_doc").alias("chunk_id"), "line_no")


def p1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in clusters of high document frequency, those included that are only near the others (five-word shingles, similarity 0.8)."""
    return _repeated(spark, sf_dir).near().select(F.col("_doc").alias("chunk_id"), "line_no", "cluster")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text without the furniture of its file, and without the lines of near-duplicate clusters that stand as often."""
    chunks = table_once(spark, sf_dir, "pdf_chunks", "chunk_id", "source_file", "text")
    repeated = _repeated(spark, sf_dir)
    gone = repeated.found().unionByName(repeated.near().select("_doc", "line_no"))
    return lines.without_lines(chunks, "chunk_id", "text", gone)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom = table(spark, sf_dir, "bom_lines", "line_id", "manufacturer", "part_number")
    got = canon.resolve(bom, "line_id", "manufacturer", "part_number", table(spark, sf_dir, "manufacturer_ref"), table(spark, sf_dir, "part_ref"))
    return got


def p3_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that name no entry, as written without outer blanks, with the number of lines."""
    bom = table(spark, sf_dir, "bom_lines", "line_id", "manufacturer", "part_number").dropDuplicates(["line_id"])
    lost = p3_found(spark, sf_dir).filter("ref_id = -1").join(bom, "line_id")
    value = stripped(F.when(F.col("field") == "manufacturer", F.col("manufacturer")).otherwise(F.col("part_number")))
    return lost.groupBy("field", value.alias("value")).agg(F.count("*").alias("lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split(table(spark, sf_dir, "pdf_chunks", "chunk_id", "text"), "chunk_id", "text", long_only=True, with_text=False)
    return pieces.filter("piece = 1").select("chunk_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk, with its heading_path."""
    chunks = table(spark, sf_dir, "pdf_chunks", "chunk_id", "source_file", "heading_path", "text")
    return split.split(chunks, "chunk_id", "text", keep=("source_file", "heading_path"))


def p6_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk the text that its pieces make when overlaps are taken off, and whether all of them keep to limit and overlap."""
    pieces = p6_pieces(spark, sf_dir)
    before = F.lag("end").over(Window.partitionBy("chunk_id").orderBy("piece"))
    own = pieces.withColumn("_before", before).withColumn("_shared", F.coalesce(F.col("_before") - F.col("start"), F.lit(0)))
    fits = (F.length("piece_text") <= 1800) & ((F.col("piece") == 0) | (F.col("_shared") == F.least(F.lit(250), "_before"))) & (F.length("piece_text") == F.col("end") - F.col("start"))
    part = F.struct("piece", F.expr("substring(piece_text, cast(_shared as int) + 1)").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")
    return own.groupBy("chunk_id").agg(F.md5(text).alias("digest"), F.bool_and(fits).alias("fits"))


def _residue(spark: SparkSession, sf_dir: str, with_text: bool, whole: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "component_pin_functions", "pinfn_id", "description", "raw_row")
    return markup.residue(rows, "pinfn_id", {"description": False, "raw_row": True}, with_text, whole)


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description and raw_row as clean text, those without markup as they are, and the structure found in them."""
    return _residue(spark, sf_dir, True, whole=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir, False).select("pinfn_id", "field")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text, or each piece of a text beyond a container, lies."""
    sizes = encode.lengths(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return pack.pack(sizes, "doc_id", "tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room used in each container."""
    return p9_containers(spark, sf_dir).filter("container is not null").groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def _common(spark: SparkSession, sf_dir: str) -> dict[str, set[str]]:
    """Function words by language: a fixed table (194 rows), read whole."""
    out: dict[str, set[str]] = {}
    for r in table(spark, sf_dir, "common_words", "lang", "word").filter("lang is not null and word <> ''").collect():
        out.setdefault(r["lang"], set()).add(r["word"].lower())
    return out


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _common(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_stats(spark, sf_dir).filter("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p1_near": p1_near, "p3_found": p3_found, "p3_misses": p3_misses, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_rebuilt": p6_rebuilt, "p7_found": p7_found, "p7_clean": p7_clean, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_stats": p10_stats}

_KEY = r"regexp_replace(lower(line), '[\s0-9\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')"
_OUTER = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL = {
    "p1_found": f"""
with chunks as (select distinct source_file, chunk_id, text from pdf_chunks where source_file is not null and chunk_id is not null),
n as (select source_file, count(distinct chunk_id) as n from chunks group by 1),
each as (select source_file, chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from chunks where text is not null),
keyed as (select source_file, chunk_id, line_no, {_KEY} as k from each where regexp_matches(line, '\\p{{L}}')),
often as (select source_file, k from keyed join n using (source_file) group by source_file, k, n having count(distinct chunk_id) >= 4 and count(distinct chunk_id) * 4 >= n)
select distinct chunk_id, line_no from keyed join often using (source_file, k)""",
    "p6_rebuilt": f"with t as (select distinct chunk_id, regexp_replace(text, '^{_OUTER}+|{_OUTER}+$', '', 'g') as t from pdf_chunks where text is not null and chunk_id is not null) select chunk_id, md5(t) as digest, true as fits from t where t <> ''",
    "p6_found": f"select distinct chunk_id from pdf_chunks where length(regexp_replace(text, '^{_OUTER}+|{_OUTER}+$', '', 'g')) > 1800",
}
