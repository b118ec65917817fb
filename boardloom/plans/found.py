"""The queries of the general data problems (2, 4 and 5), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom.operators import orphans, units, unpack
from boardloom.tables import table


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nets = table(spark, sf_dir, "nets", "net_id", "board_id", "pins_raw", "extracted_at")
    index = table(spark, sf_dir, "component_pin_index", "comp_id", "board_id", "refdes", "indexed_at", "removed_at")
    parts = table(spark, sf_dir, "refdes_to_part", "map_id", "board_id", "refdes", "part_number", "valid_from", "removed_at")
    known = table(spark, sf_dir, "part_ref", "part_number", "listed_at", "withdrawn_at")
    board, c = F.col("board_id"), F.col
    names = F.transform("pins_raw", lambda t: F.regexp_replace(t, r"(?s)-[^-]*$", ""))
    refs = [
        orphans.references(nets, "nets", "net_id", board, names, c("extracted_at")),
        orphans.references(index, "component_pin_index", "comp_id", board, c("refdes"), c("indexed_at")),
        orphans.references(parts, "refdes_to_part", "map_id", F.lit(""), c("part_number"), c("valid_from"), upper=False),
    ]
    owners = [
        orphans.parents(index, "nets", board, c("refdes"), c("indexed_at"), c("removed_at")),
        orphans.parents(parts, "component_pin_index", board, c("refdes"), c("valid_from"), c("removed_at")),
        orphans.parents(known, "refdes_to_part", F.lit(""), c("part_number"), c("listed_at"), c("withdrawn_at")),
    ]
    return refs[0].unionByName(refs[1]).unionByName(refs[2]), owners[0].unionByName(owners[1]).unionByName(owners[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = orphans.orphans(*_references(spark, sf_dir))
    return lost.select(F.col("rel").alias("src_table"), "row_id", "ref_key", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    return p2_found(spark, sf_dir).groupBy("src_table", "period").agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("keys"))


def p4_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of value and specification in its common unit, with where the unit comes from and how sure it is."""
    df = table(spark, sf_dir, "bom_lines", "line_id", "board_id", "designator", "value", "specification")
    return units.convert(df, "line_id", "designator", "value", "specification", source="board_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p4_measures(spark, sf_dir)
    # the exact check: what the forest is sure of must be what the convention says
    sure = got.filter((F.col("route") == "convert") & F.col("confirmed"))
    return sure.select(F.col("row_id").alias("line_id"), "field", "quantity", "amount")


def p4_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without a written unit that are not predicted with confidence, or against the convention."""
    return p4_measures(spark, sf_dir).filter((F.col("route") == "review") | ~F.coalesce("confirmed", F.lit(True))).select(F.col("row_id").alias("line_id"), "field", "quantity", "amount", F.round("confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom = table(spark, sf_dir, "bom_lines", "line_id", "board_id", "designator", "quantity")
    index = table(spark, sf_dir, "component_index", "entry_id", "board_id", "designators", "quantity")
    index = index.withColumn("cell", F.array_join("designators", ","))
    parts = [("bom_lines", unpack.unpack(bom, "line_id", "board_id", "designator", "quantity")), ("component_index", unpack.unpack(index, "entry_id", "board_id", "cell", "quantity"))]
    out = [df.select(F.lit(name).alias("src_table"), "row_id", "pos", "refdes") for name, df in parts]
    return out[0].unionByName(out[1])


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_review": p4_review, "p5_found": p5_found}

_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_P2 = f"""
with tokens as (select distinct net_id, board_id, extracted_at, {_strip("regexp_replace(token, '(?s)-[^-]*$', '')")} as k
                from (select net_id, board_id, extracted_at, unnest(pins_raw) as token from nets)),
refs as (
  select 'nets' as src_table, net_id as row_id, coalesce(board_id, '') as scope, upper(k) as key, upper(k) as ref_key, extracted_at as t from tokens
  union select 'component_pin_index', comp_id, coalesce(board_id, ''), upper({_strip("refdes")}), upper({_strip("refdes")}), indexed_at from component_pin_index
  union select 'refdes_to_part', map_id, '', upper({_strip("part_number")}), {_strip("part_number")}, valid_from from refdes_to_part),
owners as (
  select 'nets' as src_table, coalesce(board_id, '') as scope, upper({_strip("refdes")}) as key, indexed_at as a, removed_at as b from component_pin_index
  union all select 'component_pin_index', coalesce(board_id, ''), upper({_strip("refdes")}), valid_from, removed_at from refdes_to_part
  union all select 'refdes_to_part', '', upper({_strip("part_number")}), listed_at, withdrawn_at from part_ref),
found as (
  select distinct src_table, row_id, ref_key, strftime(t, '%Y-%m') as period from refs r
  where key <> '' and t is not null and not exists (
    select 1 from owners o where o.src_table = r.src_table and o.scope = r.scope and o.key = r.key and (o.a is null or o.a <= r.t) and (o.b is null or o.b > r.t)))
"""
_P5 = r"""
with c as (select distinct 'bom_lines' as src_table, line_id as row_id, designator as cell from bom_lines union select distinct 'component_index', entry_id, array_to_string(designators, ',') from component_index),
t as (select src_table, row_id, upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cell, '[\r]', chr(10), 'g'), '[–—−‐‑]', '-', 'g'), '[…～]', '~', 'g'),
  '["''`“”‘’„«»\[\]{}()<>\x{0B}\x{0C}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]', ' ', 'g')) as x from c where cell is not null),
m as (select src_table, row_id, string_split(regexp_replace(x, '([A-Z]+-?)?([0-9]+)', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1))[2:] as ps from t),
p as (select src_table, row_id, unnest(ps) as s, generate_subscripts(ps, 1) as k from m),
q as (select src_table, row_id, k, split_part(s, chr(2), 1) as l, split_part(split_part(s, chr(2), 2), chr(3), 1) as d, trim(split_part(s, chr(3), 2), ' ' || chr(9) || chr(10)) as sep from p),
r as (select *, regexp_full_match(sep, '-+|\.{2,}|~+|:+|TO|THRU|THROUGH|BIS') and lead(d) over w is not null as span, coalesce(last_value(nullif(l, '') ignore nulls) over (partition by src_table, row_id order by k), '') as own, lead(l) over w as l2, lead(d) over w as d2 from q window w as (partition by src_table, row_id order by k)),
s as (select *, coalesce(lag(span) over w, false) as before, coalesce(lead(span) over w, false) as after, coalesce(lag(span, 2) over w, false) as before2 from r window w as (partition by src_table, row_id order by k)),
u as (select *, span and not before and not after as opens, before and not span and not before2 as closes from s),
v as (select src_table, row_id, k, 0 as j, own, d::bigint as a, case when opens and (l2 = '' or l2 = own or l2 = own || '-') and own <> '' then d2::bigint else d::bigint end as b, d as first, opens and (l2 = '' or l2 = own or l2 = own || '-') and own <> '' as ran,
  closes and lag(opens and (l2 = '' or l2 = own or l2 = own || '-') and own <> '') over (partition by src_table, row_id order by k) as done from u),
e as (select src_table, row_id, k, own, first, ran, unnest(case when a <= b then generate_series(a, b) else list_reverse(generate_series(b, a)) end) as n, unnest(range(1, abs(b - a) + 2)) as j from v where own <> '' and not coalesce(done, false)),
f as (select src_table, row_id, row_number() over (partition by src_table, row_id order by k, j) as pos, own || case when not ran then first when first like '0%' then lpad(n::text, greatest(length(first), length(n::text))::int, '0') else n::text end as refdes, count(*) over (partition by src_table, row_id) as many from e)
select src_table, row_id, pos, refdes from f where many >= 2"""
SQL = {
    "p5_found": _P5,
    "p2_found": _P2 + "select * from found",
    "p2_report": _P2 + "select src_table, period, count(*) as orphans, count(distinct ref_key) as keys from found group by 1, 2",
}
