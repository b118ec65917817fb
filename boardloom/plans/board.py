"""The driver queries of the board operators, each over its whole tables, with the SQL that says the same.

Re-delivered rows repeat an id with the same content; every query takes each id once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardloom import sinks
from boardloom.functions import text as T
from boardloom.operators import connect, desk, evidence, knowledge, neighborhood, search, texts
from boardloom.sources.tabular import split_designators
from boardloom.streaming import questions
from boardloom.tables import table, table_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- tables, each id once -----------------------------------------------------------------------------------------------


def _nets(s: SparkSession, d: str) -> DataFrame:
    return table_once(s, d, "nets", "net_id", "board_id", "net_ord", "net_name_raw", "net_name_canonical", "aliases", "pins_raw")


def _pins(s: SparkSession, d: str) -> DataFrame:
    return connect.net_pins(_nets(s, d))


def _index(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each component, by comp_id."""
    df = table(s, d, "component_pin_index", "comp_id", "board_id", "refdes", "image_name", "all_pins", "connected_pins", "floating_pins")
    df = df.filter("refdes is not null").withColumn("refdes", F.upper(F.trim("refdes")))
    none = F.array().cast("array<string>")
    return connect.latest(df, ["board_id", "refdes"], ["comp_id"]).withColumns({c: F.coalesce(c, none) for c in ("all_pins", "connected_pins", "floating_pins")})


def _parts(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each designator, by map_id."""
    df = table(s, d, "refdes_to_part", "map_id", "board_id", "refdes", "part_number", "manufacturer", "value", "footprint", "specification", "datasheet_candidates")
    df = df.filter("refdes is not null").withColumn("refdes", F.upper(F.trim("refdes")))
    return connect.latest(df, ["board_id", "refdes"], ["map_id"])


def _functions(s: SparkSession, d: str) -> DataFrame:
    return table_once(s, d, "component_pin_functions", "pinfn_id", "board_id", "refdes", "part_number", "pin_name", "description", "function", "raw_row")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table_once(s, d, "pdf_chunks", "chunk_id", "source_type", "source_file", "page_start", "heading_path", "text")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text", "lang", "source").filter("text is not null")


_N = "n as (select distinct on (net_id) * from nets)"
_NP = _N + """,
tok as (select board_id, net_id, net_ord, net_name_raw, net_name_canonical, unnest(pins_raw) as token, generate_subscripts(pins_raw, 1) - 1 as pin_ord from n),
np as (select *, regexp_replace(token, '(?s)-[^-]*$', '') as refdes, case when contains(token, '-') then regexp_extract(token, '(?s)^.*-([^-]*)$', 1) else '' end as pin from tok)"""
_I = "ix as (select * exclude (rn) from (select comp_id, board_id, upper(trim(refdes)) as refdes, image_name, coalesce(all_pins, []) as all_pins, coalesce(connected_pins, []) as connected_pins, coalesce(floating_pins, []) as floating_pins, row_number() over (partition by board_id, upper(trim(refdes)) order by comp_id desc) as rn from component_pin_index where refdes is not null) where rn = 1)"
_P = "pt as (select * exclude (rn) from (select map_id, board_id, upper(trim(refdes)) as refdes, part_number, manufacturer, value, footprint, specification, datasheet_candidates, row_number() over (partition by board_id, upper(trim(refdes)) order by map_id desc) as rn from refdes_to_part where refdes is not null) where rn = 1)"
_F = "fn as (select distinct on (pinfn_id) * from component_pin_functions)"
_C = "ch as (select distinct on (chunk_id) * from pdf_chunks)"
_TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9_./+-]+'), lambda x: lower(x))"
_CANON = "upper(regexp_replace(replace({}, '\\', ''), '[^A-Za-z0-9_.-]+', '_', 'g'))"


def _or(column: str, hints: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{h}')" for h in hints) + ")"


def _kind(column: str, rules: str) -> str:
    whens = " ".join(f"when starts_with(regexp_replace(upper({column}), '[^A-Z]', '', 'g'), '{p}') then '{n}'" for p, n in (r.split("=") for r in rules.split()))
    return f"case {whens} else 'other' end"


_TYPE = "MOD=module U=ic R=resistor C=capacitor L=inductor D=diode_led J=connector P=header TP=test_point SW=switch X=crystal"
_CLASS = "MOD=module U=ic J=connector TP=test_point R=resistor C=capacitor L=inductor D=diode SW=switch X=crystal"
_POWER = _or("net_name_canonical", T.POWER_HINTS)

# --- look-ups and joins -------------------------------------------------------------------------------------------------


@query(f"with {_NP} select board_id, net_id, net_name_canonical, upper(refdes) as refdes, string_agg(pin, ',' order by pin) as pins, count(*) as pin_count from np where contains(token, '-') group by all")
def net_members(s, d):
    return connect.net_members(_pins(s, d)).withColumn("pins", F.array_join("pins", ","))


@query(f"with {_NP} select board_id, token, arg_max(net_name_raw, (net_ord, net_id, pin_ord)) as net_name_raw, arg_max(net_name_canonical, (net_ord, net_id, pin_ord)) as net_name_canonical from np where token is not null group by board_id, token")
def pin_to_net(s, d):
    return connect.pin_to_net(_pins(s, d).filter("token is not null"))


@query(f"""with {_NP}, {_I}, p2n as (select board_id, token, arg_max(net_name_canonical, (net_ord, net_id, pin_ord)) as name from np group by 1, 2),
ask as (select distinct board_id, refdes, unnest(all_pins) as pin from ix)
select ask.board_id, refdes, pin, name as net_name_canonical, name is not null as connected from ask left join p2n on p2n.board_id = ask.board_id and p2n.token = refdes || '-' || pin""")
def pin_lookup(s, d):
    asked = _index(s, d).select("board_id", "refdes", F.explode("all_pins").alias("pin")).distinct()
    return connect.pin_lookup(asked, connect.pin_to_net(_pins(s, d))).select("board_id", "refdes", "pin", "net_name_canonical", "connected")


@query(f"""with {_NP}, {_I}, p2n as (select board_id, token, arg_max(net_name_canonical, (net_ord, net_id, pin_ord)) as name from np group by 1, 2),
ask as (select distinct board_id, refdes, unnest(connected_pins) as pin from ix)
select ask.board_id, refdes, string_agg(pin || '=' || name, ',' order by pin) as pin_nets from ask join p2n on p2n.board_id = ask.board_id and p2n.token = refdes || '-' || pin group by all""")
def component_pin_nets(s, d):
    asked = _index(s, d).select("board_id", "refdes", F.explode("connected_pins").alias("pin")).distinct()
    got = connect.pin_lookup(asked, connect.pin_to_net(_pins(s, d))).filter("connected")
    one = F.array_sort(F.collect_list(F.struct("pin", F.concat_ws("=", "pin", "net_name_canonical").alias("t"))))
    return got.groupBy("board_id", "refdes").agg(F.array_join(F.transform(one, lambda x: x["t"]), ",").alias("pin_nets"))


@query(f"with {_P}, {_I} select pt.board_id, pt.refdes, part_number, manufacturer, {_kind('pt.refdes', _TYPE)} as component_type, len(all_pins) as all_pins, len(connected_pins) as connected_pins, len(floating_pins) as floating_pins from pt left join ix on pt.board_id = ix.board_id and pt.refdes = ix.refdes")
def component_overview(s, d):
    sizes = _index(s, d).select("board_id", "refdes", *(F.size(c).cast("long").alias(c) for c in ("all_pins", "connected_pins", "floating_pins")))
    return _parts(s, d).select("board_id", "refdes", "part_number", "manufacturer", T.component_type(F.col("refdes")).alias("component_type")).join(sizes, ["board_id", "refdes"], "left")


@query(f"""with {_N}, a as (select board_id, net_ord, net_id, net_name_canonical, unnest(list_distinct(list_concat(coalesce(aliases, []), [net_name_raw, net_name_canonical]))) as a from n)
select board_id, {_CANON.format("a")} as alias, arg_max(net_name_canonical, (net_ord, net_id)) as net_name_canonical from a where a is not null group by 1, 2""")
def net_aliases(s, d):
    return connect.alias_lookup(_nets(s, d))


@query(f"with {_N}, w as (select unnest(['GND', 'VBAT', 'SWDIO']) as name) select board_id, net_name_canonical, arg_min(net_id, (net_ord, net_id)) as net_id, arg_min(len(pins_raw), (net_ord, net_id)) as pin_count from n join w on name = net_name_canonical group by 1, 2")
def net_by_name(s, d):
    got = connect.first_match(_nets(s, d).filter(F.col("net_name_canonical").isin("GND", "VBAT", "SWDIO")), ["board_id", "net_name_canonical"], ["net_ord", "net_id"])
    return got.select("board_id", "net_name_canonical", "net_id", F.when(F.col("pins_raw").isNotNull(), F.size("pins_raw")).cast("long").alias("pin_count"))


@query(f"with {_I} select board_id, refdes, unnest(list_filter(list_distinct(all_pins), lambda p: not list_contains(connected_pins, p))) as pin from ix")
def floating_pins(s, d):
    return connect.floating_pins(_index(s, d))


@query(f"""with {_P}, mpn as (select distinct replace(lower(trim(part_number)), '/', '_') as mpn from pt where trim(part_number) <> ''), st as (select distinct regexp_replace(source_file, '\\.[^.]*$', '') as stem from pdf_chunks where source_file is not null)
select mpn, stem from mpn join st on contains(stem, mpn) or contains(mpn, stem)""")
def datasheet_containment(s, d):
    parts = _parts(s, d).select(T.file_stem(F.col("part_number")).alias("mpn"))
    stems = table(s, d, "pdf_chunks", "source_file").select(F.regexp_replace("source_file", r"\.[^.]*$", "").alias("stem"))
    return connect.containment(parts, "mpn", stems, "stem")


@query("""with p as (select distinct part_number as p, lower(part_number) as low, regexp_replace(lower(part_number), '[^a-z0-9]', '', 'g') as norm from part_ref where part_number is not null and part_number <> ''),
st as (select distinct regexp_replace(source_file, '\\.[^.]*$', '') as s from pdf_chunks where source_file is not null), q as (select s, lower(s) as slow, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') as snorm from st where s <> ''),
h as (select p, s, case when low = slow then 1 when norm = snorm and norm <> '' then 2 else 3 end as k from p join q on low = slow or (norm <> '' and snorm <> '' and (contains(snorm, norm) or contains(norm, snorm)))),
b as (select p, min((k, s)) as b from h group by p)
select p.p as part_number, b.b[2] as stem, case b.b[1] when 1 then 'exact' when 2 then 'normalized' when 3 then 'fuzzy' else 'unmatched' end as how from p left join b on p.p = b.p""")
def datasheet_mapping(s, d):
    stems = table(s, d, "pdf_chunks", "source_file").select(F.regexp_replace("source_file", r"\.[^.]*$", "").alias("stem"))
    return desk.map_datasheets(table(s, d, "part_ref", "part_number"), "part_number", stems, "stem")


@query(f"""with {_P}, e as (select board_id, refdes, unnest(datasheet_candidates) as source_file, generate_subscripts(datasheet_candidates, 1) as pos from pt), k as (select distinct replace(lower(part_number), '/', '_') || '.pdf' as source_file from part_ref where withdrawn_at is null)
select board_id, refdes, arg_min(source_file, pos) as source_file from e join k using (source_file) group by 1, 2""")
def first_datasheet(s, d):
    """The first candidate that is a sheet of a part still listed."""
    each = _parts(s, d).select("board_id", "refdes", F.posexplode("datasheet_candidates").alias("pos", "source_file"))
    known = table(s, d, "part_ref", "part_number", "withdrawn_at").filter("withdrawn_at is null").select(F.concat(T.file_stem(F.col("part_number")), F.lit(".pdf")).alias("source_file")).distinct()
    return each.join(known, "source_file", "left_semi").groupBy("board_id", "refdes").agg(F.min_by("source_file", "pos").alias("source_file"))


@query(f"with {_P} select board_id, refdes, unnest(datasheet_candidates) as source_file from pt")
def component_datasheets(s, d):
    return _parts(s, d).select("board_id", "refdes", F.explode("datasheet_candidates").alias("source_file"))


@query(f"with {_F} select board_id, upper(refdes) as refdes, min(part_number) as part_number, count(*) as pin_rows, string_agg(pin_name, ',' order by pin_name) as pin_names from fn where refdes is not null group by board_id, upper(refdes)")
def component_facts(s, d):
    names = F.array_join(F.array_sort(F.collect_list("pin_name")), ",")
    return _functions(s, d).filter("refdes is not null").groupBy("board_id", F.upper("refdes").alias("refdes")).agg(F.min("part_number").alias("part_number"), F.count("*").alias("pin_rows"), F.nullif(names, F.lit("")).alias("pin_names"))


@query(f"""with {_C}, nm as (select distinct net_name_canonical as net_name from nets where net_name_canonical <> '') select distinct net_name, source_file, page_start as page_number from nm join ch on source_type = 'schematic' and contains(upper(text), net_name)""")
def entity_pages(s, d):
    pages = _chunks(s, d).filter("source_type = 'schematic'").select("source_file", F.col("page_start").alias("page_number"), "text")
    return knowledge.entity_pages(_nets(s, d).select(F.col("net_name_canonical").alias("net_name")), "net_name", pages, ["source_file", "page_number"], "text", spaced=False)


@query(f"with {_NP} select distinct np.board_id, np.refdes, net_name_canonical from np join (select distinct board_id, upper(trim(refdes)) as refdes from refdes_to_part where starts_with(upper(trim(refdes)), 'U')) q using (board_id, refdes)")
def nets_of_ics(s, d):
    return connect.nets_of(_pins(s, d), _parts(s, d).filter(F.col("refdes").startswith("U")))


@query(f"""with sy as (select distinct doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.\\\\/-]*'), lambda x: length(x) >= 2 and regexp_matches(x, '[A-Za-z]'))) as sym from documents where text is not null),
kr as (select distinct upper(trim(refdes)) as e from refdes_to_part where refdes is not null), kn as (select distinct net_name_canonical as e from nets)
select distinct doc_id, 'component' as kind, e as entity from sy join kr on upper(sym) = e union select distinct doc_id, 'net', e from sy join kn on {_CANON.format("sym")} = e""")
def linked_entities(s, d):
    sym = _documents(s, d).select("doc_id", F.explode(F.array_distinct(T.symbols(F.col("text")))).alias("sym"))
    refs = _parts(s, d).select(F.col("refdes").alias("entity")).distinct()
    names = _nets(s, d).select(F.col("net_name_canonical").alias("entity")).distinct()
    a = sym.select("doc_id", F.lit("component").alias("kind"), F.upper("sym").alias("entity")).distinct().join(refs, "entity", "left_semi")
    b = sym.select("doc_id", F.lit("net").alias("kind"), T.canonical_net_name(F.col("sym")).alias("entity")).distinct().join(names, "entity", "left_semi")
    return a.unionByName(b)


# --- aggregations and the knowledge graph -------------------------------------------------------------------------------


@query("""with ci as (select distinct on (entry_id) entry_id, board_id, designators, part_number, manufacturer, value, footprint, specification from component_index), e as (select *, unnest(designators) as refdes from ci)
select board_id, refdes, arg_max(coalesce(part_number, '~'), entry_id) as part_number, max(entry_id) as line_ord from e where refdes <> '' group by 1, 2""")
def parts_by_refdes(s, d):
    lines = table_once(s, d, "component_index", "entry_id", "board_id", "designators", "part_number")
    lines = lines.select("board_id", F.col("entry_id").alias("line_ord"), "designators", F.coalesce("part_number", F.lit("~")).alias("part_number"))
    each = lines.select("board_id", "line_ord", F.explode("designators").alias("refdes"), "part_number").filter("refdes <> ''")
    last = each.groupBy("board_id", "refdes").agg(F.max("line_ord").alias("line_ord"))
    return connect.parts_by_refdes(lines).join(last, ["board_id", "refdes"])


@query(f"with {_NP} select board_id, upper(refdes) as refdes, string_agg(distinct pin, ',' order by pin) as connected_pins from np where token is not null group by 1, 2")
def connected_pins(s, d):
    return connect.connected_pins(_pins(s, d).filter("token is not null")).withColumn("connected_pins", F.array_join("connected_pins", ","))


@query(f"""with {_NP}, {_I}, im as (select board_id, image_name || '_' || refdes as token, image_name as own, refdes as r, all_pins, comp_id from ix where image_name is not null),
co as (select board_id, upper(refdes) as refdes, list_sort(list_distinct(list(pin))) as connected from np where token is not null group by 1, 2),
tk as (select board_id, token, regexp_replace(token, '_[^_]*$', '') as image, upper(regexp_extract(token, '^.*_([^_]*)$', 1)) as refdes, comp_id from im),
nm as (select board_id, refdes, comp_id, 0 as which, token as image_name from tk union all select board_id, refdes, comp_id, 1, image from tk),
sz as (select board_id, image_name, list_sort(list_distinct(list(p))) as pins from (select board_id, case when comp_id % 2 = 0 then token else own end as image_name, unnest(all_pins) as p from im) group by 1, 2),
best as (select nm.board_id, nm.refdes, arg_max(coalesce(pins, []), (len(coalesce(pins, [])), -comp_id, -which)) as pins from nm left join sz using (board_id, image_name) where nm.refdes <> '' group by 1, 2)
select board_id, refdes, array_to_string(coalesce(pins, connected, []), ',') as all_pins, array_to_string(coalesce(connected, []), ',') as connected_pins,
array_to_string(list_filter(coalesce(pins, connected, []), lambda p: p <> '' and not list_contains(coalesce(connected, []), p)), ',') as floating_pins from best full join co using (board_id, refdes)""")
def component_pins(s, d):
    ix = _index(s, d).filter("image_name is not null").withColumn("token", F.concat_ws("_", "image_name", "refdes"))
    # images by their whole token, or by the part before the designator
    images = ix.select("board_id", F.when(F.col("comp_id") % 2 == 0, F.col("token")).otherwise(F.col("image_name")).alias("image_name"), F.explode("all_pins").alias("pin"))
    got = connect.component_pins(images, ix.select("board_id", F.col("comp_id").alias("ord"), "token"), connect.connected_pins(_pins(s, d).filter("token is not null")))
    return got.select("board_id", "refdes", *(F.array_join(c, ",").alias(c) for c in ("all_pins", "connected_pins", "floating_pins")))


@query(f"with {_N} select board_id, net_id, 'power:' || net_name_canonical as domain_id, net_name_canonical as net_name, coalesce(len(pins_raw), 0) as pin_count, case when net_name_canonical = 'GND' then 'ground' else 'supply' end as category from n where {_POWER}")
def power_domains(s, d):
    return knowledge.power_domains(_nets(s, d)).withColumn("pin_count", F.col("pin_count").cast("long"))


_BUS = " union ".join(f"select board_id, net_name_canonical as net_name, '{b}' as bus_type from n where {_or('net_name_canonical', h)}" for b, h in T.BUS_HINTS.items())


@query(f"with {_N}, b as ({_BUS}) select * from b")
def interface_buses(s, d):
    return knowledge.bus_nets(_nets(s, d))


_BLOB = "upper(concat_ws(' ', refdes, coalesce(part_number, ''), coalesce(manufacturer, ''), coalesce(specification, ''), coalesce(value, '')))"
_CLS = _kind("refdes", _CLASS)
_MEMBERS = f"""bm as (
  select board_id, 'compute_control' as block, 'component' as kind, refdes as member from pt where {_CLS} in ('ic', 'module')
  union select board_id, 'io_debug', 'component', refdes from pt where {_CLS} in ('connector', 'test_point', 'switch') or contains({_BLOB}, 'SWD')
  union select board_id, 'power_path', 'component', refdes from pt where {_CLS} in ('inductor', 'capacitor', 'diode') or contains({_BLOB}, 'CHARG') or contains({_BLOB}, 'REGUL')
  union select board_id, 'power_path', 'net', net_name_canonical from n where {_POWER}
  union select board_id, 'io_debug', 'net', net_name_canonical from n where regexp_matches(net_name_canonical, '^(P[012]\\.|SWD|RESET)')
  union select board_id, 'compute_control', 'net', net_name_canonical from n where regexp_matches(net_name_canonical, '^(P[012]\\.|XL)'))"""


@query(f"""with {_N}, {_P}, {_MEMBERS}, bb as (select board_id, block from (select board_id from n union select board_id from pt), (select unnest(['power_path', 'compute_control', 'io_debug']) as block))
select bb.board_id, bb.block, kind, member from bb left join bm on bb.board_id = bm.board_id and bb.block = bm.block""")
def function_blocks(s, d):
    return knowledge.block_rows(_nets(s, d), _parts(s, d))


_ANOMALIES = f"""an as (
  select board_id, 'floating:' || refdes as anomaly_id, 'high' as severity, 'floating_required_pin' as kind, refdes, null as net_name, array_to_string(floating_pins[1:20], ',') as pins, len(floating_pins[1:20]) as n from ix where {_CLS} in ('ic', 'module') and len(floating_pins) > 0
  union all select board_id, 'duplicate_members:' || net_name_canonical, 'medium', 'duplicate_pin_membership', null, net_name_canonical, null, len(pins_raw) - len(list_distinct(pins_raw)) from n where len(pins_raw) > len(list_distinct(pins_raw))
  union all select board_id, 'orphan:' || net_name_canonical, 'low', 'orphan_or_stub_net', null, net_name_canonical, null, len(list_distinct(coalesce(pins_raw, []))) from n where len(list_filter(list_distinct(coalesce(pins_raw, [])), lambda t: not starts_with(upper(t), 'TP'))) <= 1 and net_name_canonical <> 'GND')"""


@query(f"with {_N}, {_I}, {_ANOMALIES} select * from an")
def anomalies(s, d):
    return knowledge.anomalies(_index(s, d), _nets(s, d)).withColumn("n", F.col("n").cast("long"))


@query(f"with {_N}, {_I}, {_ANOMALIES} select board_id, anomaly_id, kind from an where severity = 'high' and refdes = 'U1'")
def anomalies_of_component(s, d):
    return knowledge.anomalies(_index(s, d), _nets(s, d)).filter("severity = 'high' and refdes = 'U1'").select("board_id", "anomaly_id", "kind")


_EDGES = """ed as (select board_id, 'pin:' || token as src, 'net:' || net_name_canonical as dst, 'pin_to_net' as type from np where token is not null union all select board_id, 'net:' || net_name_canonical, 'pin:' || token, 'net_to_pin' from np where token is not null
union all select board_id, 'component:' || refdes, 'pin:' || token, 'component_to_pin' from np where token is not null union all select board_id, 'pin:' || token, 'component:' || refdes, 'pin_to_component' from np where token is not null)"""


@query(f"with {_NP}, {_EDGES} select board_id, src, dst, type from ed")
def graph_edges(s, d):
    return knowledge.net_graph_edges(_pins(s, d).filter("token is not null")).select("board_id", "src", "dst", "type")


@query(f"with {_NP} select board_id, 'pin:' || token as id, 'component_pin' as type from np where token is not null union select board_id, 'component:' || refdes, 'component' from np where token is not null union select board_id, 'net:' || net_name_canonical, 'net' from n")
def graph_nodes(s, d):
    return knowledge.net_graph_nodes(_pins(s, d).filter("token is not null"), _nets(s, d))


@query(f"""with {_NP}, {_P}, {_MEMBERS}, b as ({_BUS})
select board_id, 'block:' || block as src, kind || ':' || member as dst, 'contains_' || kind as relation, null as pin from bm
union all select board_id, 'power:' || net_name_canonical, 'net:' || net_name_canonical, 'domain_net', null from n where {_POWER}
union all select board_id, 'bus:' || bus_type, 'net:' || net_name, 'bus_member', null from b
union all select board_id, 'component:' || upper(refdes), 'net:' || net_name_canonical, 'connected_to', pin from np where contains(token, '-')""")
def typed_graph(s, d):
    return knowledge.typed_graph(_nets(s, d), _parts(s, d), _pins(s, d))


@query(f"""with {_C}, t as (select source_file, page_start as page_number, heading_path, list_transform(({_TOKENS.format("coalesce(text, '')")})[1:300], lambda x: upper(x)) as t from ch where source_type = 'schematic'),
h as (select source_file, page_number, string_agg(distinct h, '|' order by h) as sheet_hints from (select source_file, page_number, unnest(heading_path) as h from t) where h is not null group by 1, 2)
select source_file, page_number, coalesce(any_value(sheet_hints), '') as sheet_hints, bool_or(len(list_filter(t, lambda x: regexp_matches(x, '^(SWD|JTAG)'))) > 0) as debug, bool_or(len(list_filter(t, lambda x: x in ('VBUSIN', 'VBAT', '1V8', '2V8_SW', 'GND'))) > 0) as power,
bool_or(len(list_filter(t, lambda x: contains(x, 'IMU') or contains(x, 'ICM'))) > 0) as sensor, bool_or(len(list_filter(t, lambda x: regexp_matches(x, '^J\\d+$'))) > 0) as connector from t left join h using (source_file, page_number) group by 1, 2""")
def sheet_semantics(s, d):
    return knowledge.sheet_semantics(_chunks(s, d)).withColumn("sheet_hints", F.array_join(F.array_compact("sheet_hints"), "|"))


@query(f"""with {_NP}, {_EDGES}, e as (select distinct board_id, src, dst from ed), h0 as (select distinct board_id, src as id from e where src = 'component:U1'),
h1 as (select distinct board_id, dst as id from h0 join e using (board_id) where src = h0.id except select * from h0), h2 as (select distinct h1.board_id, dst as id from h1 join e on e.board_id = h1.board_id and src = h1.id except (select * from h0 union select * from h1)),
h3 as (select distinct h2.board_id, dst as id from h2 join e on e.board_id = h2.board_id and src = h2.id except (select * from h0 union select * from h1 union select * from h2))
select *, 0 as hop from h0 union all select *, 1 from h1 union all select *, 2 from h2 union all select *, 3 from h3""")
def neighborhood_of_u1(s, d):
    edges = knowledge.net_graph_edges(_pins(s, d).filter("token is not null"))
    seeds = edges.filter("src = 'component:U1'").select("board_id", F.col("src").alias("id")).distinct()
    return neighborhood.k_hops(edges, seeds, 3)


@query(f"""with {_NP}, {_I}, {_P}, {_F}, {_C}, {_ANOMALIES}, b as ({_BUS}) select (select count(*) from n) as nets, (select count(*) from (select distinct board_id, token from np where token is not null)) as pin_mappings, (select count(*) from ix) as components_with_pins, (select count(*) from pt) as components_bom, (select count(*) from ch) as pdf_chunks,
(select count(*) from (select distinct source_file, page_start from ch where source_type = 'schematic')) as schematic_images, (select 3 * count(*) from (select board_id from n union select board_id from pt)) as function_blocks, (select count(*) from n where {_POWER}) as power_domains, (select count(*) from (select distinct board_id, bus_type from b)) as interface_buses,
(select count(*) from an) as connectivity_anomalies, 0::bigint as protocol_obligations, (select count(*) from (select distinct source_file, page_start from ch where source_type = 'schematic')) as sheet_semantics, (select count(*) from (select distinct board_id, upper(refdes) from fn where refdes is not null)) as component_facts, (select count(*) from fn) as component_pin_functions""")
def project_summary(s, d):
    """The fourteen counts of a summary over all boards; each is one row before they meet."""
    nets, index, parts, chunks, functions = _nets(s, d), _index(s, d), _parts(s, d), _chunks(s, d).drop("text", "heading_path"), _functions(s, d)
    sheets = chunks.filter("source_type = 'schematic'").select("source_file", "page_start").distinct()
    tables = {
        "nets": nets, "pin_mappings": _pins(s, d).filter("token is not null").select("board_id", "token").distinct(), "components_with_pins": index, "components_bom": parts, "pdf_chunks": chunks, "schematic_images": sheets,
        "function_blocks": knowledge.blocks_of(nets, parts), "power_domains": knowledge.power_domains(nets), "interface_buses": knowledge.bus_nets(nets).select("board_id", "bus_type").distinct(), "connectivity_anomalies": knowledge.anomalies(index, nets),
        "protocol_obligations": nets.limit(0), "sheet_semantics": sheets, "component_facts": functions.filter("refdes is not null").select("board_id", F.upper("refdes")).distinct(), "component_pin_functions": functions,
    }
    long = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        long = one if long is None else long.unionByName(one)
    return long.agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in tables))


# --- scored search ------------------------------------------------------------------------------------------------------


@query(f"with t as (select doc_id, unnest({_TOKENS.format('text')}) as token from documents where text is not null) select doc_id, token, count(*) as tf from t group by 1, 2")
def token_counts(s, d):
    return _documents(s, d).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query(f"with t as (select doc_id, unnest({_TOKENS.format('text')}) as token from documents where text is not null) select doc_id, cast(('0x' || substr(md5(token), 1, 8))::ubigint % 512 as int) as bucket, count(*) as tf from t group by 1, 2")
def hash_buckets(s, d):
    return search.chunk_terms(_documents(s, d), ["doc_id"], "text")


_ASK = "status indicator near the mounting hole SWDIO"


def _scored_sql(source: str, key: str, ask: str = _ASK) -> str:
    q = search.query_tokens(ask)
    vector = search.query_vector(q)
    weights = ", ".join(f"({k}, {v!r})" for k, v in vector.items())
    asked = ", ".join(f"'{t}'" for t in sorted(set(q)))
    return f"""tk as (select {key}, unnest({_TOKENS.format("text")}) as token from {source} where text is not null), bk as (select {key}, cast(('0x' || substr(md5(token), 1, 8))::ubigint % 512 as int) as bucket, count(*) as tf, sum(case when token in ({asked}) then 1 else 0 end) as lex from tk group by 1, 2),
w(bucket, w) as (values {weights}), sc as (select {key}, round(sum(lex) + 0.35 * (coalesce(sum(tf * w), 0) / sqrt(sum(tf * tf))), 6) as score from bk left join w using (bucket) group by {key})"""


@query(f"with {_C}, {_scored_sql('ch', 'chunk_id')} select chunk_id, source_file, score, left(text, 400) as snippet from sc join ch using (chunk_id) where score > 0 order by score desc, chunk_id limit 20")
def chunk_search(s, d):
    return search.search_chunks(_chunks(s, d), ["chunk_id"], "text", _ASK, 20).select("chunk_id", "source_file", "score", "snippet")


@query(f"with {_C}, {_scored_sql('ch', 'chunk_id')} select chunk_id, source_file, score from sc join ch using (chunk_id) where score > 0 and source_type = 'datasheet' and contains(lower(source_file), 'hqq3964') order by score desc, chunk_id limit 12")
def chunk_search_of_part(s, d):
    return search.search_chunks(_chunks(s, d), ["chunk_id"], "text", _ASK, 12, source_type="datasheet", part_number="HQQ3964").select("chunk_id", "source_file", "score")


@query(f"with {_C}, {_scored_sql('ch', 'chunk_id')}, r as (select source_type, chunk_id, score, row_number() over (partition by source_type order by score desc, chunk_id) as rank from sc join ch using (chunk_id) where score > 0.05) select * from r where rank <= case when source_type = 'datasheet' then 8 else 4 end")
def chunk_search_by_type(s, d):
    got = search.scored(_chunks(s, d).select("chunk_id", "source_type", "text"), "text", _ASK).withColumn("score", F.round("score", 6)).filter("score > 0.05").select("source_type", "chunk_id", "score")
    return search.top_by(got, ["source_type"], "score", ["chunk_id"], F.when(F.col("source_type") == "datasheet", 8).otherwise(4))


@query("with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_dot_product(embedding::double[], e::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[]))), 6) as cos from embeddings, q")
def cosine_embeddings(s, d):
    df = table(s, d, "embeddings", "vec_id", "embedding").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    q = df.filter("vec_id = 0").select("v").scalar()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    df = df.withColumn("q", q)
    return df.select("vec_id", F.round(dot("v", "q") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q"))), 6).alias("cos"))


_CBLOB = "lower(concat_ws(' ', refdes, coalesce(part_number, ''), coalesce(manufacturer, ''), coalesce(value, ''), coalesce(footprint, ''), coalesce(specification, ''), array_to_string(coalesce(datasheet_candidates, []), ' ')))"


@query(f"""with {_P}, b as (select board_id, refdes, {_kind("refdes", _TYPE)} as component_type, {_CBLOB} as blob from pt), c as (select board_id, refdes, component_type, round((case when lower(refdes) = 'u1 power' then 4.0 else 0.0 end) + (case when contains(blob, 'u1 power') then 2.0 else 0.0 end) + (case when contains(blob, 'power') then 0.3 else 0.0 end) + (case when contains(blob, 'u1') then 0.3 else 0.0 end), 3) as score from b)
select * from c where score > 0""")
def component_search(s, d):
    return search.search_components(_parts(s, d), "U1 power").select("board_id", "refdes", "component_type", "score")


@query(f"""with {_N}, h as (select net_id, net_name_canonical, case when net_name_canonical = 'SWD' then 4.0 when len(list_filter(list_concat(coalesce(aliases, []), [coalesce(net_name_raw, '')]), lambda a: {_CANON.format("a")} = 'SWD')) > 0 then 3.0 when contains(net_name_canonical, 'SWD') or contains('SWD', net_name_canonical) then 2.0 else 0 end as score from n)
select net_id, net_name_canonical, score, case score when 4.0 then 'exact_canonical' when 3.0 then 'exact_alias' else 'partial_match' end as match_reason from h where score > 0""")
def net_search(s, d):
    return search.search_nets(_nets(s, d), "swd").select("net_id", "net_name_canonical", "score", "match_reason")


@query(f"with {_F} select pinfn_id, 1.0 as score from fn where contains(lower(concat_ws(' ', coalesce(pin_name, ''), coalesce(description, ''), coalesce(function, ''), coalesce(raw_row, ''), coalesce(part_number, ''))), 'supply input')")
def pin_function_search(s, d):
    return search.search_pin_functions(_functions(s, d), "Supply input").select("pinfn_id", "score")


@query(f"""with {_C}, sch as (select source_file, page_start as page_number, upper(coalesce(text, '')) as t, coalesce(text, '') as raw from ch where source_type = 'schematic'),
np as (select distinct source_file, page_number, x as net_name from sch, (select unnest(['SWDIO', 'RESET']) as x) where contains(t, x)),
a as (select source_file, page_number, 2.5 as w from np union all
  select source_file, page_number, 1.2 + 0.2 * least(k, 6) from (select source_file, page_number, contains(t, 'SWDIO')::int + contains(t, 'RESET')::int + contains(t, 'CODEC')::int as k from sch) where k > 0 union all
  select source_file, page_number, 1.5 from sch group by source_file, page_number having bool_or(len(list_filter(({_TOKENS.format("raw")})[1:300], lambda x: regexp_matches(upper(x), '^(SWD|JTAG)'))) > 0))
select source_file, page_number, round(sum(w) - case when page_number = 1 then 0.4 else 0 end, 4) as score from a group by 1, 2""")
def page_ranking(s, d):
    chunks = _chunks(s, d).filter("source_type = 'schematic'").withColumn("page_number", F.col("page_start"))
    page = ["source_file", "page_number"]
    on = knowledge.pages_of(["SWDIO", "RESET"], "net_name", chunks, page, "text")
    tagged = knowledge.sheet_semantics(_chunks(s, d)).filter("debug").withColumns({"w": F.lit(1.5), "why": F.lit("sheet_tag:debug")})
    got = search.rank_pages(on, ["SWDIO", "RESET"], chunks, ["SWDIO", "RESET", "CODEC"], tagged, chunks.filter("page_number = 1"), page)
    return got.select(*page, "score")


@query(f"""with {_C}, {_scored_sql('ch', 'chunk_id')}, top as (select source_file, page_start from sc join ch using (chunk_id) where score > 0 and source_type = 'schematic' order by score desc, chunk_id limit 8) select distinct source_file, page_start as page_number, 'query' as reasons from top""")
def schematic_pages(s, d):
    got = search.search_chunks(_chunks(s, d), ["chunk_id"], "text", _ASK, 8, source_type="schematic")
    return got.select("source_file", F.col("page_start").alias("page_number"), F.lit("query").alias("reasons")).distinct()


@query(f"""with {_N}, o as (select board_id, net_name_canonical, min((net_ord, net_id)) as o, arg_max(coalesce(len(pins_raw), 0), (net_ord, net_id)) as pins from n group by 1, 2),
w as (select board_id, net_name_canonical from n where net_name_canonical in ('GND', 'SWDIO') union select board_id, net_name_canonical from n where len(list_filter(pins_raw, lambda t: starts_with(upper(t), 'U1-'))) > 0),
ask as (select o.* from o semi join w using (board_id, net_name_canonical)), have as (select board_id, count(*) as c from w group by 1),
more as (select o.*, row_number() over (partition by o.board_id order by o, net_name_canonical) as rank from o anti join w using (board_id, net_name_canonical) where {_or("net_name_canonical", search.BREADTH)})
select board_id, net_name_canonical, pins, true as asked, round(2.0 + least(1.5, 0.05 * pins), 4) as score from ask union all select more.board_id, net_name_canonical, pins, false, round(2.0 + least(1.5, 0.05 * pins), 4) from more left join have on have.board_id = more.board_id where rank <= 14 - coalesce(c, 0)""")
def net_evidence(s, d):
    nets = _nets(s, d)
    asked = nets.filter(F.col("net_name_canonical").isin("GND", "SWDIO"))
    return search.seed_nets(nets, asked, breadth=True, refs=["U1"]).withColumn("pins", F.col("pins").cast("long"))


@query(f"""with {_N}, {_P}, {_MEMBERS}, bb as (select board_id, block from (select board_id from n union select board_id from pt), (select unnest(['power_path', 'compute_control', 'io_debug']) as block)),
ov as (select board_id, block, count(distinct (kind, upper(member))) as k from bm where (kind = 'component' and upper(member) in ('U1', 'J1')) or (kind = 'net' and upper(member) = 'VBAT') group by 1, 2),
r as (select bb.board_id, bb.block, coalesce(k, 0) as overlap, 1.0 + coalesce(k, 0) + 0.6 as score, row_number() over (partition by bb.board_id order by coalesce(k, 0) desc, bb.block) as rank from bb left join ov on ov.board_id = bb.board_id and ov.block = bb.block)
select board_id, block, overlap, score from r where rank <= 6""")
def block_evidence(s, d):
    nets, parts = _nets(s, d), _parts(s, d)
    return search.block_evidence(knowledge.block_members(nets, parts), knowledge.blocks_of(nets, parts), ["U1", "J1"], ["VBAT"], breadth=True)


@query(f"""with {_N}, {_P}, {_MEMBERS} select board_id, block, count(distinct (kind, upper(member))) as overlap, 1.0 + count(distinct (kind, upper(member))) as score from bm where (kind = 'component' and upper(member) in ('U1', 'J1')) or (kind = 'net' and upper(member) = 'VBAT') group by 1, 2""")
def block_evidence_of_entities(s, d):
    nets, parts = _nets(s, d), _parts(s, d)
    return search.block_evidence(knowledge.block_members(nets, parts), knowledge.blocks_of(nets, parts), ["U1", "J1"], ["VBAT"], breadth=False)


@query(f"""with {_N}, {_I}, {_ANOMALIES}, m as (select board_id, anomaly_id, n, case when coalesce(upper(refdes) = 'U1', false) or coalesce(upper(net_name) = 'VBAT', false) then 2.1 else 1.1 end as score from an),
r as (select *, row_number() over (partition by board_id order by score desc, anomaly_id, n) as rank from m) select board_id, anomaly_id, n, score from r where rank <= 12""")
def anomaly_evidence(s, d):
    got = search.anomaly_evidence(knowledge.anomalies(_index(s, d), _nets(s, d)), ["U1"], ["VBAT"], aggressive=True)
    return got.withColumn("n", F.col("n").cast("long"))


@query(f"""with {_N}, {_I}, {_ANOMALIES}, r as (select *, row_number() over (partition by board_id order by anomaly_id, n) as rank from an where upper(refdes) = 'U1' or upper(net_name) = 'VBAT') select board_id, anomaly_id, n, 2.1 as score from r where rank <= 6""")
def anomaly_evidence_of_entities(s, d):
    got = search.anomaly_evidence(knowledge.anomalies(_index(s, d), _nets(s, d)), ["U1"], ["VBAT"], aggressive=False)
    return got.withColumn("n", F.col("n").cast("long"))


@query(f"with {_P} select board_id, refdes, part_number, 2.0 as score from pt where refdes in ('U1', 'J1', 'R1')")
def component_evidence(s, d):
    return search.component_evidence(_parts(s, d), ["U1", "J1", "R1"]).select("board_id", "refdes", "part_number", "score")


@query(f"""with {_C}, {_P}, {_scored_sql('ch', 'chunk_id')}, f as (select distinct unnest(datasheet_candidates) as source_file from pt where refdes = 'U1'),
k as (select source_type, chunk_id, score from sc join ch using (chunk_id) where score > 0.05 and (source_type = 'schematic' or (source_type = 'datasheet' and ((select count(*) from f where source_file is not null) = 0 or source_file in (select source_file from f)))))
select source_type, chunk_id, score, rank from (select *, row_number() over (partition by source_type order by score desc, chunk_id) as rank from k) where rank <= case when source_type = 'datasheet' then 8 else 4 end""")
def pdf_evidence(s, d):
    files = _parts(s, d).filter("refdes = 'U1'").select(F.explode("datasheet_candidates").alias("source_file"))
    return search.pdf_evidence(_chunks(s, d), ["chunk_id"], "text", _ASK, files)


@query(f"""with {_NP}, {_P}, {_MEMBERS}, e as (select board_id, upper(refdes) as term from np where contains(token, '-') union select board_id, upper(net_name_canonical) from n union select board_id, upper(member) from bm) select distinct board_id, term from e where term <> ''""")
def referenced_terms(s, d):
    """Of the evidence rows that members of nets and blocks make."""
    pins = _pins(s, d)
    of_nets = connect.net_members(pins).select("board_id", F.to_json(F.struct("net_name_canonical", F.struct(F.create_map("refdes", "pins").alias("component_to_pins")).alias("members"))).alias("data"))
    bare = _nets(s, d).select("board_id", F.to_json(F.struct("net_name_canonical")).alias("data"))
    m = knowledge.block_members(_nets(s, d), _parts(s, d))
    of_blocks = m.select("board_id", F.to_json(F.struct(F.when(F.col("kind") == "component", F.array("member")).alias("component_refs"), F.when(F.col("kind") == "net", F.array("member")).alias("nets"))).alias("data"))
    return search.referenced_terms(of_nets.unionByName(bare).unionByName(of_blocks), ["board_id"], "data")


_HOW = "How does U1 communicate with J1 over VBAT?"


@query(f"""with {_NP}, {_I}, {_P}, {_C}, {_MEMBERS}, {_ANOMALIES}, {_scored_sql('ch', 'chunk_id', _HOW)},
o as (select board_id, net_name_canonical, min((net_ord, net_id)) as o, arg_max(coalesce(len(pins_raw), 0), (net_ord, net_id)) as pins from n group by 1, 2),
wn as (select board_id, net_name_canonical from n where net_name_canonical = 'VBAT' union select board_id, net_name_canonical from n where len(list_filter(pins_raw, lambda t: starts_with(upper(t), 'U1-') or starts_with(upper(t), 'J1-'))) > 0),
have as (select board_id, count(*) as c from wn group by 1), more as (select o.*, row_number() over (partition by o.board_id order by o, net_name_canonical) as rank from o anti join wn using (board_id, net_name_canonical) where {_or("net_name_canonical", search.BREADTH)}),
ov as (select board_id, block, count(distinct (kind, upper(member))) as k from bm where (kind = 'component' and upper(member) in ('U1', 'J1')) or (kind = 'net' and upper(member) = 'VBAT') group by 1, 2),
bb as (select board_id, block from (select board_id from n union select board_id from pt), (select unnest(['power_path', 'compute_control', 'io_debug']) as block)),
ar as (select board_id, anomaly_id, row_number() over (partition by board_id order by anomaly_id, n) as rank from an where upper(refdes) in ('U1', 'J1') or upper(net_name) = 'VBAT'),
f as (select distinct unnest(datasheet_candidates) as source_file from pt where refdes in ('U1', 'J1')),
k as (select source_type, chunk_id, score, row_number() over (partition by source_type order by score desc, chunk_id) as rank from sc join ch using (chunk_id) where score > 0.05 and (source_type = 'schematic' or (source_type = 'datasheet' and ((select count(*) from f where source_file is not null) = 0 or source_file in (select source_file from f)))))
select board_id, kind, source_id, round(score, 6) as score from (select board_id, 'net' as kind, net_name_canonical as source_id, round(2.0 + least(1.5, 0.05 * pins), 4) as score from o semi join wn using (board_id, net_name_canonical)
union all select more.board_id, 'net', net_name_canonical, round(2.0 + least(1.5, 0.05 * pins), 4) from more left join have on have.board_id = more.board_id where rank <= 14 - coalesce(c, 0)
union all select board_id, 'component', refdes, 2.0 from pt where refdes in ('U1', 'J1')
union all select bb.board_id, 'function_block', bb.block, 1.6 + coalesce(k, 0) from bb left join ov on ov.board_id = bb.board_id and ov.block = bb.block
union all select board_id, 'anomaly', anomaly_id, 2.1 from ar where rank <= 6
union all select null, source_type, chunk_id, score from k where rank <= case when source_type = 'datasheet' then 8 else 4 end)""")
def retrieval(s, d):
    """Evidence of all kinds for one question, on every board."""
    nets, parts = _nets(s, d), _parts(s, d)
    got = search.retrieve(nets, parts, knowledge.block_members(nets, parts), knowledge.blocks_of(nets, parts), knowledge.anomalies(_index(s, d), nets), _chunks(s, d), _HOW, ["U1", "J1"], ["VBAT"], "relationship_trace")
    return got.withColumn("score", F.round("score", 6))


# --- questions, obligations, coverage -----------------------------------------------------------------------------------

_INTENT = "case " + " ".join(f"when {_or('lower(text)', terms)} then '{name}'" for name, terms in T.INTENTS.items()) + " else 'system_function' end"
_REFS = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{1,4}[0-9]{1,3}')), lambda x: upper(x))))"


@query(f"select doc_id, {_INTENT} as intent from documents where text is not null")
def intents(s, d):
    return _documents(s, d).select("doc_id", T.classify_intent(F.col("text")).alias("intent"))


@query(f"select doc_id, case when {_or('lower(text)', T.UNRELATED)} then 'irrelevant_general' when {_or('lower(text)', T.PRECISION)} then 'precision' else 'relevant_general' end as route, case when {_or('lower(text)', T.UNRELATED)} then 'high' else 'medium' end as confidence from documents where text is not null")
def routes(s, d):
    return _documents(s, d).select("doc_id", T.classify_route(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"select doc_id, array_to_string({_REFS}, ',') as refs from documents where text is not null")
def explicit_refs(s, d):
    return _documents(s, d).select("doc_id", F.array_join(T.explicit_refs(F.col("text")), ",").alias("refs"))


@query(f"""select doc_id, {_INTENT} as intent, len({_REFS}) as components, case {_INTENT} """ + " ".join(f"when '{k}' then {len(v)}" for k, v in evidence.RELATIONS.items()) + f""" end as relations, case when {_INTENT} in ('protocol_debug_validation', 'pin_validation') then 'exact' else 'high' end as minimum_confidence,
case when {_INTENT} in ('protocol_debug_validation', 'system_function') then 2 else 0 end as negative_checks, 'DSN,schematic,datasheet,BOM,inference' as sources, case {_INTENT} when 'protocol_debug_validation' then '1V8,GND,RESET,SWDCLK,SWDIO' else '' end as nets from documents where text is not null""")
def obligations(s, d):
    got = _documents(s, d).select("doc_id", evidence.obligations(F.col("text")).alias("o"))
    return got.select("doc_id", "o.intent", F.size("o.components").cast("long").alias("components"), F.size("o.relations").alias("relations"), "o.minimum_confidence", F.size("o.negative_checks").alias("negative_checks"), F.array_join("o.acceptable_sources", ",").alias("sources"), F.array_join("o.nets", ",").alias("nets"))


@query(f"""with {_N}, {_I}, b as (select board_id, list_distinct(list(net_name_canonical)) as found from n group by 1), m as (select board_id, list_filter(['1V8', 'GND', 'RESET', 'SWDCLK', 'SWDIO'], lambda x: not list_contains(found, x)) as mn, list_concat(list_filter(['SWDIO', 'SWDCLK', 'RESET', 'GND'], lambda x: not list_contains(found, x)), case when len(list_filter(found, lambda x: starts_with(x, '1V8') or starts_with(x, 'VDD'))) = 0 then ['p'] else [] end) as mr from b)
select board_id, array_to_string(mn, ',') as missing_nets, len(mr) as missing_relations, round(greatest(0.0, 1.0 - (len(mn) + len(mr)) / 10.0), 4) as coverage_score, len(mn) + len(mr) = 0 as coverage_satisfied from m""")
def coverage(s, d):
    """Whether each board has what a debug question must prove."""
    none = F.array().cast("array<string>")
    found = evidence.debug_nets_found(_nets(s, d))
    need = F.array(*map(F.lit, evidence.DEBUG_NETS))
    relations = F.array(*(F.lit("/".join(r)) for r in evidence.RELATIONS["protocol_debug_validation"]))
    got = evidence.coverage(found.select("board_id", F.lit("protocol_debug_validation").alias("intent"), none.alias("components"), need.alias("nets"), relations.alias("relations"), none.alias("found_components"), "found_nets", F.col("found_nets").alias("net_evidence"), none.alias("evidence_types")))
    return got.select("board_id", F.array_join("missing_nets", ",").alias("missing_nets"), F.size("missing_relations").cast("long").alias("missing_relations"), "coverage_score", "coverage_satisfied")


@query(f"""with {_NP}, {_I}, {_P}, {_MEMBERS}, {_ANOMALIES}, e as (select distinct board_id, anomaly_id as item, 'dsn' as sp, null as cf from an union select board_id, 'block:' || block || ':' || member, ' Schematic', null from bm union select board_id, 'part:' || refdes, 'bom', 'sure' from pt union select board_id, 'net:' || net_name_canonical, 'guess', null from n),
r as (select *, row_number() over (partition by board_id order by item, sp) as k from e)
select board_id, item, printf('ev_%04d', k) as id, case trim(lower(sp)) when 'dsn' then 'DSN' when 'schematic' then 'schematic' when 'bom' then 'BOM' else 'inference' end as source_priority, coalesce(cf, case trim(lower(sp)) when 'dsn' then 'exact' when 'schematic' then 'high' when 'bom' then 'medium' else 'low' end) as confidence,
row_number() over (partition by board_id order by case trim(lower(sp)) when 'dsn' then 1 when 'schematic' then 2 when 'bom' then 4 else 5 end, k) as place from r where k <= 400""")
def evidence_order(s, d):
    """Evidence of four sources numbered as it comes, then put in order of precedence."""
    nets, parts = _nets(s, d), _parts(s, d)
    kind = lambda df, item, priority, sure=None: df.select("board_id", item.alias("item"), F.lit(priority).alias("source_priority"), F.lit(sure).cast("string").alias("confidence"))
    rows = kind(knowledge.anomalies(_index(s, d), nets), F.col("anomaly_id"), "dsn")
    rows = rows.unionByName(kind(knowledge.block_members(nets, parts), F.concat_ws(":", F.lit("block"), "block", "member"), " Schematic"))
    rows = rows.unionByName(kind(parts, F.concat(F.lit("part:"), "refdes"), "bom", "sure")).unionByName(kind(nets, F.concat(F.lit("net:"), "net_name_canonical"), "guess")).distinct()
    got = evidence.normalize(rows, ["item", "source_priority"], ["board_id"])
    return evidence.by_precedence(got, ["board_id"]).select("board_id", "item", "id", "source_priority", "confidence", F.col("place").cast("long").alias("place"))


@query(f"with {_N}, {_I}, {_ANOMALIES} select distinct board_id, upper(severity) || ': ' || kind || ' at ' || coalesce(refdes, nullif(net_name, ''), 'unknown_target') || '.' as finding from an")
def critical_findings(s, d):
    return evidence.findings(knowledge.anomalies(_index(s, d), _nets(s, d)), ["board_id"])


@query(f"""with {_N}, {_I}, {_P}, {_ANOMALIES}, e as (select board_id, net_name, refdes, 0 as b from an union all select board_id, null, null, 1 from (select board_id from n union select board_id from pt), (select unnest([1, 2, 3])))
select board_id, count(distinct net_name) as distinct_nets, count(distinct refdes) as distinct_components, sum(b)::bigint as distinct_blocks from e group by 1""")
def evidence_diversity(s, d):
    none = F.lit(None).cast("string")
    nets, parts = _nets(s, d), _parts(s, d)
    rows = knowledge.anomalies(_index(s, d), nets).select("board_id", F.lit("anomaly").alias("type"), "net_name", "refdes")
    rows = rows.unionByName(knowledge.blocks_of(nets, parts).select("board_id", F.lit("function_block").alias("type"), none.alias("net_name"), none.alias("refdes")))
    return evidence.diversity_by(rows, ["board_id"])


@query(f"""with {_N}, g as (select case when right(board_id, 1) in ('0', '2', '4', '6', '8') then 'even' else 'odd' end as suite, board_id, bool_or(net_name_canonical = 'GND') as passed, bool_or(net_name_canonical = 'SWDIO') as covered, bool_or(net_name_canonical like 'VDD%') as unsure, count(distinct case when net_name_canonical like 'USB%' then net_name_canonical end) as images from n where board_id is not null group by 1, 2),
f as (select suite, count(*) as total, sum(passed::int)::bigint as p, sum(covered::int)::bigint as c, sum((covered and unsure)::int) as u, sum((images > 0)::int) as i from g group by 1)
select suite, total, p as passed_heuristic, total - p as failed_heuristic, c as coverage_passed, total - c as coverage_failed, round(u / total, 4) as false_uncertainty_rate, round(i / total, 4) as image_attachment_precision_proxy from f
union all select 'totals', sum(total)::bigint, sum(p)::bigint, sum(total - p)::bigint, sum(c)::bigint, sum(total - c)::bigint, null, null from f having count(*) > 0""")
def validation_summary(s, d):
    """Figures of two suites of runs (here one of each board) and their totals."""
    name = F.col("net_name_canonical")
    g = _nets(s, d).filter("board_id is not null").groupBy("board_id").agg(F.bool_or(name == "GND").alias("heuristic_pass"), F.bool_or(name == "SWDIO").alias("coverage_satisfied"), F.bool_or(name.startswith("VDD")).alias("uncertain"), F.count_distinct(F.when(name.startswith("USB"), name)).alias("images"))
    suite = F.when(F.right("board_id", F.lit(1)).isin("0", "2", "4", "6", "8"), "even").otherwise("odd")
    return evidence.suites(g.withColumn("suite", suite))


# --- texts --------------------------------------------------------------------------------------------------------------


@query(f"with {_C} select chunk_id, coalesce(nullif(regexp_extract(text, '[A-Za-z0-9_]+\\.SchDoc'), ''), nullif(regexp_extract(text, '--\\s*\\d+\\s+of\\s+\\d+\\s*--'), ''), 'unknown_sheet') as hint from ch")
def sheet_hints(s, d):
    return _chunks(s, d).select("chunk_id", T.sheet_hint(F.col("text")).alias("hint"))


@query(f"""with {_C}, l as (select chunk_id, text, string_split(text, chr(10)) as ls, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from ch where text is not null), s as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as h from l)
select chunk_id, line_no, h as heading, case when line_no = 0 then 0 else length(array_to_string(ls[1:line_no], chr(10))) + 1 end as "offset" from s where length(h) between 3 and 80 and ((upper(h) = h and lower(h) <> h) or regexp_matches(h, '^\\d+(\\.\\d+)*\\s+[A-Za-z]') or regexp_matches(lower(h), '^(table|figure|section) '))""")
def heading_lines(s, d):
    got = texts.heading_lines(_chunks(s, d).filter("text is not null"), ["chunk_id"], "text")
    return got.select("chunk_id", *(F.col(c).cast("long").alias(c) for c in ("line_no", "offset")), "heading")


@query(f"""with {_C}, b as (select chunk_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from ch where text is not null), w as (select chunk_id, t, unnest(generate_series(0, length(t) - 1, 750)) as start from b where t <> '')
select chunk_id, start // 750 as window_no, start, substring(t, start + 1, 1000) as window_text from w""")
def text_windows(s, d):
    got = texts.windows(_chunks(s, d), ["chunk_id"], "text", size=1000)
    return got.withColumns({"window_no": F.col("window_no").cast("long"), "start": F.col("start").cast("long")})


_CELLS = "list_filter(list_transform(string_split(line, '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '')"


@query(f"""with {_F}, l as (select pinfn_id, unnest(string_split(raw_row, chr(10))) as line, generate_subscripts(string_split(raw_row, chr(10)), 1) - 1 as line_no from fn where raw_row is not null), c as (select pinfn_id, line_no, {_CELLS} as cells from l where contains(line, '|'))
select pinfn_id, line_no, cells[1] as pin_name, cells[2] as description, coalesce(cells[3], cells[2]) as function, array_to_string(cells, ' | ') as raw_row from c where len(cells) >= 2 and len(list_filter(cells, lambda x: contains(lower(x), 'pin'))) = 0 and regexp_matches(cells[1], '[A-Za-z0-9]')""")
def pin_table_rows(s, d):
    rows = _functions(s, d).select("pinfn_id", F.col("raw_row").alias("t")).filter("t is not null")
    return texts.pin_table_rows(rows, ["pinfn_id"], "t").withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""with {_C}, l as (select chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: not starts_with(x, '#') and not starts_with(x, '|') and length(x) >= 20) as l from ch where text is not null) select chunk_id, coalesce(left(l[1], 400), '') as part_description from l""")
def first_descriptions(s, d):
    return _chunks(s, d).filter("text is not null").select("chunk_id", texts.first_description("text").alias("part_description"))


_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"""with recursive t as (select doc_id, {_strip("text")} as t from documents where text is not null),
l as (select doc_id, t, regexp_split_to_array(t, '{_ENDS}') as l from t where t <> ''),
h as (select doc_id, t, list_append(list_filter(list_transform(generate_series(1, len(l)), lambda k: case when length({_strip("l[k]")}) between 3 and 80 and ((upper({_strip("l[k]")}) = {_strip("l[k]")} and lower({_strip("l[k]")}) <> {_strip("l[k]")}) or regexp_matches({_strip("l[k]")}, '^([0-9]+([.][0-9]+)*\\s+[A-Za-z]|(?i:table|figure|section) )'))
  then coalesce(list_sum(list_transform(l[1:k-1], lambda x: length(x) + 1)), 0)::bigint end), lambda x: x is not null), length(t)) as b from l),
r as (select doc_id, 0::bigint as a, coalesce(list_max(list_filter(b, lambda x: x > 0 and x <= 1800)), 1800) as e from h
  union all select q.doc_id, q.a, coalesce(list_max(list_filter(b, lambda x: x > q.a and x <= q.a + 1800)), q.a + 1800) from (select r.doc_id, case when e - 250 <= a then e else e - 250 end as a from r join h using (doc_id) where e < length(t)) q join h using (doc_id)),
c as (select doc_id, a, {_strip("substring(t, a + 1, e - a)")} as c from r join h using (doc_id))
select doc_id, row_number() over (partition by doc_id order by a) as chunk_no, length(c) as size, md5(c) as digest from c where c <> ''""")
def page_chunks(s, d):
    """The greedy heading-aware chunker over whole documents."""
    return texts.chunk_pages(_documents(s, d).select("doc_id", "text"), ["doc_id"], "text").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk_text").cast("long").alias("size"), F.md5("chunk_text").alias("digest"))


@query(f"""with {_C}, p as (select source_file, chunk_id, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') as t from ch where source_file is not null)
select source_file, chunk_id, md5('## Page ' || chunk_id || chr(10) || chr(10) || case when t = '' then '_No extractable text on this page._' else t end) as digest from p""")
def datasheet_markdown(s, d):
    got = texts.markdown_pages(_chunks(s, d).filter("source_file is not null"), ["source_file"], "chunk_id", "text")
    return got.select("source_file", "chunk_id", F.md5("markdown").alias("digest"))


# --- lines, desk --------------------------------------------------------------------------------------------------------


@query("with b as (select distinct on (line_id) * from bom_lines), l as (select line_id, list_filter(list_transform(string_split(designator, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ds from b where designator is not null) select line_id, unnest(ds) as designator from l")
def designator_cells(s, d):
    lines = table_once(s, d, "bom_lines", "line_id", "designator")
    return lines.select("line_id", F.explode(split_designators(F.col("designator"))).alias("designator"))


@query("""with ci as (select distinct on (entry_id) * from component_index) select board_id, entry_id as line_ord, '| ' || concat_ws(' | ', array_to_string(designators, ', '), coalesce(quantity, ''), coalesce(value, ''), coalesce(manufacturer, ''), coalesce(part_number, ''), coalesce(footprint, '')) || ' |' as row from ci
union all select board_id, k, r from (select distinct board_id from ci), (values (-4, '# Bill of Materials Overview'), (-3, ''), (-2, '| Designators | Quantity | Value | Manufacturer | Part Number | Footprint |'), (-1, '| --- | --- | --- | --- | --- | --- |')) h(k, r)""")
def bom_overview(s, d):
    lines = table_once(s, d, "component_index", "entry_id", "board_id", "designators", "quantity", "value", "manufacturer", "part_number", "footprint")
    return sinks.bom_overview(lines.withColumnRenamed("entry_id", "line_ord"))


@query(f"""with {_N}, {_P}, {_MEMBERS}, b as ({_BUS}), bb as (select board_id, block from (select board_id from n union select board_id from pt), (select unnest(['power_path', 'compute_control', 'io_debug']) as block)),
f as (select bb.board_id, bb.block, coalesce(string_agg(case when kind = 'component' then member end, ', ' order by member), 'none') as c, coalesce(string_agg(case when kind = 'net' then member end, ', ' order by member), 'none') as m from bb left join bm on bb.board_id = bm.board_id and bb.block = bm.block group by 1, 2)
select board_id, 1 as section, '- ' || block || ': components ' || c || '; nets ' || m as line from f
union all select board_id, 2, '- ' || net_name_canonical || ' (' || case when net_name_canonical = 'GND' then 'ground' else 'supply' end || ', pins ' || coalesce(len(pins_raw), 0) || ')' from n where {_POWER}
union all select board_id, 3, '- ' || bus_type || ': ' || string_agg(net_name, ', ' order by net_name) from b group by board_id, bus_type
union all select distinct board_id, 2, 'No power domains detected.' from bb where board_id not in (select board_id from n where {_POWER}) union all select distinct board_id, 3, 'No interface buses detected.' from bb where board_id not in (select board_id from b)""")
def circuit_summary(s, d):
    nets = _nets(s, d)
    return sinks.circuit_summary(knowledge.function_blocks(nets, _parts(s, d)), knowledge.power_domains(nets), knowledge.interface_buses(nets))


@query("with b as (select distinct on (line_id) line_id, part_number from bom_lines), k as (select *, regexp_replace(lower(part_number), '[^a-z0-9]', '', 'g') as part_key from b) select part_key, arg_min(part_number, line_id) as part_number, min(line_id) as line_id from k where part_key <> '' group by 1")
def first_parts(s, d):
    return desk.first_parts(table_once(s, d, "bom_lines", "line_id", "part_number"), "part_number", ["line_id"]).select("part_key", "part_number", "line_id")


@query(f"with {_P} select board_id, refdes, case when regexp_matches(refdes, '^(R|C|L|FB|RT)\\d+') then 'Passives' when regexp_matches(refdes, '^U\\d+') then 'ICs' else 'Other' end as part_group, {_CLS} as component_class from pt where part_number is null or trim(part_number) = ''")
def unmatched_parts(s, d):
    lost = _parts(s, d).filter("part_number is null or trim(part_number) = ''")
    return desk.unmatched_groups(lost, "refdes", "part_number").select("board_id", "refdes", "part_group", T.component_class(F.col("refdes")).alias("component_class"))


@query("""with m as (select user_id, event_id, case when event_type = 'view' then 'user' when event_type = 'click' then 'assistant' else 'other' end as role, event_type || ' ' || props as text from events)
select user_id, concat_ws(' -> ', arg_min(text, event_id) filter (role = 'user'), arg_max(case when length(text) > 120 then left(text, 117) || '...' else text end, event_id) filter (role = 'assistant')) as summary from m group by 1""")
def conversation_summaries(s, d):
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").otherwise("other")
    m = table(s, d, "events").select("user_id", "event_id", role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return desk.conversation_summary(m, "user_id", "event_id", "role", "text")


@query("select user_id, max(ts) as updated_at from events where user_id <> 1 group by 1 order by updated_at desc, user_id limit 3")
def carry_over(s, d):
    return desk.carry_over(table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at")), 1, "user_id", "updated_at")


@query("select part_id, part_number from part_ref where part_id not in (select part_id from part_ref where withdrawn_at is not null) union all select part_id, lower(part_number) from part_ref where withdrawn_at is not null")
def upserted_parts(s, d):
    ref = table(s, d, "part_ref", "part_id", "part_number", "withdrawn_at")
    return desk.upsert(ref.select("part_id", "part_number"), ref.filter("withdrawn_at is not null").select("part_id", F.lower("part_number").alias("part_number")), ["part_id"])


@query(f"with q as (select created_at, {_INTENT} as intent from documents where text is not null and created_at is not null) select time_bucket(interval 5 minutes, created_at) as start, intent, count(*) as n from q group by 1, 2")
def intents_by_window(s, d):
    """The stream's rules on a batch."""
    return questions.intents_by_window(table(s, d, "documents", "text", "created_at").filter("text is not null and created_at is not null"), "created_at", "text")
