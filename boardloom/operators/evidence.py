"""Evidence: obligations of a question, coverage, precedence, findings, packets and prompts; and the deterministic plan."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions import text as T

HARD_CAP = 400
# The line that system questions get, and the nets of a debug header.
SYSTEM_LINE = "System-function conclusion is based on multi-artifact functional + connectivity coverage."
DEBUG_NETS = ["SWDIO", "SWDCLK", "RESET", "GND", "1V8"]
# Relations that an intent must prove, as (type, subject, object).
RELATIONS = {
    "protocol_debug_validation": [("maps_to_header", "SWDIO", "debug_header"), ("maps_to_header", "SWDCLK", "debug_header"), ("maps_to_header", "RESET", "debug_header"), ("power_reference_present", "debug_header", "1V8"), ("ground_reference_present", "debug_header", "GND")],
    "pin_validation": [("pin_to_net_validation", "target_pin", "expected_net")],
    "anomaly_check": [("anomaly_presence_check", "target_scope", "known_anomalies")],
    "net_trace": [("trace_path", "seed_nets_or_pins", "neighboring_graph")],
    "relationship_trace": [("cross_block_connectivity", "block_a", "block_b")],
    "system_function": [("block_presence", "power", "compute_or_io"), ("inter_block_path", "control", "peripheral_or_connector")],
}


# What an intent must not conclude, and the sources that count for every intent.
NEGATIVE_CHECKS = {
    "protocol_debug_validation": ["if required protocol nets are not confirmed in DSN, classify as unresolved_not_missing", "do not claim missing VTREF/GND without explicit DSN search for header pins"],
    "system_function": ["do not finalize with single-net-dominated evidence", "must include at least one power-domain and one io/debug trace"],
}
SOURCES = ["DSN", "schematic", "datasheet", "BOM", "inference"]


def obligations(question: Column, linked_refs: Column | None = None, linked_nets: Column | None = None) -> Column:
    """struct(intent, components, nets, relations, minimum_confidence, acceptable_sources, negative_checks) of a question."""
    none = F.array().cast("array<string>")
    intent = T.classify_intent(question)
    refs = F.array_sort(F.array_distinct(F.concat(T.explicit_refs(question), F.coalesce(linked_refs, none) if linked_refs is not None else none)))
    nets = F.coalesce(linked_nets, none) if linked_nets is not None else none
    nets = F.array_sort(F.array_distinct(F.when(intent == "protocol_debug_validation", F.concat(nets, F.array(*map(F.lit, DEBUG_NETS)))).otherwise(nets)))
    relations = F
    for name, rows in RELATIONS.items():
        relations = relations.when(intent == name, F.array(*(F.lit("/".join(r)) for r in rows)))
    checks = F
    for name, rows in NEGATIVE_CHECKS.items():
        checks = checks.when(intent == name, F.array(*map(F.lit, rows)))
    checks = checks.otherwise(none)
    return F.struct(intent.alias("intent"), refs.alias("components"), nets.alias("nets"), relations.alias("relations"), F.when(intent.isin("protocol_debug_validation", "pin_validation"), "exact").otherwise("high").alias("minimum_confidence"), F.array(*map(F.lit, SOURCES)).alias("acceptable_sources"), checks.alias("negative_checks"))


def coverage(df: DataFrame) -> DataFrame:
    """Adds missing_components, missing_nets, missing_relations, coverage_score, coverage_satisfied.

    df: intent, components, nets, relations (arrays of what is required), found_components, found_nets, net_evidence (names
    of nets with evidence of their own), evidence_types."""
    up = lambda c: F.transform(c, F.upper)
    df = df.withColumn("missing_components", F.array_sort(F.array_except(up("components"), up("found_components")))).withColumn("missing_nets", F.array_sort(F.array_except(up("nets"), up("found_nets"))))
    seen = up("net_evidence")
    debug = [F.when(~F.array_contains(seen, n), f"required_debug_net_not_evidenced:{n}") for n in DEBUG_NETS[:4]]
    debug.append(F.when(~F.exists(seen, lambda n: n.startswith("1V8") | n.startswith("VDD")), "required_debug_power_reference_not_evidenced"))
    system = [F.when(~F.array_contains("evidence_types", "function_block"), "missing_function_block_evidence"), F.when(F.size(F.array_distinct(up("found_nets"))) < 5, "insufficient_net_diversity")]
    none = F.array().cast("array<string>")
    df = df.withColumn("missing_relations", F.when(F.col("intent") == "protocol_debug_validation", F.array_compact(F.array(*debug))).when(F.col("intent") == "system_function", F.array_compact(F.array(*system))).otherwise(none))
    total = F.size(F.array_distinct(up("components"))) + F.size(F.array_distinct(up("nets"))) + F.size("relations")
    lost = F.size("missing_components") + F.size("missing_nets") + F.size("missing_relations")
    return df.withColumn("coverage_score", F.round(F.when(total > 0, F.greatest(F.lit(0.0), 1.0 - lost / total)).otherwise(1.0), 4)).withColumn("coverage_satisfied", lost == 0)


def debug_nets_found(nets: DataFrame) -> DataFrame:
    """(board_id, found_nets): of the nets that a debug question asks for those a board has, every supply as one of its kind; at
    most seven a board, whatever its size."""
    name = F.col("net_name_canonical")
    told = F.when(name.isin(*DEBUG_NETS), name).when(name.startswith("1V8"), "1V8_").when(name.startswith("VDD"), "VDD")
    return nets.groupBy("board_id").agg(F.collect_set(told).alias("found_nets"))


def normalize(rows: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Evidence with ids by place (before sorting), known priorities and confidence; the first HARD_CAP rows, or those of each group."""
    if group:
        # ranked within salted parts first, so that no group is ranked whole by one task
        salted = rows.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64)))
        rows = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_s").orderBy(*order))).filter(F.col("_n") <= HARD_CAP).drop("_n", "_s")
    else:
        rows = rows.orderBy(*order).limit(HARD_CAP)
    df = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order))).filter(F.col("_n") <= HARD_CAP)
    df = df.withColumn("id", F.format_string("ev_%04d", F.col("_n"))).withColumn("source_priority", T.normal_priority(F.col("source_priority")))
    return df.withColumn("confidence", F.coalesce("confidence", T.default_confidence(F.col("source_priority")))).drop("_n")


def by_precedence(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows in order of precedence, then of id; group: with their `place` from 1 within it (HARD_CAP rows at most, see `normalize`)."""
    order = [T.priority_rank(F.col("source_priority")), F.col("id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))) if group else rows.orderBy(*order)


def suites(runs: DataFrame) -> DataFrame:
    """Figures of each suite of runs (suite, heuristic_pass, coverage_satisfied, uncertain, images), and their totals as one more row."""
    share = lambda n: F.round(n / F.count("*"), 4)
    passed, covered = F.count_if("heuristic_pass"), F.count_if("coverage_satisfied")
    each = runs.groupBy("suite").agg(
        F.count("*").alias("total"), passed.alias("passed_heuristic"), (F.count("*") - passed).alias("failed_heuristic"), covered.alias("coverage_passed"), (F.count("*") - covered).alias("coverage_failed"),
        share(F.count_if(F.col("coverage_satisfied") & F.col("uncertain"))).alias("false_uncertainty_rate"), share(F.count_if(F.col("images") > 0)).alias("image_attachment_precision_proxy"),
    )
    sums = ["total", "passed_heuristic", "failed_heuristic", "coverage_passed", "coverage_failed"]
    none = F.lit(None).cast("double")
    total = each.agg(*(F.sum(c).alias(c) for c in sums)).filter("total is not null").select(F.lit("totals").alias("suite"), *sums, none.alias("false_uncertainty_rate"), none.alias("image_attachment_precision_proxy"))
    return each.unionByName(total)


def findings(anomalies: DataFrame, group: list[str], intent: str = "") -> DataFrame:
    """(group..., finding): one line per distinct anomaly, and one more for system questions."""
    label = F.coalesce(F.nullif(F.col("refdes"), F.lit("")), F.nullif(F.col("net_name"), F.lit("")), F.lit("unknown_target"))
    out = anomalies.select(*group, F.format_string("%s: %s at %s.", F.upper("severity"), F.col("kind"), label).alias("finding")).distinct()
    if intent == "system_function":
        out = out.unionByName(anomalies.select(*group, F.lit(SYSTEM_LINE).alias("finding")).distinct())
    return out


def findings_of(anomalies: list[dict], intent: str) -> list[str]:
    """The same lines of a run's own rows, each once, in order."""
    lines = [f"{str(a.get('severity') or 'medium').upper()}: {a.get('kind') or 'anomaly'} at {a.get('refdes') or a.get('net_name') or 'unknown_target'}." for a in anomalies]
    return list(dict.fromkeys(lines + ([SYSTEM_LINE] if intent == "system_function" else [])))


def packet(question: str, evidence: DataFrame, limit: int = 64, **parts) -> dict:
    """The evidence packet of one question: at most `limit` rows (cut before the sort), in order of precedence."""
    few = [r.asDict(recursive=True) for r in by_precedence(evidence.limit(limit)).limit(limit).collect()]
    keys = ("agent_trace", "resolved_entities", "open_uncertainties", "critical_findings", "obligations", "coverage_report", "missing_obligations", "tool_decision_trace", "image_selection_trace", "recommended_answer_constraints")
    return {"question": question, "evidence_priority": list(T.PRIORITY_ORDER), "evidence": few, "functional_hypotheses": [], "anomaly_findings": [], **{k: parts.get(k) or [] for k in keys}, "intent": parts.get("intent", "system_function"), "evidence_diversity_metrics": diversity(few, parts.get("nets") or (), parts.get("components") or ())}


def diversity(rows: list[dict], nets=(), components=()) -> dict:
    """Different nets and components found, and rows about function blocks."""
    return {"distinct_nets": len(set(nets)), "distinct_components": len(set(components)), "distinct_blocks": sum(r.get("type") == "function_block" for r in rows)}


def diversity_by(rows: DataFrame, group: list[str]) -> DataFrame:
    """The same of each group of rows (type, net_name, refdes)."""
    return rows.groupBy(*group).agg(F.countDistinct("net_name").alias("distinct_nets"), F.countDistinct("refdes").alias("distinct_components"), F.count_if(F.col("type") == "function_block").alias("distinct_blocks"))


def prompt(packet: dict) -> str:
    """The question's instructions and evidence as one text."""
    blocks = [("Critical findings", packet["critical_findings"]), ("Missing obligations", packet["missing_obligations"]), ("Coverage report", packet["coverage_report"])]
    head = ["Review this hardware design using the supplied evidence alone; say so where it is incomplete.", f"Question: {packet['question']}", f"Intent: {packet['intent']}", "Priority of evidence: " + " > ".join(packet["evidence_priority"])]
    for title, rows in blocks:
        if rows:
            head.append(f"{title}: " + (json.dumps(rows, default=str) if isinstance(rows, dict) else "\n".join(f"- {r}" for r in rows)))
    head += ["Answer with verdict, reasoning tied to evidence ids, citations, and what stays uncertain.", "Evidence:", json.dumps(packet["evidence"], default=str, indent=1)]
    return "\n\n".join(head)
