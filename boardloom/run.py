"""The run of a question over a project folder: entities linked, evidence gathered by a fixed plan or by a model's tool calls,
a gate on coverage, a packet; and the other ways to answer: retrieval at one go, general answers, suites of questions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom import api, sinks
from boardloom.catalog import Catalog
from boardloom.functions import text as T
from boardloom.operators import connect, evidence, knowledge, search


@dataclass(frozen=True)
class Limits:
    """How far a run goes."""

    iterations: int = 18
    tool_calls: int = 120
    chunks: int = 16
    pages: int = 4
    items: int = 64


#: Of a suite of questions.
SUITE = Limits(iterations=4, tool_calls=32, chunks=12, pages=4, items=48)
#: How many rows of a tool's result become evidence, and of what kind.
_CAPS = {"search_components": ("component", 8), "search_nets": ("net", 8), "search_pdf_chunks": ("schematic", 12), "search_datasheet_chunks": ("datasheet", 12), "search_pin_functions": ("datasheet", 20), "get_function_blocks": ("function_block", 20), "get_power_domains": ("net", 16), "get_interface_buses": ("net", 20), "get_connectivity_anomalies": ("anomaly", 20), "get_net_members": ("net", 20), "get_component_datasheet_facts": ("datasheet", 1), "get_component": ("component", 1), "get_pin_net": ("pin", 1)}
# What an answer must keep to.
CONSTRAINTS = ["Use evidence IDs for every key claim.", "Do not finalize confident claims with unmet obligations.", "Prefer DSN exact evidence over inferred semantics."]
GATE = [
    {"type": "function", "name": "get_coverage_status", "description": "What of the obligations the evidence so far leaves open.", "parameters": {"type": "object", "properties": {}, "required": [], "additionalProperties": False}},
    {"type": "function", "name": "finalize_evidence", "description": "Ends the run; allowed only when coverage is satisfied.", "parameters": {"type": "object", "properties": {"reason": {"type": "string"}}, "required": [], "additionalProperties": False}},
]


def _one(cat: Catalog, column) -> dict:
    return cat.spark.range(1).select(column.alias("x")).select("x.*").first().asDict(recursive=True)


def link(cat: Catalog, question: str) -> dict[str, list[str]]:
    """Components and nets that the question's words name, by designator and by any spelling of a net; as many as it has words."""
    asked = cat.spark.range(1).select(F.explode(F.array_distinct(T.symbols(F.lit(question)))).alias("s"))
    words = [r["s"] for r in asked.collect()]
    refs = cat.table("refdes_to_part").select(F.upper("refdes").alias("x")).join(asked.select(F.upper("s").alias("x")), "x", "left_semi").distinct()
    nets = connect.alias_lookup(cat.table("nets")).select(F.col("alias").alias("x")).join(asked.select(T.canonical_net_name(F.col("s")).alias("x")), "x", "left_semi").distinct()
    return {"refdes": sorted(r["x"] for r in refs.collect()), "nets": sorted(r["x"] for r in nets.collect()), "symbols": sorted(words)}


@dataclass
class Run:
    """What a question has gathered: evidence rows, tool calls, nets and components found, pages chosen."""

    cat: Catalog
    question: str = ""
    need: dict = field(default_factory=dict)
    log: Path | None = None
    evidence: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)
    nets: set[str] = field(default_factory=set)
    components: set[str] = field(default_factory=set)
    pages: list[int] = field(default_factory=list)
    page_trace: list[dict] = field(default_factory=list)
    finished: str | None = None

    @classmethod
    def of(cls, cat: Catalog, question: str, log: Path | None = None) -> Run:
        """A run with the question's entities linked and its obligations derived."""
        known = link(cat, question)
        some = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
        need = _one(cat, evidence.obligations(F.lit(question), some(known["refdes"]), some(known["nets"])))
        return cls(cat, question, need, log, nets=set(known["nets"]), components=set(known["refdes"]))

    def coverage(self) -> dict:
        """What of the obligations the evidence so far leaves open."""
        seen = sorted({json.loads(r["data"]).get("net_name_canonical") or "" for r in self.evidence if r["type"] == "net"} - {""})
        row = (self.need["intent"], self.need["components"], self.need["nets"], self.need["relations"], sorted(self.components), sorted(self.nets), seen, sorted({r["type"] for r in self.evidence}))
        state = self.cat.spark.createDataFrame([row], "intent string, components array<string>, nets array<string>, relations array<string>, found_components array<string>, found_nets array<string>, net_evidence array<string>, evidence_types array<string>")
        return evidence.coverage(state).first().asDict()

    def finish(self, reason: str = "") -> dict:
        """The gate: a run is finished only when coverage is satisfied."""
        report = self.coverage()
        if not report["coverage_satisfied"]:
            return {"finalize_allowed": False, "reason": "coverage_incomplete", "coverage": report}
        self.finished = reason
        return {"finalize_allowed": True, "coverage": report}

    def terms(self) -> list[str]:
        """What the evidence so far speaks of (`search.referenced_terms`)."""
        if not self.evidence:
            return []
        rows = self.cat.spark.createDataFrame([(r["data"],) for r in self.evidence], "data string").withColumn("k", F.lit(0))
        return sorted(r["term"] for r in search.referenced_terms(rows, ["k"], "data").collect())

    def rank_pages(self, most: int) -> list[dict] | dict:
        """Pages chosen for the obligations and for what the evidence speaks of; pages it holds already weigh less."""
        seen = sorted({p for r in self.evidence if isinstance(p := json.loads(r["data"]).get("page_start"), int)})
        got = self.execute("rank_schematic_images_for_obligations", required_nets=self.need["nets"], required_components=self.need["components"], terms=self.terms(), intent=self.need["intent"], seen_pages=seen, max_results=most)
        if isinstance(got, list):
            self.pages = list(dict.fromkeys(r["page_number"] for r in got))
            self.page_trace.append({"tool_call_id": self.calls[-1]["call_id"], "selected_pages": self.pages, "rationale": got})
        return got

    def execute(self, name: str, **arguments) -> list[dict] | dict:
        """Runs a tool; what it raises comes back as an error. Results are bounded by the tool's cap before they are collected."""
        call = f"call_{len(self.calls) + 1:04d}"
        kind, cap = _CAPS.get(name, ("inference", 20))
        try:
            if name == "get_coverage_status":
                out = self.coverage()
            elif name == "finalize_evidence":
                out = self.finish(str(arguments.get("reason", "")))
            else:
                got = api.TOOLS[name](self.cat, **arguments)
                rows = lambda df: [r.asDict(recursive=True) for r in df.limit(cap).collect()]
                out = rows(got) if isinstance(got, DataFrame) else {k: rows(v) if isinstance(v, DataFrame) else v for k, v in got.items()}
        except (KeyError, TypeError, ValueError, FileNotFoundError) as e:
            out = {"error": {"tool": name, "type": type(e).__name__, "message": str(e), "arguments": arguments}}
        self.calls.append({"tool_name": name, "arguments": arguments, "result_preview": json.dumps(out, default=str)[:1200], "call_id": call})
        if self.log:
            with self.log.open("a", encoding="utf-8") as f:  # only ever added to
                f.write(json.dumps(self.calls[-1], default=str) + "\n")
        for row in out if isinstance(out, list) and name in _CAPS else []:
            if len(self.evidence) < evidence.HARD_CAP:
                self.evidence.append({"type": kind, "claim_supported": f"{name} result", "data": json.dumps(row, default=str), "tool_call_id": call, "ord": len(self.evidence)})
            if n := row.get("net_name_canonical"):
                self.nets.add(n)
            if c := row.get("refdes"):
                self.components.add(c.upper())
        return out


#: A planner: (run, limits); a model: (messages, tool schemas) -> tool calls, each {"name", "arguments", "id"}; none ends the loop.
Model = Callable[[list[dict], list[dict]], list[dict]]


def fixed_plan(run: Run, limits: Limits) -> None:
    """Nets, blocks, domains, facts of components, pin functions, chunks, pages; then the gate."""
    for net in run.need["nets"][:6]:
        run.execute("get_net_members", net_name=net)
    run.execute("get_function_blocks")
    run.execute("get_power_domains")
    for c in run.need["components"][:4]:
        run.execute("get_component_datasheet_facts", refdes=c)
    run.execute("search_pin_functions", query=run.question, max_results=10)
    run.execute("search_pdf_chunks", query=run.question, source_type="schematic", max_results=min(8, limits.chunks))
    run.rank_pages(limits.pages)
    run.execute("finalize_evidence", reason="fixed_plan")


def planner_prompt(run: Run, limits: Limits) -> str:
    """What a model is told before it plans."""
    return json.dumps({
        "goal": "Gather evidence until every obligation is met, then call finalize_evidence.", "question": run.question, "intent": run.need["intent"], "obligations": run.need, "current_coverage": run.coverage(),
        "current_resolved_entities": {"components": sorted(run.components), "nets": sorted(run.nets)}, "evidence_count": len(run.evidence), "limits": asdict(limits),
        "rules": ["Take claims about pins and nets from the netlist tools.", "A debug question needs evidence of SWDIO, SWDCLK, RESET, GND and a supply.", "Rank schematic pages before you finish.", "finalize_evidence is refused while coverage is incomplete."],
    })


def model_plan(model: Model, progress: Callable[[str], None] = lambda _: None) -> Callable[[Run, Limits], None]:
    """A plan by a model's tool calls, within the limits, until it finishes or calls nothing."""

    def plan(run: Run, limits: Limits) -> None:
        tools, done = api.schemas() + GATE, 0
        messages: list[dict] = [{"role": "system", "content": "You plan which evidence tools to call."}, {"role": "user", "content": planner_prompt(run, limits)}]
        for iteration in range(1, max(1, limits.iterations) + 1):
            asked = model(messages, tools)[: max(0, limits.tool_calls - done)]
            for call in asked:
                args = call.get("arguments") or {}
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except ValueError:
                        args = {}
                args = args if isinstance(args, dict) else {}
                if call["name"] == "rank_schematic_images_for_obligations":
                    out = run.rank_pages(int(args.get("max_results", limits.pages)))
                else:
                    out = run.execute(call["name"], **args)
                done += 1
                run.decisions.append({"iteration": iteration, "tool": call["name"], "arguments": args, "why": "planned by the model"})
                messages.append({"role": "tool", "call_id": call.get("id", ""), "content": json.dumps(out, default=str)})
                progress(f"tool call {done}: {call['name']}")
            if not asked or run.finished is not None or done >= limits.tool_calls:
                return

    return plan


def answer_input(cat: Catalog, prompt: str, pages: list[int], detail: str = "auto") -> list[dict]:
    """The prompt, and the drawn pages that there are, as one model input."""
    content: list[dict] = [{"type": "input_text", "text": prompt}]
    for page in pages:
        try:
            image = api.TOOLS["get_schematic_page_image"](cat, page).first()["image_base64"]
        except KeyError:
            continue
        content.append({"type": "input_image", "image_url": f"data:image/png;base64,{image}", "detail": detail})
    return [{"role": "user", "content": content}]


def ask(cat: Catalog, question: str, limits: Limits = Limits(), planner: Callable[[Run, Limits], None] = fixed_plan, answer: Callable[[list[dict]], str] | None = None, folder: str | None = None, progress: Callable[[str], None] = lambda _: None) -> dict:
    """The evidence packet of a question. folder: where packet, prompt, obligations, coverage, trace and calls are written;
    answer(model input) -> text is asked where given, and its text kept beside them."""
    out = Path(folder) if folder else None
    if out:
        out.mkdir(parents=True, exist_ok=True)
        (out / "agent_tool_calls.jsonl").write_text("")
    progress(f"question: {question}")
    run = Run.of(cat, question, out / "agent_tool_calls.jsonl" if out else None)
    planner(run, limits)
    report = run.coverage()
    if run.finished is None and report["coverage_satisfied"]:
        run.execute("finalize_evidence", reason="after_the_plan")
    if not run.pages:
        run.rank_pages(limits.pages)
    rows = run.evidence or [{"type": "inference", "claim_supported": "", "data": "{}", "tool_call_id": "", "ord": 0}]
    df = cat.spark.createDataFrame(rows, "type string, claim_supported string, data string, tool_call_id string, ord int")
    df = evidence.normalize(df.withColumn("source_priority", T.source_priority(F.col("type"))).withColumn("confidence", T.source_confidence(F.col("type"))), ["ord"])
    missing = {k: report[f"missing_{k}"] for k in ("components", "nets", "relations")}
    unsure = sorted({*(["obligation_coverage_incomplete"] if not report["coverage_satisfied"] else []), *(f"missing_relation:{r}" for r in missing["relations"])}) or ["none_explicitly_detected"]
    told = evidence.findings_of([json.loads(r["data"]) for r in run.evidence[: limits.items] if r["type"] == "anomaly"], run.need["intent"])
    stop = "coverage_satisfied_finalize" if run.finished is not None else "coverage_incomplete"
    trace = {"tool_call_count": len(run.calls), "stop_reason": stop, "limits": asdict(limits)}
    packet = evidence.packet(
        question, df, limits.items, intent=run.need["intent"], obligations=run.need, coverage_report={"coverage_score": report["coverage_score"], "coverage_satisfied": report["coverage_satisfied"]}, missing_obligations=missing,
        tool_decision_trace=run.decisions or run.calls, image_selection_trace=run.page_trace, resolved_entities={"components": sorted(run.components), "nets": sorted(run.nets), "schematic_pages": run.pages}, open_uncertainties=unsure,
        critical_findings=told, agent_trace=trace, recommended_answer_constraints=CONSTRAINTS, nets=run.nets, components=run.components,
    )
    packet |= {"stop_reason": stop, "schematic_image_count": len(run.pages)}
    prompt = evidence.prompt(packet)
    if answer:
        packet["answer"] = answer(answer_input(cat, prompt, run.pages[: limits.pages]))
    if out:
        for name, value in (("agent_evidence_packet", packet), ("coverage_report", report), ("obligations", {"question": question, "obligations": run.need}), ("agent_trace", trace | {"iterations": run.decisions})):
            sinks.write_json(value, str(out / f"{name}.json"))
        (out / "agent_prompt.txt").write_text(prompt)
        if answer:
            (out / "agent_answer.txt").write_text(packet["answer"])
            sinks.write_answer(packet["answer"], str(out))
    progress(f"finished: {stop}")
    return packet


def retrieve(cat: Catalog, question: str, k: int = 8) -> dict:
    """Evidence of all kinds at one go: the question's intent and entities, rows per kind (best first), what stays open."""
    known, intent = link(cat, question), cat.spark.range(1).select(T.classify_intent(F.lit(question)).alias("i")).first()["i"]
    nets, parts = cat.table("nets"), cat.table("refdes_to_part")
    got = search.retrieve(nets, parts, knowledge.block_members(nets, parts), knowledge.blocks_of(nets, parts), cat.table("anomalies"), cat.table("pdf_chunks"), question, known["refdes"], known["nets"], intent, k)
    rows: dict[str, list[dict]] = {kind: [] for kind in ("net", "component", "function_block", "anomaly", "datasheet", "schematic")}
    for r in got.orderBy(F.desc("score"), "source_id").collect():  # bounded kind by kind
        rows[r["kind"]].append(r.asDict())
    unsure = ["insufficient_net_diversity_for_system_function"] if intent == "system_function" and len(rows["net"]) < 5 else []
    unsure += ["no_matching_connectivity_anomalies_detected"] if intent in search.AGGRESSIVE and not rows["anomaly"] else []
    return {"intent": intent, "entities": known, "open_uncertainties": unsure} | {f"{kind}_evidence": x for kind, x in rows.items()}


def route(cat: Catalog, question: str, forced: str | None = None, model: Callable[[str], dict] | None = None) -> dict:
    """Which way a question goes, how sure, why and by whom: as forced (`general` or `precision`), else by model(question), else by its terms."""
    if forced in ("general", "precision"):
        return {"route": "relevant_general" if forced == "general" else "precision", "confidence": "forced", "rationale": f"forced mode: {forced}", "model_used": "none"}
    if model:
        got = model(question)
        if got.get("route") in ("irrelevant_general", "relevant_general", "precision"):
            return {"confidence": "medium", "rationale": "", "model_used": "model"} | got
    return _one(cat, T.classify_route(F.lit(question))) | {"rationale": "terms of the question", "model_used": "heuristic"}


def answer_generally(cat: Catalog, question: str, forced: str | None = None, model=None, pages: int = 2) -> dict:
    """The way without evidence: model(question, context) where there is one, else a plain text that says what is missing;
    context is the circuit summary, and what drawn pages there are come beside it."""
    way = route(cat, question, forced)
    context = [r["line"] for r in api.get_circuit_summary(cat).limit(60).collect()]
    images = [r["page_number"] for r in cat.table("page_images").select("page_number").distinct().orderBy("page_number").limit(pages).collect()]
    if model:
        return way | {"mode": "general", "answer": model(question, context), "pages": images}
    told = "This question is not about the board." if way["route"] == "irrelevant_general" else "No model is set up to answer in general; ask for the evidence packet, or see the circuit summary."
    return way | {"mode": "general", "answer": told, "context": context, "pages": images}


def focused(packet: dict, tokens: list[str]) -> bool:
    """Whether any expected token stands in what a run resolved, left open or found critical."""
    own = packet["resolved_entities"]
    said = " ".join([*own["components"], *own["nets"], *packet["open_uncertainties"], *packet["critical_findings"]]).upper().replace("\\", "")
    return any(t.upper().replace("\\", "") in said for t in tokens)


def validate(cat: Catalog, suites: dict[str, list[dict]]) -> dict:
    """Each suite's questions (id, question, expected_focus) are asked; figures of each suite and their totals."""
    rows, runs = [], []
    for suite, questions in suites.items():
        for q in questions:
            p = ask(cat, q["question"], SUITE)
            row = (suite, focused(p, q["expected_focus"]), p["coverage_report"]["coverage_satisfied"], "obligation_coverage_incomplete" in p["open_uncertainties"], p["schematic_image_count"])
            rows.append(row)
            runs.append({"suite": suite, "id": q["id"], "question": q["question"], "heuristic_pass": row[1], "coverage_satisfied": row[2], "missing_obligations": p["missing_obligations"], "schematic_image_count": row[4]})
    df = cat.spark.createDataFrame(rows, "suite string, heuristic_pass boolean, coverage_satisfied boolean, uncertain boolean, images long")
    figures = {r["suite"]: {k: v for k, v in r.asDict().items() if k != "suite" and v is not None} for r in evidence.suites(df).collect()}
    return figures | {"runs": runs}
