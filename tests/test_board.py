"""A small synthetic board from files to packet, and the rules that are easy to get wrong."""

import json
import random

import pytest
from pyspark.sql import functions as F

from boardloom import api, run, sinks
from boardloom.catalog import Catalog
from boardloom.functions import text as T
from boardloom.operators import connect, desk, evidence, knowledge, neighborhood, texts
from boardloom.pipeline import ingest
from boardloom.sources import dsn, tabular

DSN = r"""(pcb x.dsn
 (placement (component IMG_U3 (place U3 1 2 front 0)) (component IC8_U6 (place U6 1 2 front 0)) (component SW_SW3 (place SW3 0 0 front 0)) (component R_R1 (place R1 0 0 front 0)) (component nounderscore (place X 0 0 front 0)))
 (library (image IMG_U3 (outline (path 1 2)) (pin Round 1 0 0) (pin Round 2 0 0) (pin Round 02 0 0) (pin Round 8 0 0)) (image IC8 (pin P 1 0 0)) (image SW_SW3 (outline)) (image R_R1 (pin P 1 0 0) (pin P 2 0 0)))
 (network
  (net SWDIO (pins MOD1-5 P3-2 U3-1))
  (net R\E\S\E\T\ (pins U3-8
     SW3-1 SW3-1))
  (net GND (pins R1-1))
  (net 1V8 (pins U3-2 MOD-1-33))
  (net NetC18_1 (pins U6-1 R1-2))
  (net P1.04 (pins U6-1 U3-2))
  (net "USB_D+" (pins J4-A5 U6-3))
  (net NetTP1_1 (pins TP1-1))))"""  # fmt: skip
BOM = 'Designator,Quantity,Value,Manufacturer,Part Number,Note,Specification,Footprint\n"U3, U6",2,MCU,Acme,AB12/3,,SWD core,QFN\n,1,skip,me,,,,\nU6,1,IC,Other,ZZ9,,second wins,QFN\nr1,1,10k,Acme,,,,0603\nL1,1,2u2,Acme,LQ,,,0805\n'
HEAD = "1 OVERVIEW OF SWDIO\n"
SHEET = HEAD + ("The regulator holds the rail while the board sleeps. " * 40) + "\nTABLE 2 PINS\n| Name | Use | More |\n| SWDIO | debug data | input |\n| spinning | x | y |\n| only |\n" + "tail " * 200


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "in" / "sheets").mkdir(parents=True)
    (root / "out").mkdir()
    (root / "in/board.dsn").write_text(DSN)
    (root / "in/bom.csv").write_text(BOM)
    (root / "in/schematic.txt").write_text("Main.SchDoc SWDIO J4 U3 GND\fsecond page RESET 1V8\f")
    (root / "in/sheets/ab12_3_rev2.txt").write_text(SHEET + "\f")
    summary = ingest(spark, str(root / "out"), str(root / "in/board.dsn"), str(root / "in/bom.csv"), str(root / "in/schematic.txt"), str(root / "in/sheets"), "*.txt")
    return Catalog(spark, str(root / "out")), summary


def _one(df, **match):
    rows = [r.asDict() for r in df.collect() if all(r[k] == v for k, v in match.items())]
    assert len(rows) == 1, rows
    return rows[0]


def test_counts(project):
    assert project[1]["counts"]["nets"] == 8 and project[1]["counts"]["bom_lines"] == 4


def test_nets_and_names(project):
    nets = project[0].table("nets")
    reset = _one(nets, net_name_canonical="RESET")
    assert reset["aliases"] == ["RESET", "R\\E\\S\\E\\T\\"] and reset["pins_raw"] == ["U3-8", "SW3-1", "SW3-1"]
    assert _one(nets, net_ord=6)["net_name_canonical"] == "_USB_D_"
    pin = _one(connect.net_pins(nets), token="MOD-1-33")
    assert (pin["refdes"], pin["pin"]) == ("MOD-1", "33")


def test_components(project):
    pins = project[0].table("component_pins")
    u3 = _one(pins, refdes="U3")
    assert u3["all_pins"] == ["02", "1", "2", "8"] and u3["floating_pins"] == ["02"]
    assert _one(pins, refdes="U6")["all_pins"] == ["1"]  # the image without its last part
    sw = _one(pins, refdes="SW3")
    assert sw["all_pins"] == [] and sw["connected_pins"] == ["1"] and sw["floating_pins"] == []
    assert _one(pins, refdes="MOD1")["all_pins"] == ["5"]


def test_parts(project):
    parts = project[0].table("refdes_to_part")
    assert _one(parts, refdes="U6")["part_number"] == "ZZ9"  # the last line wins
    assert _one(parts, refdes="U3")["datasheet_candidates"] == ["ab12_3_rev2.txt"]
    assert {r["refdes"] for r in parts.collect()} == {"U3", "U6", "r1", "L1"}


def test_anomalies(project):
    got = {(r["kind"], r["refdes"] or r["net_name"]): r["n"] for r in project[0].table("anomalies").collect()}
    assert got == {("floating_required_pin", "U3"): 1, ("duplicate_pin_membership", "RESET"): 1, ("orphan_or_stub_net", "NETTP1_1"): 0 + 1}


def test_graph(project):
    cat, _ = project
    assert cat.table("graph_edges").count() == 4 * 16
    got = api.TOOLS["trace_net_neighborhood"](cat, seed_nets=["swdio"], depth=1)
    assert set(got["nodes"]) == {"net:SWDIO", "pin:MOD1-5", "pin:P3-2", "pin:U3-1"} and len(got["edges"]) == 3 and not got["truncated"]
    cut = api.TOOLS["trace_net_neighborhood"](cat, seed_nets=["SWDIO"], depth=4, max_nodes=3)
    assert len(cut["nodes"]) == 3 and cut["truncated"]
    assert api.TOOLS["trace_net_neighborhood"](cat, seed_pins=["PIN:U3-1"])["edges"] == []
    seeds = cat.spark.createDataFrame([("board", "net:SWDIO")], "board_id string, id string")
    hops = {r["id"]: r["hop"] for r in neighborhood.k_hops(cat.table("graph_edges"), seeds, 4).collect()}
    assert hops["component:U3"] == 2 and hops["net:RESET"] == 4
    relations = {r["relation"]: r["count"] for r in cat.table("typed_graph").groupBy("relation").count().collect()}
    assert relations["connected_to"] == 16 and relations["domain_net"] == 2


def test_trace_against_a_queue(spark):
    """The trace is that of a queue that takes each edge in turn."""
    import random
    from collections import deque

    r = random.Random(4)
    rows = [("b", k, k, 0, 0, f"n{r.randrange(12)}", f"n{r.randrange(25)}", "t") for k in range(80)] + [("other", 1, 1, 0, 0, "n1", "n99", "t")]
    edges = spark.createDataFrame(rows, "board_id string, net_ord long, net_id long, pin_ord int, edge_no int, src string, dst string, type string")
    for depth, most in ((1, 250), (2, 250), (3, 8), (2, 2), (0, 5)):
        seen, queue, log, cut = ["n1", "n2"], deque([("n1", 0), ("n2", 0)]), [], False
        while queue:
            node, d = queue.popleft()
            for x in rows if d < depth else ():
                if x[0] == "b" and x[5] == node:
                    log.append((node, x[6]))
                    if x[6] not in seen:
                        if len(seen) < most:
                            seen.append(x[6])
                            queue.append((x[6], d + 1))
                        else:
                            cut = True
        nodes, truncated, own = neighborhood.trace(edges, "b", ["n1", "n2"], depth, most)
        assert (nodes, truncated) == (seen, cut) and [(e["src"], e["dst"]) for e in own.orderBy("place").collect()] == log


def test_texts(project):
    cat, _ = project
    facts = _one(cat.table("component_facts"), refdes="U3")
    assert facts["part_description"].startswith("The regulator holds") and facts["has_pin_table"]
    pins = sorted(r["pin_name"] for r in cat.table("component_pin_functions").collect())
    assert pins == ["Name", "SWDIO"]  # a row that mentions `pin` anywhere is left out
    chunks = cat.table("pdf_chunks")
    assert {r["chunk_id"] for r in chunks.filter("source_type = 'schematic'").collect()} == {"schematic:1:1", "schematic:2:1"}
    assert _one(chunks, chunk_id="schematic:1:1")["heading_path"] == ["Main.SchDoc"]
    assert {(r["net_name"], r["page_number"]) for r in cat.table("entity_pages").collect()} >= {("SWDIO", 1), ("RESET", 2)}


def test_tail_is_emitted_again():
    text = "a" * 1000 + "\nHEADING ONE\n" + "b" * 2500
    got = texts.page_chunks(text)
    # the heading is the only boundary in reach: the 250 characters before it (a line end among them) come again on their own
    assert got[0] == "a" * 1000 and got[1] == "a" * 249 and got[2].startswith("HEADING ONE")
    assert texts.page_chunks("") == [] and texts.page_chunks(None) == []


def test_tools(project):
    cat, _ = project
    assert api.TOOLS["get_pin_net"](cat, "u3", "8").first()["net_name_canonical"] == "RESET"
    assert api.TOOLS["get_pin_net"](cat, "U3", "77").first()["connected"] is False
    assert {r["refdes"]: r["pins"] for r in api.TOOLS["get_net_members"](cat, "r\\e\\s\\e\\t").collect()} == {"U3": ["8"], "SW3": ["1", "1"]}
    with pytest.raises(KeyError):
        api.TOOLS["get_net"](cat, "NOPE")
    with pytest.raises(KeyError):
        api.TOOLS["get_component"](cat, "u99")
    with pytest.raises(ValueError):
        api.TOOLS["search_components"](cat, "U*")
    with pytest.raises(ValueError):
        api.TOOLS["search_components"](cat, "U", "gizmo")
    assert [r["refdes"] for r in api.TOOLS["search_components"](cat, "u3").collect()][0] == "U3"
    assert api.TOOLS["search_nets"](cat, "reset").first()["match_reason"] == "exact_canonical"
    assert api.TOOLS["search_pdf_chunks"](cat, "SWDIO", refdes="L1").count() > 0  # no sheets: all are searched
    assert api.TOOLS["search_pdf_chunks"](cat, "SWDIO", mpn="nothere").count() == 0
    assert set(api.TOOLS["get_component_context_bundle"](cat, "U3")) == {"component", "pins", "top_datasheet_chunks", "related_schematic_pages", "related_nets"}
    assert api.TOOLS["get_connectivity_anomalies"](cat, "HIGH", "u3").count() == 1


def test_packet(project, tmp_path):
    cat, _ = project
    said = []
    p = run.ask(cat, "Is the SWD programming header of U3 wired correctly?", folder=str(tmp_path / "qa"), answer=lambda x: x[0]["content"][0]["text"][:20], progress=said.append)
    assert p["intent"] == "protocol_debug_validation" and p["stop_reason"] == "coverage_incomplete" and "SWDCLK" not in {n["data"] for n in p["evidence"]}
    assert p["evidence"] and p["evidence"][0]["source_priority"] == "DSN" and p["missing_obligations"]["nets"] == ["SWDCLK"] and "obligation_coverage_incomplete" in p["open_uncertainties"]
    assert "U3" in p["obligations"]["components"] and p["obligations"]["negative_checks"] and p["schematic_image_count"] > 0 and set(p["evidence_diversity_metrics"]) == {"distinct_nets", "distinct_components", "distinct_blocks"}
    assert "Evidence:" in evidence.prompt(p) and json.dumps(p, default=str)
    files = {f.name for f in (tmp_path / "qa").iterdir()}
    assert files >= {"agent_evidence_packet.json", "agent_prompt.txt", "coverage_report.json", "obligations.json", "agent_trace.json", "agent_tool_calls.jsonl", "agent_answer.txt"} and any(f.startswith("response_") for f in files)
    assert len((tmp_path / "qa" / "agent_tool_calls.jsonl").read_text().splitlines()) == p["agent_trace"]["tool_call_count"] and said[0].startswith("question") and said[-1].startswith("finished")
    bad = run.Run(cat).execute("get_net", net_name="NOPE")
    assert bad["error"]["type"] == "KeyError" and run.Run(cat).execute("get_net", nothing=1)["error"]["type"] == "TypeError"


def test_linked_entities(project):
    cat, _ = project
    got = run.link(cat, r"Does u3 drive R\E\S\E\T\ or swdio, and what is X99?")
    assert got["refdes"] == ["U3"] and got["nets"] == ["RESET", "SWDIO"] and "X99" in got["symbols"]


def test_model_plan(project):
    cat, _ = project

    def model(messages, tools):
        assert {"finalize_evidence", "get_net"} <= {t["name"] for t in tools}
        done = sum(m["role"] == "tool" for m in messages)
        return [{"name": "get_net_members", "arguments": '{"net_name": "SWDIO"}', "id": "a"}, {"name": "finalize_evidence", "arguments": {"reason": "x"}, "id": "b"}] if done < 20 else []

    p = run.ask(cat, "What is on the RESET path?", run.Limits(iterations=3, tool_calls=5), run.model_plan(model))
    assert p["stop_reason"] == "coverage_satisfied_finalize" and len(p["tool_decision_trace"]) == 2
    p = run.ask(cat, "Is the SWD header right?", run.Limits(iterations=3, tool_calls=5), run.model_plan(model))
    assert p["stop_reason"] == "coverage_incomplete" and len(p["tool_decision_trace"]) == 5  # the gate holds, the limit ends it


def test_retrieval(project):
    cat, _ = project
    got = run.retrieve(cat, "How does U3 communicate over SWDIO with U6?")
    assert got["intent"] == "protocol_debug_validation" and [r["source_id"] for r in got["component_evidence"]] == ["U3", "U6"] and "SWDIO" in {r["source_id"] for r in got["net_evidence"]}
    assert got["anomaly_evidence"] and got["datasheet_evidence"] and all(r["score"] > 0.05 for r in got["datasheet_evidence"])
    run_ = run.Run.of(cat, "Is the SWD header of U3 right?")
    run_.execute("get_net_members", net_name="SWDIO")
    assert {"SWDIO", "MOD1", "P3", "U3"} <= set(run_.terms())


def test_suites(project):
    cat, _ = project
    got = run.validate(cat, {"board": [{"id": "a", "question": "Which pins are on SWDIO?", "expected_focus": ["swdio"]}, {"id": "b", "question": "What about X99?", "expected_focus": ["nothere"]}], "other": [{"id": "c", "question": "Which pins are on SWDIO?", "expected_focus": ["zzz"]}]})
    assert got["totals"] == {"total": 3, "passed_heuristic": 1, "failed_heuristic": 2, "coverage_passed": got["totals"]["coverage_passed"], "coverage_failed": 3 - got["totals"]["coverage_passed"]}
    assert got["board"]["passed_heuristic"] == 1 and got["other"]["total"] == 1 and 0 <= got["board"]["image_attachment_precision_proxy"] <= 1 and len(got["runs"]) == 3


def test_server(project):
    import io

    from boardloom import server

    cat, _ = project
    tools = server.reply(cat, {"id": 1, "method": "tools/list"})["result"]["tools"]
    assert len(tools) == 26 and next(t for t in tools if t["name"] == "get_pin_net")["inputSchema"]["required"] == ["refdes", "pin"]
    packet = server.call(cat, "build_evidence_packet", {"question": "What is on the RESET path?"})
    assert packet["evidence"] and "RESET" in server.call(cat, "render_prompt_from_evidence_packet", {"packet": packet})["prompt"] and server.call(cat, "build_evidence_packet", {})["error"]["type"] == "TypeError"
    bundle = server.call(cat, "get_component_context_bundle", {"refdes": "U3"})
    assert bundle["component"][0]["refdes"] == "U3" and bundle["pins"] and json.dumps(bundle)
    to = io.StringIO()
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "get_pin_net", "arguments": {"refdes": "U3", "pin": "8"}}}, {"id": 3, "method": "tools/call", "params": {"name": "nope"}}, {"id": 4, "method": "what"}]
    server.serve(cat, io.StringIO("\n".join(map(json.dumps, asked)) + "\n{"), to)
    got = [json.loads(x) for x in to.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, None] and "RESET" in got[1]["result"]["content"][0]["text"] and "error" in got[2] and got[4]["error"]["code"] == -32700


def test_command_line(project, tmp_path, capsys):
    from boardloom import __main__ as cli

    cat, _ = project
    with pytest.raises(SystemExit):
        cli.main(["ingest", "--root", str(tmp_path), "--netlist", "x.dsn"])  # all inputs or none
    with pytest.raises(FileNotFoundError):
        cli.main(["ingest", "--root", str(tmp_path)])
    assert cli.main(["ask", "--root", cat.root, "--mode", "auto", "--quiet", "what about the weather"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["route"] == "irrelevant_general" and got["mode_selected"] == "auto" and got["mode"] == "general"
    assert cli.main(["tool", "--root", cat.root, "get_pin_net", "--json", '{"refdes": "U3", "pin": "8"}']) == 0 and "RESET" in capsys.readouterr().out


def test_documents(project):
    cat, _ = project
    from pathlib import Path

    root = Path(cat.root)
    assert (root / "bom_overview.md").read_text().startswith("# Bill of Materials Overview\n\n| Designators") and "power_path" in (root / "circuit_summary.md").read_text()
    items = json.loads((root / "datasheets" / "manifest.json").read_text())["items"]
    assert items and Path(items[0]["markdown_path"]).read_text().startswith("# Datasheet: ") and json.loads((root / "schematic_page_images.json").read_text())["page_count"] == 0
    assert set(api.TOOLS["list_project_summary"](cat)) == set(api.SUMMARY) and len(api.SUMMARY) == 14


def test_ways(project, tmp_path):
    cat, _ = project
    assert run.route(cat, "what about the weather")["route"] == "irrelevant_general" and run.route(cat, "x", "precision")["confidence"] == "forced"
    assert run.route(cat, "x", model=lambda q: {"route": "precision"})["model_used"] == "model" and run.route(cat, "x", model=lambda q: {"route": "odd"})["model_used"] == "heuristic"
    got = run.answer_generally(cat, "tell me about it", model=lambda q, c: f"{q} {len(c) > 0}")
    assert got["answer"] == "tell me about it True" and "board" in run.answer_generally(cat, "the weather")["answer"]
    assert api.TOOLS["get_circuit_summary"](cat).filter("section = 1").count() == 3
    with pytest.raises(KeyError):
        api.TOOLS["get_schematic_page_image"](cat, 1)
    assert sinks.write_answer("x", str(tmp_path)).endswith(".md")
    images = tabular.page_images(cat.spark, str(cat.root) + "/../in", lambda b: [(2, 3, b"png")], "*.txt").collect()
    assert [(r["page_number"], r["width"], bytes(r["image"])) for r in images] == [(1, 2, b"png")]


def test_rules(spark):
    df = spark.createDataFrame([(x,) for x in ("LED1", "USB1", "RT1", "FB1", "P3", "TP2", "SW1", "MOD1", "X1", "D4")], "r string")
    got = {r["r"]: (r["a"], r["b"]) for r in df.select("r", T.component_type(F.col("r")).alias("a"), T.component_class(F.col("r")).alias("b")).collect()}
    assert got == {"LED1": ("inductor", "inductor"), "USB1": ("ic", "ic"), "RT1": ("resistor", "resistor"), "FB1": ("other", "other"), "P3": ("header", "other"), "TP2": ("test_point", "test_point"), "SW1": ("switch", "switch"), "MOD1": ("module", "module"), "X1": ("crystal", "crystal"), "D4": ("diode_led", "diode")}
    q = spark.createDataFrame([("the planet turns",), ("check the mapping",), ("SWD header",), ("hello",), ("shopping list for U12 and r3",)], "t string")
    assert [r[0] for r in q.select(T.classify_intent(F.col("t"))).collect()] == ["net_trace", "pin_validation", "protocol_debug_validation", "system_function", "pin_validation"]
    assert [r[0]["route"] for r in q.select(T.classify_route(F.col("t"))).collect()] == ["precision", "precision", "relevant_general", "relevant_general", "irrelevant_general"]
    assert q.select(T.explicit_refs(F.col("t")).alias("x")).collect()[4]["x"] == ["R3", "U12"]
    n = spark.createDataFrame([("USB_D+",)], "net_name_canonical string").select(F.lit("b").alias("board_id"), T.canonical_net_name(F.col("net_name_canonical")).alias("net_name_canonical"))
    assert [r["bus_type"] for r in knowledge.bus_nets(n).collect()] == ["usb"]
    assert spark.range(1).select(T.response_time(F.lit("response_20240102_030405.md")).alias("t")).first()["t"].hour == 3
    assert spark.range(1).select(T.page_mention(F.lit("see Page  12")).alias("t")).first()["t"] == 12


def test_dsn_errors():
    with pytest.raises(ValueError):
        dsn.balanced("(net (a)", "(net")
    with pytest.raises(ValueError):
        dsn.balanced("nothing", "(net")
    assert dsn.balanced("x (net (a) b) c", "(net") == "(net (a) b)"
    with pytest.raises(FileNotFoundError):
        tabular.required("/no/such/file")
    with pytest.raises(FileNotFoundError):
        Catalog(None, "/no/such/folder")


def test_containment_against_nested_loop(spark):
    a = ["ab", "abc", "x", "bc1", "zz", "abcd1"]
    b = ["abc", "b", "xyz", "bc12", "q"]
    got = {tuple(r) for r in connect.containment(spark.createDataFrame([(x,) for x in a], "p string"), "p", spark.createDataFrame([(x,) for x in b], "s string"), "s").collect()}
    assert got == {(x, y) for x in a for y in b if x in y or y in x}


def test_enrichment(spark, tmp_path):
    from boardloom import enrich
    from boardloom.schemas import TABLES

    cat = Catalog(spark, str(tmp_path))
    sinks.write_table(spark.createDataFrame([("b", "U1", "P", "M", "s.pdf", "", False)], TABLES["component_facts"]), cat.root, "component_facts")
    sinks.write_table(spark.createDataFrame([("s.pdf", "x " * 30_000)], TABLES["datasheet_markdown"]), cat.root, "datasheet_markdown")
    calls = []

    def model(kind, context):
        calls.append(kind)
        return {"blocks": {"blocks": [{"block": "radio", "nets": ["ANT"]}, "odd"]}, "protocols": {"protocols": [{"protocol": "swd", "required_nets": ["SWDIO"]}]}, "facts": {"part_description": "A part.", "pins": [{"pin_name": "1"}] if calls.count("facts") > 1 else []}}[kind]

    assert enrich.enrich(cat, None) == {} and enrich.enrich(cat, model) == {"blocks": 1, "protocols": 1, "facts": 2}
    assert calls.count("facts") == 2 and cat.table("function_blocks").first()["nets"] == ["ANT"] and cat.table("component_pin_functions").first()["pin_name"] == "1" and cat.table("component_facts").count() == 2
    assert enrich.facts(Catalog(spark, str(tmp_path)), lambda k, c: calls.append("w") or {}, windows=3) == 0 and calls.count("w") == 3


def test_markdown_and_headings(spark):
    df = spark.createDataFrame([("f", 1, "1 START\nbody\n\nTABLE X\nmore"), ("f", 2, None), ("f", 3, "  ")], "f string, p int, t string")
    assert [(r["line_no"], r["heading"], r["offset"]) for r in texts.heading_lines(df, ["f", "p"], "t").orderBy("line_no").collect()] == [(0, "1 START", 0), (3, "TABLE X", 14)]
    assert texts.datasheet_markdown(df, "f", "p", "t").first()["markdown"] == "# Datasheet: f\n\n## Page 1\n\n1 START\nbody\n\nTABLE X\nmore\n\n## Page 2\n\n_No extractable text on this page._\n\n## Page 3\n\n_No extractable text on this page._\n"
    assert [r["window_text"] for r in texts.windows(spark.createDataFrame([("  abcdefgh \n",), (" ",), (None,)], "t string"), [], "t", size=4, overlap=0.5).orderBy("start").collect()] == ["abcd", "cdef", "efgh", "gh"]
    hints = spark.createDataFrame([("Top-A_1.SchDoc x",), ("-- 2  of 9--",), ("no",)], "t string").select(T.sheet_hint(F.col("t")))
    assert [r[0] for r in hints.collect()] == ["A_1.SchDoc", "-- 2  of 9--", "unknown_sheet"]


def test_names_in_pages(spark):
    names = spark.createDataFrame([("AB",), ("X Y",), ("Q",), ("NOPE",), ("",)], "n string")
    pages = spark.createDataFrame([(1, "xab-1 z"), (2, "x y q"), (3, None), (4, "x z y"), (5, "AB"), (6, "")], "page int, t string")
    got = {tuple(r) for r in knowledge.entity_pages(names, "n", pages, ["page"], "t").select("n", "page").collect()}
    assert got == {("AB", 1), ("AB", 5), ("X Y", 2), ("Q", 2)}


def _moved(node) -> tuple[int, list[str]]:
    """Bytes that the exchanges of a plan that ran took, and the names of its nodes."""
    kids = [node.executedPlan()] if hasattr(node, "executedPlan") and node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    below = [_moved(k) for k in kids]
    own = node.metrics().apply("dataSize").value() if "Exchange" in node.nodeName() and node.metrics().contains("dataSize") else 0
    return own + sum(b for b, _ in below), [node.nodeName(), *(n for _, names in below for n in names)]


@pytest.mark.parametrize("spaced", [True, False])
def test_names_in_long_words(spark, spaced):
    """What moves grows with the length of a word, not with its square, and no side of a join goes through the driver."""
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000))
    up = word.upper()
    inside = [up[i : i + n] for i in (0, 1, 63, 64, 65, 66, 7_000, 12_345) for n in (7, 31, 32, 33, 96, 97, 500)] + [up[-n:] for n in (7, 32, 33, 200)] + [up]
    others = [up[70:102] + "-", up[200:300] + "-", "-" + up[500:540], up[:2_000] + up[2_001:4_000]]
    names = spark.createDataFrame([(n,) for n in [*inside, *others, "-"]], "n string")
    pages = spark.createDataFrame([(None, 1, f"a {word} b"), ("f", 2, word[:500] + "\n" + word[500:]), ("f", 3, "a-b"), ("f", None, word[70:102] + "-" + word[200:230])], "f string, page int, t string")
    texts = [(r["f"], r["page"], r["t"].upper()) for r in pages.collect()]
    found = knowledge.entity_pages(names, "n", pages, ["f", "page"], "t", spaced=spaced)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted({str((n, f, p)) for n in [*inside, *others, "-"] for f, p, t in texts if n in t})
    moved, nodes = _moved(found._jdf.queryExecution().executedPlan())
    assert 0 < moved < 1_000 * sum(len(t) for _, _, t in texts) and not [n for n in nodes if "Broadcast" in n]


def test_desk(spark):
    c = spark.createDataFrame([(1, "t1", "s1", 5), (2, "t2", None, 7), (3, "t3", "s3", 9)], "k int, t string, s string, u int")
    assert [r["line"] for r in desk.carried_lines(c, 3, "k", "t", "s", "u").collect()] == ["t2: ", "t1: s1"]
    f = spark.createDataFrame([("response_20240102_030405.md",), ("x.md",), ("response_20250102_030405.md",)], "n string")
    assert [r["n"] for r in desk.response_files(f, "n").collect()] == ["response_20250102_030405.md", "response_20240102_030405.md"]
    m = desk.map_datasheets(spark.createDataFrame([("AB-1",), ("C/2",), ("D3X",), ("none",)], "p string"), "p", spark.createDataFrame([("ab-1",), ("c2",), ("d3xy",), ("d3xz",)], "s string"), "s")
    assert {r["p"]: (r["s"], r["how"]) for r in m.collect()} == {"AB-1": ("ab-1", "exact"), "C/2": ("c2", "normalized"), "D3X": ("d3xy", "fuzzy"), "none": (None, "unmatched")}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, desk.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
