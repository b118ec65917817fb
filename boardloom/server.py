"""The tools over standard input and output: JSON-RPC, one message a line, as tool servers of the Model Context Protocol speak it."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from boardloom import api
from boardloom.catalog import Catalog
from boardloom.operators import evidence
from boardloom.run import Limits, Run, ask

VERSION = "2024-11-05"
#: Tools beside those of the project: a whole run, and its prompt.
MORE = {
    "build_evidence_packet": (lambda cat, question, max_items=64: ask(cat, question, Limits(items=int(max_items))), {"question": "string", "max_items": "integer"}, "The evidence packet of a question, by the fixed plan."),
    "render_prompt_from_evidence_packet": (lambda cat, packet: {"prompt": evidence.prompt(packet)}, {"packet": "object"}, "The prompt of an evidence packet."),
}


def tools() -> list[dict]:
    own = [{"name": s["name"], "description": s["description"], "inputSchema": s["parameters"]} for s in api.schemas()]
    return own + [{"name": n, "description": told, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in fields.items()}, "required": list(fields)[:1], "additionalProperties": False}} for n, (_, fields, told) in MORE.items()]


def call(cat: Catalog, name: str, arguments: dict) -> list[dict] | dict:
    if name not in MORE:
        return Run(cat).execute(name, **arguments)
    try:
        return MORE[name][0](cat, **arguments)
    except (KeyError, TypeError, ValueError) as e:
        return {"error": {"tool": name, "type": type(e).__name__, "message": str(e), "arguments": arguments}}


def reply(cat: Catalog, message: dict) -> dict | None:
    """The answer to one message; none to a notification."""
    if "id" not in message:
        return None
    method, p = message.get("method"), message.get("params") or {}
    out = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "boardloom", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": tools()}}
    if method == "tools/call":
        if p.get("name") not in {*api.TOOLS, *MORE}:
            return out | {"error": {"code": -32602, "message": f"unknown tool: {p.get('name')}"}}
        got = call(cat, p["name"], p.get("arguments") or {})
        return out | {"result": {"content": [{"type": "text", "text": json.dumps(got, default=str)}], "isError": isinstance(got, dict) and "error" in got}}
    return out | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(cat: Catalog, source: TextIO = sys.stdin, to: TextIO = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            got = reply(cat, json.loads(line))
        except ValueError:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if got:
            print(json.dumps(got, default=str), file=to, flush=True)
