"""Command line: ingest, ask, validate, tool, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from boardloom import api
from boardloom.catalog import Catalog
from boardloom.operators import evidence
from boardloom.run import Limits, Run, answer_generally, ask, route, validate

INPUTS = ("netlist", "bom", "schematic", "datasheets")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boardloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="build the tables of a project; without inputs, from ROOT/input")
    for x in INPUTS:
        a.add_argument(f"--{x}")
    a.add_argument("--glob", default="*.pdf")
    b = sub.add_parser("ask", help="the evidence packet of a question, or a general answer")
    b.add_argument("question")
    b.add_argument("--prompt", action="store_true")
    b.add_argument("--mode", choices=["auto", "general", "precision"], default="precision")
    b.add_argument("--out", help="folder for packet, prompt, coverage and trace")
    b.add_argument("--quiet", action="store_true")
    for name, value in vars(Limits()).items():
        b.add_argument(f"--max-{name.replace('_', '-')}", type=int, default=value)
    v = sub.add_parser("validate", help="ask the suites of questions in a JSON file: {suite: [{id, question, expected_focus}]}")
    v.add_argument("questions")
    c = sub.add_parser("tool")
    c.add_argument("name", choices=sorted(api.TOOLS))
    c.add_argument("--json", default="{}")
    s = sub.add_parser("serve", help="the tools over standard input and output")
    for x in (a, b, c, v, s):
        x.add_argument("--root", required=True)
    return p


def inputs(p: argparse.ArgumentParser, args: argparse.Namespace) -> dict[str, str]:
    """The four inputs: all as given, or all found in ROOT/input."""
    given = {x: getattr(args, x) for x in INPUTS}
    if any(given.values()):
        if not all(given.values()):
            p.error("give all of " + ", ".join(f"--{x}" for x in INPUTS) + ", or none")
        return given
    from boardloom.sources.tabular import default_inputs

    return default_inputs(f"{args.root}/input")


def main(arguments: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(arguments)
    found = inputs(p, args) if args.command == "ingest" else {}
    from pyspark.sql import SparkSession

    from boardloom.pipeline import ingest
    from boardloom.ship import ship

    spark = SparkSession.builder.appName("boardloom").getOrCreate()
    ship(spark)
    if args.command == "ingest":
        Path(args.root).mkdir(parents=True, exist_ok=True)
        got = ingest(spark, args.root, **found, glob=args.glob)
    else:
        cat = Catalog(spark, args.root)
        if args.command == "ask":
            way = route(cat, args.question, None if args.mode == "auto" else args.mode)
            if way["route"] == "precision":
                limits = Limits(**{name: getattr(args, f"max_{name}") for name in vars(Limits())})
                got = ask(cat, args.question, limits, folder=args.out, progress=(lambda _: None) if args.quiet else lambda x: print(x, file=sys.stderr)) | {"route_decision": way}
                if args.prompt:
                    print(evidence.prompt(got))
                    return 0
            else:
                got = answer_generally(cat, args.question, None if args.mode == "auto" else args.mode)
            got["mode_selected"] = args.mode
        elif args.command == "validate":
            got = validate(cat, json.loads(Path(args.questions).read_text()))
        elif args.command == "serve":
            from boardloom.server import serve

            serve(cat)
            return 0
        else:
            got = Run(cat).execute(args.name, **json.loads(args.json))
    print(json.dumps(got, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
