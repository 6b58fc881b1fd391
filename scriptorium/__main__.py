"""Command line: list, show or run queries over a data folder, preview a plan, check Markdown files, read a run's state. Results as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    query = commands.add_parser("query", help="run a query")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--output", help="write Parquet here instead of printing")
    query.add_argument("--show", type=int, default=20, help="rows to print")
    query.add_argument("--explain", action="store_true", help="print the plan instead")
    query.add_argument("--master", default=None)
    plan = commands.add_parser("plan", help="preview a plan's YAML file")
    plan.add_argument("file")
    plan.add_argument("--only", nargs="*", help="these nodes and what they need")
    check = commands.add_parser("check", help="check Markdown files")
    check.add_argument("files", nargs="+")
    check.add_argument("--rules", help="a YAML file of rules")
    state = commands.add_parser("state", help="saved stages of a run")
    state.add_argument("folder")
    return out


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if options.command == "plan":
        from scriptorium.plans import planner
        from scriptorium.sources.files import read_yaml

        plan = planner.build(read_yaml(options.file))
        print(planner.preview(planner.narrowed(plan, options.only) if options.only else plan))
        return 0
    if options.command == "check":
        from scriptorium.operators import lint
        from scriptorium.sources.files import read_yaml

        rules = lint.Rules.of(read_yaml(options.rules)) if options.rules else lint.Rules()
        worst = 0
        for file in options.files:
            found = list(lint.findings(Path(file).read_text("utf-8", "replace"), Path(file).stem, rules))
            levels = {level: sum(f[0] == level for f in found) for level in lint.LEVELS}
            status = "error" if levels["P0"] else "warning" if levels["P1"] else "ok"
            worst = max(worst, ("ok", "warning", "error").index(status))
            say({"file": file, "status": status, **levels, "findings": found})
        return worst
    if options.command == "state":
        from scriptorium.sources.writes import load_state

        say(load_state(Path(options.folder) / "state.json") or {})
        return 0
    from scriptorium import catalog

    if options.command == "queries":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if options.name not in catalog.queries():
        print(f"no query {options.name}", file=sys.stderr)
        return 2
    from scriptorium import build_session

    spark = build_session("scriptorium", options.master)
    rows = catalog.queries()[options.name](spark, options.folder)
    if options.explain:
        rows.explain("formatted")
    elif options.output:
        rows.write.parquet(options.output)
        say({"query": options.name, "output": options.output})
    else:
        for row in rows.limit(options.show).collect():
            say(row.asDict(recursive=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
