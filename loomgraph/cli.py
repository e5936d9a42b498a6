"""The command line: `python -m loomgraph ...`. Answers are lines of JSON; errors go to standard error with status 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from importlib.metadata import version as installed

from pyspark.sql import DataFrame, SparkSession

from loomgraph import ask as asking
from loomgraph import settings as configured
from loomgraph.context import rows, write_context, write_snapshot
from loomgraph.workspace import Workspace, as_dict

VERSION = "0.3.0"


def _between(least: int, most: int):
    def number(text: str) -> int:
        if not least <= (n := int(text)) <= most:
            raise argparse.ArgumentTypeError(f"a number from {least} to {most}")
        return n

    return number


def parser(s: configured.Settings) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    top.add_argument("--workspace", default=s.workspace, help="folder of the stored projects")
    commands = top.add_subparsers(dest="command", required=True)

    def command(group, name: str, help: str, *, project: bool = True, term: bool = False, limit: int = 0, include: bool = False):
        p = group.add_parser(name, help=help)
        if project:
            p.add_argument("project")
        if term:
            p.add_argument("term")
        if limit:
            p.add_argument("--limit", type=_between(1, 10_000), default=limit)
        if include:
            p.add_argument("--include", action="append", metavar="PROJECT", help="answer beside this project too; may be repeated")
        return p

    command(commands, "version", "the version", project=False)
    command(commands, "init", "make the workspace", project=False)
    command(commands, "doctor", "what the command line runs with", project=False)
    command(commands, "find", "entities by name", term=True, limit=100, include=True)
    calls = command(commands, "calls", "call chains", term=True, limit=200, include=True)
    calls.add_argument("--direction", choices=["both", "incoming", "outgoing"], default="both")
    calls.add_argument("--depth", type=_between(1, 10), default=1)
    command(commands, "impact", "what depends on a term", term=True, limit=500, include=True).add_argument("--depth", type=_between(1, 10), default=2)
    context = command(commands, "context", "write the context package of a term", term=True, include=True)
    context.add_argument("output")
    context.add_argument("--depth", type=_between(1, 10), default=1)
    audit = command(commands, "audit", "how calls were resolved", limit=50)
    audit.add_argument("--group-by", choices=["reason", "name", "qualifier"], default="reason")
    question = command(commands, "ask", "prepare the prompt of a question (no provider is included)", include=True)
    question.add_argument("question")
    question.add_argument("--term")
    question.add_argument("--depth", type=_between(1, 10), default=2)
    question.add_argument("--output", default=s.output)
    for p in (context, question):
        p.add_argument("--max-chars", type=_between(1, 1_000_000), default=s.max_chars)
        p.add_argument("--max-units", type=_between(1, 200), default=s.max_units)
    question.add_argument("--max-prompt-chars", type=_between(20_000, 2_000_000), default=s.max_prompt_chars)

    project = commands.add_parser("project", help="projects of the workspace").add_subparsers(dest="subcommand", required=True)
    command(project, "add", "a project of the sources in a folder").add_argument("root")
    command(project, "list", "all projects", project=False)
    command(project, "show", "a project and its files", limit=100)
    command(project, "scan", "bring the catalogue in line with the folder")
    analyze = command(project, "analyze", "scan, parse what changed, resolve what that changes", include=True)
    analyze.add_argument("--force", action="store_true")
    analyze.add_argument("--no-scan", action="store_true")
    command(project, "resolve", "resolve calls", include=True).add_argument("--force", action="store_true")
    command(project, "summary", "counts")
    command(project, "find", "objects and symbols whose name holds a term", term=True, limit=100)
    command(project, "callers", "calls of what a term names", term=True)
    command(project, "callees", "calls from what a term names", term=True)
    dependencies = command(project, "dependencies", "edges of what a term names", term=True, limit=200)
    dependencies.add_argument("--outgoing", action="store_true")
    command(project, "queries", "tables that embedded queries name").add_argument("term", nargs="?")
    command(project, "snapshot", "write a project as one ordered document").add_argument("output")
    command(project, "remove", "take a project out")
    return top


def answer(a: argparse.Namespace, s: configured.Settings, spark: SparkSession) -> DataFrame | Iterable[dict]:
    """What a command says: a bounded DataFrame, or a few records."""
    space = Workspace(spark, a.workspace)
    opened = lambda: space.open(a.project, getattr(a, "include", None))
    if a.command == "project":
        match a.subcommand:
            case "add":
                space.add(a.project, a.root)
                return [{"added": a.project}]
            case "list":
                return space.projects()
            case "show":
                return [space.status(a.project), *rows(space.files(a.project).limit(a.limit))]
            case "scan":
                return [as_dict(space.scan(a.project))]
            case "analyze":
                return [as_dict(space.analyze(a.project, a.force, not a.no_scan, a.include or ()))]
            case "resolve":
                return [{"calls_resolved": space.resolve(a.project, a.include or (), a.force), **rows(opened().audit_counters())[0]}]
            case "summary":
                return opened().summary()
            case "find":
                return opened().search(a.term, a.limit)
            case "callers":
                return opened().callers(a.term)
            case "callees":
                return opened().callees(a.term)
            case "dependencies":
                return opened().dependencies(a.term, not a.outgoing, a.limit)
            case "queries":
                return opened().query_usage(a.term)
            case "snapshot":
                write_snapshot(opened(), a.output)
                return [{"written": a.output}]
            case "remove":
                space.remove(a.project)
                return [{"removed": a.project}]
    match a.command:
        case "init":
            return [{"workspace": a.workspace, "projects": len(space.projects())}]
        case "doctor":
            return [{"spark": installed("pyspark"), "master": spark.sparkContext.master, "workspace": a.workspace, "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None), "projects": len(space.projects())}]
        case "find":
            return opened().find(a.term, a.limit)
        case "calls":
            return opened().calls(a.term, a.direction, a.depth, a.limit)
        case "impact":
            return opened().impact(a.term, a.depth, a.limit)
        case "audit":
            return opened().audit(a.group_by, a.limit)
        case "context":
            return [{"written": str(write_context(opened(), a.term, a.output, depth=a.depth, max_chars=a.max_chars, max_units=a.max_units))}]
        case "ask":
            return [asking.ask(opened(), a.question, a.output, term=a.term, model=s.model, reasoning_effort=s.reasoning_effort, depth=a.depth, max_chars=a.max_chars, max_units=a.max_units, max_prompt_chars=a.max_prompt_chars, max_output_tokens=s.max_output_tokens)]
    raise AssertionError(a.command)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        s = configured.load()
        a = parser(s).parse_args(arguments)
        if a.command == "version":
            print(VERSION)
            return 0
        said = answer(a, s, spark or SparkSession.builder.master(s.master).appName("loomgraph").getOrCreate())
        lines = (r.j for r in said.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) AS j").toLocalIterator()) if isinstance(said, DataFrame) else (json.dumps(x, ensure_ascii=False) for x in said)
        for line in lines:
            print(line)
        return 0
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
