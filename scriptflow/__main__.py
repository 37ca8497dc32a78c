"""Command line: lint, rules, editor server, tool server."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import serve
from .lint import lint
from .operators import diagnostics, rules, sinks
from .session import get_session
from .sources import files

FORMATS = ("text", "json", "sarif", "checkstyle", "annotations")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("scriptflow")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("lint", help="lint files and folders")
    one.add_argument("paths", nargs="+")
    one.add_argument("--format", choices=FORMATS, default="text")
    one.add_argument("--fail-on", choices=["error", "warning", "info", "none"], default="error")
    one.add_argument("--max-issues", type=int)
    one.add_argument("--select", action="append", default=[])
    one.add_argument("--ignore", action="append", default=[])
    one.add_argument("--severity", action="append", default=[], metavar="CODE=LEVEL")
    one.add_argument("--baseline")
    for flag in ("style", "strict", "fix", "check-suppressions", "timings"):
        one.add_argument(f"--{flag}", action="store_true")
    commands.add_parser("rules", help="the catalog as Markdown")
    commands.add_parser("lsp", help="serve an editor on standard streams")
    commands.add_parser("mcp", help="serve tools on standard streams")
    for parser in commands.choices.values():
        parser.add_argument("--registry", action="append", default=[], metavar="KIND=FILE")
    return top


def main(argv: list[str] | None = None) -> int:
    given = arguments().parse_args(argv)
    spark = get_session("scriptflow")
    registry = rules.empty_registry(spark)
    for kind, path in (r.split("=", 1) for r in given.registry):
        registry = files.additive_union(registry, files.read_registry(spark, path, kind))
    if given.command == "rules":
        print(*(r["report"] for r in sinks.catalog_table(rules.catalog(spark)).collect()), sep="\n")
        return 0
    if given.command == "lsp":
        check = lambda file, text: serve.lint_texts(spark, registry, {file: text})
        return serve.run_framed(serve.EditorServer(check), sys.stdin.buffer, sys.stdout.buffer)
    if given.command == "mcp":
        return serve.run_lines(serve.ToolServer(spark, registry), sys.stdin, sys.stdout)

    times = sinks.Timings()
    with times.step("collection"):
        sources = files.read_paths(spark, given.paths)
        if given.fix:
            sinks.write_fixed(sources.where(F.col("ext") == "sqf"))
            sources = files.read_paths(spark, given.paths)
    with times.step("lint"):
        levels = dict(s.split("=", 1) for s in given.severity)
        found = lint(sources, registry, ignored=given.ignore, severities=levels, strict=given.strict, style=given.style, check_suppressions=given.check_suppressions, roots=given.paths, named=given.paths)
        if given.select:
            found = diagnostics.select_rules(found, given.select, rules.catalog(spark))
        baseline = files.read_baseline(spark, given.baseline) if given.baseline else None
        if baseline is not None:
            baseline = baseline.select(diagnostics.fingerprints().alias("fingerprint"))
        found = diagnostics.reported(found, given.max_issues, baseline)
        code = diagnostics.exit_code(found, given.fail_on).first()["exit_code"]
    order = ["file", "pass_no", "seq", "line", "column", "code", "message"]
    report = {"text": lambda: sinks.text_lines(found.orderBy(*order)), "json": lambda: sinks.json_array(found), "sarif": lambda: sinks.sarif(found, [{"id": c, "name": n} for c, (_, n) in sorted(rules.CATALOG.items())]), "checkstyle": lambda: sinks.checkstyle(found), "annotations": lambda: sinks.annotations(found.orderBy(*order))}
    for row in report[given.format]().toLocalIterator():
        print(row["report"])
    if given.format == "text":
        print(sinks.summary(found, sources).first()["report"])
    if given.timings:
        print(times.report(), file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
