"""The whole chain over a corpus: kinds of files, all rules, filters, severities, suppression, merging.

`lint` is the library's entry point: one DataFrame of sources in, one of findings out. Every kind of file has its
rules; a kind without files costs a filter. Null texts count as empty, repeated files give each finding once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import config_rules, diagnostics, flow, postfilters, preprocess, rules, types
from .operators.plugins import PluginRule, run_plugins
from .operators.rules import CATALOG, Project
from .schemas import DIAGNOSTIC_COLUMNS
from .session import kept

STYLE = [rules.trailing_blanks, rules.tabs]
#: What joins a config's name and the place of code in it.
_PLACE = "\x1f"
Rule = Callable[[Project], DataFrame]


def _embedded(p: Project, checks: list[Rule]) -> DataFrame:
    """Findings on code in the properties of configs, at their place in the config."""
    code = config_rules.embedded_code(p, config_rules.CODE_FIELDS)
    name = F.concat("file", F.lit(_PLACE), F.col("line").cast("string"), F.lit(_PLACE), F.col("col").cast("string"))
    inner = Project(kept(code.select(name.alias("file"), F.col("code").alias("text")), "embedded"), p.registry, True)
    found = _united(inner, checks)
    part = lambda k: F.split_part("file", F.lit(_PLACE), F.lit(k))
    at = found.select("*", part(1).alias("_f"), part(2).cast("int").alias("_l"), part(3).cast("int").alias("_c"))
    return at.select(F.col("_f").alias("file"), (F.col("line") + F.col("_l") - 1).alias("line"), F.when(F.col("line") == 1, F.col("column") + F.col("_c") - 1).otherwise(F.col("column")).alias("column"), "code", "message", "seq", "pass_no")


def _united(p: Project, checks: Iterable[Rule], first: int = 0) -> DataFrame:
    out = None
    for number, check in enumerate(checks):
        part = check(p).select("file", "line", "column", "code", "message", "seq").withColumn("pass_no", F.lit(first + number))
        out = part if out is None else out.unionByName(part)
    return out


def lint(
    sources: DataFrame, registry: DataFrame, *, commands: DataFrame | None = None, function_types: DataFrame | None = None, function_returns: DataFrame | None = None, ignored: Iterable[str] = (), severities: Mapping[str, str] | None = None,
    strict: bool = False, style: bool = False, check_suppressions: bool = False, plugins: list[PluginRule] | None = None, external: DataFrame | None = None, roots: Iterable[str] = (), named: Iterable[str] = (),
) -> DataFrame:
    """Findings of all rules over sources (file, text, ...). registry: (kind, name); commands: signatures as
    addons.signatures gives them, without which the type rules stay silent; function_types: (name, pos, types);
    function_returns: (name, type); external: (file, name) of locals from elsewhere; roots and named decide which missions count."""
    sources = kept(sources.select("file", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["file"]), "sources")
    kinds = postfilters.protect_apostrophes(sources).withColumn("kind", postfilters.kind_of(F.col("file"), list(roots), list(named)))
    of = {kind: Project(kinds.where(F.col("kind") == kind).select("file", "text"), registry, True) for kind in ("sqf", "config", "mission")}
    typed: list[Rule] = []
    if commands is not None:
        typed = [partial(r, commands=commands, functions=function_returns) for r in (types.operands, types.call_targets, types.comparisons)]
        if function_types is not None:
            typed.append(partial(types.arguments, signatures=function_types, commands=commands, functions=function_returns))
    if function_types is not None:
        most = function_types.groupBy("name").agg((F.max("pos") + 1).alias("most"))
        typed.append(partial(rules.argument_counts, signatures=most))
    plain = [r for r in rules.RULES if r not in STYLE and r is not rules.shadowed_locals] + [partial(rules.shadowed_locals, external=external)]
    checks = [*plain, *typed, *(STYLE if style else [])]
    found = _united(of["sqf"], [*checks, preprocess.directive_rules, preprocess.include_rules, flow.flow_rules])
    found = found.unionByName(_united(of["config"], config_rules.CONFIG_RULES, 200)).unionByName(_embedded(of["config"], [*plain, *typed])).unionByName(_united(of["mission"], config_rules.MISSION_RULES, 300))
    included = preprocess.include_graph(Project(sources, registry)).select(F.col("dst").alias("file"), F.lit("W209").alias("code")).distinct()
    found = found.join(included, ["file", "code"], "left_anti")  # who includes a file may use its locals
    levels = F.create_map(*[F.lit(x) for code, (level, _) in CATALOG.items() for x in (code, level)])
    found = found.withColumn("severity", levels[F.col("code")]).select(*DIAGNOSTIC_COLUMNS)
    if plugins:
        found = found.unionByName(run_plugins(of["sqf"].sources, plugins))
    found = kept(found, "found")
    found = diagnostics.drop_in_headers(postfilters.drop_unfounded(found, sources), F.lower(F.regexp_extract("file", r"\.([^./\\]+)$", 1)))
    found = diagnostics.override_severities(found, severities or {}, strict)
    directives = diagnostics.directives(sources)
    if check_suppressions:
        found = found.unionByName(diagnostics.suppression_quality(found, directives, True))
    return diagnostics.merge_equal(diagnostics.ignore_rules(diagnostics.suppress(found, directives), ignored))
