"""What happens to diagnostics after the rules: severities, suppression, merging, filters, limits and totals.

Small sides (rule lists, overrides) come as Python values and become expressions; tables that grow
with a project (directives, baselines, changed lines) are joined by keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, lines_of
from .rules import CATALOG

#: The word that begins a directive in a comment.
MARKER = "lint"
ACTIONS = "disable-next-line|disable-line|disable|enable"
# Codes that mean little in headers, where macro bodies aren't code yet, and the extensions of headers.
HEADER_CODES = ["W203", "W205", "W216", "W217", "W219", "W220", "W221", "W222", "W223", "W224", "W226"]
HEADER_EXTENSIONS = ["h", "hpp", "ext", "cpp", "cfg", "inc"]
_CODE = r"\b[EeWw]\d{3}\b"


def override_severities(d: DataFrame, levels: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Severities by code; off drops a finding. strict makes errors of warnings before the overrides."""
    severity = F.when((F.col("severity") == "warning") & F.lit(strict), "error").otherwise(F.col("severity"))
    if levels:
        table = F.create_map(*[F.lit(x) for code, level in levels.items() for x in (code.upper(), level)])
        severity = F.coalesce(table[F.upper("code")], severity)
    return d.withColumn("severity", severity).where("severity <> 'off'")


def ignore_rules(d: DataFrame, codes: Iterable[str]) -> DataFrame:
    listed = sorted({c.upper() for c in codes})
    return d.where(~F.upper("code").isin(*listed)) if listed else d


def select_rules(d: DataFrame, selected: Iterable[str], catalog: DataFrame) -> DataFrame:
    """Only the findings of rules that are named by code or category."""
    names = list(selected)
    kept = catalog.where(F.upper("code").isin([n.upper() for n in names]) | F.arrays_overlap("categories", F.array(*[F.lit(n.lower()) for n in names]))).select("code")
    return d.join(F.broadcast(kept), "code", "left_semi")  # at most the catalog


def directives(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file, line, last_line, action, codes, reason, malformed, unknown) of the directives in comments. codes is null for all rules."""
    lines = sources.select("file", F.posexplode(lines_of(F.col("text"))).alias("n", "text"), F.size(lines_of(F.col("text"))).alias("last_line"))
    lines = lines.where(F.col("text").rlike(rf"(?i)//\s*{marker}\s*:"))
    shape = rf"(?i)//\s*{marker}:\s*({ACTIONS})\b(.*)$"
    action, rest = F.lower(F.regexp_extract("text", shape, 1)), F.regexp_extract("text", shape, 2)
    codes = F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(_CODE), 0), F.upper))
    head = F.split(rest, "--", 2)[0]
    reason = F.when(F.contains(rest, F.lit("--")), F.trim(F.split(rest, "--", 2)[1])).otherwise(F.trim(F.regexp_replace(rest, _CODE, ""), F.lit(" -:;")))
    unknown = F.array_except(F.transform(F.regexp_extract_all(head, F.lit(_CODE), 0), F.upper), F.array(*[F.lit(c) for c in CATALOG]))
    return lines.select("file", (F.col("n") + 1).alias("line"), "last_line", action.alias("action"), F.when(F.size(codes) > 0, codes).alias("codes"), reason.alias("reason"), (action == "").alias("malformed"), F.when(action != "", unknown).alias("unknown"))


def suppressed_ranges(dirs: DataFrame) -> DataFrame:
    """(file, code, first, last) of lines in which a directive turns a code off; code * is all.

    A region ends where a directive turns on the same code or, bare, everything; turning on one code
    doesn't end a region of all.
    """
    good = dirs.where("not malformed").withColumn("code", F.explode(F.coalesce("codes", F.array(F.lit("*")))))
    lone = good.where("action in ('disable-next-line','disable-line')").select("file", "code", (F.col("line") + (F.col("action") == "disable-next-line").cast("int")).alias("first"))
    lone = lone.withColumn("last", F.col("first"))
    off = good.where("action = 'disable'").select("file", "code", F.col("line").alias("first"), "last_line")
    on = good.where("action = 'enable'").select("file", F.col("code").alias("on"), "line")
    ends = off.join(on, "file", "left").where("line is null or (line > first and (on = '*' or on = code))")
    closed = ends.groupBy("file", "code", "first").agg((F.min("line") - 1).alias("end"))
    regions = off.join(closed, ["file", "code", "first"], "left").select("file", "code", "first", F.coalesce("end", "last_line").alias("last"))
    return lone.unionByName(regions).distinct()


def suppress(d: DataFrame, dirs: DataFrame) -> DataFrame:
    """Findings that no directive of their file covers. The join is by file, with the range behind it."""
    r = suppressed_ranges(dirs)
    return d.alias("d").join(r.alias("r"), (F.col("d.file") == F.col("r.file")) & F.col("d.line").between(F.col("r.first"), F.col("r.last")) & ((F.col("r.code") == "*") | (F.col("r.code") == F.col("d.code"))), "left_anti")


def suppression_quality(d: DataFrame, dirs: DataFrame, need_reason: bool = False) -> DataFrame:
    """Findings about the directives: malformed or unknown ones, those without a reason, those that match nothing in d."""

    def made(rows: DataFrame, code: str, message: Column | str) -> DataFrame:
        text = F.lit(message) if isinstance(message, str) else message
        return rows.select("file", "line", F.lit(1).alias("column"), F.lit(CATALOG[code][0]).alias("severity"), F.lit(code).alias("code"), text.alias("message"), F.lit(900).alias("pass_no"), F.col("line").alias("seq"))

    out = made(dirs.where("malformed"), "W231", "malformed suppression directive")
    out = out.union(made(dirs.select("file", "line", F.explode("unknown").alias("u")), "W231", F.concat(F.lit("unknown suppression rule: "), "u")))
    good = dirs.where("not malformed")
    if need_reason:
        out = out.union(made(good.where("reason = ''"), "W229", "suppression requires a justification comment"))
    off = good.where("action <> 'enable'").select("file", "line", "action", "codes", "last_line")
    on = good.where("action = 'enable'").select("file", F.col("line").alias("at"), F.col("codes").alias("on"))
    meets = F.col("on").isNull() | F.col("codes").isNull() | F.arrays_overlap("on", "codes")
    ends = off.where("action = 'disable'").join(on, "file").where((F.col("at") > F.col("line")) & meets).groupBy("file", "line").agg(F.min("at").alias("end"))
    spans = off.join(ends, ["file", "line"], "left")
    first = F.when(F.col("action") == "disable-line", F.col("line")).otherwise(F.col("line") + 1)
    last = F.when(F.col("action") == "disable-line", F.col("line")).when(F.col("action") == "disable-next-line", F.col("line") + 1).otherwise(F.coalesce(F.col("end") - 1, F.col("last_line")))
    spans = spans.withColumns({"first": first, "last": last})
    hit = d.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("code").alias("_c"))
    idle = spans.join(hit, (F.col("file") == F.col("_f")) & F.col("_l").between(F.col("first"), F.col("last")) & (F.col("codes").isNull() | F.array_contains("codes", F.col("_c"))), "left_anti")
    return out.union(made(idle, "W230", "suppression does not match any diagnostic"))


def merge_equal(d: DataFrame) -> DataFrame:
    """One finding for each file, place, severity, code and message: the one of the earliest pass."""
    return d.groupBy("file", "line", "column", "severity", "code", "message").agg(F.min(F.struct("pass_no", "seq")).alias("_f")).select("file", "line", "column", "severity", "code", "message", "_f.pass_no", "_f.seq")


def drop_in_headers(d: DataFrame, ext: Column) -> DataFrame:
    return d.where(~(F.col("code").isin(*HEADER_CODES) & ext.isin(*HEADER_EXTENSIONS)))


def fingerprints(d: DataFrame | None = None) -> Column:
    """The fingerprint of a row's code, file, place and message."""
    return fingerprint(F.col("code"), F.col("file"), F.col("line"), F.col("column"), F.col("message"))


def without_baseline(d: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that an earlier run didn't have. baseline: fingerprint."""
    return d.withColumn("fingerprint", fingerprints(d)).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").drop("fingerprint")


def on_changed_lines(d: DataFrame, changed: DataFrame) -> DataFrame:
    return d.join(changed.select("file", "line").distinct(), ["file", "line"], "left_semi")


def first_findings(d: DataFrame, most: int) -> DataFrame:
    """At most so many findings in the order of files and passes."""
    return d.orderBy("file", "pass_no", "seq", "line", "column", "code", "message").limit(most)


def reported(d: DataFrame, most: int | None = None, baseline: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """What is shown: the first findings, of them those that the baseline lacks, of those again the first, on changed lines."""
    if most is not None:
        d = first_findings(d, most)
    if baseline is not None:
        d = without_baseline(d, baseline)
    return d if changed is None else on_changed_lines(d, changed)


def rank_of(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def exit_code(d: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: exit_code 1 if a finding is at or above the level, else 0; never 1 for none."""
    least = {"error": 3, "warning": 2, "info": 1, "none": 9}[fail_on]
    return d.agg(F.coalesce(F.max(F.when(rank_of(F.col("severity")) >= least, 1).otherwise(0)), F.lit(0)).cast("int").alias("exit_code"))


def totals(d: DataFrame) -> DataFrame:
    """Findings by code and severity, with subtotals."""
    return d.rollup("code", "severity").agg(F.count("*").alias("n"))


def safe_edits(sources: DataFrame, toks: DataFrame) -> DataFrame:
    """Edits that keep a text's meaning: trailing blanks, tabs, commas before a closing bracket. Where two overlap, the earlier stays."""
    rows = sources.select("file", F.col("text"), F.regexp_extract_all("text", F.lit("[ \t]+(?=\r|\n|$)|\t"), 0).alias("_t"))
    marks = rows.select("file", "text", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("base", F.coalesce(F.sum(F.length("body") + 1).over(w), F.lit(0)))
    body = F.regexp_replace("body", "\r+$", "")
    bare = F.regexp_replace(body, "[ \t]++$", "")
    tail = marks.where(F.length(body) > F.length(bare)).select("file", (F.col("n") + 1).alias("line"), (F.length(bare) + 1).alias("column"), (F.col("base") + F.length(bare)).alias("start"), (F.col("base") + F.length(body)).alias("end"), F.lit("").alias("replacement"), F.lit("W301").alias("rule"))
    chars = marks.where(F.contains(body, F.lit("\t"))).select("file", "n", "base", F.posexplode(F.split(body, "")).alias("k", "c")).where("c = '\t'")
    single = chars.select("file", (F.col("n") + 1).alias("line"), (F.col("k") + 1).alias("column"), (F.col("base") + F.col("k")).alias("start"), (F.col("base") + F.col("k") + 1).alias("end"), F.lit("    ").alias("replacement"), F.lit("W302").alias("rule"))
    order = Window.partitionBy("file").orderBy("i")
    commas = toks.where("type <> 'comment'").withColumn("_n", F.lead("type").over(order)).where("type = 'comma' and _n = 'rbracket'")
    comma = commas.select("file", "line", F.col("col").alias("column"), F.col("off").cast("bigint").alias("start"), (F.col("off") + 1).cast("bigint").alias("end"), F.lit("").alias("replacement"), F.lit("E003").alias("rule"))
    every = tail.unionByName(single).unionByName(comma)
    # edits are single characters or one tail a line, so only a tail can cover others: those that begin in it go
    inside = Window.partitionBy("file").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("_end", F.max("end").over(inside)).where("_end is null or start >= _end").drop("_end")


def fixed_text(text: Column) -> Column:
    """A text without trailing blanks and with four spaces for a tab."""
    return F.replace(F.regexp_replace(text, "[ \t]++(?=\r?\n|\r|$)", ""), F.lit("\t"), F.lit("    "))
