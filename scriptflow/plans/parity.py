"""Queries over the driver's tables, each with the same result in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators import addons, config_rules, diagnostics, flow, includes, lexer, preprocess, rules, sinks, structure, symbols, types
from ..session import shared_dir
from ..sources import files
from ..streaming import watch
from .scripts import COMMANDS, FUNCTIONS, SCRIPTS_SQL, lexed_sql, project, registry, script_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NAMES = "(" + ", ".join(f"'{n}'" for n in [*COMMANDS, *FUNCTIONS]) + ")"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _longs(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that both engines show one type."""
    return df.select(*(F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name) for f in df.schema))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _longs(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Rules that read the tokens more than twice.
_SEVERAL = [rules.brackets, rules.missing_then, rules.missing_commas, rules.unended_blocks, rules.unused_locals, rules.shadowed_locals, rules.event_handlers, rules.remote_calls, rules.unsaved_handles, rules.overwritten_values]


def _rule(name: str, rule: Callable[[rules.Project], DataFrame], sql: str) -> None:
    """A rule over the made scripts. sql: a query over tok, sig, pairs and ends for file, line, col, message."""
    QUERIES[name] = lambda spark, sf_dir: _longs(rule(project(spark, sf_dir, keep=rule in _SEVERAL)).select("file", "line", "column", "message").distinct())
    ORACLES[name] = f'{SCRIPTS_SQL} SELECT DISTINCT file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column", message FROM ({sql})'


# Lexing and structure

@query("script_tokens", f"{SCRIPTS_SQL} SELECT file, i, type, value, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, raw, CAST(off AS BIGINT) AS off FROM tok")
def script_tokens(spark, sf_dir):
    return lexer.tokens(script_sources(spark, sf_dir))


@query("script_symbols", f"{SCRIPTS_SQL} SELECT file, s, type, v, n1v, p1v FROM sig")
def script_symbols(spark, sf_dir):
    return project(spark, sf_dir).sig.select("file", "s", "type", "v", "n1v", "p1v")


_PAGES = "SELECT 'p' || CAST(page_id AS VARCHAR) AS file, {text} AS text FROM pages"


def _pages(spark, sf_dir, text):
    return _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.expr(text).alias("text"))


@query("lex_token_histogram", f"{lexed_sql(_PAGES.format(text='html'))} SELECT type, count(*) AS n FROM tok GROUP BY type")
def lex_token_histogram(spark, sf_dir):
    return lexer.tokens(_pages(spark, sf_dir, "html")).groupBy("type").agg(F.count("*").alias("n"))


@query("lex_lossless", "SELECT 'p' || CAST(page_id AS VARCHAR) AS file, CAST(length(html) AS BIGINT) AS chars, true AS lossless FROM pages")
def lex_lossless(spark, sf_dir):
    src = _pages(spark, sf_dir, "html")
    parts = lexer.lexemes(src).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "").alias("joined"), F.sum(F.length("raw")).alias("chars"))
    return src.join(parts, "file").select("file", "chars", (F.col("joined") == F.col("text")).alias("lossless"))


@query("bracket_balance")
def bracket_balance(spark, sf_dir):
    src = _pages(spark, sf_dir, "html")
    return _balance(src, lexer.brackets(src))


def _balance(src, sig):
    faults = structure.bracket_faults(sig)
    counts = faults.groupBy("file").agg(F.count(F.when(F.col("fault") == "unclosed", 1)).alias("unclosed"), F.count(F.when(F.col("fault") == "unmatched", 1)).alias("unmatched"))
    return src.select("file").join(counts, "file", "left").na.fill(0)


@query("bracket_spans", f"{SCRIPTS_SQL} SELECT file, open AS s, close FROM pairs")
def bracket_spans(spark, sf_dir):
    return structure.bracket_pairs(project(spark, sf_dir).sig)


@query("nesting_depth_max", f"{SCRIPTS_SQL} SELECT file, max(depth) AS depth FROM (SELECT s.file, s.s, count(p.open) AS depth FROM sig s LEFT JOIN (SELECT p.* FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbrace') p ON p.file = s.file AND p.open < s.s AND p.close > s.s GROUP BY s.file, s.s) GROUP BY file")
def nesting_depth_max(spark, sf_dir):
    sig = project(spark, sf_dir, keep=True).sig
    pairs = structure.bracket_pairs(sig).join(sig.where("type = 'lbrace'").select("file", "s"), ["file", "s"])
    edges = pairs.select("file", (F.col("s") + 1).alias("at"), F.lit(1).alias("d")).union(pairs.select("file", F.col("close"), F.lit(-1)))
    deepest = edges.groupBy("file", "at").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(Window.partitionBy("file").orderBy("at"))).groupBy("file").agg(F.max("depth").alias("depth"))
    return sig.select("file").distinct().join(deepest, "file", "left").na.fill(0)


@query("statement_sizes", f"{SCRIPTS_SQL} SELECT file, stmt, count(*) AS n FROM (SELECT file, type, coalesce(sum(CASE WHEN type = 'semicolon' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stmt FROM sig) WHERE type <> 'semicolon' GROUP BY file, stmt")
def statement_sizes(spark, sf_dir):
    return structure.statements(project(spark, sf_dir).sig).where("type <> 'semicolon'").groupBy("file", "stmt").agg(F.count("*").alias("n"))


# Rules

_rule("e001_brackets", rules.brackets, "SELECT s.file, s.line, s.col, 'unclosed ''' || s.raw || '''' AS message FROM sig s JOIN ends USING (file, s) UNION ALL SELECT s.file, s.line, s.col, 'unmatched ''' || s.raw || '''' FROM sig s JOIN fold f ON f.file = s.file AND f.bad = s.s")
_rule("e002_unterminated_strings", rules.unterminated_strings, "SELECT file, line, col, 'unterminated string' AS message FROM sig WHERE type = 'string' AND NOT ends_with(raw, raw[1])")
_rule("e003_trailing_commas", rules.trailing_commas, "SELECT file, p1line AS line, p1col AS col, 'trailing comma in array' AS message FROM sig WHERE type = 'rbracket' AND p1t = 'comma'")
_rule("e004_missing_then", rules.missing_then, """SELECT c.file, coalesce(c.n1line, c.line) AS line, coalesce(c.n1col, c.col) AS col, 'expected ''then'' after if condition' AS message
FROM sig i JOIN sig o ON o.file = i.file AND o.type = 'lparen' AND o.s = i.s + CASE WHEN i.n1t = 'operator' AND i.n1v = '!' THEN 2 ELSE 1 END JOIN pairs p ON p.file = o.file AND p.open = o.s JOIN sig c ON c.file = p.file AND c.s = p.close
WHERE i.type = 'keyword' AND i.v = 'if' AND NOT coalesce(c.n1v IN ('then','exitwith','continue','break','throw'), false)
AND NOT (coalesce(c.n1t = 'operator', false) AND EXISTS (SELECT 1 FROM sig b WHERE b.file = c.file AND b.s > c.s + 1 AND b.v IN ('then','exitwith','continue','break','throw') AND NOT EXISTS (SELECT 1 FROM sig m WHERE m.file = c.file AND m.type = 'semicolon' AND m.s > c.s + 1 AND m.s < b.s)))""")
_rule("e005_bad_else", rules.bad_else, "SELECT file, coalesce(n1line, line) AS line, coalesce(n1col, col) AS col, 'expected code block or if after ''else''' AS message FROM sig WHERE type = 'keyword' AND v = 'else' AND NOT coalesce(n1t = 'lbrace' OR (n1t = 'keyword' AND n1v = 'if'), false)")
_rule("e006_missing_commas", rules.missing_commas, "SELECT file, f.n1line AS line, f.n1col AS col, 'missing comma between array elements' AS message FROM (SELECT p.file, p.open, arg_min({'n1line': a.n1line, 'n1col': a.n1col}, a.s) AS f FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbracket' JOIN sig a ON a.file = p.file AND a.s > p.open AND a.s + 1 < p.close AND a.type IN ('number','string') AND a.n1t IN ('number','string') GROUP BY p.file, p.open)")
_rule("e007_reversed_loops", rules.reversed_loops, "SELECT file, line, col, 'expected code block before ''forEach''' AS message FROM sig WHERE type = 'keyword' AND v = 'foreach' AND n1t IN ('ident','local') AND n2t = 'lbrace'")
_rule("e008_unended_blocks", rules.unended_blocks, f"SELECT n.file, n.line, n.col, 'missing semicolon after command with code block' AS message FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbrace' AND b.p1t = 'ident' AND b.p1v IN {_NAMES} JOIN sig n ON n.file = p.file AND n.s = p.close + 1 WHERE n.type IN ('ident','local') AND n.v NOT IN ('isequalto','isnotequalto') AND n.v NOT IN {_NAMES}")
_rule("e009_postfix_commands", rules.postfix_commands, f"SELECT file, b.line AS line, b.col AS col, 'invalid postfix command expression; use ''' || b.value || ' <value>'' or assign its result' AS message FROM (SELECT file, stmt, count(*) AS n, arg_min({{'type': type, 'v': v}}, s) AS a, arg_max({{'type': type, 'v': v, 'value': value, 'line': line, 'col': col}}, s) AS b FROM (SELECT *, coalesce(sum(CASE WHEN type = 'semicolon' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt FROM sig) WHERE type <> 'semicolon' GROUP BY file, stmt) WHERE n = 2 AND a.type IN ('local','ident') AND a.v NOT IN {_NAMES} AND b.type = 'ident' AND b.v IN {_NAMES} AND b.v <> 'ctrlsetfocus'")
_rule("w201_unknown_calls", rules.unknown_calls, f"SELECT file, n1line AS line, n1col AS col, 'unknown function/command: ' || n1value AS message FROM sig WHERE type = 'keyword' AND v IN ('call','spawn') AND (n1t = 'ident' OR (n1t = 'string' AND NOT regexp_matches(n1v, '\\.(sqf|sqs|ext)$'))) AND n1v NOT IN {_NAMES}")
_rule("w202_unknown_commands", rules.unknown_commands, f"SELECT file, line, col, 'unknown command/function: ' || value AS message FROM sig WHERE type = 'ident' AND (n1t IN ('local','number','string','lparen','lbracket','lbrace') OR (n1t = 'keyword' AND n1v IN ('true','false','nil'))) AND v NOT IN {_NAMES}")
_rule("w205_value_calls", rules.value_calls, "SELECT file, n1line AS line, n1col AS col, value || ' target is a value, not code' AS message FROM sig WHERE type = 'keyword' AND v IN ('call','spawn') AND (n1t IN ('number','lbracket') OR (n1t = 'keyword' AND n1v IN ('true','false','nil')))")
_rule("w206_constant_conditions", rules.constant_conditions, "SELECT file, n1line AS line, n1col AS col, 'if condition is constant' AS message FROM sig WHERE type = 'keyword' AND v = 'if' AND n1t = 'lparen' AND (n2t IN ('number','string') OR (n2t = 'keyword' AND n2v IN ('true','false','nil'))) AND n3t = 'rparen' AND n4v = 'then'")
_DEFINED = "SELECT *, coalesce(max(CAST(func AS INT)) OVER (PARTITION BY file, v ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS before FROM (SELECT g.*, (contains(v, '_fnc_') OR EXISTS (SELECT 1 FROM sig c WHERE c.file = g.file AND c.type = 'keyword' AND c.v IN ('call','spawn') AND c.n1t = 'ident' AND c.n1v = g.v)) AND (n2t = 'lbrace' OR n2v IN ('compile','compilefinal')) AS func FROM sig g WHERE type = 'ident' AND n1v = '=' AND n2t IS NOT NULL)"
_rule("w207_duplicate_definitions", rules.duplicate_definitions, f"SELECT file, line, col, 'duplicate function definition: ' || value AS message FROM ({_DEFINED}) WHERE func AND before")
_rule("w208_overwritten_definitions", rules.overwritten_definitions, f"SELECT file, line, col, 'function overwritten by non-code value: ' || value AS message FROM ({_DEFINED}) WHERE NOT func AND before")
# braces around every token, and the array right around it
_BRACES = "SELECT p.* FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbrace'"
_ARRAYS = "SELECT p.*, b.p1t, b.p1v FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbracket'"
_SCOPED = f"SELECT s.file, s.s, list(p.open ORDER BY p.open) FILTER (p.open IS NOT NULL) AS path FROM sig s LEFT JOIN ({_BRACES}) p ON p.file = s.file AND p.open < s.s AND p.close > s.s WHERE s.type IN ('local','string') OR s.v IN ('private','params') GROUP BY s.file, s.s"
_HANDLERS = "('addeventhandler','addmissioneventhandler','addstackedeventhandler','displayaddeventhandler','ctrladdeventhandler','ctrlseteventhandler','buttonsetaction')"
_rule("w209_unused_locals", rules.unused_locals, f"""WITH sc AS MATERIALIZED ({_SCOPED}), ar AS MATERIALIZED ({_ARRAYS}), bc AS MATERIALIZED ({_BRACES}),
hd AS (SELECT DISTINCT h.file, (SELECT min(j.s) FROM sig j WHERE j.file = h.file AND j.type = 'lbracket' AND j.s > h.s) AS j FROM sig h WHERE h.v IN {_HANDLERS}),
cb AS (SELECT k.file, k.k, coalesce(b.close, 1073741824) AS close FROM (SELECT file, j, (SELECT min(l.s) FROM sig l WHERE l.file = hd.file AND l.type = 'lbrace' AND l.s > hd.j) AS k FROM hd) k LEFT JOIN ar ON ar.file = k.file AND ar.open = k.j LEFT JOIN bc b ON b.file = k.file AND b.open = k.k WHERE ar.close IS NULL OR k.k < ar.close),
al AS (SELECT t.file, t.s, arg_max(r.open, r.open) AS a FROM sig t JOIN ar r ON r.file = t.file AND t.s > r.open AND t.s < r.close WHERE t.type = 'string' AND starts_with(t.value, '_') GROUP BY t.file, t.s),
decl AS (SELECT file, s, v, value, line, col FROM sig WHERE type = 'local' AND p1t = 'keyword' AND p1v IN ('private','params')
 UNION ALL SELECT t.file, t.s, t.v, t.value, t.line, t.col FROM al JOIN sig t USING (file, s) JOIN ar ON ar.file = al.file AND ar.open = al.a WHERE ar.p1t = 'keyword' AND ar.p1v IN ('private','params') AND NOT (ar.p1v = 'params' AND EXISTS (SELECT 1 FROM cb WHERE cb.file = t.file AND cb.k < ar.open - 1 AND cb.close > ar.open - 1)))
SELECT d.file, d.line, d.col, 'unused local variable: ' || d.value AS message FROM decl d JOIN sc ds USING (file, s) WHERE d.v NOT IN ('_x','_this','_thisargs')
AND NOT EXISTS (SELECT 1 FROM sig u JOIN sc us USING (file, s) WHERE u.file = d.file AND u.type = 'local' AND u.v = d.v AND u.s > d.s AND coalesce(us.path, [])[1:len(coalesce(ds.path, []))] = coalesce(ds.path, []))
AND NOT EXISTS (SELECT 1 FROM sig h WHERE h.file = d.file AND h.type = 'keyword' AND h.v = 'for' AND h.n1t = 'string' AND h.n1v = d.v AND h.s > d.s)""")
_rule("w215_shadowed_locals", rules.shadowed_locals, f"""WITH RECURSIVE sc AS MATERIALIZED ({_SCOPED}), ar AS MATERIALIZED ({_ARRAYS}),
-- arrays of parameters and the arrays that begin their items, however deep
ch AS (SELECT file, open AS root, open, close FROM ar WHERE p1t = 'keyword' AND p1v = 'params' UNION ALL SELECT c.file, c.root, a.open, a.close FROM ch c JOIN ar a ON a.file = c.file AND a.open > c.open AND a.close < c.close AND a.p1t IN ('lbracket','comma') AND NOT EXISTS (SELECT 1 FROM ar m WHERE m.file = a.file AND m.open > c.open AND m.open < a.open AND m.close > a.close)),
nm AS (SELECT t.file, t.s - 1 AS key, t.s, t.v, t.value FROM sig t WHERE t.type = 'local' AND t.p1t = 'keyword' AND t.p1v IN ('private','params')
 UNION ALL SELECT t.file, r.open - 1, t.s, t.v, t.value FROM sig t JOIN ar r ON r.file = t.file AND t.s > r.open AND t.s < r.close AND r.p1t = 'keyword' AND r.p1v = 'private' WHERE t.type = 'string' AND starts_with(t.value, '_')
 UNION ALL SELECT t.file, c.root - 1, t.s, t.v, t.value FROM ch c JOIN sig t ON t.file = c.file AND t.s > c.open AND t.s < c.close AND t.type = 'string' AND starts_with(t.value, '_') AND t.p1t IN ('lbracket','comma') AND NOT EXISTS (SELECT 1 FROM ar m WHERE m.file = t.file AND m.open > c.open AND m.open < t.s AND m.close > t.s)),
pl AS (SELECT nm.*, coalesce(sc.path[-1], -1) AS scope, k.line, k.col, (SELECT count(*) FROM sig m WHERE m.file = nm.file AND m.v = 'method' AND m.type IN ('ident','keyword') AND m.s < nm.key) AS serial FROM nm JOIN sc ON sc.file = nm.file AND sc.s = nm.key JOIN sig k ON k.file = nm.file AND k.s = nm.key)
SELECT file, line, col, 'local declaration shadows or duplicates ' || value AS message FROM (SELECT *, row_number() OVER w AS r, first_value(serial) OVER w AS serial0 FROM pl WINDOW w AS (PARTITION BY file, scope, v ORDER BY key, s)) WHERE r > 1 AND serial = serial0""")
_rule("w218_namespace_operations", rules.namespace_operations, "SELECT file, line, col, p1value || ' ' || v || ' expects a name or [name, value] array' AS message FROM sig WHERE type IN ('ident','keyword') AND v IN ('getvariable','setvariable') AND p1v IN ('missionnamespace','profilenamespace','parsingnamespace','uinamespace','servernamespace','localnamespace','missionprofilenamespace') AND NOT coalesce(n1t IN ('string','lbracket','local','ident','keyword','lparen'), false)")
_ITEMS = """SELECT a.file, a.s, a.type, a.v, a.value, a.line, a.col, a.p1v, p.open, p.close,
 CASE WHEN p.open IS NOT NULL AND p.close > p.open + 1 THEN 1 + (SELECT count(*) FROM sig c WHERE c.file = a.file AND c.type = 'comma' AND c.s > p.open AND c.s < p.close AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file = c.file AND q.open > p.open AND q.close < p.close AND q.open < c.s AND q.close > c.s)) END AS size,
 (SELECT t.type FROM sig t WHERE t.file = a.file AND t.s = p.open + 1) AS t0, (SELECT t.v FROM sig t WHERE t.file = a.file AND t.s = p.open + 1) AS v0,
 (SELECT t.type FROM sig t WHERE t.file = a.file AND t.s = p.open + 3) AS t1
FROM sig a LEFT JOIN (SELECT p.* FROM pairs p JOIN sig b ON b.file = p.file AND b.s = p.open AND b.type = 'lbracket') p ON p.file = a.file AND p.open = a.s + 1 WHERE a.type IN ('ident','keyword')"""
_rule("w219_event_handlers", rules.event_handlers, f"""WITH e AS ({_ITEMS} AND a.v IN ('addeventhandler','removeeventhandler'))
SELECT file, line, col, value || ' expects an event name and handler' AS message FROM e WHERE v = 'addeventhandler' AND (size IS NULL OR size < 2)
UNION ALL SELECT file, line, col, value || ' expects an event name and handler id' FROM e WHERE v = 'removeeventhandler' AND (size IS NULL OR size < 2)
UNION ALL SELECT file, line, col, value || ' removes an event handler that was not registered in this file' FROM e WHERE v = 'removeeventhandler' AND size >= 2 AND t1 = 'number' AND NOT EXISTS (SELECT 1 FROM e m WHERE m.file = e.file AND m.v = 'addeventhandler' AND m.size >= 2 AND m.p1v = e.p1v AND m.t0 = 'string' AND m.v0 = e.v0 AND m.s < e.s)""")
_rule("w220_remote_calls", rules.remote_calls, f"SELECT file, line, col, value || ' expects [function, targets, jip]' AS message FROM ({_ITEMS} AND a.v IN ('remoteexec','remoteexeccall')) WHERE size IS NULL OR size NOT IN (1, 2, 3)")
_rule("w221_public_variables", rules.public_variables, "SELECT file, line, col, value || ' expects the name of a public variable as a String' AS message FROM sig WHERE type IN ('ident','keyword') AND v IN ('publicvariable','publicvariableserver','publicvariableclient') AND NOT coalesce(n1t IN ('string','local','ident','lparen'), false)")
_EPOCHS = "SELECT g.*, e.epoch, (SELECT min(m.s) FROM sig m WHERE m.file = g.file AND m.type = 'semicolon' AND m.s >= g.s) AS fin FROM sig g JOIN (SELECT file, off, sum(CASE WHEN type IN ('lbrace','rbrace') OR (type = 'preprocessor' AND regexp_matches(lower(value), '^(if|ifdef|ifndef|elif|else|endif)\\b')) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY i) AS epoch FROM tok) e USING (file, off) WHERE g.type = 'local'"
_rule("w222_overwritten_values", rules.overwritten_values, f"SELECT file, line, col, 'value assigned to ' || value || ' is overwritten before it is read' AS message FROM (SELECT *, coalesce(n1v = '=', false) AS a, coalesce(p1v = 'private', false) AS d, lag(coalesce(n1v = '=', false)) OVER w AS a0, lag(coalesce(p1v = 'private', false)) OVER w AS d0, lead(s) OVER w AS nx FROM ({_EPOCHS}) WINDOW w AS (PARTITION BY file, v, epoch ORDER BY s)) WHERE a AND NOT d AND a0 AND NOT d0 AND NOT coalesce(n2t = 'lbrace', false) AND NOT coalesce(nx < coalesce(fin, 1073741824), false)")
_rule("w223_repeated_constants", rules.repeated_constants, f"SELECT file, line, col, 'repeated constant assignment to ' || value AS message FROM (SELECT *, lag(n2value) OVER (PARTITION BY file, v, epoch ORDER BY s) AS prev FROM ({_EPOCHS}) WHERE n1v = '=' AND n2t IN ('number','string')) WHERE prev = n2value")
_rule("w224_empty_selects", rules.empty_selects, "SELECT file, line, col, 'selecting from an empty array is ineffective' AS message FROM sig WHERE type = 'lbracket' AND n1t = 'rbracket' AND n2v = 'select'")
_rule("w227_conditional_balance", rules.conditional_balance, """WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS n FROM (SELECT file, i, line, col, regexp_extract(lower(value), '^(if|ifdef|ifndef|elif|else|endif)\\b', 1) AS word FROM tok WHERE type = 'preprocessor') WHERE word <> ''),
st AS (SELECT file, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS open, CAST(NULL AS BIGINT) AS bad FROM src UNION ALL SELECT d.file, d.n, CASE WHEN d.word IN ('if','ifdef','ifndef') THEN list_append(st.open, d.n) WHEN d.word = 'endif' AND len(st.open) > 0 THEN st.open[1:-2] ELSE st.open END, CASE WHEN d.word IN ('elif','else','endif') AND len(st.open) = 0 THEN d.n END FROM st JOIN d ON d.file = st.file AND d.n = st.n + 1),
lastst AS (SELECT file, unnest(open) AS n FROM (SELECT file, arg_max(open, n) AS open FROM st GROUP BY file))
SELECT d.file, d.line, d.col, '#' || d.word || ' without a matching conditional' AS message FROM d JOIN st ON st.file = d.file AND st.bad = d.n UNION ALL SELECT d.file, d.line, 1, 'conditional directive is not closed with #endif' FROM d JOIN lastst USING (file, n)""")
_rule("w232_unsaved_handles", rules.unsaved_handles, "SELECT file, line, col, 'namespace variable ' || value || ' stores a non-serializable runtime handle' AS message FROM sig WHERE type IN ('ident','keyword') AND n1v = '=' AND n2v IN ('controlnull','displaynull','scriptnull','tasknull','controldisplay','finddisplay','displayctrl','ctrlcreate')")
_LINES = "SELECT file, n, l[n] AS text FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT file, string_split(text, chr(10)) AS l FROM src))"
_rule("w301_trailing_blanks", rules.trailing_blanks, f"SELECT file, n AS line, length(rtrim(text, ' ' || chr(9))) + 1 AS col, 'trailing whitespace at character ' || CAST(length(rtrim(text, ' ' || chr(9))) + 1 AS VARCHAR) AS message FROM ({_LINES}) WHERE text <> rtrim(text, ' ' || chr(9))")
_rule("w302_tabs", rules.tabs, f"SELECT file, n AS line, instr(text, chr(9)) AS col, 'tab character in source indentation at character ' || CAST(instr(text, chr(9)) AS VARCHAR) AS message FROM ({_LINES}) WHERE contains(text, chr(9))")


# Lines, fixes and edits

@query("line_stats", "SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM documents")
def line_stats(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(lines_of(F.col("text"))).alias("n_lines"))


@query("style_fix_text", f"{SCRIPTS_SQL} SELECT file, replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), chr(9), '    ') AS fixed FROM src")
def style_fix_text(spark, sf_dir):
    return script_sources(spark, sf_dir).select("file", diagnostics.fixed_text(F.col("text")).alias("fixed"))


@query("style_edits", f"""{SCRIPTS_SQL}, l AS ({_LINES}), b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l)
SELECT file, CAST(n AS BIGINT) AS line, CAST(length(rtrim(text, ' ' || chr(9))) + 1 AS BIGINT) AS "column", CAST(base + length(rtrim(text, ' ' || chr(9))) AS BIGINT) AS start, CAST(base + length(text) AS BIGINT) AS "end", '' AS replacement, 'W301' AS rule FROM b WHERE text <> rtrim(text, ' ' || chr(9))
UNION ALL SELECT file, n, instr(text, chr(9)), CAST(base + instr(text, chr(9)) - 1 AS BIGINT), CAST(base + instr(text, chr(9)) AS BIGINT), '    ', 'W302' FROM b WHERE contains(text, chr(9))
UNION ALL SELECT file, CAST(line AS BIGINT), CAST(col AS BIGINT), CAST(off AS BIGINT), CAST(off + 1 AS BIGINT), '', 'E003' FROM (SELECT *, lead(type) OVER (PARTITION BY file ORDER BY i) AS nx FROM tok WHERE type <> 'comment') WHERE type = 'comma' AND nx = 'rbracket'""")
def style_edits(spark, sf_dir):
    p = project(spark, sf_dir)
    return diagnostics.safe_edits(p.sources, p.tokens)


# Suppression over the made scripts: findings are the blanks and overwritten values

_DIRS = f"SELECT file, n AS line, lower(regexp_extract(text, '(?i)//\\s*lint:\\s*(disable-next-line|disable-line|disable|enable)\\b', 1)) AS action, regexp_extract_all(text, '\\b[EW][0-9]{{3}}\\b') AS codes, text FROM ({_LINES}) WHERE regexp_matches(text, '(?i)//\\s*lint\\s*:')"
_FINDINGS = f"SELECT file, n AS line, 'W301' AS code FROM ({_LINES}) WHERE text <> rtrim(text, ' ' || chr(9)) UNION ALL SELECT file, n, 'W302' FROM ({_LINES}) WHERE contains(text, chr(9))"
_OFF = "(d.action = 'disable-next-line' AND f.line = d.line + 1) OR (d.action = 'disable' AND f.line >= d.line AND f.line < coalesce((SELECT min(e.line) FROM dirs e WHERE e.file = d.file AND e.action = 'enable' AND e.line > d.line AND (len(e.codes) = 0 OR list_contains(e.codes, f.code))), 1000000))"


def _blank_findings(p):
    both = rules.trailing_blanks(p).unionByName(rules.tabs(p))
    return both.withColumns({"severity": F.lit("warning"), "pass_no": F.lit(0)}).select("file", "line", "column", "severity", "code", "message", "pass_no", "seq")


@query("suppress_inline", f"{SCRIPTS_SQL}, dirs AS ({_DIRS}), fd AS ({_FINDINGS}) SELECT file, CAST(line AS BIGINT) AS line, code FROM fd f WHERE NOT EXISTS (SELECT 1 FROM dirs d WHERE d.file = f.file AND (len(d.codes) = 0 OR list_contains(d.codes, f.code)) AND ({_OFF}))")
def suppress_inline(spark, sf_dir):
    p = project(spark, sf_dir)
    return diagnostics.suppress(_blank_findings(p), diagnostics.directives(p.sources)).select("file", "line", "code")


@query("suppression_quality", f"""{SCRIPTS_SQL}, dirs AS ({_DIRS}), fd AS ({_FINDINGS}), sizes AS (SELECT file, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS last_line FROM src),
off AS (SELECT d.*, CASE WHEN d.action = 'disable-next-line' THEN d.line + 1 ELSE coalesce((SELECT min(e.line) - 1 FROM dirs e WHERE e.file = d.file AND e.action = 'enable' AND e.line > d.line AND (len(e.codes) = 0 OR len(d.codes) = 0 OR len(list_intersect(e.codes, d.codes)) > 0)), s.last_line) END AS lst FROM dirs d JOIN sizes s USING (file) WHERE d.action IN ('disable', 'disable-next-line'))
SELECT file, CAST(line AS BIGINT) AS line, 'W230' AS code, 'suppression does not match any diagnostic' AS message FROM off d WHERE NOT EXISTS (SELECT 1 FROM fd f WHERE f.file = d.file AND f.line > d.line AND f.line <= d.lst AND (len(d.codes) = 0 OR list_contains(d.codes, f.code)))
UNION ALL SELECT file, CAST(line AS BIGINT), 'W231', 'malformed suppression directive' FROM dirs WHERE action = ''
UNION ALL SELECT file, CAST(line AS BIGINT), 'W229', 'suppression requires a justification comment' FROM dirs WHERE action <> '' AND NOT contains(text, '--') AND trim(regexp_replace(regexp_replace(text, '(?i)^.*lint:\\s*(disable-next-line|disable-line|disable|enable)', ''), '\\b[EW][0-9]{{3}}\\b', '', 'g'), ' -:;') = ''""")
def suppression_quality(spark, sf_dir):
    p = project(spark, sf_dir)
    return diagnostics.suppression_quality(_blank_findings(p), diagnostics.directives(p.sources), need_reason=True).select("file", "line", "code", "message")


# Post-processing on diagnostics made from line items

_CODES = ["E001", "E003", "W201", "W203", "W209", "W222", "W301"]
_LIST = ", ".join(f"'{c}'" for c in _CODES)
DIAGNOSTICS_SQL = f"""SELECT 's' || CAST(l_suppkey AS VARCHAR) || '.sqf' AS file, CAST(l_partkey % 50 + 1 AS BIGINT) AS line, CAST(l_linenumber AS BIGINT) AS "column", CASE WHEN code[1] = 'E' THEN 'error' ELSE 'warning' END AS severity, code, 'finding ' || l_returnflag || '|' || CAST(l_linenumber AS VARCHAR) AS message, CAST(l_linenumber AS BIGINT) AS pass_no, CAST(l_orderkey AS BIGINT) AS seq
FROM (SELECT *, ([{_LIST}])[CAST((l_orderkey + l_linenumber) % 7 + 1 AS INT)] AS code FROM lineitem)"""


def made_diagnostics(spark, sf_dir):
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 7).cast("int"))
    d = _table(spark, sf_dir, "lineitem").withColumn("code", code)
    return d.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".sqf")).alias("file"), (F.col("l_partkey") % 50 + 1).cast("bigint").alias("line"), F.col("l_linenumber").cast("bigint").alias("column"), F.when(F.col("code").startswith("E"), "error").otherwise("warning").alias("severity"), "code", F.concat(F.lit("finding "), "l_returnflag", F.lit("|"), F.col("l_linenumber").cast("string")).alias("message"), F.col("l_linenumber").cast("bigint").alias("pass_no"), F.col("l_orderkey").cast("bigint").alias("seq"))


_D = f"WITH d AS ({DIAGNOSTICS_SQL})"
_SHOWN = 'file, line, "column", severity, code, message'


@query("dedup_diagnostics", f"{_D} SELECT {_SHOWN}, f.pass_no AS pass_no, f.seq AS seq FROM (SELECT {_SHOWN}, min({{'pass_no': pass_no, 'seq': seq}}) AS f FROM d GROUP BY ALL)")
def dedup_diagnostics(spark, sf_dir):
    return diagnostics.merge_equal(made_diagnostics(spark, sf_dir))


@query("severity_override", f"{_D} SELECT severity, code, count(*) AS n FROM (SELECT code, CASE code WHEN 'W201' THEN 'error' WHEN 'E003' THEN 'info' WHEN 'W301' THEN 'off' ELSE severity END AS severity FROM d) WHERE severity <> 'off' GROUP BY severity, code")
def severity_override(spark, sf_dir):
    d = diagnostics.override_severities(made_diagnostics(spark, sf_dir), {"w201": "error", "E003": "info", "W301": "off"})
    return d.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("strict_preset", f"{_D} SELECT 'error' AS severity, code, count(*) AS n FROM d GROUP BY code")
def strict_preset(spark, sf_dir):
    return diagnostics.override_severities(made_diagnostics(spark, sf_dir), {}, strict=True).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("ignore_rules", f"{_D} SELECT code, count(*) AS n FROM d WHERE code NOT IN ('W201', 'E001') GROUP BY code")
def ignore_rules(spark, sf_dir):
    return diagnostics.ignore_rules(made_diagnostics(spark, sf_dir), ["w201", "E001"]).groupBy("code").agg(F.count("*").alias("n"))


@query("rule_selection", f"{_D} SELECT code, count(*) AS n FROM d WHERE code IN ('W209', 'W222', 'E003') GROUP BY code")
def rule_selection(spark, sf_dir):
    return diagnostics.select_rules(made_diagnostics(spark, sf_dir), ["flow", "E003"], rules.catalog(spark)).groupBy("code").agg(F.count("*").alias("n"))


_PRINT = "substring(sha256(concat_ws('|', code, file, CAST(line AS VARCHAR), CAST(\"column\" AS VARCHAR), message)), 1, 24)"


@query("fingerprints", f"{_D} SELECT DISTINCT {_PRINT} AS fingerprint FROM d")
def fingerprints(spark, sf_dir):
    return made_diagnostics(spark, sf_dir).select(diagnostics.fingerprints(None).alias("fingerprint")).distinct()


@query("baseline_filter", f"{_D} SELECT {_SHOWN}, pass_no, seq FROM d WHERE {_PRINT} NOT IN (SELECT {_PRINT} FROM d WHERE seq % 3 = 0)")
def baseline_filter(spark, sf_dir):
    d = made_diagnostics(spark, sf_dir)
    return diagnostics.without_baseline(d, d.where("seq % 3 = 0").select(diagnostics.fingerprints(d).alias("fingerprint")))


@query("diff_filter", f"{_D} SELECT {_SHOWN}, pass_no, seq FROM d WHERE (file, line) IN (SELECT 's' || CAST(o_custkey % 100 AS VARCHAR) || '.sqf', o_orderkey % 50 + 1 FROM orders WHERE o_orderstatus = 'O')")
def diff_filter(spark, sf_dir):
    changed = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("s"), (F.col("o_custkey") % 100).cast("string"), F.lit(".sqf")).alias("file"), (F.col("o_orderkey") % 50 + 1).alias("line"))
    return diagnostics.on_changed_lines(made_diagnostics(spark, sf_dir), changed).select("file", "line", "column", "severity", "code", "message", "pass_no", "seq")


@query("max_issues", f"{_D} SELECT {_SHOWN}, pass_no, seq FROM d ORDER BY file, pass_no, seq, line, \"column\", code, message LIMIT 100")
def max_issues(spark, sf_dir):
    return diagnostics.first_findings(made_diagnostics(spark, sf_dir), 100)


@query("exit_code", f"{_D} SELECT CAST(coalesce(max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS exit_code FROM d")
def exit_code(spark, sf_dir):
    return diagnostics.exit_code(made_diagnostics(spark, sf_dir))


@query("rule_rollup", f"{_D} SELECT code, severity, count(*) AS n FROM d GROUP BY ROLLUP (code, severity)")
def rule_rollup(spark, sf_dir):
    return diagnostics.totals(made_diagnostics(spark, sf_dir))


@query("header_filter", f"{_D} SELECT code, count(*) AS n FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'hpp' ELSE 'sqf' END AS ext FROM d) WHERE NOT (ext = 'hpp' AND code IN ('W203','W205','W216','W217','W219','W220','W221','W222','W223','W224','W226')) GROUP BY code")
def header_filter(spark, sf_dir):
    d = made_diagnostics(spark, sf_dir).withColumn("ext", F.when(F.col("seq") % 2 == 0, "hpp").otherwise("sqf"))
    return diagnostics.drop_in_headers(d, F.col("ext")).groupBy("code").agg(F.count("*").alias("n"))


@query("sink_text", f"{_D} SELECT file || ':' || CAST(line AS VARCHAR) || ':' || CAST(\"column\" AS VARCHAR) || ': ' || severity || ' [' || code || ']: ' || message AS report FROM d")
def sink_text(spark, sf_dir):
    return sinks.text_lines(made_diagnostics(spark, sf_dir)).select("report")


@query("sink_json", f"{_D} SELECT '{{\"file\":\"' || file || '\",\"line\":' || CAST(line AS VARCHAR) || ',\"column\":' || CAST(\"column\" AS VARCHAR) || ',\"severity\":\"' || severity || '\",\"code\":\"' || code || '\",\"message\":\"' || message || '\"}}' AS report FROM d")
def sink_json(spark, sf_dir):
    return sinks.json_rows(made_diagnostics(spark, sf_dir))


@query("sink_annotations", f"{_D} SELECT '::' || severity || ' file=' || file || ',line=' || CAST(line AS VARCHAR) || ',col=' || CAST(\"column\" AS VARCHAR) || ',title=' || code || '::' || message AS report FROM d")
def sink_annotations(spark, sf_dir):
    return sinks.annotations(made_diagnostics(spark, sf_dir))


@query("sink_checkstyle", f"{_D} SELECT file, '<file name=\"' || file || '\">' || string_agg('<error line=\"' || CAST(line AS VARCHAR) || '\" column=\"' || CAST(\"column\" AS VARCHAR) || '\" severity=\"' || severity || '\" message=\"' || message || '\" source=\"' || code || '\"/>', '' ORDER BY pass_no, seq, '<error line=\"' || CAST(line AS VARCHAR) || '\" column=\"' || CAST(\"column\" AS VARCHAR) || '\" severity=\"' || severity || '\" message=\"' || message || '\" source=\"' || code || '\"/>') || '</file>' AS report FROM (SELECT * FROM d) GROUP BY file")
def sink_checkstyle(spark, sf_dir):
    return sinks.checkstyle(made_diagnostics(spark, sf_dir))


@query("sink_sarif", f"{_D} SELECT '{{\"ruleId\":\"' || code || '\",\"level\":\"' || severity || '\",\"message\":{{\"text\":\"' || message || '\"}},\"locations\":[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":\"' || file || '\"}},\"region\":{{\"startLine\":' || CAST(line AS VARCHAR) || ',\"startColumn\":' || CAST(\"column\" AS VARCHAR) || '}}}}}}],\"partialFingerprints\":{{\"primary\":\"' || {_PRINT} || '\"}}}}' AS report FROM d")
def sink_sarif(spark, sf_dir):
    return sinks.sarif_results(made_diagnostics(spark, sf_dir))


# Graphs, configs, joins and snapshots

_EDGES = "SELECT 'c' || CAST(c_custkey % 60 AS VARCHAR) AS src, 'c' || CAST((c_custkey * 7 + c_nationkey) % 60 AS VARCHAR) AS dst FROM customer"


def _edges(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 60).cast("string")).alias("src"), F.concat(F.lit("c"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 60).cast("string")).alias("dst"))


_CLOSURE = f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_EDGES})), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.depth < 70), c AS (SELECT src, dst, min(depth) AS depth FROM r GROUP BY src, dst)"


@query("include_closure", f"{_CLOSURE} SELECT src, dst, CAST(depth AS BIGINT) AS depth FROM c")
def include_closure(spark, sf_dir):
    return includes.closure(_edges(spark, sf_dir))


@query("include_cycles", f"{_CLOSURE} SELECT src AS file, CAST(depth AS BIGINT) AS depth FROM c WHERE src = dst")
def include_cycles(spark, sf_dir):
    return includes.cycles(includes.closure(_edges(spark, sf_dir)))


@query("include_repeats", f"SELECT src AS file, dst AS target, count(*) AS n FROM ({_EDGES}) WHERE dst NOT IN ('c1', 'c2', 'c3') GROUP BY src, dst HAVING count(*) > 1")
def include_repeats(spark, sf_dir):
    guarded = spark.range(1, 4).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("file"))
    return includes.repeats(_edges(spark, sf_dir), guarded)


_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/x' AS file FROM pages"


@query("nearest_config", f"WITH f AS ({_PATHS}), c AS (SELECT DISTINCT regexp_replace(file, '/.*$', '') AS dir FROM f WHERE page_id % 3 = 0) SELECT f.file, any_value(CASE WHEN c.dir IS NOT NULL THEN 'config of ' || c.dir ELSE 'root config' END) AS config FROM f LEFT JOIN c ON starts_with(f.file, c.dir || '/') GROUP BY f.file")
def nearest_config(spark, sf_dir):
    f = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/x")).alias("file"))
    hosts = f.where("page_id % 3 = 0").select(F.regexp_replace("file", "/.*$", "").alias("dir")).distinct().withColumns({"config": F.concat(F.lit("config of "), "dir"), "priority": F.lit(0)})
    root = spark.range(1).select(F.lit("").alias("dir"), F.lit("root config").alias("config"), F.lit(0).alias("priority"))
    return files.nearest_config(f.select("file").distinct(), hosts.union(root))


@query("corpus_filter", "SELECT page_id FROM pages WHERE regexp_full_match(url, '.*/en/.*') AND NOT regexp_full_match(url, '.*page=.*')")
def corpus_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(F.col("url").rlike(files.glob_pattern("*/en/*")) & ~F.col("url").rlike(files.glob_pattern("*page=*"))).select("page_id")


@query("registry_additive_union", "SELECT DISTINCT kind, name FROM (SELECT 'command' AS kind, lower(p_name) AS name FROM part UNION ALL SELECT 'command', lower(p_type) FROM part UNION ALL SELECT 'function', lower(s_name) FROM supplier)")
def registry_additive_union(spark, sf_dir):
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    return files.additive_union(part.select(F.lit("command").alias("kind"), F.lower("p_name").alias("name")), part.select(F.lit("command").alias("kind"), F.lower("p_type").alias("name")), supplier.select(F.lit("function").alias("kind"), F.lower("s_name").alias("name")))


@query("tag_vs_exact_lookup", "WITH n AS (SELECT 't' || CAST(p_size % 10 AS VARCHAR) || '_fnc_' || CAST(p_partkey % 40 AS VARCHAR) AS name FROM part), k AS (SELECT DISTINCT 't' || CAST(s_nationkey % 5 AS VARCHAR) || '_fnc_' || CAST(s_suppkey % 40 AS VARCHAR) AS name FROM supplier) SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM k) AND NOT (split_part(name, '_fnc_', 1) IN ('t3','t6','t7') AND split_part(name, '_fnc_', 1) NOT IN (SELECT split_part(name, '_fnc_', 1) FROM k))")
def tag_vs_exact_lookup(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (F.col("p_size") % 10).cast("string"), F.lit("_fnc_"), (F.col("p_partkey") % 40).cast("string")).alias("name")).distinct()
    known = _table(spark, sf_dir, "supplier").select(F.lit("function").alias("kind"), F.concat(F.lit("t"), (F.col("s_nationkey") % 5).cast("string"), F.lit("_fnc_"), (F.col("s_suppkey") % 40).cast("string")).alias("name")).distinct()
    tags = spark.range(1).select(F.lit("tag").alias("kind"), F.explode(F.array(F.lit("t3"), F.lit("t6"), F.lit("t7"))).alias("name"))
    p = rules.Project(names, known.union(tags))
    return p.unknown(names.withColumnRenamed("name", "n"), F.col("n")).select(F.col("n").alias("name"))


@query("longest_prefix_owner", f"WITH f AS ({_PATHS}), s AS (SELECT split_part(file, '/', 1) AS stem, 'host' AS owner FROM f UNION SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2), 'folder' FROM f WHERE page_id % 4 = 0) SELECT file AS name, arg_max(owner, len(stem)) AS owner FROM (SELECT DISTINCT f.file, s.stem, s.owner FROM f JOIN s ON starts_with(f.file, s.stem || '/')) GROUP BY file")
def longest_prefix_owner(spark, sf_dir):
    f = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/x")).alias("name"))
    stem = lambda n: F.substring_index("name", "/", n)
    stems = f.select(stem(1).alias("stem"), F.lit("host").alias("owner")).union(f.where("page_id % 4 = 0").select(stem(2), F.lit("folder"))).distinct()
    return addons.owners(f, stems, "/")


@query("latest_assignment_asof", "SELECT event_id, coalesce(CAST(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), -1) AS assigned FROM events")
def latest_assignment_asof(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("assigns", F.col("event_type") == "purchase")
    return types.latest(rows, ["user_id"], ["ts", "event_id"], "event_id", "assigns").select("event_id", F.coalesce("last", F.lit(-1)).alias("assigned"))


@query("branch_intersection", "SELECT user_id, list_sort(list_intersect(list(DISTINCT event_type) FILTER (event_id % 2 = 0), list(DISTINCT event_type) FILTER (event_id % 2 = 1)))::VARCHAR AS both FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0")
def branch_intersection(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return e.where("size(a) > 0 and size(b) > 0").select("user_id", F.concat(F.lit("["), F.array_join(F.sort_array(F.array_intersect("a", "b")), ", "), F.lit("]")).alias("both"))


@query("snapshot_diff", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'deleted' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def snapshot_diff(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.lit(1).alias("mtime_ns"), F.col("n_chars").alias("size"))
    old = d.where("doc_id % 10 <> 1")
    new = d.where("doc_id % 10 <> 2").withColumn("mtime_ns", F.when(F.col("doc_id") % 10 == 3, 2).otherwise(F.col("mtime_ns")))
    return watch.snapshot_diff(old, new)


@query("incremental_equals_full", f"{SCRIPTS_SQL} SELECT file, CAST(n AS BIGINT) AS line FROM ({_LINES}) WHERE text <> rtrim(text, ' ' || chr(9))")
def incremental_equals_full(spark, sf_dir):
    def lint(sources):
        return rules.trailing_blanks(rules.Project(sources, registry(spark))).select("file", "line")

    new = script_sources(spark, sf_dir).withColumns({"mtime_ns": F.lit(2), "size": F.length("text")})
    old = new.withColumns({"mtime_ns": F.when(F.col("file").endswith("7.sqf"), 1).otherwise(2), "text": F.when(F.col("file").endswith("7.sqf"), F.lit("old \n ")).otherwise(F.col("text"))})
    return watch.incremental(old.drop("text"), lint(old), new, lint)


@query("conflicting_types", "SELECT user_id, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS merged FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def conflicting_types(spark, sf_dir):
    return types.merged(_table(spark, sf_dir, "events"), ["user_id"], "event_type").where("kinds > 1")


@query("element_type_homogeneous", "SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS element FROM lineitem GROUP BY l_orderkey")
def element_type_homogeneous(spark, sf_dir):
    return types.homogeneous(_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), ["k"], "l_returnflag")


@query("core_alias_closure", "WITH n AS (SELECT DISTINCT 'T' || CAST(s_nationkey AS VARCHAR) || '_core_fnc_' || CAST(s_suppkey % 7 AS VARCHAR) AS name FROM supplier) SELECT name FROM n UNION SELECT replace(name, '_core_fnc_', '_fnc_') FROM n")
def core_alias_closure(spark, sf_dir):
    n = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), F.col("s_nationkey").cast("string"), F.lit("_core_fnc_"), (F.col("s_suppkey") % 7).cast("string")).alias("name"))
    return symbols.core_aliases(n)


@query("changed_lines_from_hunks", "SELECT DISTINCT 'f' || CAST(o_custkey % 20 AS VARCHAR) || '.sqf' AS file, CAST(unnest(range(o_orderkey % 90 + 1, o_orderkey % 90 + 1 + o_orderkey % 4)) AS BIGINT) AS line FROM orders")
def changed_lines_from_hunks(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    head = o.select(F.col("o_orderkey").alias("diff"), F.lit(1).alias("n"), F.concat(F.lit("+++ b/f"), (F.col("o_custkey") % 20).cast("string"), F.lit(".sqf")).alias("text"))
    hunk = o.select(F.col("o_orderkey").alias("diff"), F.lit(2).alias("n"), F.concat(F.lit("@@ -1 +"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(","), (F.col("o_orderkey") % 4).cast("string"), F.lit(" @@ x")).alias("text"))
    return files.changed_lines(head.union(hunk))


@query("plugin_todo_rule", f"{SCRIPTS_SQL} SELECT file, CAST(n AS BIGINT) AS line, CAST(instr(text, 'forEach') AS BIGINT) AS \"column\", 'W901' AS code, 'loop' AS message FROM ({_LINES}) WHERE contains(text, 'forEach')")
def plugin_todo_rule(spark, sf_dir):
    from ..operators.plugins import PluginRule, run_plugins

    def check(text, name):
        return [{"line": k, "column": line.index("forEach") + 1, "message": "loop"} for k, line in enumerate(text.split("\n"), 1) if "forEach" in line]

    return run_plugins(script_sources(spark, sf_dir), [PluginRule("W901", "warning", "loops", check)]).select("file", "line", "column", "code", "message")


# Symbols, configs, preprocessing, flow

@query("symbol_index", f"""{SCRIPTS_SQL}, fn AS (SELECT v AS name FROM sig WHERE type = 'ident' AND n1t = 'operator' AND n1v = '=' AND (n2t = 'lbrace' OR n2v IN ('compile', 'compilefinal') OR (n2t IN ('ident', 'local') AND contains(v, 'callback') AND contains(n2v, 'callback')))
 UNION SELECT h.n2v FROM sig h WHERE h.type = 'ident' AND h.n1t = 'lbracket' AND h.n2t = 'string' AND h.v IN ('setvariable', 'addeventhandler') AND regexp_matches(h.n2v, '^[A-Za-z_][A-Za-z0-9_]*$') AND EXISTS (SELECT 1 FROM sig c WHERE c.file = h.file AND c.type = 'lbrace' AND c.s > h.s AND c.s < (SELECT min(e.s) FROM sig e WHERE e.file = h.file AND e.type = 'rbracket' AND e.s > h.s)))
SELECT 'function' AS kind, name FROM fn UNION SELECT 'tag', split_part(name, '_fnc_', 1) FROM fn WHERE contains(name, '_fnc_') UNION SELECT 'macro', lower(regexp_extract(value, '(?i)^define\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM tok WHERE type = 'preprocessor' AND regexp_matches(value, '(?i)^define\\s+[A-Za-z_]')""")
def symbol_index(spark, sf_dir):
    p = project(spark, sf_dir, keep=True)
    return symbols.index(p.tokens, p.sig)


_ADDONS = "SELECT 'm' || CAST(o_custkey AS VARCHAR) AS file, 'version = 1; class Mission {{}}; addOns[] = {{\"' || string_agg('a_' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN ' x' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'B' END, '\",\"' ORDER BY o_orderkey) || '\"}};' AS text FROM orders GROUP BY o_custkey".replace("{{", "{").replace("}}", "}")


@query("mission_addons", f"""WITH n AS (SELECT file, unnest(regexp_extract_all(regexp_extract(text, 'addOns\\[\\] = \\{{([^}}]*)\\}}', 1), '"([^"]+)"', 1)) AS addon FROM ({_ADDONS}))
SELECT file, 'W212' AS code, 'duplicate mission addon: ' || lower(addon) AS message FROM n GROUP BY file, lower(addon) HAVING count(*) > 1 UNION ALL SELECT file, 'W213', 'invalid mission addon name: ' || addon FROM (SELECT n.*, row_number() OVER (PARTITION BY file, lower(addon) ORDER BY i) AS r FROM (SELECT file, unnest(l) AS addon, unnest(range(len(l))) AS i FROM (SELECT file, regexp_extract_all(regexp_extract(text, 'addOns\\[\\] = \\{{([^}}]*)\\}}', 1), '"([^"]+)"', 1) AS l FROM ({_ADDONS}))) n) WHERE r = 1 AND NOT regexp_full_match(addon, '[A-Za-z0-9_]+')""")
def mission_addons(spark, sf_dir):
    name = F.concat(F.lit("a_"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, " x").otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("B"))
    lists = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", name.alias("n")))), lambda x: x["n"]), '","').alias("names"))
    sources = lists.select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("file"), F.concat(F.lit('version = 1; class Mission {}; addOns[] = {"'), "names", F.lit('"};')).alias("text"))
    return config_rules.addon_entries(rules.Project(sources, registry(spark))).select("file", "code", "message")


@query("config_structure", f"""{SCRIPTS_SQL}, b AS (SELECT file, s, type, line, col, sum(CASE type WHEN 'lbrace' THEN 1 WHEN 'rbrace' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s) AS run FROM (SELECT g.* FROM sig g WHERE NOT EXISTS (SELECT 1 FROM tok d WHERE d.file = g.file AND d.line = g.line AND d.type = 'preprocessor' AND regexp_matches(d.value, '(?i)^define')))),
c AS (SELECT *, least(0, min(run) OVER (PARTITION BY file ORDER BY s)) AS low FROM b), e AS (SELECT *, run - low AS level, coalesce(lag(low) OVER (PARTITION BY file ORDER BY s), 0) AS low0 FROM c), f AS (SELECT *, min(level) OVER (PARTITION BY file ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e)
SELECT file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column", 'unmatched ''}}'' in config' AS message FROM f WHERE type = 'rbrace' AND low < low0 UNION ALL SELECT file, CAST(line AS BIGINT), CAST(col AS BIGINT), 'unclosed ''{{'' in config' FROM f WHERE type = 'lbrace' AND coalesce(later >= level, true)""")
def config_structure(spark, sf_dir):
    return config_rules.structure(project(spark, sf_dir)).select("file", "line", "column", "message")


@query("preprocess_scripts")
def preprocess_scripts(spark, sf_dir):
    """Combined texts by line; a fold with state has no SQL form."""
    return preprocess.preprocess(project(spark, sf_dir)).select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query("directive_rules")
def directive_rules(spark, sf_dir):
    return preprocess.directive_rules(project(spark, sf_dir))


@query("flow_rules")
def flow_rules(spark, sf_dir):
    """Unreachable code and locals that may be undefined; the parser has no SQL form."""
    return flow.flow_rules(project(spark, sf_dir))


@query("streaming_changed_files")
def streaming_changed_files(spark, sf_dir):
    """Findings of a stream over the made scripts as one batch of arriving files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sources = script_sources(spark, sf_dir).withColumns({"mtime_ns": F.lit(1).cast("bigint"), "size": F.length("text").cast("bigint")})
    sources.write.parquet(f"{base}/in")
    lint = lambda s: rules.trailing_blanks(rules.Project(s, registry(spark)))
    watch.lint_stream(spark, f"{base}/in", "file string, text string, mtime_ns bigint, size bigint", lint, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file", "line", "column", "message")


ORACLES["streaming_changed_files"] = f"{SCRIPTS_SQL} SELECT file, CAST(n AS BIGINT) AS line, CAST(length(rtrim(text, ' ' || chr(9))) + 1 AS BIGINT) AS \"column\", 'trailing whitespace at character ' || CAST(length(rtrim(text, ' ' || chr(9))) + 1 AS VARCHAR) AS message FROM ({_LINES}) WHERE text <> rtrim(text, ' ' || chr(9))"

from . import project_queries  # noqa: E402, F401 - registers its queries
