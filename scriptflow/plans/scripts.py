"""Scripts made from the events table, and the same lexing in ANSI SQL for the oracle.

One file per user, one line per event in order of time. The line's text is one SQL expression that
Spark and the oracle's engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexer import KEYWORDS
from ..operators.rules import Project

# Names that the made scripts may use.
COMMANDS = "hint str reverse select addeventhandler removeeventhandler setvariable getvariable remoteexec publicvariable finddisplay setpos".split()
FUNCTIONS = [f"fn_{k}" for k in range(9)]

LINE = """CASE
 WHEN e % 61 = 0 THEN 'if (true) then { hint "a' || ks || '"; };'
 WHEN e % 61 = 1 THEN 'if (_v1) hint "b";'
 WHEN e % 61 = 2 THEN 'else ;'
 WHEN e % 61 = 3 THEN 'x = ["a" "b", 1];'
 WHEN e % 61 = 4 THEN 'forEach _v2 { hint "c"; };'
 WHEN e % 61 = 5 THEN '_v3 reverse;'
 WHEN e % 61 = 6 THEN 'TAG_fnc_f' || k5 || ' = { hint "d"; };'
 WHEN e % 61 = 7 THEN 'TAG_fnc_f' || k5 || ' = ' || ks || ';'
 WHEN e % 61 = 8 THEN '[] select 0;'
 WHEN e % 61 = 9 THEN '#define M' || k5 || ' ' || ks
 WHEN e % 61 = 10 THEN '#ifdef M' || k5
 WHEN e % 61 = 11 THEN '#endif'
 WHEN e % 61 = 12 THEN '// lint: disable-next-line W301'
 WHEN e % 61 = 13 THEN '// lint: disable W222 -- legacy'
 WHEN e % 61 = 14 THEN '// lint: enable W222'
 WHEN e % 61 = 15 THEN 'roadThing _v' || k7 || ';'
 WHEN e % 61 = 16 THEN 'call 5;'
 WHEN e % 61 = 17 THEN 'unit addEventHandler ["Fired"];'
 WHEN e % 61 = 18 THEN 'missionNamespace setVariable ' || ks || ';'
 WHEN e % 61 = 19 THEN '[1,2] remoteExec [1,2,3,4];'
 WHEN e % 61 = 20 THEN 'publicVariable ' || ks || ';'
 WHEN e % 61 = 21 THEN 'hud = findDisplay 46;'
 WHEN e % 61 = 22 THEN 'unit addEventHandler ["E' || k5 || '", { hint "f"; }];'
 WHEN e % 61 = 23 THEN 'unit removeEventHandler ["E' || k5 || '", 0];'
 WHEN e % 61 = 24 THEN '#else'
 WHEN e % 61 = 25 THEN chr(9) || 'hint "t";'
 WHEN e % 61 = 26 THEN '_v' || k7 || ' = -5;'
 WHEN e % 61 = 27 THEN '/* block ' || ks || ' */ hint "g"; }'
 WHEN e % 61 = 28 THEN '// lint: disable X' || ks
 WHEN e % 61 = 29 THEN '_g = [1, [2, "q""r"], {3}];'
 WHEN e % 61 = 30 THEN 'str { 1 } zap;'
 WHEN et = 'signup' THEN 'private _v' || k7 || ' = ' || ks || ';'
 WHEN et = 'purchase' THEN '_v' || k7 || ' = ' || ks || ';'
 WHEN et = 'view' THEN 'hint str _v' || k7 || ';'
 WHEN et = 'click' THEN '[' || ks || CASE WHEN e % 11 = 0 THEN ',' ELSE '' END || '] call fn_' || k13 || ';'
 ELSE '_w = (_v' || k7 || ' + 1' || CASE WHEN e % 5 = 0 THEN '' ELSE ')' END || ';'
END || CASE WHEN e % 7 = 0 THEN ' ' ELSE '' END"""

#: What a script ends with: callbacks, nested lists of parameters, comments within expressions, methods, an open string.
TAIL = """CASE
 WHEN user_id % 6 = 0 THEN chr(10) || 'unit addEventHandler ["Hit", { params ["_u", "_src"]; hint str _u; if (alive _u) then { private ["_deep", "_used"]; hint _used; }; }];'
 WHEN user_id % 6 = 1 THEN chr(10) || 'private ["_n1", ["_n2"]]; params ["_n1", ["_n3", 0], [["_n4", 1, ["_n5"]]]]; private ["_n3", "_n5"]; hint /* , */ str _n2;'
 WHEN user_id % 6 = 2 THEN chr(10) || 'fn_a = { params ["_a", "_b"]; { private _a = 1; hint str _a; } forEach [1, [2, {3}]]; method; private _a = 2; private _a = 3; _b };'
 WHEN user_id % 6 = 3 THEN chr(10) || 'private ["_i", "_k"]; for "_i" from 0 to 1 do { ctrl ctrlAddEventHandler ["x", [{ params ["_c"]; params "_d"; }]]; { params ["_e", "_k"]; } }; hint "open ""quoted"" text'
 WHEN user_id % 6 = 4 THEN chr(10) || '0 spawn { params ["_p"]; { _x } count _p }; [_p select { _x > 1 }, 2 call { params ["_q"]; [_q] }] call fn_3; hint (str _p + "a" "b"); /* open'
 ELSE chr(10) || '_c = 1; if (_c == "x") exitWith {}; _d = "s"; if (_d != "t" && true == 1) then { 2 > "q"; }; configFile >> "a" > 5; ("x" find "y") == "z"; _n call 5; _c call fn_1; [1, "a", true, {_c}] call fn_2; [_d, _c, [1]] call fn_1; _t = true; if (_t == _c) then { publicVariable _c; str _t; }; _x == "n"; _q = [1, 2]; hint _q; unit setPos _d; _f = count "x"; if (_f == "s") then {}; if (typeName _d == 5) then {}; _y = 4; _y isEqualType 1; _y == "g"; spawn _t;' END"""

_EVENTS = """SELECT user_id, ts, event_id AS e, event_type AS et, k, CAST(k AS STRING) AS ks, CAST(k % 5 AS STRING) AS k5, CAST(k % 7 AS STRING) AS k7, CAST(k % 13 AS STRING) AS k13
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""

#: The lexing pattern without possessive groups, for an engine that doesn't backtrack.
PLAIN_LEXEME = (
    r"""(?m)(^[ \t\r]*#[^\r\n]*|"[^"]*(?:""[^"]*)*"?|''[^'']*(?:''''[^'']*)*''?"""
    r"|//[^\n]*|/\*[^*]*(?:\*+[^*/][^*]*)*(?:\*+/|\**\z)|0[xX][0-9A-Fa-f]*|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|&&|\|\||\+\+|--|=>|[ \t\r]+|\n|[^\n])"
)
_KEYS = ", ".join(f"'{k}'" for k in KEYWORDS)


def lexed_sql(source: str) -> str:
    """WITH clauses src, tok and sig over a query for (file, text)."""
    return f"""WITH RECURSIVE src AS ({source}),
lex AS (SELECT file, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS raw FROM (SELECT file, regexp_extract_all(text, '{PLAIN_LEXEME}', 1) AS l FROM src)),
placed AS (SELECT file, n, raw, coalesce(sum(length(raw)) OVER w, 0) AS off, 1 + coalesce(sum(length(raw) - length(replace(raw, chr(10), ''))) OVER w, 0) AS line FROM lex WINDOW w AS (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cols AS (SELECT *, off - coalesce(max(CASE WHEN contains(raw, chr(10)) THEN off + length(raw) - instr(reverse(raw), chr(10)) + 1 END) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM placed),
typed AS (SELECT * FROM (SELECT file, raw, off, line, col, CASE
  WHEN regexp_full_match(raw, '[ \\t\\r\\n]*') THEN NULL
  WHEN col = 1 AND regexp_matches(raw, '^[ \\t\\r]*#') THEN 'preprocessor'
  WHEN starts_with(raw, '//') OR starts_with(raw, '/*') THEN 'comment'
  WHEN raw[1] IN ('"', '''') THEN 'string' WHEN regexp_matches(raw, '^\\.?[0-9]') THEN 'number' WHEN raw[1] = '_' THEN 'local'
  WHEN regexp_matches(raw, '^[A-Za-z]') THEN CASE WHEN lower(raw) IN ({_KEYS}) THEN 'keyword' ELSE 'ident' END
  WHEN raw = '(' THEN 'lparen' WHEN raw = ')' THEN 'rparen' WHEN raw = '[' THEN 'lbracket' WHEN raw = ']' THEN 'rbracket'
  WHEN raw = '{{' THEN 'lbrace' WHEN raw = '}}' THEN 'rbrace' WHEN raw = ';' THEN 'semicolon' WHEN raw = ',' THEN 'comma' ELSE 'operator' END AS type FROM cols) WHERE type IS NOT NULL),
bare AS (SELECT file, type, line, CASE WHEN type = 'preprocessor' THEN ltrim(raw, ' ' || chr(9) || chr(13)) ELSE raw END AS raw, off + CASE WHEN type = 'preprocessor' THEN length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13))) ELSE 0 END AS off, col + CASE WHEN type = 'preprocessor' THEN length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13))) ELSE 0 END AS col FROM typed),
signs AS (SELECT *, raw = '-' AND coalesce(regexp_matches(lead(raw) OVER w, '^[0-9]'), false) AND lead(off) OVER w = off + 1 AND NOT coalesce(lag(type) OVER w IN ('number','ident','local','string','keyword','rparen','rbracket','rbrace'), false) AS sign FROM bare WINDOW w AS (PARTITION BY file ORDER BY off)),
signed AS (SELECT *, coalesce(lag(sign) OVER (PARTITION BY file ORDER BY off), false) AND type = 'number' AS neg FROM signs),
merged AS (SELECT file, type, line, CASE WHEN neg THEN '-' || raw ELSE raw END AS raw, off - CAST(neg AS INT) AS off, col - CAST(neg AS INT) AS col FROM signed WHERE NOT coalesce(sign, false)),
tok AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY off) - 1 AS i, type, CASE WHEN type = 'string' THEN replace(substring(raw, 2, length(raw) - CASE WHEN length(raw) > 1 AND ends_with(raw, raw[1]) THEN 2 ELSE 1 END), raw[1] || raw[1], raw[1]) WHEN type = 'preprocessor' THEN trim(substring(raw, 2), ' ' || chr(9) || chr(13)) ELSE raw END AS value, line, col, raw, off FROM merged),
sig AS (SELECT *, lead(type) OVER w AS n1t, lead(v) OVER w AS n1v, lead(value) OVER w AS n1value, lead(line) OVER w AS n1line, lead(col) OVER w AS n1col, lead(type, 2) OVER w AS n2t, lead(v, 2) OVER w AS n2v, lead(value, 2) OVER w AS n2value, lead(type, 3) OVER w AS n3t, lead(v, 3) OVER w AS n3v, lead(v, 4) OVER w AS n4v, lag(type) OVER w AS p1t, lag(v) OVER w AS p1v, lag(value) OVER w AS p1value, lag(line) OVER w AS p1line, lag(col) OVER w AS p1col, row_number() OVER w - 1 AS s FROM (SELECT *, lower(value) AS v FROM tok WHERE type NOT IN ('comment', 'preprocessor')) WINDOW w AS (PARTITION BY file ORDER BY i)),
br AS (SELECT file, s, starts_with(type, 'l') AS opens, substring(type, 2) AS kind, row_number() OVER (PARTITION BY file ORDER BY s) AS n FROM sig WHERE type IN ('lparen','rparen','lbracket','rbracket','lbrace','rbrace')),
fold AS (SELECT file, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, kind VARCHAR)[]) AS stack, CAST(NULL AS BIGINT) AS open, CAST(NULL AS BIGINT) AS close, CAST(NULL AS BIGINT) AS bad FROM src
 UNION ALL SELECT b.file, b.n, CASE WHEN b.opens THEN list_append(f.stack, {{'s': b.s, 'kind': b.kind}}) WHEN len(f.stack) > 0 AND f.stack[-1].kind = b.kind THEN f.stack[1:-2] ELSE f.stack END,
  CASE WHEN NOT b.opens AND len(f.stack) > 0 AND f.stack[-1].kind = b.kind THEN f.stack[-1].s END, CASE WHEN NOT b.opens AND len(f.stack) > 0 AND f.stack[-1].kind = b.kind THEN b.s END,
  CASE WHEN NOT b.opens AND NOT (len(f.stack) > 0 AND f.stack[-1].kind = b.kind) THEN b.s END
  FROM fold f JOIN br b ON b.file = f.file AND b.n = f.n + 1),
pairs AS (SELECT file, open, close FROM fold WHERE open IS NOT NULL),
ends AS (SELECT file, unnest(stack).s AS s FROM (SELECT file, arg_max(stack, n) AS stack FROM fold GROUP BY file))"""


SOURCE_SQL = f"SELECT 'u' || CAST(user_id AS VARCHAR) || '.sqf' AS file, string_agg(line, chr(10) ORDER BY ts, e) || {TAIL} AS text FROM (SELECT user_id, ts, e, {LINE} AS line FROM ({_EVENTS})) GROUP BY user_id"
SCRIPTS_SQL = lexed_sql(SOURCE_SQL)


def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of the made scripts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    named = events.select("user_id", "ts", F.col("event_id").alias("e"), F.col("event_type").alias("et"), F.col("k").cast("string").alias("ks"), *((F.col("k") % m).cast("string").alias(f"k{m}") for m in (5, 7, 13)))
    lines = named.select("user_id", "ts", "e", F.expr(LINE).alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "e", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("user_id").agg(text.alias("text")).select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".sqf")).alias("file"), F.concat("text", F.expr(TAIL)).alias("text"))


def registry(spark: SparkSession) -> DataFrame:
    rows = [("command", c) for c in COMMANDS] + [("function", f) for f in FUNCTIONS]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in rows])))


def project(spark: SparkSession, sf_dir: str, keep: bool = False) -> Project:
    """The made scripts as a project."""
    return Project(script_sources(spark, sf_dir), registry(spark), keep)
