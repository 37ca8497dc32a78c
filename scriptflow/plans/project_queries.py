"""Queries over configs, addons, type rules and reports: what the made projects of the driver's tables give, and the same in SQL.

The SQL doesn't read what the queries read: it follows the rule by which the texts are made, or lexes them in its own way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import addons, cfg_functions, diagnostics, expressions, postfilters, preprocess, rules, sinks, types
from ..operators.rules import CATALOG, Project
from ..sources import project_config
from ..streaming import watch
from .parity import _D, _EDGES, _LINES, _PATHS, _PRINT, _SHOWN, _edges, _table, made_diagnostics, query, _rule
from .scripts import SCRIPTS_SQL, project, registry, script_sources


def _made(spark, sf_dir, table, columns, group, line, order, head="", tail=""):
    """A file for each group: lines by an expression that both engines read, in order, between a head and a tail."""
    rows = _table(spark, sf_dir, table).selectExpr(f"{group} AS file", f"{order} AS _o", f"{line} AS _x", *columns)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_x"))), lambda x: x["_x"]), "\n")
    return rows.groupBy("file").agg(F.concat(F.lit(head), text, F.lit(tail)).alias("text"))


# Functions that configs declare

_CLASS = """CASE s_suppkey % 5
 WHEN 0 THEN concat('class C', s_suppkey, ' { file = "x"; class f', s_suppkey, ' {}; class g', s_suppkey, ' { class h', s_suppkey, ' {}; }; };')
 WHEN 1 THEN concat('class f', s_suppkey, ' { preInit = 1; };')
 WHEN 2 THEN concat('class b', s_suppkey, ' { postInit = 1; }; class f', s_suppkey, ': b', s_suppkey, ' {}; class h', s_suppkey, ': f', s_suppkey, ' { y = 2; };')
 WHEN 3 THEN concat('class n', s_suppkey, ' { x = 1; }; // class no', s_suppkey, ' { file = 1; };')
 ELSE concat('class K', s_suppkey, ' { class spawn', s_suppkey, ' { scriptName = "s"; }; class o', s_suppkey, ': gone {}; };') END"""


@query("cfg_functions", """WITH n AS (SELECT 'n' || CAST(s_nationkey AS VARCHAR) || '.hpp' AS file, 't' || CAST(s_nationkey AS VARCHAR) AS tag, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 5 AS c FROM supplier)
SELECT DISTINCT file, 'tag' AS kind, tag AS name FROM n UNION ALL SELECT file, 'function', tag || '_fnc_' || unnest(CASE c WHEN 0 THEN ['f' || k, 'g' || k, 'h' || k] WHEN 1 THEN ['f' || k] WHEN 2 THEN ['b' || k, 'f' || k, 'h' || k] WHEN 4 THEN ['spawn' || k] ELSE [] END) FROM n""")
def cfg_functions_query(spark, sf_dir):
    """Nations whose number is odd hold the fragment form, with a tag of their own instead of the wrapper."""
    src = _made(spark, sf_dir, "supplier", [], "concat('n', s_nationkey, '.hpp')", _CLASS, "s_suppkey")
    tag = F.regexp_extract("file", r"n(\d+)", 1)
    whole = F.when(tag.cast("int") % 2 == 0, F.concat(F.lit("class CfgFunctions { class T"), tag, F.lit(" {\n"), "text", F.lit("\n}; };"))).otherwise(F.concat(F.lit('class Any { tag = "T'), tag, F.lit('";\n'), "text", F.lit("\n};")))
    return cfg_functions.functions(Project(src.select("file", whole.alias("text")), registry(spark)))


@query("config_references", "SELECT DISTINCT 'p' || CAST(p_size AS VARCHAR) AS file, 't_fnc_' || CAST(p_partkey % 300 AS VARCHAR) AS name FROM part WHERE p_partkey % 3 <> 0")
def config_references(spark, sf_dir):
    line = "CASE WHEN p_partkey % 3 = 0 THEN concat('class m', p_partkey, ' { function = \"not a name ', p_partkey, '\"; };') ELSE concat('class m', p_partkey, ' { Function = \" T_fnc_', p_partkey % 300, '\"; };') END"
    src = _made(spark, sf_dir, "part", [], "concat('p', p_size)", line, "p_partkey")
    return cfg_functions.references(Project(src, registry(spark), True))


# Project configs: one for each customer

_CONFIG = """concat('{"functionTags": [" Tag', c_nationkey, ' ", ', c_custkey, ', "", "x"], "severity": {"w', 200 + c_custkey % 40, '": "', CASE c_custkey % 5 WHEN 0 THEN 'Error' WHEN 1 THEN 'off' WHEN 2 THEN 'loud' ELSE 'info' END, '"}, "ignoreRules": ["e00', c_custkey % 10, '"], ',
 CASE c_custkey % 6 WHEN 0 THEN '"odd": 1, ' WHEN 1 THEN '"plugins": 7, ' WHEN 2 THEN '"presets": ["strict", "none"], ' ELSE '' END, '"mods": ["http://w/?id=', c_custkey, '", {"name": "m"}, {"url": " u ", "name": "n"}], "functionTypes": {"F', c_custkey, '": ["Object", "String|Array"], "g": [1]}}')"""
_CODES = "(" + ", ".join(f"'{c}'" for c in CATALOG) + ")"


def _configs(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey, '/scriptflow.json') AS path", f"{_CONFIG} AS value")


_C = "SELECT 'c' || CAST(c_custkey AS VARCHAR) || '/scriptflow.json' AS path, c_custkey AS k, c_nationkey AS n FROM customer"


@query("config_function_tags", f"SELECT path, unnest(['tag' || CAST(n AS VARCHAR), 'x']) AS name FROM ({_C})")
def config_function_tags(spark, sf_dir):
    return project_config.function_tags(project_config.settings(_configs(spark, sf_dir)))


@query("config_severities", f"SELECT path, 'W' || CAST(200 + k % 40 AS VARCHAR) AS code, CASE k % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'off' ELSE 'info' END AS level FROM ({_C}) WHERE k % 5 <> 2")
def config_severities(spark, sf_dir):
    return project_config.severities(project_config.settings(_configs(spark, sf_dir)))


@query("config_function_types", f"SELECT path, 'f' || CAST(k AS VARCHAR) AS name, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 0 THEN 'Object' ELSE 'String/Array' END AS types FROM ({_C}), range(2) r(pos)")
def config_function_types(spark, sf_dir):
    return project_config.function_types(project_config.settings(_configs(spark, sf_dir))).withColumn("types", F.array_join("types", "/"))


@query("config_mods", f"SELECT path, CAST(NULL AS VARCHAR) AS name, 'http://w/?id=' || CAST(k AS VARCHAR) AS url, CAST(k AS VARCHAR) AS workshop_id FROM ({_C}) UNION ALL SELECT path, 'n', 'u', NULL FROM ({_C})")
def config_mods(spark, sf_dir):
    return project_config.mods(project_config.settings(_configs(spark, sf_dir)))


@query("config_findings", f"""SELECT path AS file, 'E012' AS code, m AS message FROM (SELECT path, unnest([
 CASE k % 6 WHEN 0 THEN 'unknown configuration key: odd' WHEN 1 THEN 'plugins must be a string or array' WHEN 2 THEN 'unknown rule preset: none' END,
 CASE WHEN 'W' || CAST(200 + k % 40 AS VARCHAR) NOT IN {_CODES} THEN 'unknown rule code in severity: w' || CAST(200 + k % 40 AS VARCHAR) END,
 CASE k % 5 WHEN 0 THEN 'invalid severity for w' || CAST(200 + k % 40 AS VARCHAR) || ': Error' WHEN 2 THEN 'invalid severity for w' || CAST(200 + k % 40 AS VARCHAR) || ': loud' END,
 CASE WHEN 'E00' || CAST(k % 10 AS VARCHAR) NOT IN {_CODES} THEN 'unknown rule code in ignoreRules: e00' || CAST(k % 10 AS VARCHAR) END]) AS m FROM ({_C})) WHERE m IS NOT NULL""")
def config_findings(spark, sf_dir):
    return project_config.findings(_configs(spark, sf_dir)).select("file", "code", "message")


_LISTING = f"SELECT DISTINCT file FROM ({_PATHS}) UNION SELECT DISTINCT regexp_replace(file, '/.*$', '') || '/.scriptflow.json' FROM ({_PATHS}) WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_replace(file, '/[^/]*/x$', '') || '/scriptflow.json' FROM ({_PATHS}) WHERE page_id % 4 = 0 UNION SELECT '.scriptflow.json' UNION SELECT 'scriptflow.json'"


def _listing(spark, sf_dir):
    f = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/x")).alias("file"))
    host = f.where("page_id % 3 = 0").select(F.concat(F.regexp_replace("file", "/.*$", ""), F.lit("/.scriptflow.json")))
    inner = f.where("page_id % 4 = 0").select(F.concat(F.regexp_replace("file", "/[^/]*/x$", ""), F.lit("/scriptflow.json")))
    top = spark.range(1).select(F.explode(F.array(F.lit(".scriptflow.json"), F.lit("scriptflow.json"))))
    return f.select("file").union(host).union(inner).union(top).distinct()


@query("config_discovery", f"""WITH f AS ({_LISTING}), d AS (SELECT file, regexp_replace(file, '/?[^/]*$', '') AS dir FROM f), c AS (SELECT dir, min_by(file, CASE WHEN file = 'scriptflow.json' OR ends_with(file, '/scriptflow.json') THEN 0 ELSE 1 END) AS path FROM d WHERE regexp_matches(file, '(^|/)[.]?scriptflow[.]json$') GROUP BY dir)
SELECT d.file, max_by(c.path, len(c.dir)) AS path FROM d JOIN c ON c.dir = '' OR d.dir = c.dir OR starts_with(d.dir, c.dir || '/') GROUP BY d.file""")
def config_discovery(spark, sf_dir):
    return project_config.discover(_listing(spark, sf_dir))


@query("cache_discovery", f"""WITH f AS (SELECT DISTINCT file FROM ({_PATHS})), d AS (SELECT file, regexp_replace(file, '/?[^/]*$', '') AS dir, regexp_replace(file, '/.*$', '') AS host FROM f), h AS (SELECT DISTINCT regexp_replace(file, '/.*$', '') AS host, page_id FROM ({_PATHS}))
SELECT d.file, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.host = d.host AND page_id % 2 = 0) THEN host || '/.scriptflow/names.json' WHEN EXISTS (SELECT 1 FROM h WHERE h.host = d.host AND page_id % 2 = 1) THEN host || '/names.json' END AS path FROM d""")
def cache_discovery(spark, sf_dir):
    """Of a host with both caches, the one in the state folder is taken."""
    f = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/x")).alias("file"))
    host = F.regexp_replace("file", "/.*$", "")
    caches = f.select(F.concat(host, F.when(F.col("page_id") % 2 == 0, "/.scriptflow/names.json").otherwise("/names.json")).alias("file"))
    files = f.select("file").union(caches).distinct()
    return project_config.discover_cache(files, "names.json").where("endswith(file, '/x')")


@query("first_wins_merge", "WITH m AS (SELECT lower(p_brand) AS key, p_type AS value, 0 AS r FROM part WHERE p_size < 10 UNION ALL SELECT lower(p_brand), p_name, 1 FROM part UNION ALL SELECT lower(s_name), s_name, 2 FROM supplier) SELECT key, min_by(value, {'r': r, 'value': value}) AS value FROM m GROUP BY key")
def first_wins_merge(spark, sf_dir):
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    key = F.lower("p_brand").alias("key")
    return project_config.first_wins(part.where("p_size < 10").select(key, F.col("p_type").alias("value")), part.select(key, F.col("p_name").alias("value")), supplier.select(F.lower("s_name").alias("key"), F.col("s_name").alias("value")))


# Filters by the text around a finding

_LIKE = """CASE o_orderkey % 8 WHEN 0 THEN concat('hint "say zap', o_orderkey % 5, ' now"; zap9 1;') WHEN 1 THEN concat('zap', o_orderkey % 5, ' 1; hint "a ""zap9"" b";') WHEN 2 THEN concat('x = ''zap', o_orderkey % 5, ''';')
 WHEN 3 THEN 'overview = "the nation''s zap0";' WHEN 4 THEN '/* open' WHEN 5 THEN 'close */ zap1 2;' WHEN 6 THEN 'RETURN zap2 [1 2];' ELSE concat('zap', o_orderkey % 5, ' 5;') END"""
_FILE = "concat('o', o_custkey % 40, CASE WHEN o_custkey % 4 = 0 THEN '/description.ext' ELSE '.sqf' END)"
_TEXTS = f"SELECT {_FILE} AS file, (CASE o_custkey % 40 % 10 WHEN 1 THEN '#include \"oop.h\"' || chr(10) || 'CLASS(\"a\") PUBLIC FUNCTION(\"b\",\"c\")' || chr(10) WHEN 2 THEN '#define RETURN' || chr(10) ELSE '' END) AS head, o_orderkey, {_LIKE} AS line FROM orders"
_TEXT_SQL = f"SELECT file, any_value(head) || string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM ({_TEXTS}) GROUP BY file"
_NAMED = f"SELECT file, n AS line, k AS \"column\", code, CASE WHEN code = 'W202' THEN 'unknown command/function: zap' || CAST(n % 5 AS VARCHAR) || ' (x)' ELSE 'finding' END AS message, l[n] AS text FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT file, string_split(text, chr(10)) AS l FROM ({_TEXT_SQL}))), (VALUES (1, 'W202'), (13, 'W202'), (2, 'W203'), (3, 'E006'), (4, 'E001')) v(k, code)"


def _texts(spark, sf_dir):
    head = F.expr("CASE o_custkey % 40 % 10 WHEN 1 THEN '#include \"oop.h\"\nCLASS(\"a\") PUBLIC FUNCTION(\"b\",\"c\")\n' WHEN 2 THEN '#define RETURN\n' ELSE '' END")
    rows = _table(spark, sf_dir, "orders").select(F.expr(_FILE).alias("file"), head.alias("head"), F.struct("o_orderkey", F.expr(_LIKE).alias("x")).alias("s"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["x"]), "\n")
    return rows.groupBy("file").agg(F.concat(F.first("head"), text).alias("text"))


def _found(sources):
    """Five findings on every line."""
    lines = sources.select("file", F.posexplode(F.split("text", "\n")).alias("n", "_x")).withColumn("line", F.col("n") + 1)
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("code")) for k, c in ((1, "W202"), (13, "W202"), (2, "W203"), (3, "E006"), (4, "E001"))])
    each = lines.select("file", "line", F.explode(kinds).alias("v"))
    message = F.when(F.col("v.code") == "W202", F.concat(F.lit("unknown command/function: zap"), (F.col("line") % 5).cast("string"), F.lit(" (x)"))).otherwise("finding")
    return each.select("file", "line", F.col("v.k").alias("column"), F.lit("warning").alias("severity"), "v.code", message.alias("message"), F.lit(0).alias("pass_no"), F.col("line").alias("seq"))


#: Whether a place lies within a string of a line, by taking whole strings out of what stands before it; whoever stops between doubled quotes is inside.
_IN = "(regexp_matches(regexp_replace({before}, '\"[^\"]*(\"\"[^\"]*)*\"|''[^'']*(''''[^'']*)*''', '', 'g'), '[\"'']') OR (regexp_matches({before}, '[\"'']$') AND {text}[{at}] = {text}[{at} - 1] AND regexp_matches(regexp_replace(substring({before}, 1, CAST({at} - 2 AS BIGINT)), '\"[^\"]*(\"\"[^\"]*)*\"|''[^'']*(''''[^'']*)*''', '', 'g'), '[\"'']')))"
_INSIDE = _IN.format(before='substring(text, 1, "column" - 1)', text="text", at='"column"')
_AT = "instr(text, 'zap' || CAST(line % 5 AS VARCHAR))"
_NAME_INSIDE = _IN.format(before=f"substring(text, 1, {_AT} - 1)", text="text", at=_AT)
_KEY = 'file, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", code'


@query("quoted_name_filter", f"""SELECT {_KEY} FROM ({_NAMED}) WHERE code <> 'W202' OR NOT ({_INSIDE} OR regexp_matches(text, '["'']zap' || CAST(line % 5 AS VARCHAR) || '["'']') OR ({_AT} > 0 AND {_NAME_INSIDE}))""")
def quoted_name_filter(spark, sf_dir):
    src = _texts(spark, sf_dir)
    return postfilters.drop_quoted_names(_found(src), src).select("file", "line", "column", "code")


@query("config_prose_filter", f"""SELECT {_KEY} FROM ({_NAMED}) WHERE NOT (code = 'W202' AND ends_with(file, 'description.ext') AND (len(text) - len(replace(text, '"', '')) >= 2 AND contains(text, '''') OR (text = '' AND line = 8)))""")
def config_prose_filter(spark, sf_dir):
    src = _texts(spark, sf_dir)
    return postfilters.drop_config_prose(_found(src), src).select("file", "line", "column", "code")


@query("commented_filter", f"""WITH n AS ({_NAMED}), c AS (SELECT file, line, sum((len(text) - len(replace(text, '/*', '')) - len(text) + len(replace(text, '*/', ''))) / 2) OVER (PARTITION BY file ORDER BY line) AS deep FROM (SELECT DISTINCT file, line, text FROM n))
SELECT n.file, CAST(n.line AS BIGINT) AS line, CAST(n."column" AS BIGINT) AS "column", n.code FROM n JOIN c ON c.file = n.file AND c.line = n.line WHERE NOT (n.code = 'W203' AND deep > 0)""")
def commented_filter(spark, sf_dir):
    src = _texts(spark, sf_dir)
    return postfilters.drop_commented(_found(src), src).select("file", "line", "column", "code")


@query("macro_framework_filter", f"""WITH n AS ({_NAMED}), k AS (SELECT file, CAST(regexp_extract(file, 'o([0-9]+)', 1) AS INT) % 10 AS k FROM (SELECT DISTINCT file FROM n))
SELECT n.file, CAST(n.line AS BIGINT) AS line, CAST(n."column" AS BIGINT) AS "column", n.code FROM n JOIN k USING (file) WHERE NOT (k = 1 AND code IN ('E001', 'E006')) AND NOT (k = 2 AND code = 'E006' AND contains(text, 'RETURN'))""")
def macro_framework_filter(spark, sf_dir):
    src = _texts(spark, sf_dir)
    return postfilters.drop_macro_frameworks(_found(src), src).select("file", "line", "column", "code")


@query("protected_apostrophes", f"SELECT file, string_agg(CASE WHEN ends_with(file, '.ext') AND contains(x, '\"') THEN replace(x, '''', '’') ELSE x END, chr(10) ORDER BY n) AS text FROM (SELECT file, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM ({_TEXT_SQL})) GROUP BY file")
def protected_apostrophes(spark, sf_dir):
    return postfilters.protect_apostrophes(_texts(spark, sf_dir)).select("file", "text")


@query("file_kinds", f"SELECT file, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'sqf' WHEN 1 THEN 'config' WHEN 2 THEN 'config' WHEN 3 THEN CASE WHEN file = 'mission.sqm' OR dir = 'named' THEN 'mission' END WHEN 5 THEN 'mission' END AS kind FROM (SELECT page_id, CASE CAST(page_id % 6 AS INT) WHEN 5 THEN 'Named/Mission' || CAST(page_id AS VARCHAR) || '.SQM' ELSE file || CAST(page_id AS VARCHAR) || ['.SQF', '.hpp', '.Ext', '.sqm', '.txt'][CAST(page_id % 6 AS INT) + 1] END AS file, '' AS dir FROM ({_PATHS}))")
def file_kinds(spark, sf_dir):
    f = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/x")).alias("file"))
    k = (F.col("page_id") % 6).cast("int")
    ends = F.get(F.array(*[F.lit(e) for e in (".SQF", ".hpp", ".Ext", ".sqm", ".txt")]), k)
    named = f.select(F.when(k == 5, F.concat(F.lit("Named/Mission"), F.col("page_id").cast("string"), F.lit(".SQM"))).otherwise(F.concat("file", F.col("page_id").cast("string"), ends)).alias("file"))
    return named.select("file", postfilters.kind_of(F.col("file"), roots=["named/"], named=["other.sqm"]).alias("kind"))


@query("include_origins", f"WITH e AS (SELECT DISTINCT src, dst FROM ({_EDGES})), d AS (SELECT DISTINCT dst AS file FROM e) SELECT file, CASE WHEN file = 'c1' THEN '' ELSE coalesce((SELECT string_agg('included from ' || src, '/' ORDER BY src) FROM e WHERE e.dst = d.file), '') END AS related FROM d")
def include_origins(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("line", F.lit(3))
    d = edges.select(F.col("dst").alias("file")).distinct()
    return postfilters.with_origins(d, edges, F.lit("c1")).select("file", F.array_join(F.transform("related", lambda r: r["message"]), "/").alias("related"))


# Reports

_UNIQUE = f"SELECT DISTINCT file, line, \"column\", severity, code, message, pass_no, seq, {_PRINT} AS print FROM d"


@query("sink_json_array", f"""{_D}, r AS (SELECT row_number() OVER (ORDER BY file, pass_no, seq, line, "column", report) AS n, report FROM (SELECT DISTINCT file, pass_no, seq, line, "column", '{{"file":"' || file || '","line":' || line || ',"column":' || "column" || ',"severity":"' || severity || '","code":"' || code || '","message":"' || message || '"}}' AS report FROM d))
SELECT '[' AS report UNION ALL SELECT ']' UNION ALL SELECT CASE WHEN n > 1 THEN ',' ELSE '' END || report FROM r""")
def sink_json_array(spark, sf_dir):
    return sinks.json_array(made_diagnostics(spark, sf_dir))


@query("sink_sarif_report", f"""{_D}, r AS (SELECT row_number() OVER (ORDER BY file, pass_no, seq, line, "column", report) AS n, report FROM (SELECT DISTINCT file, pass_no, seq, line, "column", '{{"ruleId":"' || code || '","level":"' || severity || '","message":{{"text":"' || message || '"}},"partialFingerprints":{{"primary":"' || {_PRINT} || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || '}}}}}}]}}' AS report FROM d))
SELECT '{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"automationDetails":{{"id":"scriptflow/default"}},"tool":{{"driver":{{"name":"scriptflow","version":"1","rules":[{{"id":"E001"}}]}}}},"results":[' AS report UNION ALL SELECT ']}}]}}' UNION ALL SELECT CASE WHEN n > 1 THEN ',' ELSE '' END || report FROM r""")
def sink_sarif_report(spark, sf_dir):
    return sinks.sarif(made_diagnostics(spark, sf_dir), [{"id": "E001"}])


@query("summary_line", f"{_D} SELECT CAST(count(DISTINCT file) AS VARCHAR) || ' of 1 file linted, ' || CAST(count(*) AS VARCHAR) || ' diagnostics' AS report FROM d")
def summary_line(spark, sf_dir):
    d = made_diagnostics(spark, sf_dir)
    return sinks.summary(d, d.select("file"), 1)


@query("limit_then_filters", f"{_D}, f AS (SELECT * FROM d ORDER BY file, pass_no, seq, line, \"column\", code, message LIMIT 200) SELECT {_SHOWN}, pass_no, seq FROM f WHERE {_PRINT} NOT IN (SELECT {_PRINT} FROM d WHERE seq % 3 = 0) AND line < 30")
def limit_then_filters(spark, sf_dir):
    """The limit comes before the baseline and the changed lines, so fewer than 200 are left."""
    d = made_diagnostics(spark, sf_dir)
    changed = d.where("line < 30").select("file", "line")
    return diagnostics.reported(d, 200, d.where("seq % 3 = 0").select(diagnostics.fingerprints(d).alias("fingerprint")), changed)


@query("fixed_sources", f"{SCRIPTS_SQL}, x AS (SELECT file, text, string_agg(replace(rtrim(line, ' ' || chr(9)), chr(9), '    '), chr(10) ORDER BY n) AS fixed FROM (SELECT file, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM src) GROUP BY file, text) SELECT file, fixed AS text FROM x WHERE fixed <> text")
def fixed_sources(spark, sf_dir):
    return sinks.fixed_sources(script_sources(spark, sf_dir))


@query("rule_table", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '| `{c}` | {s} | {n} |')" for c, (s, n) in CATALOG.items()) + ") v(code, report)")
def rule_table(spark, sf_dir):
    """Without the categories' column, which is a rule of its own."""
    return sinks.catalog_table(rules.catalog(spark)).select("code", F.regexp_replace("report", r" \| [a-z, ]+ \|$", " |").alias("report"))


# Addons

_ADDON_FILES = """SELECT 'mods/@m' || CAST(s_nationkey AS VARCHAR) AS mod, 'mods/@m' || CAST(s_nationkey AS VARCHAR) || CASE WHEN s_nationkey % 2 = 0 THEN '/Addons/' ELSE '/addons/' END || CASE s_suppkey % 3 WHEN 0 THEN 'core_main' WHEN 1 THEN 'gui' ELSE 'pack' || CAST(s_suppkey AS VARCHAR) || '.PBO' END AS addon, s_suppkey AS k, s_nationkey AS n FROM supplier"""


def _addon_files(spark, sf_dir):
    mod = F.concat(F.lit("mods/@m"), F.col("s_nationkey").cast("string"))
    k = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, "core_main").when(F.col("s_suppkey") % 3 == 1, "gui").otherwise(F.concat(F.lit("pack"), k, F.lit(".PBO")))
    addon = F.concat(mod, F.when(F.col("s_nationkey") % 2 == 0, "/Addons/").otherwise("/addons/"), name)
    rows = _table(spark, sf_dir, "supplier").select(mod.alias("mod"), addon.alias("addon"), F.col("s_suppkey").alias("k"), k.alias("ks"), F.col("s_nationkey").alias("n"))
    header = F.concat(F.lit("#define PREFIX pre"), F.col("n").cast("string"), F.lit("\n#define COMPONENT comp\n"))
    patch = F.concat(F.lit('class CfgPatches { class ADDON { units = 1; }\n class lit_'), F.col("ks"), F.lit(": base { x = 1; };\n};"))
    held = lambda text, *name: F.struct(F.concat("addon", *(F.lit(n) if n != "ks" else F.col(n) for n in name)).alias("file"), text.cast("string").alias("text"))
    core = lambda f: F.when(F.col("k") % 3 == 0, f)
    files = F.array(
        held(F.lit(""), "\\functions\\fnc_Do", "ks", ".sqf"), held(F.lit(None), "/f/FN_make", "ks", ".SQF"), held(F.lit(""), "/f/fnx", "ks", ".sqf"),
        core(held(F.concat(header, F.lit("// ")), "/script_component.hpp")), core(held(patch, "/Config.cpp")),
    )
    return rows.select("mod", "addon", "k", "n", F.explode(F.array_compact(files)).alias("f")).select("mod", "addon", "f.file", "f.text")


@query("addon_listing", f"SELECT DISTINCT mod, 'dir' AS kind, addon FROM ({_ADDON_FILES}) WHERE k % 3 = 0 UNION SELECT mod, 'pbo', addon FROM ({_ADDON_FILES}) WHERE k % 3 = 2")
def addon_listing(spark, sf_dir):
    files = _addon_files(spark, sf_dir)
    packed = files.where(F.col("addon").endswith(".PBO")).select(F.col("addon").alias("file"))
    return addons.list_addons(files.where(~F.col("addon").endswith(".PBO")).select("file").union(packed))


@query("addon_functions", f"""WITH a AS ({_ADDON_FILES}), t AS (SELECT *, CASE k % 3 WHEN 0 THEN 'core_main' WHEN 1 THEN 'gui' ELSE 'pack' || CAST(k AS VARCHAR) END AS tag, max(k % 3 = 0) OVER (PARTITION BY mod) AS shared FROM a)
SELECT DISTINCT addon, addon || '\\functions\\fnc_Do' || CAST(k AS VARCHAR) || '.sqf' AS file, lower(tag || '_fnc_Do' || CAST(k AS VARCHAR)) AS name FROM t
UNION SELECT addon, addon || '/f/FN_make' || CAST(k AS VARCHAR) || '.SQF', lower(x || '_fnc_make' || CAST(k AS VARCHAR)) FROM (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN ['pre' || CAST(n AS VARCHAR), tag] WHEN shared THEN ['pre' || CAST(n AS VARCHAR)] ELSE [tag] END) AS x FROM t)""")
def addon_functions(spark, sf_dir):
    return addons.named_functions(_addon_files(spark, sf_dir))


@query("addon_patches", f"WITH a AS (SELECT addon, n, min(k) AS k FROM ({_ADDON_FILES}) WHERE k % 3 = 0 GROUP BY addon, n) SELECT addon, 'pre' || CAST(n AS VARCHAR) || '_comp' AS name FROM a UNION SELECT addon, 'lit_' || CAST(k AS VARCHAR) FROM a")
def addon_patches(spark, sf_dir):
    """Of an addon with several configs the first one's patches count; here each has one, of its smallest number."""
    files = _addon_files(spark, sf_dir)
    first = files.where(F.col("file").endswith("/Config.cpp")).groupBy("addon", "file").agg(F.min_by("text", F.regexp_extract("text", r"lit_(\d+)", 1).cast("int")).alias("text"))
    return addons.patches(files.where(~F.col("file").endswith("/Config.cpp")).select("addon", "file", "text").union(first))


_NAMES_SQL = "SELECT 'gm_' || lower(replace(p_type, ' ', '_')) || '_' || CAST(p_size AS VARCHAR) AS name, p_partkey AS k FROM part"


@query("addon_owners", f"WITH n AS ({_NAMES_SQL}), s AS (SELECT name AS stem, 'own' AS owner FROM n WHERE k % 5 = 0 UNION SELECT regexp_replace(name, '_[^_]*$', ''), 'kind' FROM n WHERE k % 3 = 0 UNION SELECT 'gm', 'root') SELECT n.name, max_by(owner, len(stem)) AS owner FROM (SELECT DISTINCT name FROM n) n JOIN s ON n.name = s.stem OR starts_with(n.name, s.stem || '_') GROUP BY n.name")
def addon_owners(spark, sf_dir):
    n = _table(spark, sf_dir, "part").select(F.concat(F.lit("gm_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("k"))
    stems = n.where("k % 5 = 0").select(F.col("name").alias("stem"), F.lit("own").alias("owner")).union(n.where("k % 3 = 0").select(F.regexp_replace("name", "_[^_]*$", ""), F.lit("kind"))).union(n.sparkSession.range(1).select(F.lit("GM"), F.lit("root"))).distinct()
    return addons.owners(n, stems)


@query("game_roots", "SELECT 'base' AS root UNION SELECT 'dlc' || CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part)")
def game_roots(spark, sf_dir):
    """Every part asks for an addon of the supplier of its number, half of them by a name that goes on behind the archive's."""
    need = _table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "A3_").otherwise(""), F.lit("addon"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_more").otherwise("")).alias("name"))
    held = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("dlc"), F.col("s_nationkey").cast("string")).alias("root"), F.concat(F.lit("Addons/Addon"), F.col("s_suppkey").cast("string"), F.lit(".ebo")).alias("file"))
    return addons.select_roots(need, held, spark.range(1).select(F.lit("base").alias("root")))


@query("function_files", "SELECT DISTINCT 'f' || CAST(s_suppkey AS VARCHAR) AS name, 'src/' || CAST(p_partkey AS VARCHAR) || '/run' || CAST(p_size AS VARCHAR) || '.SQF' AS file FROM supplier JOIN part ON p_size = s_suppkey % 60")
def function_files(spark, sf_dir):
    declared = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("\\x\\Run"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".sqf")).alias("path"))
    held = _table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("/run"), F.col("p_size").cast("string"), F.lit(".SQF")).alias("file"))
    return addons.matching_files(declared, held)


@query("mod_resolution", "SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce((SELECT min_by('ws/' || CAST(s_nationkey AS VARCHAR) || '/' || CAST(s_suppkey AS VARCHAR), 0) FROM supplier WHERE s_suppkey = p_partkey), (SELECT min('ws/mod' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) FROM supplier WHERE s_suppkey % 50 = p_size)) AS path FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) OR p_size IN (SELECT s_suppkey % 50 FROM supplier)")
def mod_resolution(spark, sf_dir):
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    wanted = part.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("Addon"), F.col("p_size").cast("string")).alias("name"))
    folders = supplier.select(F.concat_ws("/", F.lit("ws"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")).alias("path"))
    archives = supplier.select(F.concat(F.lit("ws/mod"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("mod"), F.concat(F.lit("x/ADDON"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".pbo")).alias("file"))
    return addons.resolve_mods(wanted, folders, archives)


_PARAMS = "concat('hint \"x\"; params [\"_a\", [\"_b', p_partkey, '\", 0, [0, \"\"', CASE p_partkey % 3 WHEN 0 THEN ', []' WHEN 1 THEN ', x' ELSE '' END, ']], [\"_c\", 1]];', CASE p_partkey % 4 WHEN 0 THEN ' _d = _this param [4, 0, [objNull, true]]; _e = param [0, 1, [{}]];' WHEN 1 THEN ' _e = param [1, \"\", [grpNull]]; params [\"_z\"];' ELSE '' END)"


@query("parameter_types", """WITH p AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS file, p_partkey AS k FROM part), s AS (SELECT file, k, unnest(range(CASE WHEN k % 4 = 0 THEN 5 ELSE 3 END)) AS pos FROM p)
SELECT file, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 0 THEN CASE WHEN k % 4 = 0 THEN 'Code' END WHEN 1 THEN 'Number/String' || CASE WHEN k % 3 = 0 THEN '/Array' ELSE '' END || CASE WHEN k % 4 = 1 THEN '/Group' ELSE '' END WHEN 4 THEN 'Object/Boolean' END AS types FROM s""")
def parameter_types(spark, sf_dir):
    src = _table(spark, sf_dir, "part").selectExpr("concat('f', p_partkey) AS file", f"{_PARAMS} AS text")
    return addons.parameter_types(Project(src, registry(spark), True)).select("file", "pos", F.array_join("types", "/").alias("types"))


_XML = """concat('<command name="cmd', p_partkey, '" version="1" game="g">', CASE WHEN p_partkey % 7 = 0 THEN '<deprecated/>' ELSE '' END, '<syntax><param name="a" type="', CASE p_partkey % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'position_asl' WHEN 2 THEN 'anything' ELSE 'string' END, '" optional="t" order="', CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, '"/>',
 CASE WHEN p_partkey % 3 = 0 THEN '<param name="b" type="number" order="1"/>' ELSE '' END, '<return><value type="', CASE WHEN p_partkey % 2 = 0 THEN 'boolean' ELSE 'nothing' END, '"><alt-types><t type="boolean"/></alt-types></value></return></syntax></command>')"""


def _metadata(spark, sf_dir):
    return addons.read_metadata(_table(spark, sf_dir, "part").selectExpr(f"{_XML} AS text"))


@query("command_metadata", """SELECT 'cmd' || CAST(p_partkey AS VARCHAR) AS name, '1' AS version, 'g' AS game, p_partkey % 7 = 0 AS deprecated, false AS uncertain, 1 AS forms, CASE WHEN p_partkey % 3 = 0 THEN 'a:0/b:1' ELSE 'a:1' END AS params, CASE WHEN p_partkey % 2 = 0 THEN 'BOOLEAN' ELSE 'NOTHING/BOOLEAN' END AS returns FROM part""")
def command_metadata(spark, sf_dir):
    first = F.get("syntaxes", 0)
    return _metadata(spark, sf_dir).select("name", "version", "game", "deprecated", "uncertain", F.size("syntaxes").alias("forms"), F.array_join(F.transform(first["params"], lambda q: F.concat_ws(":", q["name"], q["order"].cast("string"))), "/").alias("params"), F.array_join(first["returns"], "/").alias("returns"))


@query("command_signatures", """SELECT 'cmd' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN k = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS arity, CASE WHEN k = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Number' ELSE CASE k WHEN 0 THEN 'Object' WHEN 1 THEN 'Array' ELSE 'String' END END AS label, 'Boolean' AS returns FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def command_signatures(spark, sf_dir):
    return addons.signatures(_metadata(spark, sf_dir), ["if"]).select("name", "arity", "label", "returns")


@query("reference_names", "SELECT DISTINCT 'cmd' || CAST(p_size AS VARCHAR) AS name, 'tree' AS source FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT 'bis_fnc_' || CAST(p_size AS VARCHAR), 'keys' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT 'BIS_fnc_' || CAST(p_size AS VARCHAR), 'lines' FROM part WHERE p_partkey % 5 = 0")
def reference_names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    tree = part.selectExpr("concat('{\"tree\":[{\"path\":\"a/cmd', p_size, CASE WHEN p_partkey % 2 = 0 THEN '.xml' ELSE '.md' END, '\",\"type\":\"blob\"},{\"path\":\"b/c.xml\",\"type\":\"tree\"}]}') AS text")
    keys = part.selectExpr("concat('{\"', CASE WHEN p_partkey % 3 = 0 THEN 'bis_fnc_' ELSE 'bin_fnc_' END, p_size, '\": {}}') AS text")
    lines = part.selectExpr("concat('# c\n  ', CASE WHEN p_partkey % 5 = 0 THEN 'BIS_fnc_' ELSE 'other_' END, p_size, ' \n\n') AS text")
    told = lambda df, source: df.select("name", F.lit(source).alias("source"))
    return told(addons.tree_commands(tree), "tree").union(told(addons.keyed_names(keys, "bis_fnc_"), "keys")).union(told(addons.listed_names(lines, "bis_fnc_"), "lines"))


@query("registry_file", "WITH n AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS v FROM part) SELECT '# names' AS value UNION ALL SELECT '# brands: ' || CAST(count(*) AS VARCHAR) FROM n UNION ALL SELECT v FROM n")
def registry_file(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("name"))
    return addons.registry_text(names.union(names.sparkSession.range(1).select(F.lit("not a name"))), "brands", ["names"])


@query("reuse_counts", "SELECT 'r' || CAST(doc_id % 7 AS VARCHAR) AS root, CAST(count(*) FILTER (doc_id % 10 NOT IN (1, 3)) AS BIGINT) AS reused, count(*) FILTER (doc_id % 10 IN (1, 3)) AS rescanned FROM documents WHERE doc_id % 10 <> 2 GROUP BY 1")
def reuse_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")).alias("root"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.lit(1).alias("mtime_ns"), F.col("n_chars").alias("size"))
    old = d.where("doc_id % 10 <> 1")
    new = d.where("doc_id % 10 <> 2").withColumn("mtime_ns", F.when(F.col("doc_id") % 10 == 3, 2).otherwise(F.col("mtime_ns")))
    return addons.reuse_counts(watch.snapshot_diff(old, new), new)


@query("mission_requirements", "SELECT DISTINCT lower('a_' || o_orderstatus || CAST(o_orderkey % 400 AS VARCHAR)) AS name FROM orders")
def mission_requirements(spark, sf_dir):
    lists = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("A_"), "o_orderstatus", (F.col("o_orderkey") % 400).cast("string"))), '","').alias("n"))
    return addons.required_addons(lists.select(F.concat(F.lit("deep/m"), F.col("o_custkey").cast("string"), F.lit("/mission.SQM")).alias("file"), F.concat(F.lit('addOns[] = {"'), "n", F.lit('"};')).alias("text")))


@query("library_folders", "SELECT DISTINCT 'D:\\lib' || CAST(s_nationkey AS VARCHAR) || '\\x' AS path FROM supplier UNION SELECT DISTINCT '/home/u' || CAST(s_suppkey % 7 AS VARCHAR) FROM supplier")
def library_folders(spark, sf_dir):
    text = _table(spark, sf_dir, "supplier").select(F.concat(F.lit('"0" { "path"\t\t"D:\\\\lib'), F.col("s_nationkey").cast("string"), F.lit('\\\\x" "label" "" "totalsize" "12" } "1" "/home/u'), (F.col("s_suppkey") % 7).cast("string"), F.lit('" "2" "33"')).alias("text"))
    return addons.library_folders(text)


@query("macro_locals", """WITH n AS (SELECT s_suppkey AS k, 'd/s' || CAST(s_suppkey AS VARCHAR) || '.sqf' AS file, CAST(s_suppkey AS VARCHAR) AS t FROM supplier), own AS (SELECT file, k, unnest(list_concat(['__file__', '__line__', '_loc' || t, '_q' || t, '_p' || t], CASE WHEN k % 3 = 0 THEN ['_thisclass', '_thisobject', '_oop_logscope'] ELSE [] END)) AS name FROM n)
SELECT DISTINCT a.file, o.name FROM n a JOIN n b ON b.k >= a.k AND b.k // 10 = a.k // 10 JOIN own o ON o.k = b.k""")
def macro_locals(spark, sf_dir):
    """Ten files in a row include the next one each, so the first sees the names of all."""
    k = F.col("s_suppkey").cast("string")
    follows = F.when(F.col("s_suppkey") % 10 != 9, F.concat(F.lit('#include "s'), (F.col("s_suppkey") + 1).cast("string"), F.lit('.sqf"\n'))).otherwise("")
    text = F.concat(follows, F.lit("#define M(x) private _Loc"), k, F.lit(' = x; \\\n f("_q'), k, F.lit('")\nparams ["_p'), k, F.lit('", _no];\n_not = 1;\n'), F.when(F.col("s_suppkey") % 3 == 0, "METHOD (x)").otherwise(""))
    src = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("d/s"), k, F.lit(".sqf")).alias("file"), text.alias("text"))
    return preprocess.macro_locals(Project(src, registry(spark)))


@query("expression_nodes", """WITH p AS (SELECT 'e' || CAST(p_size AS VARCHAR) AS file, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r FROM part), n(node, parent, kind, value) AS (VALUES (0, NULL, 'binary', '='), (1, 0, 'name', '_a'), (2, 0, 'binary', '+'), (3, 2, 'literal', 'K'), (4, 2, 'binary', '*'), (5, 4, 'command', 'count'), (6, 5, 'array', ''), (7, 6, 'literal', '1'), (8, 6, 'group', ''), (9, 8, 'name', 'x'), (10, 4, 'code', ''), (11, 10, 'call', 'call'), (12, 11, 'name', 'f'))
SELECT file, CAST(r * 23 AS BIGINT) AS stmt, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, kind, CASE value WHEN 'K' THEN CAST(k AS VARCHAR) ELSE value END AS value FROM p, n""")
def expression_nodes(spark, sf_dir):
    """A statement for each part, and behind it one that is no whole expression."""
    src = _made(spark, sf_dir, "part", [], "concat('e', p_size)", "concat('_a = ', p_partkey, ' + count [1, (x)] * { call f }; _b = 1 +;')", "p_partkey")
    return expressions.nodes(Project(src, registry(spark)))


# Types

_COMMANDS = [("publicvariable", 1, ["String"], "String", None), ("str", 1, ["Array", "String", "Code"], "Array, String or Code", "String"), ("hint", 1, ["String", "Structured Text"], "String or Structured Text", None), ("count", 1, ["Array"], "Array", "Number"), ("setpos", 2, ["Array"], "Array", None), ("call3", 1, ["Code"], "Code", "Code")]
_FUNCTION_TYPES = [("fn_1", 0, ["Object"]), ("fn_1", 1, ["String", "Array"]), ("fn_2", 0, ["Number"]), ("fn_2", 1, ["Boolean"]), ("fn_2", 2, None)]


def _commands(spark):
    return spark.createDataFrame(_COMMANDS, "name string, arity int, operand array<string>, label string, returns string")


def _typed(spark, sf_dir):
    return project(spark, sf_dir, keep=True)


_LIT = "CASE WHEN {t} = 'number' THEN 'Number' WHEN {t} = 'string' THEN 'String' WHEN {t} = 'keyword' AND {v} IN ('true','false') THEN 'Boolean' WHEN {t} = 'lbracket' THEN 'Array' WHEN {t} = 'lbrace' THEN 'Code' WHEN {v} = 'objnull' THEN 'Object' WHEN {v} = 'grpnull' THEN 'Group' END"
_ENDS = "coalesce({t} IN ('semicolon','rbrace'), true)"
_TYPED = f"""cmd(name, arity, operand, label, returns) AS (VALUES {', '.join(f"('{n}', {a}, {o!r}, '{la}', {f"'{r}'" if r else 'NULL'})" for n, a, o, la, r in _COMMANDS)}),
asg AS MATERIALIZED (SELECT g.file, g.s, g.v AS name, g.n2t, g.n2v, CASE WHEN g.n2t NOT IN ('lbracket','lbrace') AND {_ENDS.format(t='g.n3t')} AND ({_LIT.format(t='g.n2t', v='g.n2v')}) IS NOT NULL THEN {_LIT.format(t='g.n2t', v='g.n2v')}
 WHEN g.n2t IN ('lbracket','lbrace') AND p.close IS NOT NULL AND {_ENDS.format(t='a.type')} THEN {_LIT.format(t='g.n2t', v='g.n2v')}
 WHEN g.n2t = 'ident' AND g.n3t IN ('local','string','number') AND {_ENDS.format(t='e.type')} THEN c.returns END AS t
 FROM sig g LEFT JOIN pairs p ON p.file = g.file AND p.open = g.s + 2 LEFT JOIN sig a ON a.file = g.file AND a.s = p.close + 1 LEFT JOIN sig e ON e.file = g.file AND e.s = g.s + 4 LEFT JOIN cmd c ON c.name = g.n2v AND c.returns IS NOT NULL WHERE g.type = 'local' AND g.n1t = 'operator' AND g.n1v = '='),
ty AS MATERIALIZED (SELECT g.*, coalesce({_LIT.format(t='g.type', v='g.v')}, CASE WHEN g.type = 'local' AND g.v <> '_x' AND (SELECT count(DISTINCT t) FROM asg x WHERE x.file = g.file AND x.name = g.v AND x.s < g.s) <= 1 AND NOT EXISTS (SELECT 1 FROM sig q WHERE q.file = g.file AND q.type = 'local' AND q.v = g.v AND q.n1v IN ('isequaltype','isequaltypeall')) THEN l.t END) AS t, CASE WHEN g.type = 'local' THEN l.s END AS of
 FROM sig g LEFT JOIN asg l ON l.file = g.file AND l.name = g.v AND l.s = (SELECT max(x.s) FROM asg x WHERE x.file = g.file AND x.name = g.v AND x.s < g.s))"""
_rule("w203_operands", lambda p: types.operands(p, _commands(p.sources.sparkSession)), f"""WITH {_TYPED} SELECT b.file, b.line, b.col, a.value || ' expects ' || cmd.label || ', got ' || b.t AS message FROM ty a JOIN ty b ON b.file = a.file AND b.s = a.s + 1 JOIN cmd ON cmd.name = a.v WHERE a.type = 'ident' AND b.t IS NOT NULL AND b.v <> '_x' AND NOT list_contains(cmd.operand, b.t)
 AND NOT (a.v = 'count' AND coalesce(a.p1t = 'rbrace', false)) AND NOT EXISTS (SELECT 1 FROM sig k WHERE k.file = a.file AND k.v = 'select' AND k.s > a.s)""")
_rule("w205_typed_targets", lambda p: types.call_targets(p, _commands(p.sources.sparkSession)), f"WITH {_TYPED} SELECT b.file, b.line, b.col, a.value || ' expects Code or String, got ' || b.t AS message FROM ty a JOIN ty b ON b.file = a.file AND b.s = a.s + 1 WHERE a.type = 'keyword' AND a.v IN ('call','spawn') AND b.type IN ('local','number','keyword') AND b.t NOT IN ('Code','String')")
_rule("w203_arguments", lambda p: types.arguments(p, p.sources.sparkSession.createDataFrame(_FUNCTION_TYPES, "name string, pos int, types array<string>"), _commands(p.sources.sparkSession)), f"""WITH {_TYPED}, fs(name, pos, kinds) AS (VALUES {', '.join(f"('{n}', {k}, {t if t else 'NULL'})" for n, k, t in _FUNCTION_TYPES)}),
cl AS (SELECT c.file, p.open, p.close, c.n1v, c.n1value FROM sig c JOIN pairs p ON p.file = c.file AND p.close = c.s - 1 WHERE c.type = 'keyword' AND c.v IN ('call','spawn') AND c.n1t = 'ident' AND c.p1t = 'rbracket'),
-- tokens of the array that aren't within further brackets, with the commas before them
inn AS (SELECT cl.*, t.s, t.type, t.t, t.line, t.col, (SELECT count(*) FROM sig k WHERE k.file = cl.file AND k.type = 'comma' AND k.s > cl.open AND k.s < t.s AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file = cl.file AND q.open > cl.open AND q.close < cl.close AND q.open < k.s AND q.close > k.s)) AS item FROM cl JOIN ty t ON t.file = cl.file AND t.s > cl.open AND t.s < cl.close AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file = cl.file AND q.open > cl.open AND q.close < cl.close AND q.open < t.s AND q.close >= t.s) WHERE t.type <> 'comma'),
one AS (SELECT file, open, n1v, n1value, item, any_value(s) AS s, any_value(t) AS t, any_value(line) AS line, any_value(col) AS col FROM inn GROUP BY file, open, n1v, n1value, item HAVING count(*) = 1)
SELECT o.file, o.line, o.col, o.n1value || ' argument ' || CAST(item + 1 AS VARCHAR) || ' expects ' || array_to_string(kinds, '|') || ', got ' || t AS message FROM one o JOIN fs ON fs.name = o.n1v AND fs.pos = item WHERE t IS NOT NULL AND kinds IS NOT NULL AND NOT list_contains(kinds, t)""")
_RESULTS = "('count','find','findif','inputaction','getvariable','gettext','getnumber','gethitpointdamage','distance','distance2d','distancesqr')"
_rule("w216_comparisons", lambda p: types.comparisons(p, _commands(p.sources.sparkSession)), f"""WITH {_TYPED}, c AS (SELECT o.file, o.s, o.line, o.col, o.v, o.n1v, o.p1v, l.type AS lt, l.v AS lv, r.v AS rv, r.t AS rt, (SELECT q.v FROM sig q WHERE q.file = o.file AND q.s = o.s - 2) AS p2v,
 CASE WHEN l.type = 'local' THEN (SELECT CASE WHEN x.n2t = 'number' THEN 'Number' WHEN x.n2t = 'string' THEN 'String' WHEN x.n2v IN ('true','false') THEN 'Boolean' END FROM asg x WHERE x.file = o.file AND x.s = l.of AND o.s - x.s <= 160) ELSE l.t END AS lk,
 coalesce((SELECT max(m.s) FROM sig m WHERE m.file = o.file AND m.type = 'semicolon' AND m.s < o.s), -1) AS fin, coalesce((SELECT min(m.s) FROM sig m WHERE m.file = o.file AND m.type = 'semicolon' AND m.s > o.s), 1073741824) AS nxt
 FROM ty o JOIN ty l ON l.file = o.file AND l.s = o.s - 1 JOIN ty r ON r.file = o.file AND r.s = o.s + 1 WHERE o.type = 'operator' AND o.v IN ('==','!=','<','>','<=','>='))
SELECT c.file, c.line, c.col, 'comparison cannot match ' || lk || ' with ' || rt AS message FROM c WHERE lk IN ('Number','String','Boolean') AND rt IN ('Number','String','Boolean') AND lk <> rt AND lv <> '_x' AND rv <> '_x'
 AND NOT (v = '>' AND (coalesce(n1v = '>', false) OR coalesce(p1v = '>', false))) AND NOT (lt = 'number' AND coalesce(p2v IN ('select','#'), false)) AND NOT (lt = 'local' AND coalesce(p2v = 'typename', false))
 AND NOT (v IN ('<','>','<=','>=') AND EXISTS (SELECT 1 FROM sig z WHERE z.file = c.file AND z.s BETWEEN c.s - 48 AND c.s + 16 AND ((z.v = '>' AND coalesce(z.n1v = '>', false)) OR z.v IN ('configfile','gettext','getnumber'))))
 AND NOT EXISTS (SELECT 1 FROM sig z WHERE z.file = c.file AND z.v IN {_RESULTS} AND z.s > fin AND z.s < c.s AND c.s - z.s <= 97) AND NOT EXISTS (SELECT 1 FROM sig z WHERE z.file = c.file AND z.v IN ('gettext','getnumber') AND z.s > c.s AND z.s < nxt AND z.s - c.s <= 96)
 AND NOT (lt = 'local' AND EXISTS (SELECT 1 FROM asg x JOIN sig z ON z.file = x.file AND z.v IN ('findif','find','count','inputaction') AND z.s > x.s WHERE x.file = c.file AND x.name = lv AND x.s < c.s AND NOT EXISTS (SELECT 1 FROM sig m WHERE m.file = x.file AND m.type = 'semicolon' AND m.s > x.s AND m.s < z.s)))""")
assert _LINES
