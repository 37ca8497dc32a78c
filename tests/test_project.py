"""The whole chain on small projects, its servers and sinks, and what SQL doesn't show."""

import io
import json

import pytest
from pyspark.sql import functions as F

from scriptflow import serve
from scriptflow.lint import lint
from scriptflow.operators import addons, cfg_functions, diagnostics, includes, plugins, postfilters, preprocess, rules, sinks, types
from scriptflow.operators.rules import Project
from scriptflow.sources import files, project_config

NAMES = [("command", n) for n in ("hint", "str", "diag_log", "alive", "addeventhandler")] + [("function", "tag_fnc_known")]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(NAMES, "kind string, name string")


@pytest.fixture(scope="module")
def commands(spark):
    return spark.createDataFrame([("hint", 1, ["String"], "String", None), ("str", 1, ["Number"], "Number", "String")], "name string, arity int, operand array<string>, label string, returns string")


def test_include_chains_have_no_bound(spark):
    chain = [(f"f{k}", f"f{k + 1}") for k in range(200)] + [("x", "y"), ("y", "x"), (None, "x"), ("x", None), ("x", "y")]
    got = {(r["src"], r["dst"]): r["depth"] for r in includes.closure(spark.createDataFrame(chain, "src string, dst string")).collect()}
    want = {(f"f{a}", f"f{b}"): b - a for a in range(201) for b in range(a + 1, 201)} | {("x", "y"): 1, ("y", "x"): 1, ("x", "x"): 2, ("y", "y"): 2}
    assert got == want
    assert includes.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_deep_includes_are_preprocessed(spark, registry):
    sources = [(f"d/f{k}.sqf", f'#include "f{k + 1}.sqf"\n') for k in range(80)] + [("d/f80.sqf", "last = 1;")]
    out = preprocess.preprocess(Project(spark.createDataFrame(sources, "file string, text string"), registry)).where("file = 'd/f0.sqf'").first()
    assert "last = 1;" in out["text"]


def test_lint_takes_each_kind_of_file_as_what_it_is(spark, registry, commands):
    sources = {
        "m/a.sqf": 'private _n = 5;\nhint _n;\n[1] call tag_fnc_gone;\n[1, 2] call tag_fnc_known;\nx = [1,];\n// lint: disable-next-line E003\ny = [2,];\ndiag_log "unknown zap";\n',
        "m/ui.hpp": 'class A {\n onLoad = "hint 5; [] call nowhere_fnc_x;";\n b = 1;\n b = 2;\n};\n',
        "m/mission.sqm": 'version=1; class Mission {}; addOns[] = {"a", "A"};', "m/deep/mission.sqm": "junk }", "m/notes.txt": "}}}", "m/empty.sqf": "", "m/null.sqf": None,
    }
    rows = spark.createDataFrame(list(sources.items()), "file string, text string")
    kinds = spark.createDataFrame([("tag_fnc_known", 0, ["String"])], "name string, pos int, types array<string>")
    found = lint(rows.union(rows.limit(1)), registry, commands=commands, function_types=kinds, roots=["m"], severities={"W201": "error"}, style=True)
    got = {(r["file"], r["line"], r["code"], r["severity"]) for r in found.collect()}
    assert {("m/a.sqf", 2, "W203", "warning"), ("m/a.sqf", 3, "W201", "error"), ("m/a.sqf", 4, "W203", "warning"), ("m/a.sqf", 4, "W204", "warning"), ("m/a.sqf", 5, "E003", "error")} <= got
    assert {("m/ui.hpp", 2, "W201", "error"), ("m/ui.hpp", 4, "W214", "warning"), ("m/mission.sqm", 1, "W212", "warning")} <= got
    assert not any(f in ("m/notes.txt", "m/deep/mission.sqm", "m/empty.sqf", "m/null.sqf") or (f, line) == ("m/a.sqf", 7) for f, line, _, _ in got)
    assert ("m/ui.hpp", "W203") not in {(f, c) for f, _, c, _ in got}  # headers keep no type findings
    places = [(r["file"], r["line"], r["column"], r["code"], r["message"]) for r in found.collect()]
    assert len(places) == len(set(places))
    column = next(c for f, _, c, code, _ in places if f == "m/ui.hpp" and code == "W201")
    assert sources["m/ui.hpp"].split("\n")[1][column - 1 :].startswith("nowhere_fnc_x")


def test_types_follow_assignments(spark, registry, commands):
    cases = {
        "lit": ("hint 5;", 1), "of": ("_a = 5; hint _a;", 1), "mixed": ('_a = 5; _a = "s"; hint _a;', 0), "unknown": ("_a = 5; _a = foo; hint _a;", 0), "later": ("hint _a; _a = 5;", 0), "string": ('_a = "s"; hint _a;', 0),
        "returns": ("_a = str 5; hint _a;", 0), "returned": ("_a = str 5; hint str _a;", 1), "tested": ("_a = 5; if (_a isEqualType 1) then { hint _a; };", 0), "select": ("_a = 5; hint _a; _b select 0;", 0), "array": ("_a = [1]; hint _a;", 1), "x": ("_x = 5; hint _x;", 0), "sum": ("_a = 5 + 1; hint _a;", 0),
    }
    src = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "file string, text string")
    counts = {r["file"]: r["count"] for r in types.operands(Project(src, registry, True), commands).groupBy("file").count().collect()}
    assert counts == {k: n for k, (_, n) in cases.items() if n}


def test_functions_of_configs(spark, registry):
    texts = {
        "a": 'class CfgFunctions { class TAG { class Cat { file = "x"; class one {}; class two { class deep {}; }; };\n class Cat2 { class three { preInit = 1; }; class four: three {}; class five: four {}; class six {}; class spawn { file = "q"; }; }; }; class T2 { class Z: Y { }; class Y { file = "1"; }; class L: M {}; class M: L {}; }; };',
        "b": 'class Collections { tag = "Col"; class g { file = "z"; class h {}; }; }; class Out { class In { tag = "In"; class i { file = 1; }; class j { }; }; };',
        "c": '#define addc(cname) class cname { file = "$x"; }\nclass CfgFunctions { class M { class c { addc(foo); addc( bar ); }; }; };', "d": "", "e": None, "f": "class X {",
    }
    p = Project(spark.createDataFrame(list(texts.items()), "file string, text string"), registry)
    got = {(r["file"], r["name"]) for r in cfg_functions.functions(p).where("kind = 'function'").collect()}
    want = {"a": "tag_fnc_one tag_fnc_two tag_fnc_deep tag_fnc_three tag_fnc_four tag_fnc_five tag_fnc_spawn t2_fnc_z t2_fnc_y", "b": "col_fnc_h in_fnc_i", "c": "m_fnc_foo m_fnc_bar"}
    assert got == {(f, n) for f, names in want.items() for n in names.split()}


def test_quotes_are_read_as_the_scanner_reads_them(spark):
    def inside(text, column):
        quote, i = "", 0
        while i < min(max(0, column - 1), len(text)):
            c = text[i]
            if quote and c == quote:
                if text[i + 1 : i + 2] == quote:
                    i += 2
                    continue
                quote = ""
            elif not quote and c in "\"'":
                quote = c
            i += 1
        return bool(quote)

    lines = ['a "b" c', 'a "b""c" d', "x 'it''s' \"y'", '""', '"', "", 'a "open', '"a"""b"c"']
    rows = [(t, k) for t in lines for k in range(0, len(t) + 3)]
    got = spark.createDataFrame(rows, "text string, k int").select("text", "k", postfilters.inside_quotes(F.col("text"), F.col("k")).alias("i")).collect()
    assert [r["i"] for r in got] == [inside(t, k) for t, k in rows]


def test_configs_that_are_odd_cost_only_themselves(spark):
    texts = ['{"functionTags": "lone", "known_commands": ["A"], "knownCommands": ["b", null, {}]}', "[1]", "{bad", None, "", "{}", '{"severity": [], "functionTypes": {"f": ["Object", 3], "g": ["x"]}, "externalLocals": "_a"}']
    configs = spark.createDataFrame(list(enumerate(texts)), "path int, value string")
    rows = project_config.settings(configs)
    assert project_config.function_tags(rows).collect() == []  # a lone text is no list here
    assert {r["name"] for r in project_config.known_commands(rows).collect()} == {"b"}
    assert {r["name"] for r in project_config.function_types(rows).collect()} == {"g"}
    assert {r["name"] for r in project_config.external_locals(rows).collect()} == {"_a"}
    assert {(r["path"], r["message"]) for r in project_config.validate(configs).collect()} == {(1, "configuration root must be a JSON object"), (6, "severity must be an object")}


def test_servers_answer(spark, registry):
    seen = []
    server = serve.EditorServer(lambda file, text: seen.append((file, text)) or [{"line": 2, "column": 1, "severity": "info", "code": "W230", "message": "m"}])
    sent = [{"id": 1, "method": "initialize"}, {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": "file:///a%20b.sqf", "text": "x"}}}, {"method": "textDocument/didChange", "params": {"textDocument": {"uri": "file:///a%20b.sqf"}, "contentChanges": [{"text": "y"}]}}, {"method": "textDocument/didClose", "params": {"textDocument": {"uri": "file:///a%20b.sqf"}}}, {"id": 2, "method": "what"}, {"id": 3, "method": "shutdown"}, {"method": "exit"}]
    body = lambda m: json.dumps(m).encode()
    source, sink = io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n" % len(body(m)) + body(m) for m in sent)), io.BytesIO()
    assert serve.run_framed(server, source, sink) == 0
    out = [json.loads(part.split(b"\r\n\r\n", 1)[1]) for part in sink.getvalue().split(b"Content-Length: ")[1:]]
    assert seen == [("/a b.sqf", "x"), ("/a b.sqf", "y")] and server.documents == {}
    assert [len(m["params"]["diagnostics"]) for m in out[1:4]] == [1, 1, 0] and out[1]["params"]["diagnostics"][0]["severity"] == 3
    assert out[4]["error"]["code"] == -32601 and out[5] == {"jsonrpc": "2.0", "id": 3, "result": None}

    tools = serve.ToolServer(spark, registry)
    call = lambda tool, **given: json.dumps({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": given}})
    source, sink = io.StringIO("\n".join([json.dumps({"id": 0, "method": "tools/list"}), call("lookup_command", name=" Hint "), call("lookup_function", name="x_fnc_y"), call("list_rules"), call("nope"), "{bad"])), io.StringIO()
    serve.run_lines(tools, source, sink)
    out = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert len(out[0]["result"]["tools"]) == 5 and out[1]["result"]["structuredContent"]["known"] and not out[2]["result"]["structuredContent"]["known"]
    assert len(out[3]["result"]["structuredContent"]["rules"]) == 49 and out[4]["error"]["code"] == -32602 and out[5]["error"]["code"] == -32700


def test_plugins_are_loaded_and_contained(spark, tmp_path):
    (tmp_path / "a.py").write_text("WORD = 'zap'\n\ndef check(text, name):\n    return [{'line': 1, 'message': WORD}] if WORD in text else []\n\ndef register(api):\n    api.register('w901', 'info', 'zaps', check)\n\nRULES = {'E902': {'check': lambda t, n: 1 / 0}}\n")
    (tmp_path / "b.py").write_text("raise ValueError('no')")
    found, errors = plugins.load_plugins(["a.py", "b.py", "c.py"], str(tmp_path))
    assert [r.code for r in found] == ["W901", "E902"] and len(errors) == 2 and "no" in errors[0]
    src = spark.createDataFrame([("x", "zap"), ("y", None)], "file string, text string")
    got = sorted((r["file"], r["code"], r["message"]) for r in plugins.run_plugins(src, found).collect())
    assert got == [("x", "E012", "plugin check failed: E902: division by zero"), ("x", "W901", "zap"), ("y", "E012", "plugin check failed: E902: division by zero")]


def test_reports_and_fixes(spark, tmp_path):
    d = spark.createDataFrame([("b", 3, 1, "info", "W230", 'say "x"', 1, 1), ("a", 1, 2, "error", "E001", "m", 0, 1)], "file string, line int, `column` int, severity string, code string, message string, pass_no int, seq int")
    sinks.json_array(d).coalesce(1).write.text(f"{tmp_path}/json")
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    assert [x["file"] for x in json.loads(text)] == ["a", "b"]
    place = F.array(F.struct(F.lit("r.sqf").alias("file"), F.lit(4).alias("line"), F.lit(1).alias("column"), F.lit("included").alias("message")))
    run = json.loads("".join(r["report"] for r in sinks.sarif(d.withColumn("related", F.when(F.col("file") == "a", place)), [{"id": "E001"}]).collect()))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "note"] and run["results"][0]["relatedLocations"][0]["physicalLocation"]["region"]["startLine"] == 4 and "relatedLocations" not in run["results"][1]
    assert json.loads("".join(r["report"] for r in sinks.json_array(d.limit(0)).collect())) == []
    assert sinks.summary(d, d.select("file")).first()["report"] == "2 files linted, 2 diagnostics"

    (tmp_path / "s.sqf").write_text("a = 1; \n\tb = 2;\n")
    assert sinks.write_fixed(files.read_corpus(spark, str(tmp_path / "s.sqf"))) == 1
    assert (tmp_path / "s.sqf").read_text() == "a = 1;\n    b = 2;\n"
    table = sinks.catalog_table(rules.catalog(spark)).select(F.col("report").alias("value"))
    assert sinks.catalog_drift(rules.catalog(spark), table).count() == 0
    assert sinks.catalog_drift(rules.catalog(spark), table.where("value not like '%E001%'")).count() == 1
    sinks.write_names(spark.createDataFrame([("b",), ("a",), ("b",)], "name string"), f"{tmp_path}/names")
    assert sorted(r["name"] for r in spark.read.json(f"{tmp_path}/names").collect()) == ["a", "b"]
    times = sinks.Timings()
    with times.step("lint"):
        times.hit_rate(1, 4)
    assert list(json.loads(times.report())) == ["lint_ms", "token_cache_hit_rate", "total_ms"]
    assert [r["file"] for r in addons.ordered(spark.createDataFrame([("B",), ("a",), ("b",)], "file string")).collect()] == ["a", "B", "b"]
    assert diagnostics.reported(d, 1).count() == 1


def test_expressions_are_read_by_precedence(spark, registry):
    from scriptflow.operators import expressions

    def shown(tree):
        inner = " ".join(shown(p) for p in tree.parts)
        return f"({tree.kind[0]}{':' + tree.value if tree.value else ''}{' ' + inner if inner else ''})"

    texts = {
        "a": ("_a = 1 + 2 * 3", "(b:= (n:_a) (b:+ (l:1) (b:* (l:2) (l:3))))"), "b": ("(1 + 2) * -x + -3", "(b:+ (b:* (g (b:+ (l:1) (l:2))) (u:- (n:x))) (l:-3))"), "c": ("[] call f", "(c:call (a) (n:f))"), "d": ("x select 0 == 1", None),
        "e": ("count [1, [2]]", "(c:count (a (l:1) (a (l:2))))"), "f": ("!a && b || c", "(b:|| (b:&& (u:! (n:a)) (n:b)) (n:c))"), "g": ("{ a = 1; b } forEach c", "(c:forEach (c (b:= (n:a) (l:1)) (n:b)) (n:c))"), "h": ("(1", None), "i": ("call compile x", None), "j": ("", None),
    }
    p = Project(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "file string, text string"), registry)
    tokens = {}
    for r in p.sig.orderBy("file", "s").collect():
        tokens.setdefault(r["file"], []).append((r["type"], r["value"]))
    got = {k: (lambda t: t and shown(t))(expressions.parse(tokens.get(k, []))) for k in texts}
    assert got == {k: want for k, (_, want) in texts.items()}
    rows = expressions.nodes(p).where("file = 'a'").orderBy("node").collect()
    assert [(r["parent"], r["kind"], r["value"]) for r in rows] == [(None, "binary", "="), (0, "name", "_a"), (0, "binary", "+"), (2, "literal", "1"), (2, "binary", "*"), (4, "literal", "2"), (4, "literal", "3")]


def test_watching_sees_changes_and_deletions(spark, tmp_path):
    from scriptflow.streaming import watch

    snaps = [[("a", "x = 1; ", 1), ("b", "fine", 1)], [("a", "x = 1; ", 1), ("b", "fine", 1)], [("b", "bad \n", 2), ("c", "new ", 1)]]
    seen = []

    def lint(sources, index):
        seen.append(sorted(r["name"] for r in index.collect()))
        found = rules.trailing_blanks(Project(sources, rules.empty_registry(spark)))
        return found.withColumns({"severity": F.lit("warning"), "pass_no": F.lit(0)})

    for k, rows in enumerate(snaps):
        spark.createDataFrame([(k, f, t, m, len(t)) for f, t, m in rows], "snap bigint, file string, text string, mtime_ns bigint, size bigint").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        watch.watch_stream(spark, f"file://{tmp_path}/in", lint, lambda new: new.select(F.col("file").alias("name")), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    out = sorted((r["batch"], r["file"], r["deleted"], len(r["diagnostics"])) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [(0, "a", False, 1), (0, "b", False, 0), (2, "a", True, 0), (2, "b", False, 1), (2, "c", False, 1)]
    assert seen == [["a", "b"], ["b", "c"]]


def test_addons_are_extracted_and_kept(spark, registry, tmp_path):
    rows = [
        ("m", "m/addons/core", "m/addons/core/fnc_go.sqf", 'params [["_a", 0, [0]], "_b"];'), ("m", "m/addons/core", "m/addons/core/script_mod.hpp", "#define PREFIX pre\n#define COMPONENT c\n"), ("m", "m/addons/core", "m/addons/core/f/fn_make.sqf", None),
        ("m", "m/addons/core", "m/addons/core/config.cpp", 'class CfgPatches { class ADDON { x = 1; }; };\nclass CfgFunctions { class T { class C { class run { file = "x"; }; }; }; };'),
    ]
    files_ = spark.createDataFrame(rows, "mod string, addon string, file string, text string")
    counts = {r["what"]: r["n"] for r in addons.update(files_, registry, f"file://{tmp_path}/caches").collect()}
    assert counts == {"functions": 3, "signatures": 2, "macros": 2, "patches": 1, "names": 3}
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/caches/names").collect()} == {"core_fnc_go", "pre_fnc_make", "t_fnc_run"}
    assert {(r["name"], r["pos"], tuple(r["types"] or ())) for r in spark.read.parquet(f"{tmp_path}/caches/signatures").collect()} == {("core_fnc_go", 0, ("Number",)), ("core_fnc_go", 1, ())}
    assert addons.update(files_, registry, f"file://{tmp_path}/caches").count() == 5


def most_joined(df):
    """The rows of a query and the most rows that one of its joins gave."""
    rows, counts, todo = df.collect(), [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            counts.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        todo += inner
    return rows, max(counts)


def test_a_wanted_mod_meets_one_path_of_an_addon(spark):
    """500 ids want an addon that 400 mods hold: one row each, not 200,000; of equal paths the smaller one, and no path only where there is none."""
    wanted = spark.range(500).select(F.col("id").cast("string"), F.lit("Addon").alias("name")).union(spark.createDataFrame([("x", "bare"), ("y", "gone"), (None, "bare")], "id string, name string"))
    folders = spark.createDataFrame([("ws\\B/7",), ("ws/a/7",), ("ws/A/7",), (None,), ("ws/y",)], "path string")
    held = spark.range(400).select(F.format_string("ws/mod%03d", F.col("id") + 1).alias("mod"), F.when(F.col("id") % 2 == 0, "x/ADDON.pbo").otherwise("x\\addon.EBO").alias("file"))
    archives = held.union(spark.createDataFrame([("ws/Mod001", "addon.pbo"), (None, "addon.pbo"), (None, "bare.pbo"), ("m", None)], "mod string, file string"))
    rows, most = most_joined(addons.resolve_mods(wanted, folders, archives))
    got = {r["id"]: r["path"] for r in rows}
    assert len(rows) == len(got) == 503
    assert got == {str(k): "ws/A/7" if k == 7 else "ws/Mod001" for k in range(500)} | {"x": None, "y": "ws/y", None: None}
    assert most <= 502


def test_files_of_a_common_name_are_dealt_out(spark):
    """3,000 files and 40 functions of one last part: each pair once, in many tasks, and no rows beyond the pairs are moved to find them distinct."""
    many = spark.range(3000).select(F.format_string("src/%d/Run.SQF", "id").alias("file"))
    files_ = many.union(many.limit(50)).union(spark.createDataFrame([("a\\only.sqf",), ("nowhere.sqf",), (None,)], "file string"))
    declared = spark.range(40).select(F.format_string("f%d", "id").alias("name"), F.lit("\\x\\run.sqf").alias("path"))
    declared = declared.union(declared.limit(9)).union(spark.createDataFrame([("f0", "y/RUN.sqf"), ("f1", "only.SQF"), (None, "only.sqf"), ("g", None), ("h", "none.sqf")], "name string, path string"))
    found = addons.matching_files(declared, files_)
    got = [(r["name"], r["file"]) for r in found.collect()]
    want = {(f"f{k}", f"src/{n}/Run.SQF") for k in range(40) for n in range(3000)} | {("f1", "a\\only.sqf"), (None, "a\\only.sqf")}
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Project" and plan.child().nodeName() == "Join"  # pairs are final where they are joined
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = addons.matching_files(declared, files_).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < len(want) * 0.6
