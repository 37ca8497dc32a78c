import pytest
from pyspark.sql import functions as F

from scriptflow.operators import archives, config_rules, diagnostics, flow, lexer, preprocess, rules, symbols
from scriptflow.sources import files

COMMANDS = "hint str reverse select addeventhandler removeeventhandler setvariable remoteexec publicvariable finddisplay apply isnil".split()


def project(spark, texts, **names):
    rows = [("command", c) for c in COMMANDS] + [(k, n) for k, ns in names.items() for n in ns]
    return rules.Project(files.from_texts(spark, texts), spark.createDataFrame(rows, "kind string, name string"))


def findings(df):
    return sorted((r["line"], r["column"], r["message"]) for r in df.distinct().collect())


@pytest.mark.parametrize("text", ["", "a", "#define X\n", "x # y", '"a""b', "'it''s' // c\n/* open", "-5 - 5 -5 (-5) _a-5 .5e3 0xFf", "\t#if\n é𝒳 \x00 \r\n a"])
def test_lexemes_are_lossless(spark, text):
    got = lexer.lexemes(files.from_texts(spark, {"f": text})).orderBy("n").collect()
    assert "".join(r["raw"] for r in got) == text
    at = 0
    for r in got:
        assert r["off"] == at and r["line"] == text[:at].count("\n") + 1 and r["col"] == at - (text[:at].rfind("\n") + 1) + 1
        at += len(r["raw"])


def test_tokens(spark):
    text = ' #define A b\n_x = -5 - -3;\nif (!true) "q""r" 1-2 // c'
    got = [(r["type"], r["value"], r["line"], r["col"]) for r in lexer.tokens(files.from_texts(spark, {"f": text})).orderBy("i").collect()]
    assert got == [
        ("preprocessor", "define A b", 1, 2), ("local", "_x", 2, 1), ("operator", "=", 2, 4), ("number", "-5", 2, 6), ("operator", "-", 2, 9), ("number", "-3", 2, 11), ("semicolon", ";", 2, 13),
        ("keyword", "if", 3, 1), ("lparen", "(", 3, 4), ("operator", "!", 3, 5), ("keyword", "true", 3, 6), ("rparen", ")", 3, 10), ("string", 'q"r', 3, 12), ("number", "1", 3, 19), ("operator", "-", 3, 20), ("number", "2", 3, 21), ("comment", "// c", 3, 23),
    ]


CASES = [
    (rules.brackets, "(1 + [2", [(1, 1, "unclosed '('"), (1, 6, "unclosed '['")]),
    (rules.brackets, "{ (1 ] }", [(1, 1, "unclosed '{'"), (1, 3, "unclosed '('"), (1, 6, "unmatched ']'"), (1, 8, "unmatched '}'")]),
    (rules.brackets, "[({})]", []),
    (rules.unterminated_strings, 'x = "abc', [(1, 5, "unterminated string")]),
    (rules.trailing_commas, "[1, 2, ]; [3]", [(1, 6, "trailing comma in array")]),
    (rules.missing_then, "if (a) hint 1; if (b) then {}; if !(c) exitWith {}; if (d) && {e} then {};", [(1, 8, "expected 'then' after if condition")]),
    (rules.bad_else, "if (a) then {} else hint 1; if (b) then {} else {};", [(1, 21, "expected code block or if after 'else'")]),
    (rules.missing_commas, '[["a" "b"], 1 2]', [(1, 7, "missing comma between array elements")]),
    (rules.reversed_loops, "forEach _a { }; { } forEach _b;", [(1, 1, "expected code block before 'forEach'")]),
    (rules.unended_blocks, "str {1} zap; str {1} hint; x apply {1} joinUp 2;", [(1, 9, "missing semicolon after command with code block"), (1, 40, "missing semicolon after command with code block")]),
    (rules.postfix_commands, "_ids reverse; reverse _ids; _a ctrlSetFocus;", [(1, 6, "invalid postfix command expression; use 'reverse <value>' or assign its result")]),
    (rules.constant_conditions, 'if (true) then {}; if (1 == 2) then {}; if (a) then {};', [(1, 4, "if condition is constant"), (1, 23, "if condition is constant")]),
    (rules.duplicate_definitions, "T_fnc_a = {1}; t_FNC_a = {2}; f = {3}; f = {4};", [(1, 16, "duplicate function definition: t_FNC_a")]),
    (rules.overwritten_definitions, "call f; f = {1}; f = 2;", [(1, 18, "function overwritten by non-code value: f")]),
    (rules.unused_locals, 'private _a = 1; params ["_b", ["_c", 1]]; hint str _b; private _x = 2;', [(1, 9, "unused local variable: _a")]),
    (rules.unused_locals, "if (q) then { private _a = 1; }; hint str _a;", [(1, 23, "unused local variable: _a")]),
    (rules.unused_locals, '#include "x.hpp"\nprivate _a = 1;', []),
    (rules.shadowed_locals, "private _a = 1; { private _a = 2; }; private _a = 3;", [(1, 38, "local declaration shadows or duplicates _a")]),
    (rules.value_calls, "call 5; [] spawn true; call {};", [(1, 6, "call target is a value, not code"), (1, 18, "spawn target is a value, not code")]),
    (rules.unknown_commands, "roadOf _r; hint 1; a b; MACRO(1);", [(1, 1, "unknown command/function: roadOf"), (1, 25, "unknown command/function: MACRO (external macro is not indexed; declare its dependency and run update)")]),
    (rules.params_shapes, 'params ["_a", "b", 5, ["_c", 1, 2], ["d", 1], ["_e", 1, [], 2, 3]]; params 3; _z params ["_q"];', [(1, 15, "params names must be local variables"), (1, 20, "params declarations must be variable names or [name, default] arrays"), (1, 33, "params validators must be an array"), (1, 37, "params declaration must start with a local variable name"), (1, 47, "params declaration has too many fields"), (1, 69, "params expects an array of parameter declarations")]),
    (rules.nested_selects, 'params ["_a"]; (_a select _i) select 1; (_a select _i) select 0; (_a select 2) select 1;', [(1, 31, "dynamic nested select on a parameter may index an empty or short array element; guard its length")]),
    (rules.event_handlers, 'u addEventHandler ["A", {}]; u removeEventHandler ["A", 0]; u removeEventHandler ["B", 0]; u addEventHandler 5;', [(1, 63, "removeEventHandler removes an event handler that was not registered in this file"), (1, 94, "addEventHandler expects an event name and handler")]),
    (rules.remote_calls, '[] remoteExec ["f", 0, 5]; [] remoteExec []; [] remoteExec ["f"];', [(1, 24, "remoteExec JIP argument must be Boolean"), (1, 31, "remoteExec expects [function, targets, jip]")]),
    (rules.unsaved_handles, "hud = findDisplay 46; with uiNamespace do { hud = findDisplay 46; }; profileNamespace setVariable [\"a\", controlNull];", [(1, 1, "namespace variable hud stores a non-serializable runtime handle"), (1, 105, "profileNamespace variable stores a non-serializable runtime handle")]),
    (rules.overwritten_values, "_a = 1; _a = 2; hint str _a; _a = 3; { _a = 4; }; _b = 1; _b = _b + 1;", [(1, 9, "value assigned to _a is overwritten before it is read")]),
    (rules.repeated_constants, "_a = 1; hint str _a; _a = 1;", [(1, 22, "repeated constant assignment to _a")]),
    (rules.conditional_balance, "#endif\n#if 1\n#else\n#ifdef A\n#endif", [(1, 1, "#endif without a matching conditional"), (2, 1, "conditional directive is not closed with #endif")]),
    (rules.trailing_blanks, "a \nb\t \n\nc", [(1, 2, "trailing whitespace at character 2"), (2, 2, "trailing whitespace at character 2")]),
    (rules.tabs, "\ta\nb\tc", [(1, 1, "tab character in source indentation at character 1"), (2, 2, "tab character in source indentation at character 2")]),
    (config_rules.structure, "class A { x = 1; }; } class B {\n#define M {", [(1, 21, "unmatched '}' in config"), (1, 31, "unclosed '{' in config")]),
    (config_rules.repeated_properties, "class A { x = 1; class B { x = 2; }; X = 3;\n#ifdef Q\ny = 1;\n#else\ny = 2;\n#endif\n};", [(1, 38, "config property defined more than once: X")]),
    (config_rules.mission_structure, "version = x; class Mission {};", [(1, 1, "mission.sqm version must be numeric")]),
    (config_rules.addon_entries, 'addOns[] = {"a_b", "A_B", "c d"};', [(1, 1, "duplicate mission addon: a_b"), (1, 1, "invalid mission addon name: c d")]),
    (preprocess.directive_rules, "#define A 1\n#define A 2\n#undef B\n#if Q\n#endif\n#foo\n#pragma x\n#define", [(2, 1, "macro redefined: A"), (3, 1, "undefined macro in #undef: B"), (4, 1, "macro or expression cannot be resolved in #if: Q"), (6, 1, "unsupported preprocessor directive: #foo"), (7, 1, "unsupported #pragma: x"), (8, 1, "malformed #define directive")]),
]


@pytest.mark.parametrize("rule,text,want", CASES, ids=[f"{r.__name__}-{k}" for k, (r, _, _) in enumerate(CASES)])
def test_rule(spark, rule, text, want):
    assert findings(rule(project(spark, {"f.sqf": text}))) == want


def test_unknown_names_follow_tags_and_hooks(spark):
    p = project(spark, {"f.sqf": 'call T_fnc_a; call T_fnc_b; call U_fnc_c; isNil "hook"; call hook; spawn "x.sqf"; call "zip";'}, function=["t_fnc_a"], tag=["t", "u"])
    assert [m for _, _, m in findings(rules.unknown_calls(p))] == ["unknown function/command: T_fnc_b", "unknown function/command: zip"]


def test_argument_counts(spark):
    signatures = spark.createDataFrame([("f", 2)], "name string, most int")
    assert len(findings(rules.argument_counts(project(spark, {"f.sqf": "[1, 2, 3] call f; [1, [2, 3]] call f; [1, 2, 3] call g;"}), signatures))) == 1


def test_flow(spark):
    text = "_a = 1; if (_a > 1) then { _b = 2; } else { _b = 3; _c = 4; }; hint str _b; hint str _c; _d = _d + 1; for \"_i\" from 0 to 3 do { hint str _i; throw 1; hint 2; };"
    got = findings(flow.flow_rules(project(spark, {"f.sqf": text})))
    assert [(c, m.rsplit(" ", 1)[1]) for _, c, m in got] == [(86, "_c"), (95, "_d"), (151, "flow")]


def test_preprocessing_inlines_and_expands(spark):
    texts = {
        "a/main.sqf": '#include "inc.hpp"\n#define ADD(X,Y) (X + Y)\nz = ADD(TWO,f(1,2)); // TWO\n#ifdef NONE\nno\n#else\n"TWO" TWO##x\n#endif\n#include "main.sqf"',
        "a/inc.hpp": "#define TWO 2\nq = TWO;",
        "b.sqf": "plain",
    }
    p = project(spark, texts)
    out = {r["file"]: r for r in preprocess.preprocess(p).collect()}
    assert out["b.sqf"]["text"] == "plain"
    main = out["a/main.sqf"]
    assert main["text"].split("\n") == ["", "q = 2;", "", "z = (2 + f(1,2)); // TWO", "", "", "", '"TWO" 2##x', "", '#include "main.sqf"']
    assert [(o["file"][2:], o["line"]) for o in main["origins"]][:4] == [("inc.hpp", 1), ("inc.hpp", 2), ("main.sqf", 2), ("main.sqf", 3)]
    lines = preprocess.line_map(preprocess.preprocess(p))
    d = spark.createDataFrame([("a/main.sqf", 2, 1, "x")], "file string, line int, column int, message string")
    assert [tuple(r) for r in preprocess.remap(d, lines).collect()] == [("a/inc.hpp", 2, 1, "x")]
    assert sorted((r["code"], r["line"]) for r in preprocess.include_rules(p).collect()) == [("W210", 9)]


def test_suppression(spark):
    text = "a \n// lint: disable-next-line W301\nb \nc // lint: disable-line \n// lint: disable W301 -- why\nd \n// lint: enable\ne \n// lint: disable-next-line W302\n// lint: nonsense\n// lint: disable W999 -- x"
    p = project(spark, {"f.sqf": text})
    dirs = diagnostics.directives(p.sources)
    d = rules.run(p, [rules.trailing_blanks, rules.tabs])
    assert sorted(r["line"] for r in diagnostics.suppress(d, dirs).collect()) == [1, 8]
    quality = sorted((r["line"], r["code"]) for r in diagnostics.suppression_quality(d, dirs, True).collect())
    assert quality == [(2, "W229"), (4, "W229"), (7, "W229"), (9, "W229"), (9, "W230"), (10, "W231"), (11, "W230"), (11, "W231")]


def test_merging_and_strictness(spark):
    d = rules.run(project(spark, {"f.sqf": "[1,];"}), [rules.trailing_commas, rules.trailing_commas])
    once = diagnostics.merge_equal(d)
    assert once.count() == 1 and diagnostics.merge_equal(once).collect() == once.collect()
    assert diagnostics.exit_code(once).first()[0] == 1
    assert diagnostics.exit_code(diagnostics.override_severities(once, {"E003": "off"})).first()[0] == 0


def test_symbols(spark):
    text = 'A_fnc_x = {1}; y = compile "z"; ns setVariable ["key", {2}]; u addEventHandler ["Hit", {3}]; w = 5;\n#define M 1\n["tab_fnc_q", "a\\b.sqf"];'
    p = project(spark, {"f.sqf": text})
    got = {(r["kind"], r["name"]) for r in symbols.index(p.tokens, p.sig).collect()}
    assert got == {("function", n) for n in ("a_fnc_x", "y", "key", "hit", "tab_fnc_q")} | {("tag", "a"), ("tag", "tab"), ("macro", "m")}


def pack(data):
    """All bytes as literals, then one back reference of 18 bytes over the last 18."""
    out = bytearray()
    for k in range(0, len(data), 8):
        part = data[k : k + 8]
        out += bytes([(1 << len(part)) - 1]) + part
    return bytes(out)


def entry(name, method=0, size=0, stored=0):
    return name + b"\0" + archives.ENTRY.pack(method, size, 0, 0, stored)


def config_bytes():
    """class CfgFunctions { class T { tag = "TAG"; class Cat { class go {}; }; }; }; x[] = {1, "two"};"""
    bodies, at = [], 16
    tree = ("", [("CfgFunctions", [("T", [("Cat", [("go", [], [])], [])], [("tag", "TAG")])], [])], [])

    def size(children, props):
        return 1 + 1 + sum(1 + len(n) + 1 + 4 for n, *_ in children) + sum(1 + 1 + len(k) + 1 + len(v) + 1 for k, v in props)

    def write(children, props, start):
        raw, offset, inner = bytearray(b"\0" + bytes([len(children) + len(props)])), start + size(children, props), b""
        for key, value in props:
            raw += b"\x01\x00" + key.encode() + b"\0" + value.encode() + b"\0"
        for name, kids, own in children:
            raw += b"\0" + name.encode() + b"\0" + offset.to_bytes(4, "little")
            body = write(kids, own, offset)
            inner += body
            offset += len(body)
        return bytes(raw) + inner

    del bodies, at
    return b"\0raP" + (0).to_bytes(4, "little") + (8).to_bytes(4, "little") + (0).to_bytes(4, "little") + write(tree[1], tree[2], 16)


def test_archives(spark, tmp_path):
    text, config = b"hint 'x';" * 5, config_bytes()
    packed = pack(text)
    header = entry(b"", archives.VERSION_METHOD) + b"prefix\0p\0\0" + entry(b"a.sqf", archives.PACKED_METHOD, len(text), len(packed)) + entry(b"skip.paa", 0, 3, 3) + entry(b"config.bin", 0, len(config), len(config)) + entry(b"")
    (tmp_path / "x.pbo").write_bytes(header + packed + b"abc" + config)
    (tmp_path / "bad.pbo").write_bytes(header[:40])
    rows = archives.scan_archives(spark, str(tmp_path)).collect()
    assert {r["name"]: bytes(r["content"]) for r in rows if r["name"]} == {"a.sqf": text, "config.bin": config}
    assert [r["error"] is not None for r in rows if not r["name"]] == [True]
    tables = archives.config_tables(archives.scan_archives(spark, str(tmp_path)).where("name like '%.bin'")).cache()
    assert [r["key"] for r in tables.where("row = 'class'").orderBy("node").collect()] == ["", "CfgFunctions", "T", "Cat", "go"]
    assert [(r["name"], r["path"]) for r in archives.config_functions(tables).collect()] == [("tag_fnc_go", "functions\\Cat\\fn_go.sqf")]


def test_back_references():
    assert archives.unpack(bytes([0b00000001]) + b"a" + bytes([1, 0x0F]), 19) == b"a" * 19
    assert archives.unpack(bytes([0b00000000, 0, 0x00]), 3) == b"   "
    with pytest.raises(archives.Damaged):
        archives.unpack(b"\x01", 4)


def test_configs_and_diffs(spark):
    f = spark.createDataFrame([("a/b/x.sqf",), ("a/y.sqf",), ("z.sqf",)], "file string")
    c = spark.createDataFrame([("a", "A", 0), ("a", "late", 1), ("", "top", 0)], "dir string, config string, priority int")
    assert {r["file"]: r["config"] for r in files.nearest_config(f, c).collect()} == {"a/b/x.sqf": "A", "a/y.sqf": "A", "z.sqf": "top"}
    lines = ["--- a/x", "+++ b/x.sqf", "@@ -1,2 +3,2 @@", "@@ -9 +9 @@ f", "@@ -20,3 +19,0 @@", "+++ /dev/null", "@@ -1 +0,0 @@"]
    d = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "diff int, n int, text string")
    assert sorted(tuple(r) for r in files.changed_lines(d).collect()) == [("x.sqf", 3), ("x.sqf", 4), ("x.sqf", 9)]


def test_corpus_is_read_with_filters(spark, tmp_path):
    for name, text in {"a.sqf": "x", "b.txt": "y", ".scriptflow/c.sqf": "z", "old/d.sqf": "w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.read_corpus(spark, str(tmp_path), ignores=["*/old/*"]).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["ext"], r["text"], r["size"]) for r in got] == [("a.sqf", "sqf", "x", 1)]
    (tmp_path / "r.txt").write_text("# names\n\n Hint \nhint\nstr\n")
    assert {r["name"] for r in files.read_registry(spark, str(tmp_path / "r.txt"), "command").collect()} == {"hint", "str"}
    (tmp_path / "base.json").write_text('{"diagnostics": [{"file": "f", "startLine": 2, "column": 3, "ruleId": "E001", "message": "m"}]}')
    assert [tuple(r) for r in files.read_baseline(spark, str(tmp_path / "base.json")).collect()] == [("f", 2, 3, "E001", "m")]


def test_stream_lints_what_arrives(spark, tmp_path):
    from scriptflow.streaming import watch

    schema = "file string, text string, mtime_ns long, size long"
    source = tmp_path / "in"
    spark.createDataFrame([("f", "a ", 1, 2), ("g", "b", 1, 1), ("f", "a", 2, 1)], schema).write.parquet(str(source))
    registry = spark.createDataFrame([], "kind string, name string")
    lint = lambda s: rules.trailing_blanks(rules.Project(s, registry))
    run = lambda: watch.lint_stream(spark, str(source), schema, lint, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([("g", "b\nc ", 3, 4)], schema).write.mode("append").parquet(str(source))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["file"], r["line"]) for r in got] == [("g", 2)]


def test_catalog(spark):
    c = rules.catalog(spark)
    assert c.count() == 49
    assert {r["severity"]: r["count"] for r in c.groupBy("severity").count().collect()} == {"error": 12, "warning": 36, "info": 1}
    assert c.where(F.col("code") == "W231").first()["categories"] == ["correctness"]
