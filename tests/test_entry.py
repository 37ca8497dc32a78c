"""Every registered query against its SQL on the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pytest

from scriptflow.plans import parity

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str([cell(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(parity.ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    got = parity.QUERIES[name](spark, SF)
    want = oracle.execute(parity.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_brackets_far_into_a_page_count(spark, tmp_path):
    html = {1: "a " * 300 + "(", 2: "( b ) " * 200 + "]", 3: "{" + "[c] " * 500 + "}", 4: "", 60: "x " * 40_000 + "[ ( ]"}
    spark.createDataFrame([(k, "u", v) for k, v in html.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r["file"]: (r["unclosed"], r["unmatched"]) for r in parity.QUERIES["bracket_balance"](spark, str(tmp_path)).collect()}
    assert out == {"p1": (1, 0), "p2": (0, 1), "p3": (0, 0), "p4": (0, 0), "p60": (2, 1)}


def test_entry_reads_whole_pages(spark):
    """Against a stack over every token of every page."""
    import __spark_entry__
    from scriptflow.operators import lexer

    src = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("concat('p', page_id) AS file", "html AS text")
    want = {r["file"]: [[], 0] for r in src.select("file").collect()}
    for r in sorted(lexer.significant(lexer.tokens(src)).select("file", "s", "type").collect()):
        stack, side, kind = want[r["file"]], r["type"][:1], r["type"][1:]
        if kind in ("paren", "bracket", "brace") and side == "l":
            stack[0].append(kind)
        elif kind in ("paren", "bracket", "brace"):
            if stack[0] and stack[0][-1] == kind:
                stack[0].pop()
            else:
                stack[1] += 1
    got = {r["file"]: [r["unclosed"], r["unmatched"]] for r in __spark_entry__.entry(spark).collect()}
    assert got == {k: [len(a), b] for k, (a, b) in want.items()}


def test_whole_tables_are_read(spark, oracle):
    """No order, finding or customer is left out."""
    read = lambda name: parity.QUERIES[name](spark, SF)
    assert sum(r["report"].count("<error ") for r in read("sink_checkstyle").collect()) == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    edges = "SELECT DISTINCT 'c' || c_custkey % 60, 'c' || (c_custkey * 7 + c_nationkey) % 60 FROM customer"
    assert {(r["src"], r["dst"]) for r in read("include_closure").where("depth = 1").collect()} == set(oracle.execute(edges).fetchall())
    lines = "SELECT DISTINCT 'f' || o_custkey % 20 || '.sqf', o_orderkey % 90 + 1 + k FROM orders, range(3) r(k) WHERE k < o_orderkey % 4"
    assert {(r["file"], r["line"]) for r in read("changed_lines_from_hunks").collect()} == set(oracle.execute(lines).fetchall())


def test_nothing_else_imports_the_llm_subpackage():
    for path in [*(ROOT / "scriptflow").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
