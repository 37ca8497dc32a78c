"""Brackets, statements, scopes and items of significant tokens.

Brackets are matched by a fold with a stack, file by file in Arrow batches, which sees nothing but
brackets; everything else is windows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPENERS, CLOSERS = ["lparen", "lbracket", "lbrace"], ["rparen", "rbracket", "rbrace"]


def matched(sig: DataFrame) -> DataFrame:
    """(file, s, close, fault): openers with their closers, or a fault (unmatched, unclosed). A closer that doesn't fit the top
    of the stack leaves it. One file's brackets at a time, once over; other tokens don't reach Python."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        stack: list[tuple[int, str]] = []
        out: list[tuple[int, int | None, str | None]] = []
        for s, kind in zip(table["s"].to_pylist(), table["type"].to_pylist(), strict=True):
            if kind[0] == "l":
                stack.append((s, kind[1:]))
            elif stack and stack[-1][1] == kind[1:]:
                out.append((stack.pop()[0], s, None))
            else:
                out.append((s, None, "unmatched"))
        out += [(s, None, "unclosed") for s, _ in stack]
        file = pa.array([table["file"][0].as_py()] * len(out), pa.string())
        return pa.table([file, *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string())))], names=["file", "s", "close", "fault"])

    brackets = sig.where(F.col("type").isin(*OPENERS, *CLOSERS)).select("file", "s", "type")
    return brackets.groupBy("file").applyInArrow(run, "file string, s int, close int, fault string")


def bracket_pairs(sig: DataFrame) -> DataFrame:
    """(file, s, close) of every opener with a matching closer, by positions among significant tokens."""
    return matched(sig).where("fault is null").select("file", "s", "close")


def bracket_faults(sig: DataFrame) -> DataFrame:
    """(file, s, fault): unmatched closers and unclosed openers."""
    return matched(sig).where("fault is not null").select("file", "s", "fault")


def statements(sig: DataFrame) -> DataFrame:
    """Adds stmt, the number of semicolons before a token, and at, its place among the statement's tokens."""
    w = Window.partitionBy("file").orderBy("s")
    out = sig.withColumn("stmt", F.coalesce(F.sum((F.col("type") == "semicolon").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("at", F.row_number().over(Window.partitionBy("file", "stmt").orderBy("s")))


def _steps(sig: DataFrame, kinds: list[str], only: DataFrame | None) -> DataFrame:
    """(file, s, _turn, _p): at which brackets the opener around what follows changes, and to which: null at the top. Closers
    change it before their own token (_turn 0), openers behind it (2)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        at, types, chosen = (table[c].to_pylist() for c in ("s", "type", "chosen"))
        stack: list[int] = []
        close: dict[int, int] = {}
        for k, kind in enumerate(types):
            if kind[0] == "l":
                stack.append(k)
            elif stack and types[stack[-1]][1:] == kind[1:]:
                close[stack.pop()] = k
        ends = {c: o for o, c in close.items()}
        around: list[dict | None] = [None]
        out: list[tuple[int, int, dict | None]] = []
        for k, s in enumerate(at):
            if k in close and chosen[k]:
                around.append({"s": s, "close": at[close[k]]})
                out.append((s, 2, around[-1]))
            elif k in ends and chosen[ends[k]]:
                around.pop()
                out.append((s, 0, around[-1]))
        none = {"s": None, "close": None}
        spot = pa.struct([("s", pa.int32()), ("close", pa.int32())])
        columns = [pa.array([table["file"][0].as_py()] * len(out), pa.string()), pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] or none for r in out], spot)]
        return pa.table(columns, names=["file", "s", "_turn", "_p"])

    brackets = sig.where(F.col("type").isin(*kinds, *(f"r{k[1:]}" for k in kinds))).select("file", "s", "type")
    if only is None:
        marked = brackets.withColumn("chosen", F.lit(True))
    else:
        marked = brackets.join(only.select("file", "s", F.lit(True).alias("chosen")).distinct(), ["file", "s"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return marked.groupBy("file").applyInArrow(run, "file string, s int, _turn int, _p struct<s:int,close:int>")


def enclosed(sig: DataFrame, kinds: list[str] | None = None, only: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Adds parent, the innermost matched opener around a token, and parent_close; null at the top.
    kinds: the openers that count, all without it; only: of these, the ones at (file, s); of: the tokens that are wanted, all without it.

    The opener around a token is what the last bracket before it left: one window, whatever the nesting.
    """
    wanted = (sig if of is None else of).withColumn("_turn", F.lit(1))
    rows = wanted.unionByName(_steps(sig, kinds or OPENERS, only), allowMissingColumns=True)
    so_far = Window.partitionBy("file").orderBy("s", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_p", F.last("_p", ignorenulls=True).over(so_far)).where("_turn = 1")
    return placed.withColumns({"parent": F.col("_p.s"), "parent_close": F.col("_p.close")}).drop("_turn", "_p")


def items(sig: DataFrame) -> DataFrame:
    """Top-level items of matched square brackets: file, s (opener), close, item (from 0), size (number of
    items), at, type, value and place of the item's first token, and n, its tokens that aren't within further brackets.
    An array without tokens has no items."""
    arrays = sig.where("type = 'lbracket'").select("file", F.col("s").alias("parent"))
    inner = enclosed(sig).join(arrays, ["file", "parent"], "left_semi").where("s < parent_close")
    of = Window.partitionBy("file", "parent").orderBy("s")
    numbered = inner.withColumns({"_cut": F.col("type") == "comma", "item": F.sum((F.col("type") == "comma").cast("int")).over(of)})
    numbered = numbered.withColumn("size", F.max("item").over(Window.partitionBy("file", "parent")) + 1)
    closers = F.col("type").isin(*CLOSERS)
    lone = numbered.where("not _cut").groupBy("file", "parent", "parent_close", "item", "size").agg(F.min(F.struct("s", "type", "v", "value", "line", "col")).alias("f"), F.sum((~closers).cast("int")).alias("n"))
    return lone.select("file", F.col("parent").alias("s"), F.col("parent_close").alias("close"), "item", "size", F.col("f.s").alias("at"), F.col("f.type").alias("type"), F.col("f.v").alias("v"), F.col("f.value").alias("value"), F.col("f.line").alias("line"), F.col("f.col").alias("col"), "n")
