"""Expression trees of statements, as rows.

Statements are what semicolons part at the top of a file or a code block. Each is read by precedence climbing
into one tree; a statement that is no whole expression gives nothing, as guesses would mislead. Trees are rows
(file, stmt, node, parent, kind, value), nodes numbered from 0 in the order of reading them from the root.

A file's tokens come as one Arrow group. Files without tokens give nothing; there are no ties; repeated
files would be one group, so their names must be distinct, as everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .rules import Project

# Operators by how tightly they bind, and commands that stand before their one operand.
PRECEDENCE = {"=": 0, "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
PREFIX = set("""
    abs acos asin atan ceil count cos floor isarray isclass isnil isnumber isnull isserver composetext parsenumber
    parsesimplearray parsetext round selectrandom sin sqrt str tan toarray tolower toupper typename typeof tostring
""".split())
CLOSERS = {"lparen": "rparen", "lbracket": "rbracket", "lbrace": "rbrace"}
NODES = "file string, stmt int, node int, parent int, kind string, value string"


class NotAnExpression(Exception):
    pass


@dataclass
class Tree:
    """kind: literal, name, array, code, call, unary, group, binary or command."""

    kind: str
    value: str
    parts: list[Tree] = field(default_factory=list)

    def rows(self) -> list[tuple[int | None, str, str]]:
        """(parent, kind, value) of all nodes, this one first."""
        out: list[tuple[int | None, str, str]] = []
        todo: list[tuple[int | None, Tree]] = [(None, self)]
        while todo:
            parent, tree = todo.pop()
            out.append((parent, tree.kind, tree.value))
            todo += [(len(out) - 1, part) for part in reversed(tree.parts)]
        return out


class Reader:
    """Reads (type, value) tokens from a place on."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def ahead(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None) -> str:
        found, value = self.ahead()
        if found == "end" or (kind and found != kind):
            raise NotAnExpression
        self.at += 1
        return value

    def operand(self) -> Tree:
        kind, value = self.ahead()
        low, last = value.lower(), self.at + 1 >= len(self.tokens)
        if kind == "keyword" and low in ("call", "spawn") and not last:
            return Tree("call", self.take(), [self.operand()])
        if (kind == "keyword" and low == "not") or (kind == "operator" and value in ("!", "+", "-")):
            return Tree("unary", self.take(), [self.operand()])
        if low in PREFIX and kind != "string" and not last:
            return Tree("command", self.take(), [self.operand()])
        if kind in ("number", "string") or (kind == "keyword" and low in ("true", "false", "nil")):
            return Tree("literal", self.take())
        if kind in ("ident", "local", "keyword"):
            return Tree("name", self.take())
        if kind not in CLOSERS:
            raise NotAnExpression
        self.take()
        if kind == "lparen":
            tree = Tree("group", "", [self.whole(0)])
        elif kind == "lbracket":
            tree = Tree("array", "")
            while self.ahead()[0] != "rbracket":
                tree.parts.append(self.whole(0))
                if self.ahead()[0] != "rbracket":
                    self.take("comma")
        else:
            tree = Tree("code", "", [t for _, t in trees(self.inner())])
        self.take(CLOSERS[kind])
        return tree

    def inner(self) -> list[tuple[int, str, str]]:
        """The tokens up to the brace that closes, with their places."""
        depth, start = 0, self.at
        while self.at < len(self.tokens):
            kind = self.tokens[self.at][0]
            if kind == "rbrace" and not depth:
                return [(k, *self.tokens[k]) for k in range(start, self.at)]
            depth += (kind == "lbrace") - (kind == "rbrace")
            self.at += 1
        raise NotAnExpression

    def whole(self, least: int) -> Tree:
        tree = self.operand()
        while self.ahead()[0] == "operator" and (binds := PRECEDENCE.get(self.ahead()[1], -1)) >= least:
            tree = Tree("binary", self.take(), [tree, self.whole(binds + 1)])
        while self.ahead()[0] in ("ident", "keyword"):
            tree = Tree("command", self.take(), [tree, self.operand()])
        return tree


def parse(tokens: list[tuple[str, str]]) -> Tree | None:
    """The tree of all tokens; none if they are no whole expression."""
    reader = Reader(tokens)
    try:
        tree = reader.whole(0)
    except (NotAnExpression, RecursionError):
        return None
    return tree if reader.at == len(tokens) else None


def trees(tokens: list[tuple[int, str, str]]) -> list[tuple[int, Tree]]:
    """(place, tree) of the statements that semicolons outside braces part and that are expressions."""
    out, start, depth = [], 0, 0
    for k, (_, kind, _) in enumerate([*tokens, (0, "semicolon", ";")]):
        depth += (kind == "lbrace") - (kind == "rbrace")
        if kind == "semicolon" and (depth <= 0 or k == len(tokens)):
            if k > start and (tree := parse([(a, b) for _, a, b in tokens[start:k]])):
                out.append((tokens[start][0], tree))
            start, depth = k + 1, 0
    return out


def nodes(p: Project) -> DataFrame:
    """(file, stmt, node, parent, kind, value) of the expressions of all files; stmt is the place of a statement's first token."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        found = trees(list(zip(*(table[c].to_pylist() for c in ("s", "type", "value")), strict=True)))
        rows = [(at, n, *row) for at, tree in found for n, row in enumerate(tree.rows())]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.table([pa.array([table["file"][0].as_py()] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["file", "stmt", "node", "parent", "kind", "value"])

    return p.sig.select("file", "s", "type", "value").groupBy("file").applyInArrow(run, NODES)
