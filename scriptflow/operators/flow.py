"""Control flow: a tolerant statement parser and the rules that need it.

A file's tokens come as one group and are parsed into nested statements. The walk keeps the set
of locals that are surely defined: branches meet in the intersection, blocks take their private
names with them, loops and exits define nothing for what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .rules import Project

# Statements that end a block, locals that the engine provides, words that open loops, brackets.
ENDERS = {"exitwith", "throw", "breakout", "breakto", "continue", "return", "break"}
PROVIDED = {"_this", "_x", "_y", "_foreachindex", "_exception", "_thisscript", "_fnc_scriptname", "_fnc_scriptnameparent", "_thiseventhandler", "_thisid", "_thisevent", "_thisargs"}
LOOPS = {"while", "for", "waituntil"}
PAIRS = {"lparen": "rparen", "lbracket": "rbracket", "lbrace": "rbrace"}


@dataclass
class Token:
    type: str
    value: str
    line: int
    col: int

    @property
    def low(self) -> str:
        return self.value.lower()


@dataclass
class Node:
    """kind: plain, if, loop, switch, try or exit. head: tokens outside the blocks; blocks: statements of each."""

    kind: str
    head: list[Token]
    blocks: list[list[Node]] = field(default_factory=list)
    otherwise: bool = False  # an if has an else, a switch a default
    end: Token | None = None
    bare: bool = False  # no semicolon follows

    @property
    def start(self) -> Token:
        return self.head[0]


def matching(tokens: list[Token]) -> dict[int, int]:
    """Closers of openers; brackets that don't fit are left out."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t.type in PAIRS:
            stack.append(i)
        elif t.type in PAIRS.values() and stack and PAIRS[tokens[stack[-1]].type] == t.type:
            out[stack.pop()] = i
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.close = tokens, matching(tokens)

    def block(self, start: int, end: int) -> list[Node]:
        """Statements between two places."""
        out, i = [], start
        while i < end:
            if self.tokens[i].type == "semicolon":
                i += 1
                continue
            node, i = self.statement(i, end)
            node.end, node.bare = self.tokens[i - 1], i < end and self.tokens[i].type != "semicolon"
            out.append(node)
        return out

    def braces(self, i: int, end: int) -> tuple[list[Node], int] | None:
        if i < end and self.tokens[i].type == "lbrace" and (close := self.close.get(i, end)) <= end:
            return self.block(i + 1, close), close + 1
        return None

    def until(self, i: int, end: int, words: set[str]) -> int:
        """The next of some words outside brackets before the statement's end, or that end."""
        while i < end and self.tokens[i].type != "semicolon":
            if self.tokens[i].low in words and self.tokens[i].type in ("keyword", "ident"):
                return i
            i = self.close.get(i, i) + 1
        return i

    def statement(self, i: int, end: int) -> tuple[Node, int]:
        t, word = self.tokens, self.tokens[i].low
        if word == "if":
            at = self.until(i + 1, end, {"then", "exitwith"})
            if at < end and t[at].low == "exitwith" and (body := self.braces(at + 1, end)):
                return Node("exit", t[i:at], [body[0]]), body[1]
            if at < end and t[at].low == "then" and (body := self.braces(at + 1, end)):
                node, j = Node("if", t[i:at], [body[0]]), body[1]
                if j < end and t[j].low == "else":
                    if other := self.braces(j + 1, end):
                        node.blocks.append(other[0])
                        node.otherwise, j = True, other[1]
                    elif j + 1 < end and t[j + 1].low == "if":
                        inner, j = self.statement(j + 1, end)
                        node.blocks.append([inner])
                        node.otherwise = True
                return node, j
        elif word in LOOPS:
            at = self.until(i + 1, end, {"do"})
            if at < end and t[at].low == "do" and (body := self.braces(at + 1, end)):
                return Node("loop", t[i:at], [body[0]]), body[1]
        elif word == "switch":
            at = self.until(i + 1, end, {"do"})
            if at < end and t[at].low == "do" and t[at + 1 : at + 2] and t[at + 1].type == "lbrace" and (close := self.close.get(at + 1, end)) <= end:
                node, j = Node("switch", t[i:at]), at + 2
                while j < close:
                    low = t[j].low
                    if low in ("case", "default"):
                        k = j
                        while k < close and t[k].type not in ("lbrace", "semicolon"):
                            k += 1
                        node.head += t[j + 1 : k] if low == "case" else []
                        node.otherwise |= low == "default"
                        if body := self.braces(k, close):
                            node.blocks.append(body[0])
                            j = body[1]
                            continue
                    j += 1
                return node, close + 1
        elif word == "try" and (body := self.braces(i + 1, end)) and body[1] < end and t[body[1]].low == "catch" and (other := self.braces(body[1] + 1, end)):
            return Node("try", t[i : i + 1], [body[0], other[0]]), other[1]
        node, j = Node("plain", []), i
        while j < end and t[j].type != "semicolon":
            if t[j].type == "lbrace" and (body := self.braces(j, end)):
                each = body[1] < end and t[body[1]].low == "foreach" or (node.head and node.head[-1].low in ("foreach", "apply", "count", "select", "findif"))
                node.blocks.append([Node("loop" if each else "scope", t[j : j + 1], [body[0]])])
                j = body[1]
            else:
                node.head.append(t[j])
                j += 1
        if not node.head:
            node.head = t[i : i + 1]
        return node, j


def ends(node: Node) -> bool:
    """Whether nothing after a statement can run."""
    last = lambda b: bool(b) and ends(b[-1])
    if node.kind == "plain":
        return node.start.type == "keyword" and node.start.low in ENDERS or (node.start.type == "ident" and node.start.low in ("return", "break"))
    if node.kind in ("if", "switch", "try"):
        return bool(node.blocks) and (node.otherwise or node.kind == "try") and all(last(b) for b in node.blocks)
    return False


def unreachable(block: list[Node]) -> Iterator[tuple[int, int, str, str]]:
    dead = False
    for node in block:
        if dead:
            yield node.start.line, node.start.col, "W104", "unreachable statement after unconditional control flow"
        for inner in node.blocks:
            yield from unreachable(inner)
        dead |= ends(node)


def unended(block: list[Node]) -> Iterator[tuple[int, int, str, str]]:
    """What begins on the line on which a structured statement's block ends, without a semicolon between them."""
    for node, after in zip(block, block[1:], strict=False):
        if node.kind != "plain" and node.bare and node.end.type == "rbrace" and after.start.line == node.end.line and after.start.low not in ("else", "catch", "then"):
            yield after.start.line, after.start.col, "E008", "missing semicolon after code block"
    for node in block:
        for inner in node.blocks:
            yield from unended(inner)


class Locals:
    """W101: locals that are read where they may not be defined."""

    def __init__(self) -> None:
        self.found: dict[tuple[int, int], str] = {}

    def scan(self, tokens: list[Token], known: set[str]) -> tuple[set[str], set[str]]:
        """Reads tokens in order; returns what is defined afterwards and what of it is private."""
        known, private = set(known), set()
        pending: str | None = None  # a name that its own right side can't read yet
        depth = 0
        declaring = None
        for i, t in enumerate(tokens):
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            before = tokens[i - 1] if i else None
            if t.type == "keyword" and t.low in ("private", "params") and after and after.type == "lbracket":
                declaring, depth = depth, depth
            if t.type in PAIRS:
                depth += 1
            elif t.type in PAIRS.values():
                depth -= 1
                if declaring is not None and depth <= declaring:
                    declaring = None
            elif t.type == "string" and declaring is not None and t.value.startswith("_"):
                known.add(t.low)
                private.add(t.low)
            elif t.type == "string" and before and before.low == "for" and t.value.startswith("_"):
                known.add(t.low)
            elif t.type == "local":
                if before and before.low in ("private", "params"):
                    private.add(t.low)
                    if not (after and after.value == "="):
                        known.add(t.low)
                        continue
                if after and after.value == "=":
                    if pending:
                        known.add(pending)
                    pending = t.low
                elif t.low not in known and t.low not in PROVIDED:
                    self.found.setdefault((t.line, t.col), t.value)
        if pending:
            known.add(pending)
        return known, private

    def block(self, nodes: list[Node], known: set[str], inner: bool = True) -> set[str]:
        mine: set[str] = set()
        now = set(known)
        for node in nodes:
            now, private = self.node(node, now)
            mine |= private
        return now - (mine - known) if inner else now

    def node(self, node: Node, known: set[str]) -> tuple[set[str], set[str]]:
        after, private = self.scan(node.head, known)
        if node.kind in ("if", "switch", "try") and node.blocks:
            out = [self.block(b, after) for b in node.blocks]
            if not (node.otherwise or node.kind == "try"):
                out.append(after)
            return set.intersection(*out), private
        if node.kind == "plain":
            for inner in node.blocks:
                self.block(inner, after)
            return after, private
        start = after if node.kind == "loop" else known
        for inner in node.blocks:
            self.block(inner, start)
        return known, private


def flow_rules(p: Project) -> DataFrame:
    """W104 unreachable statements and W101 locals that may be undefined, with W101 on the file's own text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        tokens = [Token(a, b, int(c), int(d)) for a, b, c, d in zip(rows["type"], rows["value"], rows["line"], rows["col"], strict=True) if a not in ("comment", "preprocessor")]
        tree = Parser(tokens).block(0, len(tokens))
        walk = Locals()
        walk.block(tree, set(), inner=False)
        found = [*unreachable(tree), *unended(tree), *((line, col, "W101", f"possible undefined variable: {name}") for (line, col), name in sorted(walk.found.items()))]
        return pd.DataFrame([(rows["file"].iloc[0], line, col, code, text, k) for k, (line, col, code, text) in enumerate(found)], columns=["file", "line", "column", "code", "message", "seq"])

    return p.tokens.groupBy("file").applyInPandas(run, "file string, line int, `column` int, code string, message string, seq int")
