"""Preprocessing: includes, macros and conditionals of a file, with a map of lines.

This is a fold with state, so it runs in Python: a root file comes together with the texts of all
files that it may include, which the include graph's closure gives, and is worked off in one go.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import includes
from .rules import Project

#: Depth to which macros are expanded within a line.
EXPANSIONS = 32
_DIRECTIVE = re.compile(r"^\s*#\s*([A-Za-z]+)\b\s*(.*?)\s*$", re.S)
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TOKEN = re.compile(rf'"(?:[^"]|"")*"?|//.*|{_NAME}|.', re.S)
_FUNCTION = re.compile(rf"^({_NAME})\(([^)]*)\)\s*(.*)$", re.S)
_OBJECT = re.compile(rf"^({_NAME})\\?(?:\s+(.*))?$", re.S)
# Directives there are, and names that the engine or the build defines.
DIRECTIVES = {"include", "define", "undef", "ifdef", "ifndef", "if", "elif", "else", "endif", "pragma"}


def resolve(base: str, target: str) -> str:
    """The path of an included file, with forward slashes and without . and .. parts."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), target.replace("\\", "/")))


@dataclass
class Fold:
    """State of one root file: open conditionals, macros, and what has come out so far."""

    texts: dict[str, str]
    conditions: list[bool] = field(default_factory=list)
    objects: dict[str, str] = field(default_factory=dict)
    functions: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list)
    origins: list[tuple[str, int]] = field(default_factory=list)

    def put(self, text: str, file: str, line: int) -> None:
        self.lines.append(text)
        self.origins.append((file, line))

    def known(self, name: str) -> bool:
        return name.lower() in self.objects or name.lower() in self.functions

    def truth(self, expression: str) -> bool | None:
        """What #if makes of an expression; None if it doesn't know its form."""
        m = re.fullmatch(rf"(!?)\s*(?:defined\s*\(\s*({_NAME})\s*\)|({_NAME})|([01]))", expression, re.I)
        if not m:
            return None
        if m[4] or (m[3] or "").lower() in ("true", "false"):
            return (m[4] or m[3]).lower() in ("1", "true")
        name = m[2] or m[3]
        return (name.lower() in self.objects) != bool(m[1])

    def directive(self, word: str, rest: str) -> bool:
        """Works off a directive that isn't an include; whether it was one."""
        live = all(self.conditions)
        if word in ("ifdef", "ifndef"):
            name = rest.split(None, 1)[0] if rest else ""
            self.conditions.append(((name.lower() in self.objects) == (word == "ifdef")) and live)
        elif word == "if":
            if (value := self.truth(rest)) is not None:
                self.conditions.append(value and live)
        elif word == "elif":
            if self.conditions:
                self.conditions[-1] = bool(self.truth(rest)) and all(self.conditions[:-1])
        elif word == "else":
            if self.conditions:
                self.conditions[-1] = not self.conditions[-1]
        elif word == "endif":
            if self.conditions:
                self.conditions.pop()
        elif word == "undef" and live:
            self.objects.pop(rest.split(None, 1)[0].lower() if rest else "", None)
        elif word == "define" and live:
            self.define(rest)
        else:
            return not live
        return True

    def define(self, rest: str) -> None:
        if m := _FUNCTION.match(rest):
            self.functions[m[1].lower()] = ([p.strip() for p in m[2].split(",") if p.strip()], _bare(m[3]))
        elif m := _OBJECT.match(rest):
            self.objects[m[1].lower()] = _bare(m[2] or "1") or "1"

    def file(self, name: str, stack: tuple[str, ...]) -> None:
        lines = iter(enumerate(self.texts[name].split("\n"), 1))
        for number, line in lines:
            m = _DIRECTIVE.match(line)
            word = m[1].lower() if m else ""
            if word == "define" and all(self.conditions):
                parts, last = [], line
                numbers = [number]
                while last.rstrip().endswith("\\") and (more := next(lines, None)):
                    parts.append(last.rstrip()[:-1].rstrip())
                    numbers.append(more[0])
                    last = more[1]
                parts.append(_bare(last.rstrip()))
                full = _DIRECTIVE.match(" ".join(parts))
                self.define(full[2] if full else m[2])
                for k in numbers:
                    self.put("", name, k)
            elif m and word != "include" and self.directive(word, m[2]):
                self.put("", name, number)
            elif not all(self.conditions):
                self.put("", name, number)
            elif word == "include" and (target := re.match(r'^["<]([^">]+)[">]', m[2])) and (path := resolve(name, target[1])) in self.texts and path not in stack:
                self.file(path, (*stack, path))
            else:
                self.put(self.expand(line, 0), name, number)

    def expand(self, text: str, depth: int, closed: frozenset[str] = frozenset()) -> str:
        """Macros of a line; strings and comments stay as they are."""
        if depth >= EXPANSIONS or not (self.objects or self.functions):
            return text
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            word, at = m[0], m.end()
            key = word.lower()
            if key in self.functions and key not in closed and at < len(text) and text[at] == "(":
                arguments, end = _arguments(text, at)
                names, body = self.functions[key]
                if arguments is not None:
                    given = dict(zip(names, [*arguments, *[""] * len(names)], strict=False))
                    filled = "".join(given.get(t, t) for t in _TOKEN.findall(body))
                    out.append(self.expand(re.sub(r"\s*##\s*", "", filled), depth + 1, closed | {key}))
                    at = end
                    continue
            if key in self.objects and key not in closed:
                word = self.expand(re.sub(r"\s*##\s*", "", self.objects[key]), depth + 1, closed | {key})
            out.append(word)
        return "".join(out)


def _bare(body: str) -> str:
    """A macro's body without a comment at its end, outside strings."""
    out = []
    for part in _TOKEN.findall(body):
        if part.startswith("//"):
            break
        out.append(part)
    return "".join(out).strip()


def _arguments(text: str, at: int) -> tuple[list[str] | None, int]:
    """Arguments of a call whose opening parenthesis is at a place, and the place behind it; None without an end."""
    depth, parts, quote = 0, [""], False
    for k in range(at, len(text)):
        c = text[k]
        quote ^= c == '"'
        if not quote and c in "([{":
            depth += 1
            if depth == 1:
                continue
        elif not quote and c in ")]}":
            depth -= 1
            if not depth:
                return [p.strip() for p in parts], k + 1
        elif not quote and c == "," and depth == 1:
            parts.append("")
            continue
        parts[-1] += c
    return None, at


def combine(texts: dict[str, str], root: str) -> tuple[str, list[tuple[str, int]]]:
    """The text of a file after preprocessing and the origin of each of its lines."""
    if "#" not in texts[root]:
        return texts[root], [(root, k) for k in range(1, texts[root].count("\n") + 2)]
    fold = Fold(texts)
    fold.file(root, (root,))
    return "\n".join(fold.lines), fold.origins


def preprocess(p: Project) -> DataFrame:
    """(file, text, origins array<struct<file, line>>) of every source. Files without directives pass by unchanged."""
    plain = p.sources.where(~F.contains("text", F.lit("#"))).select("file", "text", F.lit(None).cast("array<struct<file:string,line:int>>").alias("origins"))
    roots = p.sources.where(F.contains("text", F.lit("#"))).select("file", "text")
    edges = include_graph(p)
    closure = includes.closure(edges).select(F.col("src").alias("root"), F.col("dst").alias("file"))
    own = roots.select(F.col("file").alias("root"), "file")
    parts = own.union(closure.join(roots.select(F.col("file").alias("root")), "root", "left_semi")).distinct().join(p.sources.select("file", "text"), "file")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        text, origins = combine(dict(zip(rows["file"], rows["text"].fillna(""), strict=True)), key[0])
        return pd.DataFrame({"file": [key[0]], "text": [text], "origins": [[{"file": f, "line": n} for f, n in origins]]})

    return plain.unionByName(parts.groupBy("root").applyInPandas(run, "file string, text string, origins array<struct<file:string,line:int>>"))


def include_graph(p: Project) -> DataFrame:
    """(src, dst) of includes between sources, targets resolved against the including file."""
    edges = includes.include_edges(p.tokens)
    path = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.replace("target", F.lit("\\"), F.lit("/")))
    # "a/../" and "./" go, one level of each round; paths of corpora are short
    for _ in range(4):
        path = F.regexp_replace(F.regexp_replace(path, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return edges.select(F.col("file").alias("src"), path.alias("dst")).join(p.sources.select(F.col("file").alias("dst")), "dst", "left_semi").select("src", "dst")


def macro_locals(p: Project) -> DataFrame:
    """(file, name) of locals that macros of a file, or of what it includes over any steps, may introduce: locals and quoted
    locals in macro bodies, those in lists of params and in parameter macros, and what the engine and method wrappers provide."""
    joined = F.regexp_replace("text", r"\\[ \t]*(\r?\n)", " ")
    bodies = F.array_join(F.regexp_extract_all(joined, F.lit(r"(?m)^\s*#\s*define\s+[^\s(]+(?:\([^)]*\))?[ \t]*(.*)$"), 1), "\n")
    lists = F.array_join(F.regexp_extract_all("text", F.lit(r"(?is)\bparams\s*\[([^\]]*)\]"), 1), "\n")
    each = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    quoted = r'"(_[A-Za-z0-9_]+)"'
    wrapped = F.when(F.col("text").rlike(r"\bMETHOD\s*\("), F.array(F.lit("_thisclass"), F.lit("_thisobject"), F.lit("_oop_logscope"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(each(bodies, r"(?<![A-Za-z0-9_])(_[A-Za-z][A-Za-z0-9_]*)\b"), each(bodies, quoted), each(lists, quoted), each(F.col("text"), r'\bP_[A-Za-z0-9_]+\s*\(\s*"(_[A-Za-z0-9_]+)"'), wrapped, F.array(F.lit("__file__"), F.lit("__line__")))
    own = p.sources.where("text is not null").select("file", F.explode(names).alias("name")).select("file", F.lower("name").alias("name")).distinct()
    reached = includes.closure(include_graph(p)).select(F.col("src").alias("into"), F.col("dst").alias("file"))
    return own.unionByName(own.join(reached, "file").select(F.col("into").alias("file"), "name")).distinct()


def line_map(combined: DataFrame) -> DataFrame:
    """(file, out_line, origin_file, origin_line) of preprocessed files."""
    return combined.where("origins is not null").select("file", F.posexplode("origins").alias("n", "o")).select("file", (F.col("n") + 1).alias("out_line"), F.col("o.file").alias("origin_file"), F.col("o.line").alias("origin_line"))


def remap(d: DataFrame, lines: DataFrame) -> DataFrame:
    """Moves findings on preprocessed text to the lines they come from; those without an entry stay."""
    both = d.join(lines.withColumnRenamed("out_line", "line"), ["file", "line"], "left")
    return both.withColumns({"file": F.coalesce("origin_file", "file"), "line": F.coalesce("origin_line", "line")}).select(*d.columns)


def directive_rules(p: Project, predefined: frozenset[str] = frozenset()) -> DataFrame:
    """Findings on the directives themselves: W225 redefinitions, W226 unknown names, W228 directives that nothing knows."""

    def check(text: str) -> Iterator[tuple[int, int, str, str]]:
        defined: set[str] = set()
        branches: list[set[str]] = []
        for number, line in enumerate(text.splitlines(), 1):
            if not (m := re.match(r"^\s*#\s*([A-Za-z_]+)(.*)$", line)):
                continue
            word, rest, column = m[1].lower(), m[2].strip(), line.index("#") + 1
            first = (rest.split(None, 1) or [""])[0]
            if word not in DIRECTIVES:
                yield number, column, "W228", f"unsupported preprocessor directive: #{word}"
            elif word == "define":
                made = _FUNCTION.match(rest)
                name = made[1] if made else first.rstrip("\\")
                if not re.fullmatch(_NAME, name):
                    yield number, column, "W228", "malformed #define directive"
                    continue
                if name.lower() in defined and (not branches or name.lower() in branches[-1]):
                    yield number, column, "W225", f"macro redefined: {name}"
                defined.add(name.lower())
                if branches:
                    branches[-1].add(name.lower())
            elif word == "undef":
                if first.lower() not in defined:
                    yield number, column, "W226", f"undefined macro in #undef: {first or '<missing>'}"
                defined.discard(first.lower())
            elif word in ("ifdef", "ifndef", "if"):
                if word != "if" and not re.fullmatch(_NAME, first):
                    yield number, column, "W228", f"malformed #{word} directive"
                tight = rest.replace(" ", "")
                if word == "if" and tight and not re.match(r"!?defined\(|(0|1|true|false)$", tight):
                    name = re.fullmatch(rf"!?({_NAME})", tight)
                    if not name or name[1].lower() not in defined | predefined:
                        yield number, column, "W226", f"macro or expression cannot be resolved in #if: {rest}"
                branches.append(set())
            elif word in ("elif", "else") and branches:
                branches[-1] = set()
            elif word == "endif" and branches:
                branches.pop()
            elif word == "pragma" and rest.lower() != "once":
                yield number, column, "W228", f"unsupported #pragma: {rest}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, n, c, code, text, n) for f, t in zip(batch["file"], batch["text"], strict=True) for n, c, code, text in check(t or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "column", "code", "message", "seq"])

    return p.sources.where(F.contains("text", F.lit("#"))).select("file", "text").mapInPandas(run, "file string, line int, `column` int, code string, message string, seq int")


def include_rules(p: Project) -> DataFrame:
    """W210 for includes that lead back to a file, W211 for files included again without a guard."""
    sites = includes.include_edges(p.tokens)
    path = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.replace("target", F.lit("\\"), F.lit("/")))
    sites = sites.withColumn("dst", F.regexp_replace(path, r"(^|/)\./", "$1"))
    reached = includes.closure(include_graph(p))
    back = reached.select(F.col("src").alias("dst"), F.col("dst").alias("file")).union(p.sources.select(F.col("file").alias("dst"), "file"))
    cyclic = sites.join(back, ["dst", "file"], "left_semi")
    message = lambda text: F.concat(F.lit(text), "target")
    w210 = cyclic.select("file", "line", F.lit(1).alias("column"), F.lit("W210").alias("code"), message("include cycle detected through ").alias("message"), F.col("line").alias("seq"))
    guarded = p.sources.where(F.col("text").rlike(r"(?im)\A(?:\s|//[^\n]*\n|/\*(?s:.*?)\*/)*#\s*(?:ifndef\b|pragma\s+once\b)")).select(F.col("file").alias("dst"))
    again = sites.withColumn("_r", F.row_number().over(Window.partitionBy("file", "dst").orderBy("line"))).where("_r > 1")
    again = again.join(p.sources.select(F.col("file").alias("dst")), "dst", "left_semi").join(guarded, "dst", "left_anti")
    w211 = again.select("file", "line", F.lit(1).alias("column"), F.lit("W211").alias("code"), F.concat(F.lit("repeated include without guard: "), F.regexp_replace("target", r"^.*[\\\\/]", "")).alias("message"), F.col("line").alias("seq"))
    return w210.unionByName(w211)
