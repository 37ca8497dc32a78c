"""Diagnostic rules as queries over token tables.

A rule takes a Project and returns diagnostics: file, line, column, code, message, seq (position
that orders a file's findings of one pass). `run` adds severities and passes and unites rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, without_trailing_blanks
from ..session import kept_by
from . import lexer, structure

# Rule codes with their severities and names.
CATALOG = {
    "E001": ("error", "Unmatched or unclosed bracket"),
    "E002": ("error", "Unterminated string literal"),
    "E003": ("error", "Trailing comma in an array"),
    "E004": ("error", "Missing then after an if condition"),
    "E005": ("error", "Invalid else syntax"),
    "E006": ("error", "Missing comma between array elements"),
    "E007": ("error", "Reversed forEach syntax"),
    "E008": ("error", "Missing semicolon after a code block"),
    "E009": ("error", "Invalid postfix command expression"),
    "E010": ("error", "Malformed config structure"),
    "E011": ("error", "Malformed mission.sqm structure"),
    "E012": ("error", "Invalid project configuration"),
    "W101": ("warning", "Possible undefined local variable"),
    "W104": ("warning", "Unreachable code"),
    "W201": ("warning", "Unknown function or command name"),
    "W202": ("warning", "Unknown direct command name"),
    "W203": ("warning", "Incompatible argument type"),
    "W204": ("warning", "Incorrect function argument count"),
    "W205": ("warning", "Call or spawn target is not code"),
    "W206": ("warning", "Constant if condition"),
    "W207": ("warning", "Duplicate function definition"),
    "W208": ("warning", "Function overwritten by a non-code value"),
    "W209": ("warning", "Unused local variable"),
    "W210": ("warning", "Include cycle detected"),
    "W211": ("warning", "Repeated include without an include guard"),
    "W212": ("warning", "Duplicate mission addon entry"),
    "W213": ("warning", "Invalid mission addon name"),
    "W214": ("warning", "Config property defined more than once"),
    "W215": ("warning", "Local declaration shadows or duplicates another local"),
    "W216": ("warning", "Comparison uses incompatible statically known types"),
    "W217": ("warning", "Invalid params declaration shape"),
    "W218": ("warning", "Invalid namespace variable operation"),
    "W219": ("warning", "Invalid event-handler lifecycle or declaration"),
    "W220": ("warning", "Invalid remote execution contract"),
    "W221": ("warning", "Invalid public-variable contract"),
    "W222": ("warning", "Value overwritten before use"),
    "W223": ("warning", "Repeated constant assignment"),
    "W224": ("warning", "Ineffective empty expression"),
    "W225": ("warning", "Macro redefined"),
    "W226": ("warning", "Undefined or unresolved macro use"),
    "W227": ("warning", "Malformed conditional preprocessor nesting"),
    "W228": ("warning", "Unsupported or malformed preprocessor directive"),
    "W229": ("warning", "Suppression is missing a justification"),
    "W230": ("info", "Suppression does not match a diagnostic"),
    "W231": ("warning", "Malformed or unknown suppression directive"),
    "W232": ("warning", "Non-serializable value stored in a namespace variable"),
    "W233": ("warning", "Dynamic nested select on a parameter may index an empty or short array element"),
    "W301": ("warning", "Trailing whitespace"),
    "W302": ("warning", "Tab character in source indentation"),
}
# Rules of the categories; a warning in none of the last three is of correctness.
FLOW = ["W104", "W206", "W209", "W215", "W216", "W222", "W223", "W224"]
SUPPRESSION, STYLE = ["W229", "W230"], ["W301", "W302"]
# Words that end an if condition, namespaces, those that are saved, handles and factories that can't be, commands that take callbacks.
BODY = ["then", "exitwith", "continue", "break", "throw"]
NAMESPACES = ["missionnamespace", "profilenamespace", "parsingnamespace", "uinamespace", "servernamespace", "localnamespace", "missionprofilenamespace"]
SAVED = ["missionnamespace", "profilenamespace", "missionprofilenamespace"]
HANDLES = ["controlnull", "displaynull", "scriptnull", "tasknull", "controldisplay", "finddisplay", "displayctrl", "ctrlcreate"]
EVENT_HANDLERS = ["addeventhandler", "addmissioneventhandler", "addstackedeventhandler", "displayaddeventhandler", "ctrladdeventhandler", "ctrlseteventhandler", "buttonsetaction"]
SCRIPT_PATH = r"(?i)\.(sqf|sqs|ext)$"


def catalog(spark: SparkSession) -> DataFrame:
    """(code, severity, name, categories) of every rule."""
    rows = []
    for code, (severity, name) in sorted(CATALOG.items()):
        kinds = ["syntax"] if code[0] == "E" else ["flow"] if code in FLOW else ["suppression"] if code in SUPPRESSION else ["style"] if code in STYLE else ["correctness"]
        rows.append((code, severity, name, kinds))
    return spark.createDataFrame(rows, "code string, severity string, name string, categories array<string>")


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kind string, name string")


@dataclass
class Project:
    """Sources (file, text, and what else there is) and the names that are known. Registries are data:
    rows (kind, name) of commands, functions, tags and macros in lower case."""

    sources: DataFrame
    registry: DataFrame
    #: Writes the token tables to the shared folder, in buckets by file, for rules that read them several times.
    keep: bool = False

    @cached_property
    def tokens(self) -> DataFrame:
        made = lexer.tokens(self.sources)
        return kept_by(made, "tokens", "file") if self.keep else made

    @cached_property
    def sig(self) -> DataFrame:
        made = lexer.significant(self.__dict__.get("tokens") or lexer.tokens(self.sources))
        return kept_by(made, "significant", "file") if self.keep else made

    def known(self, kinds: Iterable[str]) -> DataFrame:
        return self.registry.where(F.col("kind").isin(*kinds)).select(F.col("name").alias("known")).distinct()

    def unknown(self, df: DataFrame, name: Column) -> DataFrame:
        """Rows whose lower-case name is no command, function or macro. A tag covers its functions only
        while no exact name of the tag is known."""
        exact = self.known(["command", "function", "macro"])
        rows = df.withColumn("_name", name).join(exact, F.col("_name") == F.col("known"), "left_anti")
        listed = self.registry.where("kind = 'function'").select(F.split_part("name", F.lit("_fnc_"), F.lit(1)).alias("tag")).distinct()
        tags = self.registry.where("kind = 'tag'").select(F.col("name").alias("tag")).join(listed, "tag", "left_anti")
        rows = rows.withColumn("_tag", F.when(F.contains("_name", F.lit("_fnc_")), F.split_part("_name", F.lit("_fnc_"), F.lit(1))))
        return rows.join(tags, F.col("_tag") == F.col("tag"), "left_anti").drop("_name", "_tag")


def found(df: DataFrame, code: str, message: Column | str, line: str = "line", col: str = "col", seq: str = "s") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select("file", F.col(line).cast("int").alias("line"), F.col(col).cast("int").alias("column"), F.lit(code).alias("code"), text.alias("message"), F.col(seq).cast("int").alias("seq"))


def brackets(p: Project) -> DataFrame:
    at = structure.bracket_faults(p.sig).join(p.sig.select("file", "s", "raw", "line", "col"), ["file", "s"])
    return found(at, "E001", F.concat("fault", F.lit(" '"), "raw", F.lit("'")))


def unterminated_strings(p: Project) -> DataFrame:
    return found(p.sig.where("type = 'string' and not endswith(raw, substring(raw, 1, 1))"), "E002", "unterminated string")


def trailing_commas(p: Project) -> DataFrame:
    return found(p.sig.where("type = 'rbracket' and p1t = 'comma'"), "E003", "trailing comma in array", "p1line", "p1col")


def missing_then(p: Project) -> DataFrame:
    """The condition's closing parenthesis must lead to a body: at once, or after an operator before the statement ends."""
    w = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    body = F.col("v").isin(*BODY)
    sig = p.sig.withColumns({"_body": F.min(F.when(body, F.col("s"))).over(w), "_semi": F.min(F.when(F.col("type") == "semicolon", F.col("s"))).over(w)})
    ifs = sig.where("type = 'keyword' and v = 'if'").select("file", F.when(F.expr("n1t = 'operator' and n1v = '!'"), F.col("s") + 2).otherwise(F.col("s") + 1).alias("open"))
    pairs = structure.bracket_pairs(p.sig)
    closed = ifs.join(pairs.withColumnRenamed("s", "open"), ["file", "open"])
    opens = p.sig.where("type = 'lparen'").select("file", F.col("s").alias("open"))
    at = closed.join(opens, ["file", "open"], "left_semi").join(sig.withColumnRenamed("s", "close"), ["file", "close"])
    # body and semicolon are looked for from the token after the operator on
    later = F.col("n1t").eqNullSafe("operator") & F.col("_body").isNotNull() & (F.col("_semi").isNull() | (F.col("_body") < F.col("_semi")))
    bad = at.where(~F.coalesce(F.col("n1v").isin(*BODY), F.lit(False)) & ~later)
    bad = bad.withColumns({"_l": F.coalesce("n1line", "line"), "_c": F.coalesce("n1col", "col")})
    return found(bad, "E004", "expected 'then' after if condition", "_l", "_c", "close")


def bad_else(p: Project) -> DataFrame:
    bad = p.sig.where("type = 'keyword' and v = 'else' and not coalesce(n1t = 'lbrace' or (n1t = 'keyword' and n1v = 'if'), false)")
    bad = bad.withColumns({"_l": F.coalesce("n1line", "line"), "_c": F.coalesce("n1col", "col")})
    return found(bad, "E005", "expected code block or if after 'else'", "_l", "_c")


def missing_commas(p: Project) -> DataFrame:
    """Two literals side by side within a matched array; each array reports its first. So a place counts if
    no earlier one lies within the innermost array around it."""
    sides = structure.enclosed(p.sig, ["lbracket"]).where("type in ('number','string') and n1t in ('number','string') and parent is not null and s + 1 < parent_close")
    first = sides.withColumn("_before", F.lag("s").over(Window.partitionBy("file").orderBy("s"))).where("_before is null or _before < parent")
    return found(first, "E006", "missing comma between array elements", "n1line", "n1col")


def reversed_loops(p: Project) -> DataFrame:
    return found(p.sig.where("type = 'keyword' and v = 'foreach' and n1t in ('ident','local') and n2t = 'lbrace'"), "E007", "expected code block before 'forEach'")


def unended_blocks(p: Project) -> DataFrame:
    """A known command with a block, followed by an unknown name: the statement before it lacks its end."""
    blocks = structure.bracket_pairs(p.sig).join(p.sig.where("type = 'lbrace' and p1t = 'ident'").select("file", "s", "p1v"), ["file", "s"])
    blocks = blocks.join(p.known(["command", "function"]), F.col("p1v") == F.col("known"), "left_semi")
    after = blocks.join(p.sig.select("file", (F.col("s") - 1).alias("close"), "type", "v", "line", "col"), ["file", "close"])
    after = after.where("type in ('ident','local') and v not in ('isequalto','isnotequalto')")
    return found(after.join(p.known(["command", "function"]), F.col("v") == F.col("known"), "left_anti"), "E008", "missing semicolon after command with code block")


def postfix_commands(p: Project) -> DataFrame:
    st = structure.statements(p.sig).where("type <> 'semicolon'")
    two = st.groupBy("file", "stmt").agg(F.count("*").alias("n"), F.min(F.struct("s", "type", "v")).alias("a"), F.max(F.struct("s", "type", "v", "value", "line", "col")).alias("b"))
    two = two.where("n = 2 and a.type in ('local','ident') and b.type = 'ident' and b.v <> 'ctrlsetfocus'").select("file", F.col("a.v").alias("av"), "b.*")
    known = p.known(["command", "function"])
    two = two.join(known, F.col("av") == F.col("known"), "left_anti").join(known, F.col("v") == F.col("known"), "left_semi")
    return found(two, "E009", F.concat(F.lit("invalid postfix command expression; use '"), "value", F.lit(" <value>' or assign its result")))


def unknown_calls(p: Project) -> DataFrame:
    """Names after call or spawn that nothing defines. Hooks that the file guards with isNil count as defined; paths of scripts aren't names."""
    calls = p.sig.where("type = 'keyword' and v in ('call','spawn') and (n1t = 'ident' or (n1t = 'string' and not rlike(n1v, '" + SCRIPT_PATH.replace("\\", "\\\\") + "')))")
    hooks = p.sig.where("v = 'isnil' and n1t = 'string'").select("file", F.col("n1v").alias("hook")).distinct()
    guarded = calls.join(hooks, (calls["file"] == hooks["file"]) & (F.col("n1t") == "ident") & (F.col("n1v") == F.col("hook")), "left_anti")
    return found(p.unknown(guarded, F.col("n1v")), "W201", F.concat(F.lit("unknown function/command: "), "n1value", F.when(F.col("n1v").startswith("cba_") & (F.col("n1t") == "ident"), " (CBA dependency is not indexed; declare it and run update)").otherwise("")), "n1line", "n1col")


def value_calls(p: Project) -> DataFrame:
    bad = p.sig.where("type = 'keyword' and v in ('call','spawn') and (n1t in ('number','lbracket') or (n1t = 'keyword' and n1v in ('true','false','nil')))")
    return found(bad, "W205", F.concat("value", F.lit(" target is a value, not code")), "n1line", "n1col")


def unknown_commands(p: Project) -> DataFrame:
    """A name right before an operand that nothing defines."""
    used = p.sig.where("type = 'ident' and (n1t in ('local','number','string','lparen','lbracket','lbrace') or (n1t = 'keyword' and n1v in ('true','false','nil')))")
    more = F.when(F.col("v").startswith("cba_"), " (CBA dependency is not indexed; declare it and run update)").when((F.col("n1t") == "lparen") & (F.upper("value") == F.col("value")), " (external macro is not indexed; declare its dependency and run update)").otherwise("")
    return found(p.unknown(used, F.col("v")), "W202", F.concat(F.lit("unknown command/function: "), "value", more))


def constant_conditions(p: Project) -> DataFrame:
    """A literal, or two joined by a comparison or a junction, as the whole parenthesised condition."""
    t = lambda k: F.col(f"n{k}t").isin("number", "string") | ((F.col(f"n{k}t") == "keyword") & F.col(f"n{k}v").isin("true", "false", "nil"))
    sig = lexer.significant(p.tokens, ahead=6, behind=0).where("type = 'keyword' and v = 'if' and n1t = 'lparen'")
    one = t(2) & (F.col("n3t") == "rparen") & (F.col("n4v") == "then")
    two = t(2) & (F.col("n3t") == "operator") & F.col("n3v").isin("==", "!=", "<", ">", "<=", ">=", "&&", "||") & t(4) & (F.col("n5t") == "rparen") & (F.col("n6v") == "then")
    return found(sig.where(one | two), "W206", "if condition is constant", "n1line", "n1col")


def _definitions(p: Project) -> DataFrame:
    """Assignments to global names, and whether each defines a function."""
    called = p.sig.where("type = 'keyword' and v in ('call','spawn') and n1t = 'ident'").select("file", F.col("n1v").alias("v")).distinct().withColumn("called", F.lit(True))
    made = p.sig.where("type = 'ident' and n1v = '=' and n2t is not null").join(called, ["file", "v"], "left")
    code = (F.col("n2t") == "lbrace") | F.col("n2v").isin("compile", "compilefinal")
    function = (F.contains("v", F.lit("_fnc_")) | F.coalesce("called", F.lit(False))) & code
    w = Window.partitionBy("file", "v").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("function", function)
    return made.withColumn("before", F.coalesce(F.max(F.col("function").cast("int")).over(w), F.lit(0)) == 1)


def duplicate_definitions(p: Project) -> DataFrame:
    return found(_definitions(p).where("function and before"), "W207", F.concat(F.lit("duplicate function definition: "), "value"))


def overwritten_definitions(p: Project) -> DataFrame:
    return found(_definitions(p).where("not function and before"), "W208", F.concat(F.lit("function overwritten by non-code value: "), "value"))


def _local_declarations(p: Project) -> DataFrame:
    """Locals declared by private or params, one name or an array of names: file, s, name, value, line, col,
    key (position of the keyword), word, listed, scope and scope_end (the innermost braces; null at the top)."""
    columns = ["file", "s", F.col("v").alias("name"), "value", "line", "col"]
    lone = p.sig.where("p1t = 'keyword' and p1v in ('private','params') and type = 'local'").select(*columns, (F.col("s") - 1).alias("key"), F.col("p1v").alias("word"), F.lit(False).alias("listed"))
    heads = p.sig.where("type = 'lbracket' and p1t = 'keyword' and p1v in ('private','params')").select("file", F.col("s").alias("parent"), (F.col("s") - 1).alias("key"), F.col("p1v").alias("word"), F.lit(True).alias("listed"))
    strings = p.sig.where("type = 'string' and startswith(value, '_')").select(*columns)
    listed = structure.enclosed(p.sig, ["lbracket"], of=strings).join(heads, ["file", "parent"]).select(*lone.columns)
    return structure.enclosed(p.sig, ["lbrace"], of=lone.unionByName(listed)).withColumnsRenamed({"parent": "scope", "parent_close": "scope_end"})


def _callbacks(p: Project) -> DataFrame:
    """(file, s, close) of the first braces within the array behind each event-handler command; close is null if they stay open."""
    later = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = p.sig.select("file", "s", "type", "v", F.min(F.when(F.col("type") == "lbracket", F.col("s"))).over(later).alias("_array"), F.min(F.when(F.col("type") == "lbrace", F.col("s"))).over(later).alias("_brace"))
    arrays = ahead.where(F.col("v").isin(*EVENT_HANDLERS)).select("file", F.col("_array").alias("s")).distinct().join(ahead.select("file", "s", "_brace"), ["file", "s"])
    ends = structure.bracket_pairs(p.sig.where("type in ('lbracket','rbracket')"))
    first = arrays.join(ends, ["file", "s"], "left").where("close is null or _brace < close").select("file", F.col("_brace").alias("s"))
    return first.where("s is not null").distinct().join(structure.bracket_pairs(p.sig.where("type in ('lbrace','rbrace')")), ["file", "s"], "left")


def unused_locals(p: Project) -> DataFrame:
    """Declared locals that no later token within their braces reads. Files with includes are left alone, and so
    are parameter lists in the callbacks of event handlers, whose parameters the engine supplies.

    Only the next use of a name matters: one window by file and name, and one that finds the widest callback around a list."""
    perhaps = p.sources.where(F.contains(F.lower("text"), F.lit("include")))
    including = lexer.tokens(perhaps).where("type = 'preprocessor' and lower(value) like 'include%'").select("file").distinct()
    made = _local_declarations(p).where("name not in ('_x','_this','_thisargs')").join(including, "file", "left_anti")
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    callbacks = _callbacks(p).select("file", F.col("s").alias("_at"), F.coalesce("close", F.lit(1 << 30)).alias("_close"))
    around = made.withColumn("_at", F.col("key")).unionByName(callbacks, allowMissingColumns=True).withColumn("_close", F.max("_close").over(before))
    made = around.where("name is not null and not (listed and word = 'params' and coalesce(_close > key, false))").drop("_at", "_close")
    uses = p.sig.where("type = 'local'").select("file", F.col("v").alias("name"), F.col("s").alias("use"), F.lit(0).alias("header"))
    headers = p.sig.where("type = 'keyword' and v = 'for' and n1t = 'string'").select("file", F.col("n1v").alias("name"), F.col("s").alias("use"), F.lit(1).alias("header"))
    every = made.unionByName(uses.unionByName(headers), allowMissingColumns=True).withColumn("_pos", F.coalesce("use", "s"))
    after = Window.partitionBy("file", "name").orderBy(F.desc("_pos")).rangeBetween(Window.unboundedPreceding, -1)
    every = every.withColumns({"_next": F.min(F.when(F.col("header") == 0, F.col("use"))).over(after), "_header": F.max("header").over(after)})
    free = every.where("s is not null and coalesce(_header, 0) = 0 and coalesce(_next >= scope_end, _next is null)")
    return found(free, "W209", F.concat(F.lit("unused local variable: "), "value"))


def shadowed_locals(p: Project, external: DataFrame | None = None) -> DataFrame:
    """A local declared again in the same scope and the same method. A params list also declares the first strings of
    nested arrays that begin its items, a private list all its strings. external: (file, name) of locals that others declare."""
    method = F.sum((F.col("type").isin("ident", "keyword") & (F.col("v") == "method")).cast("int")).over(Window.partitionBy("file").orderBy("s"))
    keys = p.sig.withColumn("method", method).where("type = 'keyword' and v in ('private','params')").select("file", "s", F.col("v").alias("word"), "line", "col", "method")
    keys = structure.enclosed(p.sig, ["lbrace"], of=keys).select("file", F.col("s").alias("key"), "word", "line", "col", "method", (F.col("s") + 1).alias("array"), F.col("parent").alias("scope"))
    lone = p.sig.where("type = 'local'").select("file", (F.col("s") - 1).alias("key"), "s", F.col("v").alias("name"), "value").join(keys.drop("array"), ["file", "key"])
    strings = p.sig.where("type = 'string' and startswith(value, '_')").select("file", "s", F.col("v").alias("name"), "value", "p1t")
    within = lambda roots: structure.enclosed(p.sig, ["lbracket"], roots, strings).withColumnRenamed("parent", "array").drop("parent_close")
    arrays = p.sig.where("type = 'lbracket'")
    in_private = within(arrays.where("p1t = 'keyword' and p1v = 'private'")).join(keys.where("word = 'private'"), ["file", "array"]).drop("p1t")
    # an array that begins an item hands its own items on; so the innermost other one is what a string belongs to
    in_params = within(arrays.where("not coalesce(p1t in ('lbracket','comma'), false)")).where("p1t in ('lbracket','comma')").join(keys.where("word = 'params'"), ["file", "array"]).drop("p1t")
    every = lone.unionByName(in_private.drop("array")).unionByName(in_params.drop("array"))
    if external is not None:
        every = every.join(external.select("file", "name"), ["file", "name"], "left_anti")
    w = Window.partitionBy("file", "scope", "name").orderBy("key", "s")
    again = every.withColumns({"_r": F.row_number().over(w), "_method": F.first("method").over(w)}).where("_r > 1 and method = _method")
    return found(again, "W215", F.concat(F.lit("local declaration shadows or duplicates "), "value"), seq="key")


def namespace_operations(p: Project) -> DataFrame:
    bad = p.sig.where("type in ('ident','keyword') and v in ('getvariable','setvariable') and not coalesce(n1t in ('string','lbracket','local','ident','keyword','lparen'), false)").where(F.col("p1v").isin(*NAMESPACES))
    before = p.sig.select("file", (F.col("s") + 1).alias("s"), F.col("value").alias("space"))
    return found(bad.join(before, ["file", "s"]), "W218", F.concat("space", F.lit(" "), "v", F.lit(" expects a name or [name, value] array")))


def _arguments(p: Project, names: list[str]) -> DataFrame:
    """Uses of commands with the number of items of the array behind them (null: no array) and their first two items."""
    used = p.sig.where(F.col("type").isin("ident", "keyword") & F.col("v").isin(*names))
    parts = structure.items(p.sig).groupBy("file", (F.col("s") - 1).alias("s")).agg(F.max("size").alias("size"), *(F.max(F.when(F.col("item") == k, F.struct("type", "v", "line", "col"))).alias(f"a{k}") for k in range(3)))
    return used.join(parts, ["file", "s"], "left")


def event_handlers(p: Project) -> DataFrame:
    adds = _arguments(p, ["addeventhandler", "addmissioneventhandler", "addmpeventhandler"])
    short = found(adds.where("size is null or size < 2"), "W219", F.concat("value", F.lit(" expects an event name and handler")))
    shape = "a0.type in ('string','ident','keyword','local','lparen') and a1.type in ('lbrace','string','ident','keyword','local')"
    odd = found(adds.where(f"size >= 2 and not coalesce({shape}, false)"), "W219", F.concat("value", F.lit(" has an invalid event-handler declaration")))
    removes = _arguments(p, ["removeeventhandler", "removemissioneventhandler", "removempeventhandler"])
    bare = found(removes.where("size is null or size < 2"), "W219", F.concat("value", F.lit(" expects an event name and handler id")))
    event = F.when(F.col("a0.type") == "string", F.col("a0.v")).otherwise("<unknown>")
    target = F.coalesce("p1v", F.lit("<unknown>"))
    made = adds.where("size >= 2").select("file", F.col("s").alias("made"), target.alias("target"), event.alias("event"))
    gone = removes.where("size >= 2 and a1.type = 'number'").select("file", "s", "value", "line", "col", target.alias("target"), event.alias("event"))
    lone = gone.alias("g").join(made.alias("m"), (F.col("g.file") == F.col("m.file")) & (F.col("g.target") == F.col("m.target")) & (F.col("g.event") == F.col("m.event")) & (F.col("m.made") < F.col("g.s")), "left_anti")
    never = found(lone, "W219", F.concat("value", F.lit(" removes an event handler that was not registered in this file")))
    return short.union(odd).union(bare).union(never)


def remote_calls(p: Project) -> DataFrame:
    used = _arguments(p, ["remoteexec", "remoteexeccall"])
    shape = found(used.where("size is null or size not in (1, 2, 3)"), "W220", F.concat("value", F.lit(" expects [function, targets, jip]")))
    jip = used.where("size = 3 and a2.type = 'number'").withColumns({"_l": F.col("a2.line"), "_c": F.col("a2.col")})
    return shape.union(found(jip, "W220", F.concat("value", F.lit(" JIP argument must be Boolean")), "_l", "_c"))


def public_variables(p: Project) -> DataFrame:
    bad = p.sig.where("type in ('ident','keyword') and v in ('publicvariable','publicvariableserver','publicvariableclient') and not coalesce(n1t in ('string','local','ident','lparen'), false)")
    return found(bad, "W221", F.concat("value", F.lit(" expects the name of a public variable as a String")))


def _assignments(p: Project) -> DataFrame:
    """Tokens of locals with what happens to them, in epochs that braces and conditional directives begin."""
    edge = F.expr("type in ('lbrace','rbrace') or (type = 'preprocessor' and rlike(lower(value), '^(if|ifdef|ifndef|elif|else|endif)\\\\b'))")
    w = Window.partitionBy("file").orderBy("i")
    epochs = p.tokens.withColumn("epoch", F.sum(edge.cast("int")).over(w)).select("file", "off", "epoch")
    ends = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    sig = p.sig.withColumn("_end", F.min(F.when(F.col("type") == "semicolon", F.col("s"))).over(ends)).join(epochs, ["file", "off"])
    return sig.where("type = 'local'").withColumns({"assigns": F.coalesce(F.col("n1v") == "=", F.lit(False)), "declares": F.coalesce(F.col("p1v") == "private", F.lit(False))})


def overwritten_values(p: Project) -> DataFrame:
    """An assignment whose value the next assignment in the same epoch replaces unread."""
    w = Window.partitionBy("file", "v", "epoch").orderBy("s")
    uses = _assignments(p).withColumns({"_a": F.lag("assigns").over(w), "_d": F.lag("declares").over(w), "_next": F.lead("s").over(w)})
    own = F.coalesce(F.col("_next") < F.coalesce("_end", F.lit(1 << 30)), F.lit(False))
    bad = uses.where("assigns and not declares and _a and not _d and not coalesce(n2t = 'lbrace', false)").where(~own)
    return found(bad, "W222", F.concat(F.lit("value assigned to "), "value", F.lit(" is overwritten before it is read")))


def repeated_constants(p: Project) -> DataFrame:
    w = Window.partitionBy("file", "v", "epoch").orderBy("s")
    made = _assignments(p).where("assigns and n2t in ('number','string')").withColumn("_before", F.lag("n2value").over(w))
    return found(made.where("_before = n2value"), "W223", F.concat(F.lit("repeated constant assignment to "), "value"))


def empty_selects(p: Project) -> DataFrame:
    return found(p.sig.where("type = 'lbracket' and n1t = 'rbracket' and n2v = 'select'"), "W224", "selecting from an empty array is ineffective")


def unsaved_handles(p: Project) -> DataFrame:
    """A global variable that is given a handle the engine can't save."""
    ui = p.sig.where("v = 'with' and n1v = 'uinamespace' and n2v = 'do' and n3t = 'lbrace'").select("file", (F.col("s") + 3).alias("s"))
    inside = structure.bracket_pairs(p.sig).join(ui, ["file", "s"]).select("file", F.col("s").alias("_o"), F.col("close").alias("_c"))
    made = p.sig.where("type in ('ident','keyword') and n1v = '='").where(F.col("n2v").isin(*HANDLES))
    free = made.alias("m").join(inside.alias("u"), (F.col("m.file") == F.col("u.file")) & F.col("m.s").between(F.col("u._o"), F.col("u._c")), "left_anti")
    globals_ = found(free, "W232", F.concat(F.lit("namespace variable "), "value", F.lit(" stores a non-serializable runtime handle")))
    stored = _arguments(p, ["setvariable"]).where("size >= 2").where(F.col("p1v").isin(*SAVED) & F.col("a1.v").isin(*HANDLES))
    before = p.sig.select("file", (F.col("s") + 1).alias("s"), F.col("value").alias("space"))
    stored = stored.join(before, ["file", "s"]).withColumns({"_l": F.col("a1.line"), "_k": F.col("a1.col")})
    return globals_.union(found(stored, "W232", F.concat("space", F.lit(" variable stores a non-serializable runtime handle")), "_l", "_k"))


def conditional_balance(p: Project) -> DataFrame:
    """Directives that go on or end a conditional where none is open, and conditionals that nothing ends."""
    word = F.regexp_extract(F.lower("value"), "^(if|ifdef|ifndef|elif|else|endif)\\b", 1)
    d = p.tokens.where("type = 'preprocessor'").withColumn("word", word).where("word <> ''")
    w = Window.partitionBy("file").orderBy("i")
    step = F.when(F.col("word").isin("if", "ifdef", "ifndef"), 1).when(F.col("word") == "endif", -1).otherwise(0)
    run = F.sum(step).over(w)
    d = d.withColumns({"_step": step, "_run": run})
    floor = F.least(F.lit(0), F.min("_run").over(w))
    before = F.least(F.lit(0), F.min("_run").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumns({"_floor": floor, "_before": F.coalesce(before, F.lit(0))})
    open_before = F.col("_run") - F.col("_step") - F.col("_before")
    stray = d.where("word in ('elif','else','endif')").where(open_before <= 0)
    lost = found(stray, "W227", F.concat(F.lit("#"), "word", F.lit(" without a matching conditional")), seq="i")
    # an opener is closed by the first later point at which the open count falls below its own
    level = F.col("_run") - F.col("_floor")
    after = Window.partitionBy("file").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    levels = d.withColumn("_level", level)
    least = levels.withColumn("_least", F.min("_level").over(after))
    open_ = least.where("word in ('if','ifdef','ifndef')").where(F.coalesce(F.col("_least") >= F.col("_level"), F.lit(True)))
    return lost.union(found(open_.withColumn("_one", F.lit(1)), "W227", "conditional directive is not closed with #endif", col="_one", seq="i"))


def params_shapes(p: Project) -> DataFrame:
    """Shapes that params can't take. Files that define macros are left alone: a macro may change the shape."""
    macros = p.tokens.where("type = 'preprocessor' and rlike(lower(value), '^define\\b')").select("file").distinct()
    heads = p.sig.where("type in ('ident','keyword') and v = 'params'").join(macros, "file", "left_anti")
    bare = found(heads.where("not coalesce(n1t in ('lbracket','local','ident'), false)"), "W217", "params expects an array of parameter declarations")
    parts = structure.items(p.sig)
    lists = parts.join(heads.select("file", (F.col("s") + 1).alias("s"), F.col("line").alias("_l"), F.col("col").alias("_c")), ["file", "s"])
    named = found(lists.where("type = 'string' and value <> '' and not startswith(value, '_')"), "W217", "params names must be local variables")
    kinds = found(lists.where("type not in ('string','lbracket')"), "W217", "params declarations must be variable names or [name, default] arrays")
    nested = lists.where("type = 'lbracket'").select("file", F.col("line").alias("l"), F.col("col").alias("c"))
    opens = p.sig.where("type = 'lbracket'").select("file", "s", F.col("line").alias("l"), F.col("col").alias("c"))
    inner = nested.join(opens, ["file", "l", "c"]).join(parts.select("file", "s", "item", "size", "type", "value", "line", "col"), ["file", "s"], "left")
    by = inner.groupBy("file", "s", "l", "c").agg(F.max("size").alias("size"), F.max(F.when(F.col("item") == 0, F.struct("type", "value"))).alias("a"), F.max(F.when(F.col("item") == 2, F.struct("type", "line", "col"))).alias("v"))
    lone = found(by.where("not coalesce(a.type = 'string' and startswith(a.value, '_'), false) and not coalesce(a.type = 'lbracket', false)"), "W217", "params declaration must start with a local variable name", "l", "c")
    long = found(by.where("size > 4"), "W217", "params declaration has too many fields", "l", "c")
    odd = by.where("size in (3, 4) and not coalesce(v.type = 'lbracket', false)").withColumns({"_l": F.coalesce("v.line", "l"), "_c": F.coalesce("v.col", "c")})
    return bare.union(named).union(kinds).union(lone).union(long).union(found(odd, "W217", "params validators must be an array", "_l", "_c"))


def argument_counts(p: Project, signatures: DataFrame) -> DataFrame:
    """Calls of known functions with an array of more items than they take. signatures: name (lower case), most."""
    calls = p.sig.where("type = 'keyword' and v in ('call','spawn') and n1t = 'ident' and p1t = 'rbracket'").select("file", (F.col("s") - 1).alias("close"), "n1v", "n1value", "n1line", "n1col")
    sizes = structure.items(p.sig).groupBy("file", "close").agg(F.max("size").alias("size"))
    both = calls.join(sizes, ["file", "close"]).join(signatures.select(F.col("name").alias("n1v"), "most"), "n1v")
    return found(both.where("size > most").withColumn("s", F.col("close")), "W204", F.concat("n1value", F.lit(" received "), F.col("size").cast("string"), F.lit(" argument(s), signature has "), F.col("most").cast("string")), "n1line", "n1col")


def nested_selects(p: Project) -> DataFrame:
    """(parameter select index) select n with n over 0: the inner element may be too short."""
    names = _local_declarations(p).join(p.sig.where("v = 'params'").select("file", F.col("s").alias("key")), ["file", "key"], "left_semi").select("file", F.col("name").alias("first")).distinct()
    sig = p.sig
    outer = sig.where("type = 'keyword' and v = 'select' and n1t = 'number' and p1t = 'rparen' and coalesce(try_cast(n1v as double), 0) >= 1").select("file", (F.col("s") - 1).alias("close"), "line", "col", "s")
    spans = structure.bracket_pairs(sig).withColumnRenamed("s", "open").join(outer.drop("s"), ["file", "close"])
    first = sig.where("type = 'local' and p1t = 'lparen'").select("file", (F.col("s") - 1).alias("open"), F.col("v").alias("first"))
    inner = sig.where("type = 'keyword' and v = 'select' and not coalesce(n1t in ('number','lbrace'), true)").select("file", F.col("s").alias("at"))
    hit = spans.join(first, ["file", "open"]).join(names, ["file", "first"], "left_semi").join(inner, "file").where("at > open + 1 and at < close")
    return found(hit.withColumn("s", F.col("close") + 1).distinct(), "W233", "dynamic nested select on a parameter may index an empty or short array element; guard its length")


def trailing_blanks(p: Project) -> DataFrame:
    lines = p.sources.select("file", F.posexplode(lines_of(F.col("text"))).alias("n", "text")).where("rlike(text, '[ \\t]$')")
    at = lines.select("file", (F.col("n") + 1).alias("line"), (F.length(without_trailing_blanks(F.col("text"))) + 1).alias("col"), F.col("n").alias("s"))
    return found(at, "W301", F.concat(F.lit("trailing whitespace at character "), F.col("col").cast("string")))


def tabs(p: Project) -> DataFrame:
    lines = p.sources.select("file", F.posexplode(lines_of(F.col("text"))).alias("n", "text")).where(F.contains("text", F.lit("\t")))
    at = lines.select("file", (F.col("n") + 1).alias("line"), F.locate("\t", F.col("text")).alias("col"), F.col("n").alias("s"))
    return found(at, "W302", F.concat(F.lit("tab character in source indentation at character "), F.col("col").cast("string")))


#: Rules in the order of their passes.
RULES: list[Callable[[Project], DataFrame]] = [
    conditional_balance, postfix_commands, missing_then, bad_else, reversed_loops, missing_commas, unended_blocks, trailing_commas, brackets, unterminated_strings,
    constant_conditions, duplicate_definitions, overwritten_definitions, unused_locals, shadowed_locals, unknown_calls, value_calls, unknown_commands,
    params_shapes, nested_selects, namespace_operations, event_handlers, remote_calls, public_variables, unsaved_handles, overwritten_values, repeated_constants, empty_selects, trailing_blanks, tabs,
]


def run(p: Project, rules: Iterable[Callable[[Project], DataFrame]] = RULES) -> DataFrame:
    """All findings of the rules with severity and pass_no. The sources are lexed once, into the shared folder."""
    p, out = Project(p.sources, p.registry, True), None
    for number, rule in enumerate(rules):
        part = rule(p).withColumn("pass_no", F.lit(number))
        out = part if out is None else out.unionByName(part)
    severity = F.create_map(*[F.lit(x) for code, (level, _) in CATALOG.items() for x in (code, level)])
    return out.withColumn("severity", severity[F.col("code")]).select("file", "line", "column", "severity", "code", "message", "pass_no", "seq")
