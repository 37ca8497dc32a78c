"""Static types of operands and the rules that need them.

What a command takes and gives back is data, a table (name, arity, operand, label, returns) as metadata gives it
(`addons.signatures`); so are the parameter types of functions (name, pos, types) and what they return (name, type).
A value has a type if it is a literal, a command or function with a known result that makes up the whole
assignment, or a local whose latest assignment has one; a local that got values of several types before, or that
the file tests for its type, has none. Nothing is said about values without a type.

All of it is windows over tokens, by file or by file and name, and joins with the tables on names. Files
without tokens give nothing; names are compared in lower case; positions make every order total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import structure
from .addons import literal_type
from .rules import Project, found

# Types that compare with themselves only, comparisons, and commands that make the tokens beside them no operands of a comparison.
PRIMITIVE = ["Number", "String", "Boolean"]
COMPARISONS, ORDERINGS = ["==", "!=", "<", ">", "<=", ">="], ["<", ">", "<=", ">="]
RESULTS = ["count", "find", "findif", "inputaction", "getvariable", "gettext", "getnumber", "gethitpointdamage", "distance", "distance2d", "distancesqr"]
COUNTERS, ACCESSORS = ["findif", "find", "count", "inputaction"], ["gettext", "getnumber"]
#: Tokens within which an assignment or a command counts for a comparison (fixed values).
NEAR, REACH, BEFORE, AFTER, SLOT = 160, 96, 48, 16, 24
_LAST = (Window.unboundedPreceding, -1)


def _whole(p: Project, commands: DataFrame, functions: DataFrame | None) -> DataFrame:
    """(file, s, type): locals that are assigned, at their token, with the type of the value, null if it isn't known."""
    sig = p.sig
    pairs = structure.bracket_pairs(sig).select("file", (F.col("s") - 2).alias("s"), "close")
    made = sig.where("type = 'local' and n1t = 'operator' and n1v = '='").join(pairs, ["file", "s"], "left")
    behind = sig.select("file", (F.col("s") - 1).alias("close"), F.col("type").alias("after"), F.col("v").alias("after_v"), F.col("n1v").alias("target"))
    made = made.join(behind, ["file", "close"], "left")
    ends = lambda t: t.isNull() | t.isin("semicolon", "rbrace")
    lone = F.when(ends(F.col("n3t")) & ~F.col("n2t").isin("lbracket", "lbrace"), literal_type(F.col("n2t"), F.col("n2v")))
    array = F.when(F.col("n2t").isin("lbracket", "lbrace") & F.col("close").isNotNull() & ends(F.col("after")), literal_type(F.col("n2t"), F.col("n2v")))
    gives = commands.where("returns is not null").select(F.col("name").alias("n2v"), "returns").distinct()
    fourth = F.lead("n3t").over(Window.partitionBy("file").orderBy("s"))
    ahead = sig.select("file", "s", fourth.alias("n4t"))
    made = made.join(gives, "n2v", "left").join(ahead, ["file", "s"], "left")
    unary = F.when((F.col("n2t") == "ident") & F.col("n3t").isin("local", "string", "number") & ends(F.col("n4t")), F.col("returns"))
    if functions is not None:
        back = functions.select(F.col("name").alias("target"), F.col("type").alias("given")).distinct()
        made = made.join(back, "target", "left")
        called = F.when(F.col("after_v").isin("call", "spawn"), F.col("given"))
    else:
        called = F.lit(None).cast("string")
    return made.select("file", "s", F.coalesce(lone, array, unary, called).alias("type"))


def latest(rows: DataFrame, by: list[str], order: list[str], value: str, marks: str) -> DataFrame:
    """Adds last (the value of the latest earlier row that marks), of (that row's order) and mixed (several known values were marked before): an as-of join of rows with themselves."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_LAST)
    marked = F.when(F.col(marks), F.struct(F.col(value).alias("v"), F.col(order[-1]).alias("at")))
    known = F.when(F.col(marks), F.col(value))
    out = rows.withColumns({"_l": F.last(marked, ignorenulls=True).over(w), "_a": F.min(known).over(w), "_b": F.max(known).over(w)})
    return out.withColumns({"last": F.col("_l.v"), "of": F.col("_l.at"), "mixed": F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))}).drop("_l", "_a", "_b")


def homogeneous(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, element): the one value that all rows of a key have; null if they differ or one has none."""
    return rows.groupBy(*by).agg(F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")), F.min(value)).alias("element"))


def merged(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, kinds, merged): how many values the rows of a key have, and their union in order, with bars between."""
    each = rows.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("t"))
    return each.select(*by, F.size("t").alias("kinds"), F.array_join("t", "|").alias("merged"))


def typed(p: Project, commands: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Significant tokens with t, the type of the token as an operand, kind (null, or literal where a literal or a literal assignment says so) and of, the latest assignment."""
    sig = p.sig
    given = _whole(p, commands, functions).withColumn("assigns", F.lit(True))
    locals_ = sig.where("type = 'local'").select("file", "s", F.col("v").alias("name"), "n1v").join(given, ["file", "s"], "left")
    tested = sig.where("type = 'local' and n1v in ('isequaltype', 'isequaltypeall')").select("file", F.col("v").alias("name")).distinct().withColumn("tested", F.lit(True))
    known = latest(locals_.withColumn("assigns", F.coalesce("assigns", F.lit(False))), ["file", "name"], ["s"], "type", "assigns").join(tested, ["file", "name"], "left")
    use = known.select("file", "s", F.when((F.col("name") != "_x") & ~F.col("mixed") & F.col("tested").isNull(), F.col("last")).alias("_t"), "of")
    out = sig.join(use, ["file", "s"], "left")
    own = literal_type(F.col("type"), F.col("v"))
    return out.withColumns({"t": F.coalesce(own, "_t"), "literal": own.isNotNull()}).drop("_t")


def _beside(tokens: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("s")
    near = F.struct("t", "literal", "of", "type", "v", "line", "col")
    return tokens.withColumns({"right": F.lead(near).over(w), "left": F.lag(near).over(w), "_select": F.max(F.when(F.col("v") == "select", F.col("s"))).over(Window.partitionBy("file"))})


def operands(p: Project, commands: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Commands whose right operand has a type that they don't take (W203). Files that select behind them are left alone: what is selected has no type."""
    near = _beside(typed(p, commands, functions))
    used = near.where("type = 'ident' and right.t is not null and right.v <> '_x' and coalesce(_select <= s, true)")
    rule = commands.where("arity in (1, 2)").select(F.col("name").alias("v"), "arity", "operand", "label")
    both = used.join(rule, "v")
    odd = ((F.col("v") == "deleteat") & F.col("p1t").isin("local", "ident", "rbracket", "rparen")) | ((F.col("v") == "count") & (F.col("p1t") == "rbrace")) | ((F.col("v") == "configclasses") & F.col("p1t").isin("string", "keyword", "ident", "local"))
    array_form = F.col("v").isin("setmarkeralpha", "setmarkeralphalocal") & (F.col("right.type") == "lbracket")
    bad = both.where(~F.array_contains("operand", F.col("right.t")) & ~F.coalesce((F.col("arity") == 1) & odd, F.lit(False)) & ~array_form)
    bad = bad.withColumns({"_l": F.col("right.line"), "_c": F.col("right.col")})
    return found(bad, "W203", F.concat("value", F.lit(" expects "), "label", F.lit(", got "), "right.t"), "_l", "_c")


def arguments(p: Project, signatures: DataFrame, commands: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Arguments of known functions of a type that their signature doesn't list (W203). signatures: name, pos, types."""
    calls = p.sig.where("type = 'keyword' and v in ('call','spawn') and n1t = 'ident' and p1t = 'rbracket'").select("file", (F.col("s") - 1).alias("close"), F.col("n1v").alias("name"), "n1value")
    lone = structure.items(p.sig).where("n = 1").select("file", "close", F.col("item").alias("pos"), F.col("at").alias("s"))
    args = calls.join(lone, ["file", "close"]).join(signatures.where("types is not null"), ["name", "pos"])
    given = args.join(typed(p, commands, functions).select("file", "s", "t", "line", "col"), ["file", "s"]).where("t is not null")
    bad = given.where(~F.array_contains("types", F.col("t")) & ~F.array_contains("types", "Anything"))
    return found(bad, "W203", F.concat("n1value", F.lit(" argument "), (F.col("pos") + 1).cast("string"), F.lit(" expects "), F.array_join("types", "|"), F.lit(", got "), "t"))


def call_targets(p: Project, commands: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Calls of values that are neither code nor the name of a script (W205), in the words of the type rules."""
    near = _beside(typed(p, commands, functions)).where("type = 'keyword' and v in ('call','spawn') and right.type in ('local','number','keyword')")
    bad = near.where("right.t not in ('Code', 'String')").withColumns({"_l": F.col("right.line"), "_c": F.col("right.col")})
    return found(bad, "W205", F.concat("value", F.lit(" expects Code or String, got "), "right.t"), "_l", "_c")


def comparisons(p: Project, commands: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Comparisons of two primitive values of different types (W216). A local on the left counts if its latest assignment, nearby,
    is a literal. Comparisons of results of commands in the statement, of config paths, type names and selected elements aren't looked at."""
    near = _beside(typed(p, commands, functions))
    w = Window.partitionBy("file").orderBy("s")
    before, after = w.rowsBetween(*_LAST), Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(*_LAST)
    at = lambda cond: F.when(cond, F.col("s"))
    path = (F.col("v") == ">") & F.coalesce(F.col("n1v") == ">", F.lit(False))
    near = near.withColumns({
        "_end": F.max(at(F.col("type") == "semicolon")).over(before), "_result": F.max(at(F.col("v").isin(RESULTS))).over(before), "_slot": F.max(at(F.col("v") == "getslotitemname")).over(before),
        "_next_end": F.min(at(F.col("type") == "semicolon")).over(after), "_accessor": F.min(at(F.col("v").isin(ACCESSORS))).over(after),
        "_config": F.max(at(path | (F.col("v") == "configfile") | F.col("v").isin(ACCESSORS))).over(w.rowsBetween(-BEFORE, AFTER)), "_p2": F.lag("v", 2).over(w),
    })
    made = _whole(p, commands, functions).join(p.sig.select("file", "s", F.col("v").alias("name"), F.col("n2t").alias("k"), F.col("n2v").alias("kv")), ["file", "s"])
    plain = made.select("file", F.col("s").alias("of"), (F.col("k").isin("number", "string") | F.col("kv").isin("true", "false")).alias("plain"), F.when(F.col("k") == "number", "Number").when(F.col("k") == "string", "String").when(F.col("kv").isin("true", "false"), "Boolean").alias("first"))
    counted = _counted(p)
    c = near.where((F.col("type") == "operator") & F.col("v").isin(COMPARISONS) & F.col("left.t").isNotNull() | (F.col("type") == "operator") & F.col("v").isin(COMPARISONS) & (F.col("left.type") == "local"))
    c = c.withColumns({"of": F.col("left.of"), "name": F.col("left.v")}).join(plain, ["file", "of"], "left").join(counted, ["file", "name"], "left")
    is_local = F.col("left.type") == "local"
    left = F.when(is_local, F.when(F.coalesce("plain", F.lit(False)) & (F.col("s") - F.col("of") <= NEAR), F.col("first"))).otherwise(F.col("left.t"))
    none = F.lit(False)
    skip = F.coalesce((F.col("v") == ">") & ((F.col("n1v") == ">") | (F.col("p1v") == ">")), none)
    skip |= F.col("v").isin(ORDERINGS) & F.col("_config").isNotNull()
    skip |= F.coalesce(F.col("_slot") >= F.col("s") - SLOT, none)
    skip |= F.coalesce((F.col("left.type") == "number") & F.col("_p2").isin("select", "#"), none)
    skip |= F.coalesce((F.col("_result") > F.coalesce("_end", F.lit(-1))) & (F.col("s") - F.col("_result") <= REACH + 1), none)
    skip |= F.coalesce((F.col("_accessor") < F.coalesce("_next_end", F.lit(1 << 30))) & (F.col("_accessor") - F.col("s") <= REACH), none)
    skip |= F.coalesce(is_local & (F.col("_p2") == "typename"), none) | F.coalesce(is_local & (F.col("counted") < F.col("s")), none)
    skip |= F.coalesce((F.col("left.v") == "_x") | (F.col("right.v") == "_x"), none)
    bad = c.withColumn("_left", left).where(F.col("_left").isin(PRIMITIVE) & F.col("right.t").isin(PRIMITIVE) & (F.col("_left") != F.col("right.t")) & ~skip)
    return found(bad, "W216", F.concat(F.lit("comparison cannot match "), "_left", F.lit(" with "), "right.t"))


def _counted(p: Project) -> DataFrame:
    """(file, name, counted): the first assignment of a local from a statement that counts or finds."""
    st = structure.statements(p.sig)
    hits = st.where(F.col("v").isin(COUNTERS)).groupBy("file", "stmt").agg(F.max("s").alias("hit"))
    made = st.where("type = 'local' and n1v = '='").select("file", "stmt", "s", F.col("v").alias("name"))
    return made.join(hits, ["file", "stmt"]).where("hit > s").groupBy("file", "name").agg(F.min("s").alias("counted"))
