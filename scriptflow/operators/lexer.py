"""The lexer: one exhaustive pattern, exploded, with offsets from running sums.

Every character of a text belongs to exactly one lexeme, so offsets, lines and columns follow
from lengths alone. All windows share one partitioning by file and one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keywords of the language, in lower case.
KEYWORDS = """
    true false nil private params if then else for while waituntil do switch case default foreach
    from to step and or not exitwith throw try catch call spawn execvm compile select breakout
    breakto continue format
""".split()

#: Branches in the order in which they are tried. Groups that repeat are possessive: the engine must not recurse on long strings.
LEXEME = (
    r"(?md)(^[ \t\r]*#[^\r\n]*"
    r"""|"[^"]*+(?:""[^"]*+)*+"?|'[^']*+(?:''[^']*+)*+'?"""
    r"|//[^\n]*|/\*[^*]*+(?:\*++[^*/][^*]*+)*+(?:\*++/|\**+\z)"
    r"|0[xX][0-9A-Fa-f]*|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|&&|\|\||\+\+|--|=>|[ \t\r]+|\n|[^\n])"
)
BRACKETS = {"(": "lparen", ")": "rparen", "[": "lbracket", "]": "rbracket", "{": "lbrace", "}": "rbrace", ";": "semicolon", ",": "comma"}
VALUE_TYPES = ["number", "ident", "local", "string", "keyword", "rparen", "rbracket", "rbrace"]
TRIVIA = ["comment", "preprocessor"]


def token_type(raw: Column, col: Column) -> Column:
    """The type of a lexeme that begins at a column; null for blanks. A directive's lexeme begins its line."""
    first = F.substring(raw, 1, 1)
    out = F.when(raw.rlike(r"^[ \t\r\n]*$"), F.lit(None).cast("string"))
    out = out.when((col == 1) & raw.rlike(r"^[ \t\r]*#"), "preprocessor")
    out = out.when(raw.startswith("//") | raw.startswith("/*"), "comment")
    out = out.when(first.isin('"', "'"), "string").when(raw.rlike(r"^\.?[0-9]"), "number").when(first == "_", "local")
    out = out.when(raw.rlike("^[A-Za-z]"), F.when(F.lower(raw).isin(*KEYWORDS), "keyword").otherwise("ident"))
    for mark, name in BRACKETS.items():
        out = out.when(raw == mark, name)
    return out.otherwise("operator")


def lexemes(sources: DataFrame) -> DataFrame:
    """(file, n, raw, off, line, col) of every lexeme of (file, text), blanks included. Texts are dealt out by file before
    they are cut, so that all windows by file find their lexemes where they are."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = sources.select("file", "text").repartition(n, "file").select("file", F.posexplode(F.regexp_extract_all("text", F.lit(LEXEME), 1)).alias("n", "raw"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size, breaks = F.length("raw"), F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    placed = parts.withColumn("off", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    last = F.when(breaks > 0, F.col("off") + F.length("raw") - F.locate("\n", F.reverse("raw")) + 1)
    placed = placed.withColumns({"line": (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).cast("int"), "_from": F.coalesce(F.max(last).over(before), F.lit(0))})
    return placed.select("file", "n", "raw", "off", "line", (F.col("off") - F.col("_from") + 1).cast("int").alias("col"))


def brackets(sources: DataFrame) -> DataFrame:
    """(file, s, type, raw, line, col) of the brackets among the lexemes alone, in their order; without lines and columns, so that no other lexeme moves."""
    kinds = {mark: name for mark, name in BRACKETS.items() if name[0] in "lr"}
    parts = sources.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(LEXEME), 1)).alias("s", "raw")).where(F.col("raw").isin(*kinds))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("raw")]
    return parts.select("file", "s", kind.alias("type"), "raw", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))


def tokens(sources: DataFrame) -> DataFrame:
    """Tokens of (file, text): file, i (from 0), type, value, line, col, raw, off.

    A minus joins the number right behind it unless a value precedes it. Strings' values are
    without their quotes, directives' without # and outer blanks.
    """
    typed = lexemes(sources).withColumn("type", token_type(F.col("raw"), F.col("col"))).where("type is not null")
    blanks = F.when(F.col("type") == "preprocessor", F.length("raw") - F.length(F.ltrim("raw", F.lit(" \t\r")))).otherwise(0)
    typed = typed.withColumns({"off": F.col("off") + blanks, "col": F.col("col") + blanks, "raw": F.when(F.col("type") == "preprocessor", F.ltrim("raw", F.lit(" \t\r"))).otherwise(F.col("raw"))})
    w = Window.partitionBy("file").orderBy("off")
    joins = (F.col("raw") == "-") & F.lead("raw").over(w).rlike("^[0-9]") & (F.lead("off").over(w) == F.col("off") + 1) & ~F.coalesce(F.lag("type").over(w).isin(*VALUE_TYPES), F.lit(False))
    typed = typed.withColumn("_sign", F.coalesce(joins, F.lit(False))).withColumn("_signed", F.coalesce(F.lag("_sign").over(w), F.lit(False)) & (F.col("type") == "number"))
    signed = F.col("_signed").cast("int")
    merged = typed.where("not _sign").select("file", "type", F.when(F.col("_signed"), F.concat(F.lit("-"), "raw")).otherwise(F.col("raw")).alias("raw"), (F.col("off") - signed).alias("off"), "line", (F.col("col") - signed).alias("col"))
    quote = F.substring("raw", 1, 1)
    closed = (F.length("raw") > 1) & F.col("raw").endswith(quote)
    inside = F.substring("raw", F.lit(2), F.length("raw") - F.when(closed, 2).otherwise(1))
    value = F.when(F.col("type") == "string", F.replace(inside, F.concat(quote, quote), quote)).when(F.col("type") == "preprocessor", F.trim(F.substring("raw", 2, 1 << 30), F.lit(" \t\r"))).otherwise(F.col("raw"))
    return merged.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("off")) - 1).alias("i"), "type", value.alias("value"), "line", "col", "raw", "off")


def significant(toks: DataFrame, ahead: int = 3, behind: int = 2) -> DataFrame:
    """Tokens that are neither comments nor directives, with s (from 0), v (value in lower case) and
    neighbours: n1t, n1v, n1line, n1col ... and p1t, p1v ..."""
    w = Window.partitionBy("file").orderBy("i")
    kept = toks.where(~F.col("type").isin(*TRIVIA)).withColumns({"v": F.lower("value"), "s": F.row_number().over(w) - 1})
    near = {}
    for k in range(1, ahead + 1):
        near |= {f"n{k}t": F.lead("type", k).over(w), f"n{k}v": F.lead("v", k).over(w), f"n{k}value": F.lead("value", k).over(w), f"n{k}line": F.lead("line", k).over(w), f"n{k}col": F.lead("col", k).over(w)}
    for k in range(1, behind + 1):
        near |= {f"p{k}t": F.lag("type", k).over(w), f"p{k}v": F.lag("v", k).over(w), f"p{k}line": F.lag("line", k).over(w), f"p{k}col": F.lag("col", k).over(w)}
    return kept.withColumns(near)
