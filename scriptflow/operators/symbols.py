"""The symbol index: names that a corpus defines, as rows (kind, name) in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


EVENT_COMMANDS = ["addeventhandler", "addmissioneventhandler", "addstackedeventhandler", "bis_fnc_addstackedeventhandler"]
COMPILERS = ["compile", "compilefinal"]
NAME = "^[A-Za-z_][A-Za-z0-9_]*$"


def defined_functions(sig: DataFrame) -> DataFrame:
    """Names that are assigned code, and callbacks that are assigned callbacks."""
    made = sig.where("type = 'ident' and n1t = 'operator' and n1v = '='")
    code = (F.col("n2t") == "lbrace") | F.col("n2v").isin(*COMPILERS)
    callback = F.col("n2t").isin("ident", "local") & F.contains("v", F.lit("callback")) & F.contains("n2v", F.lit("callback"))
    return made.where(code | callback).select("file", "v")


def keyed_functions(sig: DataFrame) -> DataFrame:
    """String keys of namespace variables and event handlers whose arguments hold code before the first closing bracket."""
    later = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    compiler = F.col("v").isin(*COMPILERS)
    t = sig.withColumns({"_end": F.min(F.when(F.col("type") == "rbracket", F.col("s"))).over(later), "_brace": F.min(F.when(F.col("type") == "lbrace", F.col("s"))).over(later), "_compiled": F.min(F.when(compiler, F.col("s"))).over(later)})
    heads = t.where("type = 'ident' and n1t = 'lbracket' and n2t = 'string'").where(F.col("v").isin("setvariable", *EVENT_COMMANDS))
    hit = heads.where("_brace < _end or (v = 'setvariable' and _compiled < _end)")
    return hit.where(F.col("n2v").rlike(NAME)).select("file", F.col("n2v").alias("v")).distinct()


def table_functions(sig: DataFrame) -> DataFrame:
    """Keys of tables of (name, path of a script) in files that both compile and set variables."""
    flags = sig.groupBy("file").agg(F.max((F.col("v") == "setvariable").cast("int")).alias("a"), F.max(F.col("v").isin(*COMPILERS).cast("int")).alias("b")).where("a = 1 and b = 1")
    rows = sig.where("type = 'string' and n1t = 'comma' and n2t = 'string'").where(F.col("v").rlike(NAME) & (F.contains("n2v", F.lit("\\")) | F.contains("n2v", F.lit(".sqf"))))
    return rows.join(flags, "file", "left_semi").select("file", "v")


def macros(tokens: DataFrame) -> DataFrame:
    return tokens.where("type = 'preprocessor'").select("file", F.lower(F.regexp_extract("value", r"(?i)^define\s+([A-Za-z_][A-Za-z0-9_]*)", 1)).alias("v")).where("v <> ''")


def index(tokens: DataFrame, sig: DataFrame) -> DataFrame:
    """(kind, name): functions, tags (what stands before _fnc_ in them) and macros of a corpus, each once."""
    functions = defined_functions(sig).unionByName(keyed_functions(sig)).unionByName(table_functions(sig)).select(F.col("v").alias("name")).distinct()
    tags = functions.where(F.contains("name", F.lit("_fnc_"))).select(F.split_part("name", F.lit("_fnc_"), F.lit(1)).alias("name"))
    rows = functions.select(F.lit("function").alias("kind"), "name").unionByName(tags.select(F.lit("tag").alias("kind"), "name")).unionByName(macros(tokens).select(F.lit("macro").alias("kind"), F.col("v").alias("name")))
    return rows.distinct()


def core_aliases(functions: DataFrame) -> DataFrame:
    """Adds TAG_fnc_x for every TAG_core_fnc_x."""
    return functions.union(functions.select(F.regexp_replace("name", "_core_fnc_", "_fnc_").alias("name"))).distinct()


def external_locals(sources: DataFrame) -> DataFrame:
    """Locals that a file declares before it compiles and calls another one: (file, name)."""
    call = r"(?i)call\s+compile\s+preprocessFileLineNumbers"
    rows = sources.where(F.col("text").rlike(call)).select("file", F.regexp_substr("text", F.lit(r"(?is)^.*" + call[4:])).alias("head"))
    names = rows.select("file", F.explode(F.regexp_extract_all("head", F.lit(r"(?i)private\s+(_[A-Za-z0-9_]*)"), 1)).alias("name"))
    listed = rows.select("file", F.explode(F.regexp_extract_all("head", F.lit(r"(?i)private\s*(\[[^\]]*\])"), 1)).alias("l")).select("file", F.explode(F.regexp_extract_all("l", F.lit('"(_[A-Za-z0-9_]*)"'), 1)).alias("name"))
    return names.union(listed).select("file", F.lower("name").alias("name")).distinct()


