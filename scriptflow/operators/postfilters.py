"""Findings that the text around them shows to be wrong, and what leads up to them: kinds of files, protected apostrophes, origins of includes.

Each filter joins findings with the lines or files they are about, by key. Null texts count as empty; findings
beyond the last line, or in files that aren't there, meet an empty line. Repeated findings are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of
from .diagnostics import HEADER_EXTENSIONS

_MARK = "\x01"
#: Strings of a line, open ones too; the mark may stand between the two quotes that mean one.
_STRINGS = f"\"[^\"]*+(?:\"{_MARK}?\"[^\"]*+)*+\"?|'[^']*+(?:'{_MARK}?'[^']*+)*+'?"


def kind_of(file: Column, roots: list[str] = (), named: list[str] = ()) -> Column:
    """What a file is linted as: sqf, config, mission or null. A mission counts if it was named itself or lies right in a root."""
    low = F.lower(F.replace(file, F.lit("\\"), F.lit("/")))
    chosen = [n.replace("\\", "/").lower() for n in named]
    folders = [r.replace("\\", "/").lower().rstrip("/") for r in roots]
    top = low.isin(chosen) | F.regexp_replace(low, "/?[^/]*$", "").isin(folders)
    return F.when(low.endswith(".sqf"), "sqf").when(low.endswith(".hpp") | low.endswith(".ext"), "config").when(low.endswith(".sqm") & top, "mission")


def protect_apostrophes(sources: DataFrame) -> DataFrame:
    """Texts of configs and headers in which apostrophes on lines that also hold double quotes are typographic ones."""
    header = F.lower(F.regexp_extract("file", r"\.([^./\\]+)$", 1)).isin(HEADER_EXTENSIONS)
    line = lambda t: F.when(F.contains(t, F.lit('"')), F.replace(t, F.lit("'"), F.lit("’"))).otherwise(t)
    return sources.withColumn("text", F.when(header, F.array_join(F.transform(F.split("text", "\n"), line), "\n")).otherwise(F.col("text")))


def inside_quotes(text: Column, column: Column) -> Column:
    """Whether a column (from 1) of a line lies within a string that begins before it; doubled quotes are part of a string."""
    marked = F.concat(F.substring(text, F.lit(1), F.greatest(column - 1, F.lit(0))), F.lit(_MARK), F.substring(text, F.greatest(column, F.lit(1)), F.length(text)))
    return F.exists(F.regexp_extract_all(marked, F.lit(_STRINGS), 0), lambda s: F.contains(s, F.lit(_MARK)))


def _lines(sources: DataFrame) -> DataFrame:
    rows = sources.select("file", F.posexplode(lines_of(F.col("text"))).alias("n", "_line"))
    deep = F.sum((F.length("_line") - F.length(F.replace("_line", F.lit("/*"), F.lit("")))) / 2 - (F.length("_line") - F.length(F.replace("_line", F.lit("*/"), F.lit("")))) / 2).over(Window.partitionBy("file").orderBy("n"))
    return rows.select("file", (F.col("n") + 1).alias("line"), "_line", deep.alias("_deep"))


def _with_lines(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings with their line and how many more block comments begin than end up to it. Only lines with findings are joined."""
    wanted = d.select("file", "line").distinct()
    return d.join(_lines(sources).join(wanted, ["file", "line"], "left_semi"), ["file", "line"], "left")


def drop_quoted_names(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Without W202 within a string of its line, and without findings about a name that its line only has as a quoted one."""
    at = _with_lines(d, sources).withColumn("_text", F.coalesce("_line", F.lit("")))
    name = F.regexp_extract("message", r"unknown command/function:\s*([^\s(]+)", 1)
    plain = F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1")
    quoted = F.expr("rlike(_text, concat('[\"\\']', _plain, '[\"\\']'))")
    first = F.expr("regexp_instr(_text, concat('\\\\b', _plain, '\\\\b'))")
    at = at.withColumns({"_name": name, "_plain": plain}).withColumns({"_quoted": quoted, "_first": first})
    within = F.when(F.col("code") == "W202", inside_quotes(F.col("_text"), F.col("column"))).otherwise(F.lit(False))
    named = (F.col("code").isin("W202", "W203")) & (F.col("_name") != "") & (F.col("_quoted") | ((F.col("_first") > 0) & inside_quotes(F.col("_text"), F.col("_first"))))
    return at.where(~(within | named)).select(*d.columns)


def drop_config_prose(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Without W202 in a description.ext on lines with a quoted text and an apostrophe, or on an eighth line that is missing."""
    at = _with_lines(d, sources).withColumn("_text", F.coalesce("_line", F.lit("")))
    prose = (F.length("_text") - F.length(F.replace("_text", F.lit('"'), F.lit(""))) >= 2) & F.contains("_text", F.lit("'"))
    gone = (F.col("code") == "W202") & F.lower("file").endswith("description.ext") & (prose | ((F.col("_text") == "") & (F.col("line") == 8)))
    return at.where(~gone).select(*d.columns)


def drop_commented(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Without W203 on lines up to which more block comments begin than end."""
    at = _with_lines(d, sources)
    return at.where(~((F.col("code") == "W203") & (F.coalesce("_deep", F.lit(0)) > 0))).select(*d.columns)


def drop_macro_frameworks(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Without E001 and E006 in files written with the macros of an old class framework; elsewhere, in files whose RETURN
    macro is or may be empty, without E006 on lines that return."""
    text = F.coalesce("text", F.lit(""))
    legacy = text.rlike(r'(?i)#\s*include\s+"oop\.h"') & text.rlike(r"\bCLASS\s*\(") & text.rlike(r"\bPUBLIC\s+FUNCTION\s*\(")
    empty = text.rlike(r"(?im)#\s*define\s+RETURN\s*(?:\\\s*)?$") | text.rlike(r'(?i)#\s*include\s+"common\.hpp"')
    flags = sources.select("file", legacy.alias("_legacy"), empty.alias("_empty")).where("_legacy or _empty")
    at = _with_lines(d, sources).join(flags, "file", "left")
    gone = (F.col("_legacy") & F.col("code").isin("E001", "E006")) | (~F.col("_legacy") & F.col("_empty") & (F.col("code") == "E006") & F.col("_line").rlike(r"\bRETURN\b|\breturn\b"))
    return at.where(~F.coalesce(gone, F.lit(False))).select(*d.columns)


def drop_unfounded(d: DataFrame, sources: DataFrame) -> DataFrame:
    """All of these filters, in their order."""
    for keep in (drop_quoted_names, drop_config_prose, drop_commented, drop_macro_frameworks):
        d = keep(d, sources)
    return d


def with_origins(d: DataFrame, edges: DataFrame, root: Column) -> DataFrame:
    """Adds related, the places that include a finding's file where that isn't the root itself. edges: src, line, dst."""
    place = F.struct("line", F.col("src").alias("file"), F.concat(F.lit("included from "), F.substring_index("src", "/", -1)).alias("message"))
    origins = edges.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set(place)).alias("_o"))
    related = F.transform("_o", lambda o: F.struct(o["file"].alias("file"), o["line"].cast("int").alias("line"), F.lit(1).alias("column"), o["message"].alias("message")))
    none = F.array().cast("array<struct<file:string,line:int,column:int,message:string>>")
    return d.join(origins, "file", "left").withColumn("related", F.when(F.col("file") != root, F.coalesce(related, none)).otherwise(none)).drop("_o")
