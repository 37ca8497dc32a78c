"""Rules for class-based configs and for mission files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of
from .rules import Project, found

# Properties whose texts are code.
CODE_FIELDS = """
    onload onunload ondestroy onchilddestroyed oncandestroy onbuttonclick onbuttondblclick onbuttondown onbuttonup onmousebuttondown
    onmousebuttonup onmousebuttonclick onmousebuttondblclick onmousezchanged onmousemoving onmouseholding onkeydown onkeyup onchar
    onimechar onsetfocus onkillfocus ontimer onlbselchanged onlbdblclick onlbdrag onlbdragging onlbdrop ontreeselchanged ontreedblclick
    ontreeexpanded ontreecollapsed ontreemousedown ontreemouseup ontreemousemove ontreemouseholding ontreemouseexit oncheckedchanged
    onchecked onsliderposchanged ontoolboxselchanged onvideostopped onhtmllink ondraw expression statement condition code
""".split()


def _outside_macros(p: Project) -> DataFrame:
    """Significant tokens outside the lines of #define, which go on where a line ends with a backslash."""
    lines = p.sources.select("file", F.posexplode(lines_of(F.col("text"))).alias("n", "text")).withColumn("line", F.col("n") + 1)
    w = Window.partitionBy("file").orderBy("n")
    goes_on = F.rtrim("text").endswith("\\")
    run = F.sum((~F.coalesce(F.lag(goes_on).over(w), F.lit(False))).cast("int")).over(w)
    first = F.first(F.col("text").rlike(r"(?i)^\s*#\s*define")).over(Window.partitionBy("file", "run").orderBy("n"))
    macro = lines.withColumn("run", run).withColumn("macro", first).where("macro").select("file", "line")
    return p.sig.join(macro, ["file", "line"], "left_anti")


def _leveled(p: Project) -> DataFrame:
    """Tokens with level, the number of braces open around them; a closer without an opener doesn't count."""
    w = Window.partitionBy("file").orderBy("s")
    step = F.when(F.col("type") == "lbrace", 1).when(F.col("type") == "rbrace", -1).otherwise(0)
    t = _outside_macros(p).withColumn("_step", step).withColumn("_run", F.sum("_step").over(w))
    t = t.withColumn("_floor", F.least(F.lit(0), F.min("_run").over(w)))
    before = F.coalesce(F.lag("_floor").over(w), F.lit(0))
    return t.withColumns({"level": F.col("_run") - F.col("_floor"), "stray": (F.col("type") == "rbrace") & (F.col("_floor") < before)})


def structure(p: Project) -> DataFrame:
    """Braces that don't balance."""
    t = _leveled(p)
    lost = found(t.where("stray"), "E010", "unmatched '}' in config")
    later = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    opened = t.withColumn("_least", F.min("level").over(later)).where("type = 'lbrace' and coalesce(_least >= level, true)")
    return lost.union(found(opened, "E010", "unclosed '{' in config"))


def repeated_properties(p: Project) -> DataFrame:
    """A property that is set again in the same class, unless the two are in different branches of one conditional."""
    t = _leveled(p)
    opens = F.when(F.col("type") == "lbrace", F.col("s"))
    # the class around a token: the last brace that reached the token's level
    t = t.withColumn("_open", opens).where("type in ('lbrace') or (type = 'ident' and n1t = 'operator' and n1v = '=' and level > 0)")
    t = t.withColumn("class", F.last("_open", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("s")))
    word = F.regexp_extract(F.lower("value"), "^(if|ifdef|ifndef|else|elif|endif)\\b", 1)
    d = p.tokens.where("type = 'preprocessor'").withColumn("word", word).where("word <> ''")
    branch = F.sum(F.lit(1)).over(Window.partitionBy("file").orderBy("line"))
    group = F.sum(F.col("word").startswith("if").cast("int")).over(Window.partitionBy("file").orderBy("line"))
    marks = d.select("file", "line", branch.alias("branch"), group.alias("group"), (F.col("word") != "endif").alias("inside"))
    last = marks.select("file", F.col("line").alias("_m"), "branch", "group", "inside")
    props = t.where("type = 'ident'").select("file", "s", "v", "value", "line", "col", "class")
    placed = props.join(last, (props["file"] == last["file"]) & (F.col("_m") < F.col("line")), "left").groupBy(props["file"], "s", "v", "value", "line", "col", "class").agg(F.max_by(F.struct("branch", "group", "inside"), "_m").alias("b"))
    again = placed.withColumn("_b", F.lag("b").over(Window.partitionBy("file", "class", "v").orderBy("s"))).withColumn("_r", F.row_number().over(Window.partitionBy("file", "class", "v").orderBy("s"))).where("_r > 1")
    other = F.coalesce(F.col("b.inside") & F.col("_b.inside") & (F.col("b.group") == F.col("_b.group")) & (F.col("b.branch") != F.col("_b.branch")), F.lit(False))
    return found(again.where(~other), "W214", F.concat(F.lit("config property defined more than once: "), "value"))


def mission_structure(p: Project) -> DataFrame:
    """A mission file needs a numeric version and a class Mission."""
    w = Window.partitionBy("file").orderBy("i")
    ahead = F.max((F.col("type") == "number").cast("int")).over(w.rowsBetween(1, 4))
    t = p.tokens.withColumns({"_n": F.coalesce(ahead, F.lit(0)), "v": F.lower("value")})
    first = t.where("type = 'ident' and v = 'version'").groupBy("file").agg(F.min(F.struct("i", "line", "col", "_n")).alias("f"))
    has = t.where("type = 'ident' and v = 'mission'").select("file").distinct()
    files = p.sources.select("file").distinct().withColumns({"line": F.lit(1), "col": F.lit(1), "s": F.lit(0)})
    none = found(files.join(first, "file", "left_anti"), "E011", "mission.sqm is missing version")
    odd = found(first.where("f._n = 0").select("file", "f.line", "f.col", F.col("f.i").alias("s")), "E011", "mission.sqm version must be numeric")
    return none.union(odd).union(found(files.join(has, "file", "left_anti"), "E011", "mission.sqm is missing class Mission"))


def mission_addons(sources: DataFrame) -> DataFrame:
    """(file, n, addon) of the addon lists of mission files, in their order, as they are spelled."""
    bodies = sources.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)\baddOns(?:Auto)?\s*(?:\[\s*\])?\s*=\s*\{([^}]*)\}"), 1)).alias("body"))
    names = bodies.groupBy("file").agg(F.flatten(F.collect_list(F.regexp_extract_all("body", F.lit('"([^"]+)"'), 1))).alias("names"))
    return names.select("file", F.posexplode("names").alias("n", "addon"))


def addon_entries(p: Project) -> DataFrame:
    """Addons listed more than once, names that no addon can have, and files that list none."""
    rows = mission_addons(p.sources).withColumns({"line": F.lit(1), "col": F.lit(1), "s": F.col("n"), "key": F.lower("addon")})
    twice = rows.groupBy("file", "key").agg(F.count("*").alias("c"), F.min("s").alias("s")).where("c > 1").withColumns({"line": F.lit(1), "col": F.lit(1)})
    doubles = found(twice, "W212", F.concat(F.lit("duplicate mission addon: "), "key"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("file", "key").orderBy("n"))).where("r = 1")
    odd = found(first.where(~F.col("addon").rlike("^[A-Za-z0-9_]+$")), "W213", F.concat(F.lit("invalid mission addon name: "), "addon"))
    bare = p.sources.select("file").distinct().join(rows, "file", "left_anti").withColumns({"line": F.lit(1), "col": F.lit(1), "s": F.lit(0)})
    return doubles.union(odd).union(found(bare, "W213", "mission.sqm has no addOns[] or addOnsAuto[] entries"))


def embedded_code(p: Project, names: list[str]) -> DataFrame:
    """(file, line, col, code) of config properties that hold code: those of the given names, or whose text looks like code."""
    looks = F.col("n2value").rlike(r"(?i)(;|\bcall\b|\bspawn\b|\bexecVM\b)")
    rows = p.sig.where("type = 'ident' and n1v = '=' and n2t = 'string'").where(F.col("v").isin(*names) | looks)
    at = p.sig.select("file", (F.col("s") - 2).alias("s"), F.col("line").alias("_l"), F.col("col").alias("_c"))
    return rows.join(at, ["file", "s"]).select("file", F.col("_l").alias("line"), (F.col("_c") + 1).alias("col"), F.col("n2value").alias("code"))


def shift_embedded(d: DataFrame, at: DataFrame) -> DataFrame:
    """Moves findings of embedded code to their config: lines by the string's line, columns on its first line only.
    d: file, line, column ...; at: file, base_line, base_col."""
    both = d.join(at, "file")
    return both.withColumns({"column": F.when(F.col("line") == 1, F.col("column") + F.col("base_col") - 1).otherwise(F.col("column")), "line": F.col("line") + F.col("base_line") - 1}).drop("base_line", "base_col")


CONFIG_RULES = [structure, repeated_properties]
MISSION_RULES = [mission_structure, addon_entries]
