"""Functions that class-based configs declare, from tokens alone.

A class of `CfgFunctions` is a tag; below it, a class with a property that makes it a function is
`<tag>_fnc_<class>`, unless it holds classes of its own: then the property counts for all of those. A
class without the property takes it from its base among its siblings, over any number of steps. Files
without the wrapper may hold fragments, classes with a `tag` of their own.

Everything around a token is found by windows over brackets, bases by the closure of their graph; no
file is gathered. Files without classes, empty and null texts give nothing; classes that stay open
and classes without a body aren't classes here; repeated files repeat nothing, as names are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import includes, structure
from .rules import Project

# Properties that make a class a function; the wrapper's name; what stands between tag and name.
FUNCTION_PROPERTIES = ["file", "scriptname", "preinit", "postinit", "prestart", "poststart"]
WRAPPER, JOINT = "cfgfunctions", "_fnc_"
REFERENCE = "^[a-z0-9_]+$"


def expand_class_macros(sources: DataFrame) -> DataFrame:
    """Texts in which uses of one-parameter macros that make classes are replaced by what they make."""
    define = r"(?m)^\s*#\s*define\s+([A-Za-z_]\w*)\s*\(\s*([A-Za-z_]\w*)\s*\)\s+([^\r\n]+)$"
    part = lambda k: F.regexp_extract_all("text", F.lit(define), k)
    defs = F.filter(F.arrays_zip(part(1).alias("name"), part(2).alias("par"), part(3).alias("body")), lambda d: F.contains(F.lower(d["body"]), F.lit("class")))

    def replaced(text: Column, d: Column) -> Column:
        plain = F.regexp_replace(d["body"], r"([\\$])", r"\\$1")
        return F.regexp_replace(text, F.concat(F.lit(r"\b"), d["name"], F.lit(r"\s*\(\s*([A-Za-z_]\w*)\s*\)")), F.replace(plain, d["par"], F.lit("$1")))

    return sources.withColumn("text", F.aggregate(defs, F.col("text"), replaced))


def classes(p: Project) -> DataFrame:
    """(file, s, close, name, base, parent): config classes by their opening braces; parent is the class around, null at the top."""
    sig = p.sig
    plain = sig.where("type = 'lbrace' and p1t in ('ident','keyword') and p2t = 'ident' and p2v = 'class'").select("file", "s", F.col("p1v").alias("name"), F.lit("").alias("base"))
    w = Window.partitionBy("file").orderBy("s")
    before = sig.withColumns({"_c": F.lag("type", 4).over(w), "_cv": F.lag("v", 4).over(w), "_n": F.lag("type", 3).over(w), "_nv": F.lag("v", 3).over(w)})
    derived = before.where("type = 'lbrace' and p1t = 'ident' and p2t = 'operator' and p2v = ':' and _n in ('ident','keyword') and _c = 'ident' and _cv = 'class'")
    heads = plain.unionByName(derived.select("file", "s", F.col("_nv").alias("name"), F.col("p1v").alias("base")))
    around = structure.enclosed(sig, ["lbrace"], heads).select("file", "s", "parent")
    return heads.join(structure.bracket_pairs(sig.where("type in ('lbrace','rbrace')")), ["file", "s"]).join(around, ["file", "s"])


def _properties(p: Project, cls: DataFrame, names: list[str]) -> DataFrame:
    """(file, class, name, type, value, at) of the properties of the given names right within classes."""
    inside = structure.enclosed(p.sig, ["lbrace"], cls)
    return inside.where(F.col("v").isin(names) & (F.col("type") == "ident") & (F.col("n1t") == "operator") & (F.col("n1v") == "=") & F.col("parent").isNotNull()).select("file", F.col("parent").alias("class"), F.col("v").alias("name"), F.col("n2t").alias("type"), F.col("n2value").alias("value"), F.col("s").alias("at"))


def inherited(cls: DataFrame, marked: DataFrame) -> DataFrame:
    """(file, s) of the classes that are marked, or whose base among their siblings is, over any number of steps. Of siblings of one name the last is the base."""
    node = F.struct("file", F.col("s"))
    sides = cls.select("file", "parent", F.col("name").alias("base"), "s").groupBy("file", "parent", "base").agg(F.max("s").alias("to"))
    steps = cls.where("base <> ''").alias("c").join(sides.alias("b"), (F.col("c.file") == F.col("b.file")) & F.col("c.parent").eqNullSafe(F.col("b.parent")) & (F.col("c.base") == F.col("b.base")))
    edges = steps.select(F.struct(F.col("c.file").alias("file"), F.col("c.s").alias("s")).alias("src"), F.struct(F.col("c.file").alias("file"), F.col("b.to").alias("s")).alias("dst"))
    own = marked.select(node.alias("dst"))
    over = includes.closure(edges).join(own, "dst", "left_semi").select("src")
    return own.select(F.col("dst").alias("src")).union(over).distinct().select("src.file", "src.s")


def _under(cls: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, s, root): the classes strictly within roots (file, s, close), which don't lie within each other."""
    w = Window.partitionBy("file").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    marks = cls.select("file", "s", "close").join(roots.select("file", "s", F.struct(F.col("s").alias("s"), F.col("close").alias("close")).alias("_r")), ["file", "s"], "left")
    return marks.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_last.close > s and _r is null").select("file", "s", F.col("_last.s").alias("root"))


def functions(p: Project) -> DataFrame:
    """(file, kind, name): the tags and functions that configs declare, in lower case."""
    p = Project(expand_class_macros(p.sources), p.registry, True)
    cls = kept(classes(p), "classes")
    props = kept(_properties(p, cls, [*FUNCTION_PROPERTIES, "tag"]), "properties")
    wrappers = cls.where(F.col("name") == WRAPPER)
    outer = wrappers.join(_under(cls, wrappers), ["file", "s"], "left_anti")
    wrapped = cls.alias("c").join(outer.select("file", F.col("s").alias("parent")).alias("w"), ["file", "parent"]).select("file", "s", "close", F.col("name").alias("tag"))
    tag = props.where("name = 'tag' and type = 'string'").groupBy("file", F.col("class").alias("s")).agg(F.min_by("value", "at").alias("tag"))
    loose = cls.join(wrappers.select("file").distinct(), "file", "left_anti").join(tag.where("tag <> ''"), ["file", "s"]).select("file", "s", "close", F.lower("tag").alias("tag"))
    fragments = loose.join(_nested(loose), ["file", "s"], "left_anti")
    roots = kept(wrapped.unionByName(fragments), "roots")

    direct = props.where("name <> 'tag'").select("file", F.col("class").alias("s")).distinct()
    below = kept(cls.join(_under(cls, roots), ["file", "s"]).join(roots.select("file", F.col("s").alias("root"), "tag"), ["file", "root"]), "below")
    makers = inherited(below.select("file", "s", "name", "base", "parent"), direct.join(below.select("file", "s"), ["file", "s"], "left_semi"))
    parents = cls.select("file", F.col("parent").alias("s")).where("s is not null").distinct().withColumn("_holds", F.lit(True))
    marked = below.join(kept(makers, "makers").withColumn("_makes", F.lit(True)), ["file", "s"], "left").join(parents, ["file", "s"], "left")
    covered = _nested(marked.where("_makes").select("file", "s", "close"), marked.select("file", "s")).withColumn("_in", F.lit(True))
    named = marked.join(covered, ["file", "s"], "left").where("_in or (_makes and _holds is null)")
    found = named.select("file", F.lit("function").alias("kind"), F.concat("tag", F.lit(JOINT), "name").alias("name"))
    return found.unionByName(roots.select("file", F.lit("tag").alias("kind"), F.col("tag").alias("name"))).distinct()


def _nested(spans: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(file, s) of the places (spans themselves without it) strictly within a span (file, s, close)."""
    w = Window.partitionBy("file").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    at = spans.select("file", "s", "close") if places is None else places.select("file", "s").join(spans.select("file", "s", "close"), ["file", "s"], "left")
    return at.withColumn("_end", F.max("close").over(w)).where("_end > s").select("file", "s")


def references(p: Project) -> DataFrame:
    """(file, name) of functions that configs name in a `function` property, wherever it is."""
    cls = classes(p)
    rows = _properties(p, cls, ["function"]).where("type = 'string'").select("file", F.lower(F.trim("value")).alias("name"))
    return rows.where(F.col("name").rlike(REFERENCE)).distinct()
