"""Addons as tables: listings, function names by file-name conventions, patches, owners, signatures, command metadata.

Files of addons are rows (file, text); paths may use either slash. An addon is a folder or archive
right below a folder `addons`. All of it is expressions and joins on keys; prefixes are
joined by exploding a name's own prefixes, of which there are few. Null and empty texts have no names;
repeated files give their names once; ties go to the smaller path in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import cfg_functions, lexer, structure, symbols
from .cfg_functions import JOINT
from .config_rules import mission_addons
from .rules import Project

# Archive endings, headers that name a prefix in order of preference, header endings.
ARCHIVES = r"(?i)\.(pbo|ebo)$"
PREFIX_FILES = ["script_mod.hpp", "script_component.hpp"]
HEADERS = r"(?i)\.(h|hpp|inc|cpp)$"
_PREFIX = r"(?m)^\s*#\s*define\s+PREFIX\s+([A-Za-z_][A-Za-z0-9_]*)"
# Types by the names that metadata uses, types that mean nothing, and words of the grammar that are no commands.
TYPES = {
    "NUMBER": "Number", "BOOLEAN": "Boolean", "STRING": "String", "OBJECT": "Object", "OBJECT_RTD": "Object", "EDEN_ENTITY": "Object", "STRUCTURED_TEXT": "Structured Text", "CONFIG": "Config",
    "HASHMAP": "HashMap", "NAMESPACE": "Namespace", "GROUP": "Group", "CONTROL": "Control", "DISPLAY": "Display", "LOCATION": "Location", "TASK": "Task", "SCRIPT_HANDLE": "Script", "CODE": "Code",
} | dict.fromkeys(["ARRAY", "VECTOR_3D", "POSITION", "POSITION_2D", "POSITION_3D", "POSITION_RELATIVE", "POSITION_AGL", "POSITION_ASL", "POSITION_ATL", "POSITION_ASLW", "POSITION_WORLD", "COLOR", "COLOR_RGB", "ARRAY_OF_EDEN_ENTITIES"], "Array")
NO_TYPES = ["NOTHING", "VOID"]
SLICES = 64  # tasks at most that share the files of one last part
#: Metadata of one command.
METADATA = "name string, version string, game string, deprecated boolean, uncertain boolean, syntaxes array<struct<params:array<struct<name:string,type:string,optional:boolean,order:int>>,returns:array<string>>>"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def tag_of(addon: Column) -> Column:
    """An addon's tag: its name without the archive's ending."""
    return F.regexp_replace(base_name(addon), ARCHIVES, "")


def list_addons(files: DataFrame) -> DataFrame:
    """(mod, kind, addon): archives in a folder `addons` (pbo) and folders there that hold a config.cpp (dir), of a listing (file)."""
    path = slashed(F.col("file"))
    inner = files.select(F.regexp_extract(path, "(?i)^(.*?)/?addons/[^/]+", 1).alias("mod"), F.regexp_extract(path, "(?i)^((?:.*?/)?addons/[^/]+)", 1).alias("addon"), F.regexp_extract(path, "(?i)^(?:.*?/)?addons/[^/]+/(.*)$", 1).alias("rest")).where("addon <> ''")
    packed = inner.where((F.col("rest") == "") & F.col("addon").rlike(ARCHIVES)).select("mod", F.lit("pbo").alias("kind"), "addon")
    loose = inner.where("lower(rest) = 'config.cpp'").select("mod", F.lit("dir").alias("kind"), "addon")
    return packed.unionByName(loose).distinct()


def prefixes(files: DataFrame) -> DataFrame:
    """(addon, prefix) that an addon's macro headers define; files: addon, file, text."""
    rank = F.array_position(F.array(*[F.lit(n) for n in PREFIX_FILES]), F.lower(base_name(F.col("file"))))
    found = files.select("addon", "file", rank.alias("rank"), F.regexp_extract("text", _PREFIX, 1).alias("prefix")).where("rank > 0 and prefix <> ''")
    return found.groupBy("addon").agg(F.min_by("prefix", F.struct("rank", F.lower("file"))).alias("prefix"))


def named_functions(files: DataFrame) -> DataFrame:
    """(addon, file, name) of functions that file names declare: fnc_x under the addon's tag, fn_x under its prefix, that
    of another addon of the mod, or the tag; *_main also under the tag, and functions_f under BIS. files: mod, addon, file, text."""
    own = prefixes(files)
    shared = files.select("mod", "addon").distinct().join(own, "addon").groupBy("mod").agg(F.min_by("prefix", F.lower("addon")).alias("shared"))
    name = base_name(F.col("file"))
    rows = files.where(name.rlike(r"(?i)^(fnc|fn)_.*\.sqf$")).select("mod", "addon", "file", F.lower(F.regexp_extract(name, r"(?i)^(fnc|fn)_", 1)).alias("how"), F.regexp_replace(name, r"(?i)^(fnc|fn)_|\.sqf$", "").alias("what"), tag_of(F.col("addon")).alias("tag"))
    rows = rows.join(own, "addon", "left").join(shared, "mod", "left")
    of_prefix = F.array(F.coalesce("prefix", "shared", "tag"), F.when(F.lower("tag").endswith("_main"), F.col("tag")), F.when(F.lower("tag") == "functions_f", "BIS"))
    tags = F.when(F.col("how") == "fnc", F.array("tag")).otherwise(F.array_compact(of_prefix))
    return rows.select("addon", "file", "what", F.explode(tags).alias("t")).select("addon", "file", F.lower(F.concat("t", F.lit(JOINT), "what")).alias("name")).distinct()


def patches(files: DataFrame) -> DataFrame:
    """(addon, name) of the patch classes in an addon's headers; `class ADDON` is the macros' PREFIX_COMPONENT. files: addon, file, text."""
    heads = files.where(F.col("file").rlike(HEADERS)).select("addon", "file", "text")
    macro = r"(?m)^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z_][A-Za-z0-9_]*)"
    pairs = heads.select("addon", "file", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(macro), 1).alias("k"), F.regexp_extract_all("text", F.lit(macro), 2).alias("v"))).alias("n", "m"))
    last = pairs.groupBy("addon").agg(*(F.max_by(F.when(F.lower("m.k") == k, F.col("m.v")), F.when(F.lower("m.k") == k, F.struct("file", "n"))).alias(k) for k in ("prefix", "component")))
    body = F.regexp_extract("text", r"(?is)\bclass\s+CfgPatches\s*\{(.*?)\n?\s*\};", 1)
    blocks = heads.where(F.col("text").rlike(r"(?is)\bclass\s+CfgPatches\s*\{.*?\n?\s*\};")).groupBy("addon").agg(F.min_by(body, "file").alias("body"))
    names = blocks.select("addon", F.explode(F.regexp_extract_all("body", F.lit(r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^\{]+)?\{"), 1)).alias("c"))
    whole = F.when((F.lower("c") == "addon") & F.col("prefix").isNotNull() & F.col("component").isNotNull(), F.concat("prefix", F.lit("_"), "component")).otherwise(F.col("c"))
    return names.join(last, "addon", "left").select("addon", F.lower(whole).alias("name")).distinct()


def library_folders(text: DataFrame) -> DataFrame:
    """(path) of the libraries that a launcher's VDF texts list, under path or, as old ones have it, under a number; escapes are undone."""
    pair = r'"(?:path|\d+)"\s+"((?:[^"\\]|\\.)*)"'
    found = text.select(F.explode(F.regexp_extract_all("text", F.lit(pair), 1)).alias("p"))
    return found.select(F.regexp_replace("p", r'\\(["\\])', "$1").alias("path")).where(F.col("path").rlike(r"[/\\]")).distinct()


def required_addons(sources: DataFrame) -> DataFrame:
    """(name) of the addons that any mission file of a corpus, however deep, lists."""
    return mission_addons(sources.where(F.lower("file").endswith(".sqm"))).select(F.lower("addon").alias("name")).distinct()


def extract(files: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """What unpacked addons declare, from one reading of their files (mod, addon, file, text): functions (addon, name), signatures
    (name, pos, types), macros (name) and patches (addon, name)."""
    low = F.lower("file")
    configs = Project(files.where(low.endswith("config.cpp") | low.endswith(".hpp")).select("file", "text"), registry, True)
    of = files.select("addon", "file").distinct()
    named = kept(named_functions(files), "named")
    declared = cfg_functions.functions(configs).where("kind = 'function'").join(of, "file").select("addon", "name")
    scripts = Project(files.where(low.endswith(".sqf")).select("file", "text"), registry, True)
    signatures = parameter_types(scripts).join(named.select("file", "name"), "file").select("name", "pos", "types")
    macros = symbols.macros(lexer.tokens(files.where(F.col("file").rlike(HEADERS)).select("file", "text"))).select(F.col("v").alias("name")).distinct()
    return {"functions": named.select("addon", "name").union(declared).distinct(), "signatures": signatures.dropDuplicates(["name", "pos"]), "macros": macros, "patches": patches(files)}


def update(files: DataFrame, registry: DataFrame, folder: str) -> DataFrame:
    """Writes what addons declare as caches below a folder, with names and their core aliases, and returns (what, n) of what is there. A cache is replaced as a whole."""
    found = extract(files, registry)
    names = symbols.core_aliases(found["functions"].select("name"))
    for what, rows in {**found, "names": names}.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{what}")
    spark = files.sparkSession
    out = None
    for what in [*found, "names"]:
        part = spark.read.parquet(f"{folder}/{what}").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.union(part)
    return out


def stems(name: Column, joint: str = "_") -> Column:
    """A name and all that stands before one of its joints, longest last."""
    parts = F.split(name, joint)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), joint))


def owners(names: DataFrame, sources: DataFrame, joint: str = "_") -> DataFrame:
    """(name, owner): the source of a stem that is the name or, else, its longest beginning before a joint. names: name; sources: stem, owner."""
    own = names.select("name").distinct().select("name", F.explode(stems(F.lower("name"), joint)).alias("stem"))
    listed = sources.select(F.lower("stem").alias("stem"), "owner")
    return own.join(listed, "stem").groupBy("name").agg(F.max_by("owner", F.struct(F.length("stem"), F.lower("owner"))).alias("owner"))


def select_roots(required: DataFrame, archives: DataFrame, base: DataFrame) -> DataFrame:
    """(root): base roots, and for each required addon the root with its archive or one whose name begins it, also without
    a leading a3_; the smallest if there are several. required: name; archives: root, file; base: root."""
    low = F.lower("name")
    wanted = required.select(low.alias("n"), F.explode(F.array_distinct(F.array(low, F.regexp_replace(low, "^a3_", "")))).alias("v")).select("n", F.explode(stems(F.col("v"))).alias("stem"))
    held = archives.where(F.col("file").rlike(ARCHIVES)).select("root", F.lower(tag_of(F.col("file"))).alias("stem")).distinct()
    found = wanted.join(held, "stem").groupBy("n").agg(F.min_by("root", F.lower("root")).alias("root"))
    return base.select("root").union(found.select("root")).distinct()


def matching_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file): source files of functions with a declared path: the path's end, or its last part alone. declared: name, path; files: file."""
    last = lambda c: F.lower(base_name(F.col(c)))
    names = declared.select("name", last("path").alias("b")).distinct()
    held = files.select("file").distinct().select("file", last("file").alias("b"), F.pmod(F.xxhash64("file"), F.lit(SLICES)).alias("slice"))
    # a common last part is dealt out in slices of its files, and its names go to those slices that there are: never more rows than pairs
    dealt = names.join(held.select("b", "slice").distinct(), "b")
    return dealt.join(held, ["b", "slice"]).select("name", "file")  # a file has one last part, so each pair comes once


def resolve_mods(wanted: DataFrame, folders: DataFrame, archives: DataFrame) -> DataFrame:
    """(id, path): a mod by the id that ends its folder, else by an addon of that name: the first path in order of lower case.
    wanted: id, name; folders: path; archives: mod, file."""
    by_id = folders.select("path", base_name(F.col("path")).alias("id"))
    by_addon = archives.select(F.col("mod").alias("path"), F.lower(tag_of(F.col("file"))).alias("n"))
    # one path for each id and each addon before wanted rows meet them, so that no row meets all mods that hold its addon
    of_id = wanted.join(_first_path(by_id, "id"), "id").select("id", F.lit(0).alias("rank"), "path")
    of_addon = wanted.select("id", F.lower("name").alias("n")).join(_first_path(by_addon, "n"), "n").select("id", F.lit(1).alias("rank"), "path")
    return _first_path(of_id.unionByName(of_addon), "id", "rank")


def _first_path(paths: DataFrame, key: str, *before: str) -> DataFrame:
    """(key, path): each key's first path in order of the columns before, then of lower case; equal ones by their own letters, nulls last."""
    path = F.col("path")
    first = F.min(F.struct(*before, path.isNull().alias("none"), F.lower(path).alias("low"), "path"))
    return paths.groupBy(key).agg(first.alias("f")).select(key, "f.path")


def literal_type(kind: Column, v: Column) -> Column:
    """The static type of a lone literal; null for others."""
    return F.when(kind == "number", "Number").when(kind == "string", "String").when((kind == "keyword") & v.isin("true", "false"), "Boolean").when(kind == "lbracket", "Array").when(kind == "lbrace", "Code").when(v == "objnull", "Object").when(v == "grpnull", "Group").when(v == "confignull", "Config").when(v == "controlnull", "Control").when(v == "displaynull", "Display").when(v == "locationnull", "Location").when(v == "scriptnull", "Script").when(v == "tasknull", "Task").when(v.isin("west", "east", "resistance", "independent", "civilian", "sideunknown"), "Side")


def parameter_types(p: Project) -> DataFrame:
    """(file, pos, types): for each position of a file's first params list the types its validator lists, null without one; types that
    `param [index, default, [examples]]` lists are merged behind them."""
    sig, parts = p.sig, structure.items(p.sig)
    arrays = parts.select("file", F.col("s").alias("array"), "item", "type", F.col("at").alias("at"), "n", F.when(F.col("n") == 1, literal_type(F.col("type"), F.col("v"))).alias("t"))
    listed = arrays.where("t is not null").groupBy("file", "array").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("item", "t"))), lambda x: x["t"])).alias("types"))
    params = sig.where("type = 'keyword' and v = 'params' and n1t = 'lbracket'").groupBy("file").agg((F.min("s") + 1).alias("array"))
    slots = arrays.join(params, ["file", "array"]).select("file", F.col("item").alias("pos"), F.when(F.col("type") == "lbracket", F.col("at")).alias("array"))
    third = arrays.where("item = 2 and type = 'lbracket'").select("file", "array", F.col("at").alias("types_at"))
    of = listed.select("file", F.col("array").alias("types_at"), "types")
    given = slots.join(third, ["file", "array"], "left").join(of, ["file", "types_at"], "left").select("file", "pos", "types", F.lit(-1).alias("s"))
    single = sig.where("type in ('keyword','ident') and v = 'param' and n1t = 'lbracket' and n2t = 'number'").select("file", (F.col("s") + 1).alias("array"), "s", F.expr("cast(try_cast(n2v as double) as int)").alias("pos")).where("pos between 0 and 255")
    merged = given.unionByName(single.join(third, ["file", "array"]).join(of, ["file", "types_at"]).select("file", "pos", "types", "s"))
    each = merged.groupBy("file", "pos").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("types").isNotNull(), F.struct("s", "types")))), lambda x: x["types"]))).alias("types"))
    known = each.select("file", "pos", F.when(F.size("types") > 0, F.col("types")).alias("types"))
    most = known.groupBy("file").agg(F.max("pos").alias("m"))  # positions in between are unconstrained
    every = most.select("file", F.explode(F.sequence(F.lit(0), "m")).alias("pos"))
    return every.join(known, ["file", "pos"], "left")


def read_metadata(texts: DataFrame) -> DataFrame:
    """Metadata of commands from their XML documents (text), one a row; documents that aren't XML give a row of nulls."""
    param = "array<struct<_name:string,_type:string,_optional:string,_order:int>>"
    value = "array<struct<_type:string,`alt-types`:struct<t:array<struct<_type:string>>>>>"
    shape = f"_name string, _version string, _game string, deprecated string, uncertain string, syntax array<struct<param:{param},return:struct<value:{value}>>>"
    x = texts.select(F.from_xml("text", shape).alias("x"), "text").select("x.*", "text")

    def types(values: Column) -> Column:
        own = F.transform(values, lambda v: F.concat(F.array(v["_type"]), F.coalesce(F.transform(v["alt-types"]["t"], lambda t: t["_type"]), F.array().cast("array<string>"))))
        return F.array_distinct(F.transform(F.array_compact(F.flatten(own)), F.upper))

    def params(found: Column) -> Column:
        one = lambda q: F.struct(F.coalesce(q["_name"], F.lit("")).alias("name"), F.upper(F.coalesce(q["_type"], F.lit("ANYTHING"))).alias("type"), F.coalesce(F.lower(q["_optional"]) == "t", F.lit(False)).alias("optional"), F.coalesce(q["_order"], F.lit(0)).alias("order"))
        return F.coalesce(F.transform(found, one), F.array().cast("array<struct<name:string,type:string,optional:boolean,order:int>>"))

    syntaxes = F.transform("syntax", lambda s: F.struct(params(s["param"]).alias("params"), F.coalesce(types(s["return"]["value"]), F.array().cast("array<string>")).alias("returns")))
    return x.select(F.col("_name").alias("name"), F.col("_version").alias("version"), F.col("_game").alias("game"), F.col("text").rlike(r"<deprecated\b").alias("deprecated"), F.col("text").rlike(r"<uncertain\b").alias("uncertain"), syntaxes.alias("syntaxes"))


def signatures(metadata: DataFrame, keywords: list[str]) -> DataFrame:
    """(name, arity, operand, label, returns): what metadata says for sure. A command whose forms all have one arity and only known types
    has the types of its right operand; returns is the one known type that all its forms give back, if there is one."""
    low = metadata.select(F.lower("name").alias("name"), "syntaxes").where(~F.col("name").isin(keywords))
    forms = low.select("name", F.posexplode("syntaxes").alias("k", "s"))
    orders = F.transform("s.params", lambda q: q["order"])
    n = F.size("s.params")
    form = F.when(n == 0, 0).when((n == 1) & (F.element_at(orders, 1) == 1), 1).when((n >= 2) & F.array_contains(orders, 0) & F.array_contains(orders, 1), 2)
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    by_order = F.transform(F.array_sort(F.transform("s.params", lambda q: F.struct(q["order"].alias("order"), q["type"].alias("type")))), lambda q: F.coalesce(table[q["type"]], F.lit("?")))
    rows = forms.select("name", form.alias("form"), by_order.alias("types"), "s.returns")
    of = rows.where("form is not null").groupBy("name").agg(F.collect_set("form").alias("forms"), F.collect_list("types").alias("all"), F.max(F.exists("types", lambda t: t == "?")).alias("unknown"), F.max(F.size("types")).alias("most"))
    sure = of.where("size(forms) = 1 and not unknown").select("name", F.col("forms")[0].alias("arity"), "all").where("arity in (1, 2)").where(F.expr("forall(all, t -> size(t) = arity)"))
    operand = F.array_sort(F.array_distinct(F.transform("all", lambda t: F.element_at(t, F.col("arity")))))
    given = rows.select("name", F.explode_outer("returns").alias("r")).where(~F.upper("r").isin(NO_TYPES)).groupBy("name").agg(F.collect_set(table[F.upper("r")]).alias("r")).where("size(r) = 1").select("name", F.col("r")[0].alias("returns"))
    typed = sure.select("name", "arity", operand.alias("operand")).withColumn("label", F.array_join("operand", " or "))
    return low.select("name").distinct().join(typed, "name", "left").join(given, "name", "left").where("arity is not null or returns is not null")


def tree_commands(text: DataFrame) -> DataFrame:
    """(name) of the XML documents in listings of a repository tree (JSON texts)."""
    tree = F.from_json("text", "struct<tree:array<struct<path:string,type:string>>>")["tree"]
    blobs = text.select(F.explode(tree).alias("e")).where("e.type = 'blob' and endswith(e.path, '.xml')")
    return blobs.select(F.regexp_replace(F.substring_index("e.path", "/", -1), r"\.xml$", "").alias("name")).distinct()


def listed_names(text: DataFrame, beginning: str = "") -> DataFrame:
    """(name): the trimmed lines of reference lists that are no comments and begin as given, in any case."""
    lines = text.select(F.explode(F.split("text", "\r\n|\r|\n")).alias("l")).select(F.trim("l", F.lit(" \t")).alias("name"))
    return lines.where((F.col("name") != "") & ~F.col("name").startswith("#") & F.lower("name").startswith(beginning)).distinct()


def keyed_names(text: DataFrame, beginning: str) -> DataFrame:
    """(name): the keys of JSON objects that begin as given."""
    return text.select(F.explode(F.expr("json_object_keys(text)")).alias("name")).where(F.col("name").startswith(beginning)).distinct()


def registry_text(names: DataFrame, kind: str, header: list[str]) -> DataFrame:
    """(value): the lines of a registry file: header, count, and the valid names in lower case and order. Written with one text file a partition."""
    valid = names.select(F.lower(F.trim("name")).alias("value")).where(F.col("value").rlike("^[a-z_][a-z0-9_]*$")).distinct()
    spark = names.sparkSession
    top = spark.range(1).select(F.posexplode(F.array(*[F.lit(f"# {h}".rstrip()) for h in header])).alias("n", "value")).select(F.lit(0).alias("part"), "n", "value")
    count = valid.agg(F.count("*").alias("c")).select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.concat(F.lit(f"# {kind}: "), F.col("c").cast("string")).alias("value"))
    body = valid.select(F.lit(2).alias("part"), F.lit(0).alias("n"), "value")
    return top.union(count).union(body).orderBy("part", "n", "value").select("value")


def reuse_counts(diff: DataFrame, new: DataFrame) -> DataFrame:
    """(root, reused, rescanned): files of each root that a new snapshot leaves as they were, and those it doesn't. new: root, file; diff: file, change."""
    changed = diff.where("change <> 'deleted'").select("file", F.lit(1).alias("c"))
    return new.join(changed, "file", "left").groupBy("root").agg(F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).alias("reused"), F.coalesce(F.sum("c"), F.lit(0)).alias("rescanned"))


def ordered(files: DataFrame) -> DataFrame:
    """A listing in the order of its paths in lower case, ties by the path as written."""
    return files.orderBy(F.lower("file"), "file")


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order that is total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
