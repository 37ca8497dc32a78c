"""Project configurations: found by directory, read tolerantly, validated, and turned into dimensions.

A config is a row (path, dir, value): one JSON text. Values are read as variants of unknown shape, so that
one bad entry costs itself and nothing else; every setting becomes rows keyed by the config's path.
Empty, missing and malformed configs have no settings; a null value counts as missing. Everything
is an expression over the table of configs, so a monorepo's many configs are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import CATALOG
from .files import STATE_DIR, ancestors

# Names of config files in order of preference, accepted keys, keys by shape, presets and levels.
CONFIG_NAMES = ["scriptflow.json", ".scriptflow.json"]
LIST_KEYS = ["dependencies", "requiredAddons", "functionTags", "knownCommands", "known_commands", "ignoreRules", "externalLocals", "externalLocal", "ignore", "ignorePatterns", "presets", "plugins", "preset"]
OBJECT_KEYS = ["functionTypes", "functionReturns", "severity", "ruleSeverity"]
KEYS = [*LIST_KEYS, *OBJECT_KEYS, "mods"]
PRESETS = ["recommended", "strict", "style", "performance"]
LEVELS = ["error", "warning", "info", "off"]
CODE, LOCAL = r"(?i)^[EW]\d{3}$", "^_[A-Za-z0-9_]+$"


def _items(value: Column) -> Column:
    """The items of a JSON list as JSON texts: strings keep their quotes, so that they are told from numbers. A lone string is a list of one."""
    wrapped = F.concat(F.lit('{"v":'), value, F.lit("}"))
    listed = F.from_json(wrapped, "struct<v:array<variant>>")["v"]
    texts = F.transform(listed, lambda x: F.to_json(x))
    return F.when(F.ltrim(value).startswith("["), texts).when(F.ltrim(value).startswith('"'), F.array(value))


def _string(item: Column) -> Column:
    """The string that a JSON text holds; null if it is something else."""
    return F.when(F.ltrim(item).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), item, F.lit("}")), "struct<v:string>")["v"])


def settings(configs: DataFrame) -> DataFrame:
    """(path, key, value): the members of every config that is a JSON object, values as JSON texts; repeated keys keep their last value."""
    parsed = F.expr("try_parse_json(value)")
    rows = configs.select("path", parsed.alias("v")).where("v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    keys = F.expr("json_object_keys(to_json(v))")
    members = rows.select("path", F.explode(keys).alias("key"), F.to_json("v").alias("_all"))
    named = F.from_json("_all", "map<string,variant>")
    return members.select("path", "key", F.to_json(F.element_at(named, F.col("key"))).alias("value"))


def _chosen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(path, value) of the first of the keys that a config has: a map that takes the first setting."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return rows.where(F.col("key").isin(keys)).groupBy("path").agg(F.min_by("value", rank).alias("value"))


def _strings(rows: DataFrame, keys: list[str], lone: bool = True) -> DataFrame:
    """(path, item): the non-blank strings of a list, trimmed; with lone also a single string."""
    chosen = _chosen(rows, keys)
    if not lone:
        chosen = chosen.where("startswith(value, '[')")
    return chosen.select("path", F.explode(_items(F.col("value"))).alias("i")).select("path", F.trim(_string(F.col("i"))).alias("item")).where("item <> ''")


def function_tags(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["functionTags"], lone=False).select("path", F.lower("item").alias("name")).distinct()


def known_commands(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["knownCommands", "known_commands"]).select("path", F.lower("item").alias("name")).distinct()


def external_locals(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["externalLocals", "externalLocal"]).where(F.col("item").rlike(LOCAL)).select("path", F.lower("item").alias("name")).distinct()


def dependencies(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["dependencies", "requiredAddons"]).select("path", F.lower("item").alias("name")).distinct()


def ignored_rules(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["ignoreRules"], lone=False).where(F.col("item").rlike(CODE)).select("path", F.upper("item").alias("code")).distinct()


def ignore_patterns(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["ignore", "ignorePatterns"], lone=False).withColumnRenamed("item", "pattern")


def presets(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["presets", "preset"]).select("path", F.lower("item").alias("preset"))


def plugins(rows: DataFrame) -> DataFrame:
    return _strings(rows, ["plugins"]).withColumnRenamed("item", "plugin")


def _objects(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(path, key, value) of the members of an object setting."""
    chosen = _chosen(rows, keys).where("startswith(value, '{')")
    named = chosen.select("path", F.explode(F.expr("json_object_keys(value)")).alias("key"), F.col("value").alias("_all"))
    return named.select("path", "key", F.to_json(F.element_at(F.from_json("_all", "map<string,variant>"), F.col("key"))).alias("value"))


def severities(rows: DataFrame) -> DataFrame:
    level = F.lower(_string(F.col("value")))
    return _objects(rows, ["severity", "ruleSeverity"]).where(F.trim("key").rlike(CODE) & level.isin(LEVELS)).select("path", F.upper("key").alias("code"), level.alias("level"))


def function_types(rows: DataFrame) -> DataFrame:
    """(path, name, pos, types): argument types by position, of functions whose entries are all type names; A|B is a union."""
    lists = _objects(rows, ["functionTypes"]).where("trim(key) <> '' and startswith(value, '[')").select("path", F.lower(F.trim("key")).alias("name"), _items(F.col("value")).alias("i"))
    typed = lists.select("path", "name", F.transform("i", lambda x: F.trim(_string(x))).alias("t")).where(~F.exists("t", lambda x: x.isNull() | (x == "")))
    return typed.select("path", "name", F.posexplode("t").alias("pos", "type")).select("path", "name", "pos", F.split("type", "[|]").alias("types"))


def function_returns(rows: DataFrame) -> DataFrame:
    given = F.trim(_string(F.col("value")))
    return _objects(rows, ["functionReturns"]).select("path", F.lower(F.trim("key")).alias("name"), given.alias("type")).where("name <> '' and type <> ''")


def mods(rows: DataFrame) -> DataFrame:
    """(path, name, url, workshop_id) of the listed mods: addresses, or objects with an address and perhaps a name."""
    items = rows.where("key = 'mods' and startswith(value, '[')").select("path", F.explode(_items(F.col("value"))).alias("i"))
    entry = F.when(F.col("i").startswith("{"), F.from_json("i", "struct<name:variant,url:variant>"))
    part = lambda name: _string(F.to_json(entry[name]))
    found = items.select("path", part("name").alias("name"), F.trim(F.coalesce(_string(F.col("i")), part("url"))).alias("url")).where("url <> ''")
    return found.withColumn("workshop_id", F.nullif(F.regexp_extract("url", r"[?&]id=(\d+)", 1), F.lit("")))


def validate(configs: DataFrame) -> DataFrame:
    """(path, message) of everything in a config that is not as it should be. A text that is no JSON gives nothing, as it has no settings."""
    rows = settings(configs)
    parsed = configs.select("path", F.expr("try_parse_json(value)").alias("v")).where("v is not null")
    out = parsed.where("not startswith(schema_of_variant(v), 'OBJECT')").select("path", F.lit("configuration root must be a JSON object").alias("message"))

    def add(df: DataFrame, message: Column) -> None:
        nonlocal out
        out = out.unionByName(df.select("path", message.alias("message")))

    add(rows.where(~F.col("key").isin(KEYS)), F.concat(F.lit("unknown configuration key: "), "key"))
    checked = [k for k in LIST_KEYS if k != "preset"]
    add(rows.where(F.col("key").isin(checked) & ~F.substring("value", 1, 1).isin("[", '"')), F.concat("key", F.lit(" must be a string or array")))
    add(rows.where(F.col("key").isin(OBJECT_KEYS) & ~F.col("value").startswith("{")), F.concat("key", F.lit(" must be an object")))
    add(presets(rows).where(~F.col("preset").isin(PRESETS)), F.concat(F.lit("unknown rule preset: "), "preset"))
    ignored = rows.where("key = 'ignoreRules'").select("path", F.explode(_items(F.col("value"))).alias("i"))
    add(ignored.where(~F.coalesce(F.upper(F.trim(_string(F.col("i")))).isin(list(CATALOG)), F.lit(False))), F.concat(F.lit("unknown rule code in ignoreRules: "), F.coalesce(_string(F.col("i")), "i")))
    levels = _objects(rows, ["severity", "ruleSeverity"])
    add(levels.where(~F.upper("key").isin(list(CATALOG))), F.concat(F.lit("unknown rule code in severity: "), "key"))
    add(levels.where(~F.coalesce(_string(F.col("value")).isin(LEVELS), F.lit(False))), F.concat(F.lit("invalid severity for "), "key", F.lit(": "), F.coalesce(_string(F.col("value")), "value")))
    return out


def findings(configs: DataFrame) -> DataFrame:
    """The messages as findings E012 at the start of the config file."""
    return validate(configs).select(F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("error").alias("severity"), F.lit("E012").alias("code"), "message", F.lit(950).alias("pass_no"), F.lit(0).alias("seq"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _nearest(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(file, path): of the candidates (dir, path, priority) the nearest at or above each file's directory."""
    dirs = files.select(_directory(F.col("file")).alias("dir")).distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "at"))
    best = above.join(candidates.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by("path", F.struct("depth", -F.col("priority"))).alias("path"))
    return files.select("file", _directory(F.col("file")).alias("dir")).join(best, "dir", "left").select("file", "path")


def discover(files: DataFrame, names: list[str] = CONFIG_NAMES) -> DataFrame:
    """(file, path): the nearest config file at or above each file, from the listing (file) alone. In one directory the earlier name is taken."""
    name = F.substring_index("file", "/", -1)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return _nearest(files, files.where(name.isin(names)).select(_directory(F.col("file")).alias("dir"), F.col("file").alias("path"), order.alias("priority")))


def discover_cache(files: DataFrame, name: str, state_dir: str = STATE_DIR) -> DataFrame:
    """(file, path): the nearest generated file of a name, in the state folder of a directory before the directory itself."""
    own = files.where(F.substring_index("file", "/", -1) == name).select("file", _directory(F.col("file")).alias("_d"))
    hidden = F.substring_index("_d", "/", -1) == state_dir
    places = own.select(F.when(hidden, _directory(F.col("_d"))).otherwise(F.col("_d")).alias("dir"), F.col("file").alias("path"), F.when(hidden, 0).otherwise(1).alias("priority"))
    return _nearest(files, places)


def first_wins(*maps: DataFrame) -> DataFrame:
    """(key, value): the union of (key, value) tables in which the earliest table's value stays; ties within one go to the smaller value."""
    out = None
    for rank, one in enumerate(maps):
        part = one.select("key", "value", F.lit(rank).alias("_rank"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.min_by("value", F.struct("_rank", "value")).alias("value"))
