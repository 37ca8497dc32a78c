"""Addon archives and binary configs as tables.

Archives are read as binary files and taken apart in Arrow batches: only the wanted entries are
unpacked. Binary configs become rows of classes and properties that refer to their parent.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: packing methods, ring size and start, magic and header size of binary configs.
VERSION_METHOD, PACKED_METHOD = 0x56657273, 0x43707273
RING, START = 4096, 4078
CONFIG_MAGIC, CONFIG_HEADER = b"\x00raP", 16
ENTRY = struct.Struct("<5I")


class Damaged(ValueError):
    """An archive or config that ends early or breaks its format."""


def unpack(data: bytes, size: int) -> bytes:
    """Undoes the archive's compression: groups of eight tokens, literal or (distance, length), behind a byte of flags.

    The ring starts out with blanks, so distances beyond what was written give blanks.
    """
    out = bytearray()
    at = 0
    while len(out) < size:
        if at >= len(data):
            raise Damaged(f"packed data end at {len(out)} of {size} bytes")
        flags, at = data[at] | 0x100, at + 1
        while flags > 1 and len(out) < size:
            if at + (0 if flags & 1 else 1) >= len(data):
                raise Damaged("packed data end within a token")
            if flags & 1:
                out.append(data[at])
                at += 1
            else:
                distance, count = data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 15) + 3
                at += 2
                distance = distance or RING
                for _ in range(min(count, size - len(out))):
                    out.append(out[-distance] if distance <= len(out) else 0x20)
            flags >>= 1
    return bytes(out)


def archive_entries(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, method, size, offset, stored size) of an archive's entries."""
    at, found = 0, []
    while True:
        end = data.find(b"\0", at)
        if end < 0 or end + 1 + ENTRY.size > len(data):
            raise Damaged("the archive's header ends early")
        name, (method, size, _, _, stored) = data[at:end], ENTRY.unpack_from(data, end + 1)
        at = end + 1 + ENTRY.size
        if method == VERSION_METHOD:  # properties: pairs of strings up to an empty one
            while data[at : at + 1] != b"\0":
                for _ in range(2):
                    at = data.find(b"\0", at) + 1
                    if not at:
                        raise Damaged("the archive's properties end early")
            at += 1
        elif not name:
            break
        else:
            found.append((_text(name), method, size, stored))
    out = []
    for name, method, size, stored in found:
        if at + stored > len(data):
            raise Damaged(f"the data of {name} end early")
        out.append((name, method, size, at, stored))
        at += stored
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_archives(files: DataFrame, wanted: str = r"(?i)\.(sqf|hpp|bin|cpp)$") -> DataFrame:
    """(archive, name, content, error) of the entries whose names match, from (path, content) rows. A damaged
    archive gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = re.compile(wanted)
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    for name, method, size, at, stored in archive_entries(data):
                        if keep.search(name):
                            block = bytes(data[at : at + stored])
                            rows.append((path, name, unpack(block, size) if method == PACKED_METHOD else block, None))
                except Damaged as error:
                    rows.append((path, None, None, str(error)))
                yield pd.DataFrame(rows, columns=["archive", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary, error string")


def scan_archives(spark: SparkSession, folder: str, wanted: str = r"(?i)\.(sqf|hpp|bin|cpp)$") -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pbo").load(folder)
    return read_archives(found, wanted)


class _Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise Damaged("the config ends early")
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)[0]

    def string(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Damaged("a string of the config has no end")
        raw, self.at = self.data[self.at : end], end + 1
        return _text(raw)

    def count(self) -> int:
        """Seven bits a byte, the low ones first; a byte below 128 is the last."""
        value = shift = 0
        while shift < 35:
            b = self.take("<B")
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
        raise Damaged("a count of the config is too long")

    def value(self, kind: int):
        plain = {1: "<f", 2: "<i", 6: "<q"}
        if kind in (0, 4):
            return self.string()
        if kind in plain:
            return self.take(plain[kind])
        if kind == 3:
            return [self.value(self.take("<B")) for _ in range(self.count())]
        raise Damaged(f"unknown kind of value {kind}")


def config_rows(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Classes (node, parent, name, base) and properties (node, name, kind, value as JSON) of a binary config.
    What follows a broken entry in a class is left out, the rest stays."""
    if data[:4] != CONFIG_MAGIC or len(data) < CONFIG_HEADER:
        raise Damaged("not a binary config")
    if struct.unpack_from("<I", data, 8)[0] != 8:
        raise Damaged("a binary config of another version")
    classes: list[tuple] = []
    properties: list[tuple] = []
    todo = [(CONFIG_HEADER, None, "")]
    seen = set()
    while todo:
        at, parent, name = todo.pop()
        if at in seen or at >= len(data):
            continue
        seen.add(at)
        node, cursor, inner = len(classes), _Cursor(data, at), []
        base = ""
        try:
            base = cursor.string()
            for _ in range(cursor.count()):
                entry = cursor.take("<B")
                if entry == 0:
                    child = cursor.string()
                    inner.append((cursor.take("<I"), child))
                elif entry == 1:
                    kind = cursor.take("<B")
                    key = cursor.string()
                    properties.append((node, key, kind, json.dumps(cursor.value(kind))))
                elif entry in (2, 5):
                    if entry == 5:
                        cursor.take("<I")
                    key = cursor.string()
                    properties.append((node, key, 3, json.dumps(cursor.value(3))))
                elif entry in (3, 4):
                    cursor.string()
                else:
                    break
        except Damaged:
            pass
        classes.append((node, parent, name, base))
        todo += [(offset, node, child) for offset, child in reversed(inner)]
    return classes, properties


def config_tables(entries: DataFrame) -> DataFrame:
    """Rows of the binary configs in (archive, name, content): archive, file, row (class or property), node,
    parent, key, base, kind, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, name, content in zip(batch["archive"], batch["name"], batch["content"], strict=True):
                try:
                    classes, properties = config_rows(bytes(content))
                except Damaged:
                    continue
                rows += [(archive, name, "class", n, p, k, b, None, None) for n, p, k, b in classes]
                rows += [(archive, name, "property", n, None, k, None, kind, v) for n, k, kind, v in properties]
            yield pd.DataFrame(rows, columns=["archive", "file", "row", "node", "parent", "key", "base", "kind", "value"]).astype({"parent": "Int64", "kind": "Int64"})

    return entries.where("content is not null").select("archive", "name", "content").mapInPandas(run, "archive string, file string, row string, node int, parent int, key string, base string, kind int, value string")


def config_functions(config: DataFrame) -> DataFrame:
    """(archive, name, path) of functions that class trees declare: CfgFunctions, tags, categories, functions."""
    c = config.where("row = 'class'").select("archive", "file", "node", "parent", "key")
    up = lambda d, n: d.select("archive", "file", F.col("node").alias(f"n{n}"), F.col("parent").alias(f"p{n}"), F.col("key").alias(f"k{n}"))
    root = up(c.where("lower(key) = 'cfgfunctions'"), 0)
    tree = root
    for level in (1, 2, 3):
        tree = tree.join(up(c, level).withColumnRenamed(f"p{level}", f"n{level - 1}"), ["archive", "file", f"n{level - 1}"])
    prop = config.where("row = 'property'").select("archive", "file", "node", F.lower("key").alias("key"), F.get_json_object("value", "$").alias("value"))
    one = lambda key, node, name: prop.where(F.col("key") == key).select("archive", "file", F.col("node").alias(node), F.trim(F.col("value"), F.lit('"')).alias(name))
    full = tree.join(one("tag", "n1", "tag"), ["archive", "file", "n1"], "left").join(one("file", "n2", "folder"), ["archive", "file", "n2"], "left").join(one("file", "n3", "own"), ["archive", "file", "n3"], "left")
    name = F.lower(F.concat(F.coalesce("tag", "k1"), F.lit("_fnc_"), "k3"))
    path = F.coalesce("own", F.concat(F.coalesce("folder", F.concat(F.lit("functions\\"), "k2")), F.lit("\\fn_"), "k3", F.lit(".sqf")))
    return full.select("archive", name.alias("name"), path.alias("path")).distinct()
