"""Reports of diagnostics: text, JSON, SARIF, Checkstyle, workflow annotations, the rule catalog."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_annotation, escape_xml
from .diagnostics import fingerprints, fixed_text


def text_lines(d: DataFrame) -> DataFrame:
    place = F.when(F.coalesce("file", F.lit("")) == "", F.format_string("line %d, col %d", "line", "column")).otherwise(F.format_string("%s:%d:%d", "file", "line", "column"))
    return d.select("file", "pass_no", "seq", F.concat(place, F.lit(": "), "severity", F.lit(" ["), "code", F.lit("]: "), "message").alias("report"))


def json_rows(d: DataFrame) -> DataFrame:
    return d.select(F.to_json(F.struct("file", "line", "column", "severity", "code", "message")).alias("report"))


def annotations(d: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    return d.select(F.concat(F.lit("::"), level, F.lit(" file="), escape_annotation(F.col("file"), True), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("column").cast("string"), F.lit(",title="), escape_annotation(F.col("code"), True), F.lit("::"), escape_annotation(F.col("message"))).alias("report"))


def checkstyle(d: DataFrame) -> DataFrame:
    """One element a file, its errors in order of passes."""
    error = F.concat(F.lit('<error line="'), F.col("line").cast("string"), F.lit('" column="'), F.col("column").cast("string"), F.lit('" severity="'), "severity", F.lit('" message="'), escape_xml(F.col("message")), F.lit('" source="'), "code", F.lit('"/>'))
    rows = d.select("file", F.struct("pass_no", "seq", error.alias("x")).alias("e")).groupBy("file").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return rows.select("file", F.concat(F.lit('<file name="'), escape_xml(F.col("file")), F.lit('">'), F.array_join(F.transform("e", lambda e: e["x"]), ""), F.lit("</file>")).alias("report"))


def sarif_results(d: DataFrame) -> DataFrame:
    """Results of a SARIF 2.1.0 run, one JSON object a row."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("column", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(fingerprints(d).alias("primary")).alias("partialFingerprints"))
    return d.select(F.to_json(result).alias("report"))


def catalog_table(catalog: DataFrame) -> DataFrame:
    """Rows of a Markdown table of the rules, in order of codes."""
    return catalog.select("code", F.concat(F.lit("| `"), "code", F.lit("` | "), "severity", F.lit(" | "), "name", F.lit(" | "), F.array_join(F.array_sort("categories"), ", "), F.lit(" |")).alias("report")).orderBy("code")


def _enveloped(rows: DataFrame, head: str, tail: str, order: list[str]) -> DataFrame:
    """(report): the lines of one JSON text: a head, a report a line in order, a tail. The driver sees none of them; the first
    report, which has no comma, is found by the least key."""
    keyed = rows.select(F.struct(*order, "report").alias("k"))
    first = keyed.agg(F.min("k").alias("f"))
    body = keyed.join(F.broadcast(first)).select(F.lit(1).alias("p"), "k", F.when(F.col("k") == F.col("f"), F.col("k.report")).otherwise(F.concat(F.lit(","), "k.report")).alias("report"))
    none = F.lit(None).cast(keyed.schema["k"].dataType)
    ends = rows.sparkSession.range(1).select(F.inline(F.array(F.struct(F.lit(0).alias("p"), none.alias("k"), F.lit(head).alias("report")), F.struct(F.lit(2).alias("p"), none.alias("k"), F.lit(tail).alias("report")))))
    return ends.union(body).orderBy("p", "k").select("report")


def json_array(d: DataFrame) -> DataFrame:
    """The lines of one JSON list of all findings, distinct ones in the order of files and passes. Written as text, its files in order are the list."""
    rows = d.select("file", "pass_no", "seq", "line", "column", F.to_json(F.struct("file", "line", "column", "severity", "code", "message")).alias("report")).distinct()
    return _enveloped(rows, "[", "]", ["file", "pass_no", "seq", "line", "column"])


def _sarif_result(d: DataFrame) -> Column:
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    spot = lambda file, line, column: F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(line, F.lit(1)).alias("startLine"), F.greatest(column, F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation")
    parts = [F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(fingerprints(d).alias("primary")).alias("partialFingerprints"), F.array(F.struct(spot(F.col("file"), F.col("line"), F.col("column")))).alias("locations")]
    if "related" in d.columns:
        one = lambda x, k: F.struct((k + 1).alias("id"), F.struct(F.coalesce(x["message"], F.lit("related source location")).alias("text")).alias("message"), spot(x["file"], x["line"], x["column"]))
        named = F.filter("related", lambda x: x["file"] != "")
        parts.append(F.when(F.size(named) > 0, F.transform(named, one)).alias("relatedLocations"))
    return F.to_json(F.struct(*parts))


def sarif(d: DataFrame, rules: list[dict], tool: str = "scriptflow", version: str = "1") -> DataFrame:
    """The lines of one SARIF 2.1.0 text with the catalog and all distinct findings; with a column related also the related places."""
    driver = json.dumps({"name": tool, "version": version, "rules": rules}, separators=(",", ":"))
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"automationDetails":{"id":"' + tool + '/default"},"tool":{"driver":' + driver + '},"results":['
    rows = d.select("file", "pass_no", "seq", "line", "column", _sarif_result(d).alias("report")).distinct()
    return _enveloped(rows, head, "]}]}", ["file", "pass_no", "seq", "line", "column"])


def _counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def summary(d: DataFrame, linted: DataFrame, of: int | None = None) -> DataFrame:
    """One row (report): how many files were linted (of so many, if it stopped early) and how many findings there are. linted: file."""
    files = linted.agg(F.count_distinct("file").alias("files"))
    told = _counted(F.col("files"), "file") if of is None else F.concat(F.col("files").cast("string"), F.lit(" of "), _counted(F.lit(of), "file"))
    return files.join(d.agg(F.count("*").alias("n"))).select(F.concat(told, F.lit(" linted, "), _counted(F.col("n"), "diagnostic")).alias("report"))


def fixed_sources(sources: DataFrame) -> DataFrame:
    """(file, text) of the sources that safe fixes change, as they should be written."""
    return sources.select("file", F.col("text").alias("_old"), fixed_text(F.col("text")).alias("text")).where("text <> _old").drop("_old")


def write_fixed(sources: DataFrame) -> int:
    """Writes fixed texts over their files, through the store that holds them: each under a new name beside it, which then takes its place. Returns how many."""
    fixed, spark = fixed_sources(sources), sources.sparkSession
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in fixed.toLocalIterator():  # one file at a time; a fix is an action of the driver
        path, new = (jvm.org.apache.hadoop.fs.Path(row["file"] + end) for end in ("", ".fixed"))
        fs = path.getFileSystem(conf)
        out = fs.create(new, True)
        out.write(row["text"].encode())
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)
        n += 1
    return n


def write_names(names: DataFrame, path: str) -> None:
    """A cache of names: distinct, in order, as JSON rows; the job's commit replaces the old one as a whole."""
    names.distinct().orderBy(*names.columns).write.mode("overwrite").json(path)


def catalog_drift(catalog: DataFrame, written: DataFrame) -> DataFrame:
    """(report): rows of the catalog's table that a written one (value) lacks, and rows of it that no rule has. None: it is up to date."""
    want = catalog_table(catalog).select("report")
    have = written.select(F.col("value").alias("report")).where("startswith(report, '| `')")
    return want.exceptAll(have).unionByName(have.exceptAll(want))


class Timings:
    """Milliseconds of named steps, and figures beside them, as one JSON object."""

    def __init__(self) -> None:
        self.figures: dict[str, float] = {}
        self.began = time.perf_counter()

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.figures[f"{name}_ms"] = round((time.perf_counter() - began) * 1000, 2)

    def hit_rate(self, hits: int, of: int) -> None:
        self.figures["token_cache_hit_rate"] = round(hits / of if of else 1.0, 3)

    def report(self) -> str:
        return json.dumps(self.figures | {"total_ms": round((time.perf_counter() - self.began) * 1000, 2)}, sort_keys=True)
