"""License scans by sparse TF-IDF cosine, with inheritance from the nearest directory.

Every line of a file that speaks of a licence is a header, and the whole text of a file named
like a licence file is one more unit. Units become sparse TF-IDF vectors of words and versions
and are compared with the notices of known licences by cosine; the best one at or above
`threshold` is the unit's licence (ties: the smaller name). A file's own licence is its best
unit's (ties: the earlier line, then the smaller name).

Wrapped headers and whole licences are longer than a line: comment blocks, paragraphs and the whole
text, of at least `least_words` words, are compared with the whole texts and standard headers of
license_texts, with logarithmic word counts. Such a match comes before those of lines.

A file is a licence file if its name says so, or if its licence lines hold a share of at least
`file_share` of its words. A directory has the licence of its licence files (the largest share
first, then the smallest path). A file without its own licence inherits that of the nearest
ancestor directory which has one, by joins on paths.

All of it is DataFrame expressions. Files without text, null texts and null paths have no own
licence; a null path inherits nothing. Repeated rows give repeated results. A very long text is
read whole, like any other. Other columns may have any names. An empty table gives an empty result.
The templates are a table of fixed size and the only thing that is broadcast by hint. The units of
files that speak of a licence are dealt out once, and one task does all comparisons of a unit; what they
found is written once, as several steps read it. So few exchanges keep the driver's plans and threads few.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .scratch import Scratch

# Licence names and the notices that licensors are told to use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "BSD-3-Clause#style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}
# Licences that identifiers name in headers.
IDENTIFIERS = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
TEMPLATES |= {f"{name}#spdx": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
#: Lines with one of these are headers.
TRIGGER = "(?i)licen[sc]e|copyright|all rights reserved|public domain"
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[^/]*)?$"
#: Comments of several lines, runs of lines that begin like comments, paragraphs of other lines.
BLOCK = (
    r"(?m)/\*[^*]*+(?:\*++[^*/][^*]*+)*+\*++/"
    r"|(?:^[ \t]*+(?://|#|--|;|%|\*)[^\n]*+(?:\n|\z))++"
    r"|(?:^(?![ \t]*+(?://|/\*|#|--|;|%|\*))[ \t\r]*+[^ \t\r\n][^\n]*+(?:\n|\z))++"
)
WORD = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
#: Kinds of units: those compared with notices, and those compared with texts.
NOTICE, TEXT = 0, 1


def template_rows(templates: dict[str, str] = TEMPLATES) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(licence, word, share of the unit vector), idf by word, and the idf of words in no template. What follows # tells the templates of one licence apart."""
    bags = {name: Counter(re.findall(WORD, text.lower())) for name, text in templates.items()}
    df = Counter(w for bag in bags.values() for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for name, bag in sorted(bags.items()):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in sorted(bag.items())))
        rows += [(name, w, n * idf[w] / norm) for w, n in sorted(bag.items())]
    return rows, idf, math.log(1 + len(bags)) + 1


def text_rows() -> tuple[list[tuple[str, dict[str, float]]], dict[str, float], float]:
    """Licence and shares by word of every whole text and header, idf by word, and the idf of words in none. Word counts are logarithmic."""
    texts = license_texts.texts()
    bags = [Counter(re.findall(WORD, text.lower())) for _, text in texts]
    df = Counter(w for bag in bags for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    found = []
    for (name, _), bag in zip(texts, bags, strict=True):
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in sorted(bag.items())}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        found.append((name, {w: x / norm for w, x in weights.items()}))
    return found, idf, math.log(1 + len(bags)) + 1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _known(templates: dict[str, str]) -> tuple[list[dict], list[str], list[float]]:
    """A row for each kind and word of what units are compared with: idf and the shares of that word by number t; the
    licence of each t; the idf of words in none, by kind."""
    rows, idf, rare = template_rows(templates)
    notices = {name: {} for name in sorted(templates)}
    for name, word, share in rows:
        notices[name][word] = share
    texts, text_idf, text_rare = text_rows()
    vectors = [(NOTICE, *x) for x in notices.items()] + [(TEXT, *x) for x in texts]
    shares = defaultdict(list)
    for t, (kind, _, words) in enumerate(vectors):
        for word, share in words.items():
            shares[kind, word].append({"t": t, "share": share})
    known = [{"kind": kind, "word": w, "idf": x, "shares": shares[kind, w]} for kind, found in ((NOTICE, idf), (TEXT, text_idf)) for w, x in sorted(found.items())]
    return known, [name for _, name, _ in vectors], [rare, text_rare]


def _units() -> Column:
    """What of a file is compared: lines that speak of a licence and the whole text of a licence file with notices, blocks
    and the whole text with texts. The whole text is number -1."""
    unit = lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("line"), text.alias("unit"))
    speaks = lambda u: u["unit"].rlike(TRIGGER)
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda x, k: unit(NOTICE, k, x)), speaks)
    blocks = F.filter(F.transform(F.regexp_extract_all("_text", F.lit(BLOCK), 0), lambda x, k: unit(TEXT, k, x)), speaks)
    whole = F.filter(F.array(unit(NOTICE, F.lit(-1), F.col("_text")), unit(TEXT, F.lit(-1), F.col("_text"))), lambda u: F.when(u["kind"] == NOTICE, F.col("_named")).otherwise(speaks(u)))
    return F.concat(lines, whole, blocks)


def _own(base: DataFrame, templates: dict[str, str], threshold: float, least: int) -> DataFrame:
    """_id, path, own_license, own_score and _share (of the words that speak of it) of the files with a licence of their own.

    Files that speak of a licence meet by _id and their units are dealt out, to as many tasks as there are shuffle
    partitions (adaptive execution would join them by the size of texts, of which words and sums are many times);
    a unit's words, sums and best match are made in its task.
    """
    spark, (rows, names, rare) = base.sparkSession, _known(templates)
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:int,word:string,idf:double,shares:array<struct<t:int,share:double>>>>")))
    known = Scratch(spark, "license").write(table, "known")  # read again from there, so that plans don't hold the rows
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    speaking = base.where(F.col("_text").rlike(TRIGGER) | (named & (F.length("_text") > 0))).select("_id", "path", "_text", named.alias("_named"), F.size(words_of(F.col("_text"))).alias("_n")).dropDuplicates(["_id"])

    file = ["_id", "path", "_n", "_named"]
    by = [*file, "kind", "line"]
    to_notices = F.col("kind") == NOTICE
    units = speaking.select(*file, F.inline(_units())).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id", "kind", "line")
    units = units.select(*by, words_of(F.col("unit")).alias("words")).where(to_notices | (F.size("words") >= least))
    bags = units.select(*by, F.explode("words").alias("word")).groupBy(*by, "word").count()
    weight = F.when(to_notices, F.col("count")).otherwise(1 + F.log("count")) * F.coalesce("idf", F.when(to_notices, rare[NOTICE]).otherwise(rare[TEXT]))
    weighed = bags.join(F.broadcast(known), ["kind", "word"], "left").withColumn("w", weight)
    itself = F.array(F.struct(F.lit(-1).alias("t"), F.col("w").alias("share")))  # its sum is the square of the unit's norm
    shares = weighed.select(*by, "count", "w", F.inline(F.when(F.col("shares").isNull(), itself).otherwise(F.concat(itself, "shares"))))
    dots = shares.groupBy(*by, "t").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.sum("count").alias("n"))
    each = dots.groupBy(*by).agg(F.max(F.when(F.col("t") < 0, F.sqrt("dot"))).alias("norm"), F.max(F.when(F.col("t") < 0, F.col("n"))).alias("size"), F.collect_list(F.when(F.col("t") >= 0, F.struct("t", "dot"))).alias("dots"))
    licenses = F.array(*[F.lit(x) for x in names])
    scores = F.transform("dots", lambda x: F.struct((-F.round(x["dot"] / F.col("norm"), 6)).alias("s"), F.col("line"), F.get(licenses, x["t"]).alias("license"), F.col("size")))
    hits = each.withColumn("best", F.array_min(F.filter(scores, lambda x: x["s"] <= -threshold))).where(F.col("best").isNotNull())
    best = hits.groupBy(*file).agg(F.min(F.when(to_notices, F.col("best"))).alias("l"), F.min(F.when(~to_notices, F.col("best"))).alias("b"), F.sum(F.when(to_notices & (F.col("line") >= 0), F.col("size"))).alias("held"))
    share = F.when(F.col("_named"), F.lit(1.0)).otherwise(F.coalesce("b.size", "held", F.lit(0)) / F.greatest(F.col("_n"), F.lit(1)))
    return best.select("_id", "path", F.coalesce("b.license", F.split_part("l.license", F.lit("#"), F.lit(1))).alias("own_license"), (-F.coalesce("b.s", "l.s")).alias("own_score"), share.alias("_share"))


def scan(files: DataFrame, keys: list[str], path: str = "path", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.2, least_words: int = 20) -> DataFrame:
    """keys, path, own_license, own_score, license, origin (header, inherited or none) and
    inherited_from (a directory, empty for the top) of every row of files."""
    spark = files.sparkSession
    base = files.select(*keys, F.col(path).alias("path"), F.col(text).cast("string").alias("_text"))
    base = base.withColumn("_id", F.xxhash64("path", "_text")).withColumn("_dir", directory(F.col("path")))
    own = Scratch(spark, "license").write(_own(base, templates, threshold, least_words), "own")

    holders = own.where((F.col("_share") >= file_share) & F.col("path").isNotNull()).withColumn("_dir", directory(F.col("path")))
    declared = holders.groupBy("_dir").agg(F.min(F.struct((-F.col("_share")).alias("s"), "path", "own_license")).alias("d")).select(F.col("_dir").alias("_above"), F.col("d.own_license").alias("_license"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    places = base.select("_dir").where("_dir is not null").distinct().select("_dir", F.posexplode(above).alias("_depth", "_above"))
    nearest = places.join(declared, "_above").groupBy("_dir").agg(F.max(F.struct("_depth", "_above", "_license")).alias("n")).select("_dir", F.col("n._above").alias("_from"), F.col("n._license").alias("_license"))
    out = base.drop("_text").join(own.drop("path", "_share"), "_id", "left").join(nearest, "_dir", "left")
    lone = F.col("own_license").isNull()
    return out.select(*keys, "path", "own_license", "own_score", F.coalesce("own_license", "_license").alias("license"), F.when(~lone, "header").when(F.col("_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(lone, F.col("_from")).alias("inherited_from"))
