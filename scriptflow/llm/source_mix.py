"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral gives the source's
cumulative token demand; inverting that demand at a document's offset within its source gives
the document's training position. Positions of documents (and of their repeats) are sorted by
range, so the order of training is a distributed sort.

Sources are ordered by code point, null last, and weigh the cycle of `weights`. Targets share
all words; one that would pass `most` times its source's size stops there and its excess goes
to the others by weight. Within a source, documents are laid out in the order of the MD5 of
their ids; the mix takes the layout from its start, as often as needed, up to the target.

Null texts and texts without words have size 0 and take nothing. An empty table gives an empty
result. Repeated rows are separate documents; ties in the hash fall back on id and size. A
source of any share of the rows is split over tasks: offsets come from per-range sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributed import ranked
from .scratch import Scratch

#: Weights over time at equally spaced knots; sources take these rows in turn. Only shapes matter.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert_demand(share: Column, schedule: Sequence[float]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches share of its whole."""
    n = len(schedule) - 1
    areas = [(a + b) / 2 / n for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(areas), 0.0, F.lit(1.0)
    if min(schedule) < 0 or total <= 0:
        raise ValueError("a schedule has weights of at least 0, not all 0")
    pieces = []
    for k, area in enumerate(areas):
        a, slope = schedule[k], (schedule[k + 1] - schedule[k]) * n
        left = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
        if area == 0:
            into: Column = F.lit(0.0)
        elif slope == 0:
            into = left / F.lit(a)
        else:
            into = (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * left, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        done += area
        pieces.append((share * F.lit(total) <= F.lit(done), F.lit(k / n) + F.least(into, F.lit(1 / n))))
    for condition, value in reversed(pieces):
        out = F.when(condition, value).otherwise(out)
    return out


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Adds target to (source, source_size, weight) rows. The driver sees sums only."""
    capped = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    words, level, full = float(whole["t"] or 0), 0.0, -1
    if words:
        level = words / whole["w"]
        while True:
            above = capped <= F.lit(level) * F.col("weight")
            row = sources.agg(F.sum(F.when(above, capped).otherwise(0.0)).alias("held"), F.sum(F.when(~above, F.col("weight")).otherwise(0.0)).alias("w"), F.sum(above.cast("long")).alias("n")).first()
            if row["n"] == full or not row["w"]:
                break
            full, level = row["n"], (words - row["held"]) / row["w"]
    return sources.withColumn("target", F.least(capped, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1.0, 2.0, 3.0), most: int = 3, schedules: Sequence[Sequence[float]] = SCHEDULES, turn: Column | None = None) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken (words the mix takes,
    repeats counted) and positions (array of double: the training time at which each pass over the
    source comes to the document), sorted by range of the first position. turn: a column whose MD5
    orders documents within a source, in place of the key's."""
    scratch = Scratch(docs.sparkSession, "mix")
    by = docs[key] if turn is None else turn
    d = docs.select(docs[key].alias("_key"), docs[source].cast("string").alias("_source"), words_in(docs[text].cast("string")).alias("size"), F.md5(F.coalesce(by.cast("string"), F.lit(""))).alias("_turn"))
    order = [F.col("_source").asc_nulls_last(), F.col("_turn"), F.col("_key").asc_nulls_first(), F.col("size")]
    laid = d.repartitionByRange(*order)
    laid = scratch.write(laid.withColumn("_part", F.spark_partition_id()), "laid")

    sums = laid.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sums = ranked(sums, [F.col("_source").asc_nulls_last()], scratch, "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = sums.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    sums = scratch.write(targets(sums, weights, most), "targets")

    by_part = laid.groupBy("_source", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    plan = offsets.alias("o").join(sums.alias("s"), F.col("o._source").eqNullSafe(F.col("s._source"))).select("o.*", "s.source_size", "s.target", "s.rank")
    plan = scratch.write(plan, "plan")

    running = Window.partitionBy("_part", "_source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    rows = rows.alias("r").join(plan.alias("p"), F.col("r._source").eqNullSafe(F.col("p._source")) & (F.col("r._part") == F.col("p._part"))).select("r._key", "r._source", "r.size", "p.source_size", "p.target", "p.rank", (F.col("r._before") + F.col("p._offset")).alias("_at"))
    need = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(need / F.col("source_size"))).otherwise(0).cast("long")
    rest = need - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    rows = rows.withColumn("taken", taken.cast("long"))

    def position(offset: Column) -> Column:
        share = offset / F.round("target")
        out: Column = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            out = F.when(F.col("rank") % len(schedules) == k, invert_demand(share, schedule)).otherwise(out)
        return out

    at = [F.when((F.col("size") > 0) & (F.col("_at") + F.lit(e) * F.col("source_size") < need), position(F.col("_at") + F.lit(e) * F.col("source_size"))) for e in range(most)]
    rows = rows.withColumn("positions", F.filter(F.array(*at), lambda x: x.isNotNull()))
    out = rows.select(F.col("_key").alias(key), F.col("_source").alias("source"), "size", "source_size", "target", "taken", "positions")
    return out.orderBy(F.get("positions", 0).asc_nulls_last(), F.col(key))
