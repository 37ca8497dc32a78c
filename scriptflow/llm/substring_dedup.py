"""Substring deduplication over a log-structured fingerprint index.

A window is `width` consecutive words of one document. Of the hashes of the `gram`-word parts of
a window, the smallest is its fingerprint, so equal windows have equal fingerprints, and about
two words in twenty-seven carry one. Texts are packed into slices of about 1 MB, and whatever
occurs in a slice is sent once by it, so that a passage found in a third of all documents costs an
entry per slice, not one per document.

The index holds the fingerprints of slices in sorted immutable runs, cut into buckets by hash.
Each new batch becomes a run and is merge-joined with the runs before it, bucket by bucket, so
history isn't shuffled again; runs of one level are compacted into one of the next. An index stays
in its folder and can be opened again, by a later job too. A fingerprint found twice makes
candidates only: the windows behind it are verified by two independent 64-bit hashes of all
their words (other values for the words, other bases for the windows). Each slice asks about its
candidates by parts of the hashes; parts are merged in two steps, some thousand slices at a time
and then over all, so no task holds more than a part's distinct windows; the answer is a bit for each.

Every word is removed that a window covers whose words also start anywhere else, in the same
document or another; windows are judged on the input, so all occurrences go, the first too.

Null texts have no words; texts shorter than a window lose nothing; repeated rows are separate
documents, so their windows occur twice. Texts are compared as they are, by bytes; there are no
ties. A very long text is a slice of its own. Other columns may have any names. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .scratch import Scratch

WIDTH, GRAM = 35, 10
#: Runs of one level that are merged into one of the next.
FANOUT = 3
#: Batches in which a table goes into the index: the third makes the first compaction, the fourth meets the compacted run.
BATCHES = 4

#: Bytes of text in a slice; slices whose questions are merged at once; windows in a part, about; words between two fingerprints, about.
SLICE, TOGETHER, PART, SPACING = 1 << 20, 4_096, 1_000_000, 13

_RUN = "m long, sid long, many boolean"
_ASK = "sid long, p long, team long, keys binary, many binary"


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """kernel.slices of the texts in a column with one list of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return kernel.slices(column.flatten())


def pack(docs: DataFrame, columns: list[str], text: str, batches: int) -> DataFrame:
    """Slices of documents: sid (long, by chance, so they are to be written once), batch, rows (columns of each) and texts."""
    kept = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), docs[text].cast("string").alias("text"))
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("rows", T.ArrayType(kept.schema["row"].dataType)), T.StructField("texts", T.ArrayType(T.StringType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, _, _ in kernel.slices(part.column(1), SLICE):
                sid, bounds = secrets.randbits(62), pa.array([0, j - i], pa.int32())
                lists = (pa.ListArray.from_arrays(bounds, pa.concat_arrays([c.slice(i, j - i)])) for c in part.columns)
                yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([sid % batches], pa.int32()), *lists], names=schema.names)

    return kept.mapInArrow(kernel.releasing(run), schema)


def _windows(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[kernel.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, the hashes of parts, each window's fingerprint and whether it lies in one text."""
    w = kernel.words(data, offsets)
    h = w.hashes()
    g = kernel.window_hashes(h, gram)
    reach = width - gram + 1
    low = kernel.sliding(g, reach) if len(g) >= reach else np.empty(0, np.uint64)
    return w, h, g, low, kernel.windows_inside(w.first, width, len(low))


def fingerprints(slices: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(m, sid, many): a row for each fingerprint of each slice; many: at more than one place in it."""
    reach = width - gram + 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.empty(0, np.uint64)]
        for _, _, data, offsets in _texts(table["texts"]):
            _, _, g, low, inside = _windows(data, offsets, width, gram)
            if inside.any():
                padded = np.zeros(len(g) + reach - 1, np.uint64)
                padded[reach - 1 : reach - 1 + len(low)] = np.where(inside, low, np.uint64(0))
                found.append(g[kernel.sliding(padded, reach, np.maximum) == g])
        m = np.concatenate(found)
        m, n = np.unique(m, return_counts=True)
        return pa.table({"m": m.view(np.int64), "sid": pa.array(np.full(len(m), key[0].as_py(), np.int64)), "many": n > 1})

    return slices.select("sid", "texts").groupBy("sid").applyInArrow(run, _RUN)


class FingerprintIndex:
    """Sorted immutable runs of (m, sid, many) in a folder, in levels. The folder has a manifest, so that it can be opened again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.scratch = spark, Scratch(spark, path=folder)
        self.tables: dict[str, DataFrame] = {}
        if found := self.scratch.read_text("manifest"):
            state = json.loads(found)
            self.levels, self.made, self.buckets = state["levels"], state["made"], state["buckets"]
        else:
            self.levels, self.made = [], 0
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run-{self.made}"
        self.made += 1
        self.tables[name] = self.scratch.bucketed(rows, name, "m", self.buckets)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.scratch.open_bucketed(name, _RUN, "m", self.buckets)
        return self.tables[name]

    def runs(self) -> list[DataFrame]:
        return [self.read(name) for level in self.levels for name in level]

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes a batch as a run and returns its repeated fingerprints (m), within it or with earlier runs; then compacts."""
        before = self.runs()
        new = self.read(self._write(rows, 0))
        own = new.groupBy("m").agg(F.count("*").alias("c"), F.max("many").alias("many"))
        repeated = own.where("c > 1 or many").select("m")
        for run in before:
            repeated = repeated.union(own.select("m").join(run.select("m"), "m", "left_semi"))
        hits = self.scratch.write(repeated.distinct(), f"hits-{self.made}")
        full = self.compact()
        self.scratch.write_text("manifest", json.dumps({"levels": self.levels, "made": self.made, "buckets": self.buckets}))
        self.scratch.drop(*full)  # only now does nothing name them any more
        return hits

    def compact(self) -> list[str]:
        """Merges the runs of each full level into one run of the next level; returns the names of those merged."""
        level, gone = 0, []
        while level < len(self.levels):
            if len(names := self.levels[level]) >= FANOUT:
                merged = self.read(names[0])
                for name in names[1:]:
                    merged = merged.union(self.read(name))
                self.levels[level] = []
                self._write(merged, level + 1)
                gone += names
            level += 1
        return gone

    def slices(self, hits: DataFrame) -> DataFrame:
        """(sid, m): the repeated fingerprints of every slice that holds some."""
        found = None
        for run in self.runs():
            part = run.join(hits, "m", "left_semi").select("sid", "m")
            found = part if found is None else found.union(part)
        return found


def _candidates(texts: pa.ChunkedArray, width: int, gram: int, wanted: np.ndarray, parts: int) -> tuple[list[tuple[int, kernel.Words, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a slice with a wanted fingerprint: for each run of its texts the first row, the words and the
    windows' places; and over all of them their part, their two hashes and an order by all three."""
    found, hashes = [], [np.empty((0, 2), np.uint64)]
    for i, _, data, offsets in _texts(texts):
        w, h, _, low, inside = _windows(data, offsets, width, gram)
        at = np.flatnonzero(inside & np.isin(low, wanted)) if len(low) else np.empty(0, int)
        if len(at):
            found.append((i, w, at))
            hashes.append(np.column_stack([kernel.window_hashes(x, width, second=s)[at] for x, s in ((h, False), (w.hashes(second=True), True))]))
    keys = np.concatenate(hashes)
    part = (kernel.mix(keys[:, 0] ^ kernel.mix(keys[:, 1])) % np.uint64(parts)).astype(np.int64)
    return found, part, keys, np.lexsort((keys[:, 1], keys[:, 0], part))


def _firsts(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the sorted entries differ from the one before."""
    return np.r_[np.ones(min(len(part), 1), bool), (part[1:] != part[:-1]) | (keys[1:] != keys[:-1]).any(1)]


def _asked(slices: DataFrame, wanted: DataFrame, parts: int, teams: int, width: int, gram: int) -> DataFrame:
    """What each slice asks of each part: its distinct candidate windows in order, and which are in it more than once."""

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes, bytes]] = []
        if told.num_rows and own.num_rows:
            _, part, keys, order = _candidates(own["texts"], width, gram, told["m"].to_numpy().view(np.uint64), parts)
            part, keys = part[order], keys[order]
            first = np.flatnonzero(_firsts(part, keys))
            many, part, keys = np.diff(np.r_[first, len(part)]) > 1, part[first], keys[first]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            rows = [(int(part[a]), keys[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        sid = key[0].as_py()
        return pa.table([pa.array([sid] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([sid % teams] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["sid", "p", "team", "keys", "many"])

    return slices.select("sid", "texts").groupBy("sid").cogroup(wanted.groupBy("sid")).applyInArrow(run, _ASK)


def _pairs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in column]


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of what some rows ask, an order, the distinct windows in it, which of them are there more than once, and each entry's place among them."""
    keys = np.concatenate(_pairs(table["keys"]))
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(1)]
    first = np.flatnonzero(new)
    many = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in table["many"]])[order]
    many = np.logical_or.reduceat(many, first) | (np.diff(np.r_[first, len(keys)]) > 1)
    return order, keys[order[first]], many, np.cumsum(new) - 1


def _merged(asked: DataFrame, *by: str) -> DataFrame:
    """(p, keys, many): the distinct windows that rows of a group ask about, and which are there more than once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys, many, _ = _joined(table)
        return pa.table({"p": [key[0].as_py()], "keys": [keys.tobytes()], "many": [many.tobytes()]})

    return asked.select(*by, "keys", "many").groupBy(*by).applyInArrow(run, "p long, keys binary, many binary")


def _told(asks: pa.Table, twice: np.ndarray) -> pa.Table:
    """The answers to rows of asks, from those to all their entries one after the other."""
    ends = np.cumsum([len(k) // 16 for k in asks["keys"].to_pylist()])
    out = [t.tobytes() for t in np.split(twice, ends[:-1])] if asks.num_rows else []
    return pa.table([asks["sid"], asks["p"], pa.chunked_array([pa.array(out, pa.binary())])], names=["sid", "p", "twice"])


_ANSWER = "sid long, p long, twice binary"


def _answers(asked: DataFrame, merged: DataFrame, teams: int) -> DataFrame:
    """(sid, p, twice): for each window that a slice asks about, in its order, a byte that says whether it occurs elsewhere."""

    def run(_: tuple, asks: pa.Table, all_: pa.Table) -> pa.Table:
        keys, many = _pairs(all_["keys"])[0], np.frombuffer(all_["many"][0].as_buffer(), bool)
        return _told(asks, _among(np.concatenate([np.empty((0, 2), np.uint64), *_pairs(asks["keys"])]), keys[many]))

    spread = merged.withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(teams - 1).cast("long"))))
    return asked.select("p", "team", "sid", "keys").groupBy("p", "team").cogroup(spread.groupBy("p", "team")).applyInArrow(run, _ANSWER)


def _answers_at_once(asked: DataFrame) -> DataFrame:
    """The same where one team asks, so that a part's questions are together."""

    def run(table: pa.Table) -> pa.Table:
        order, _, many, place = _joined(table)
        twice = np.empty(len(order), bool)
        twice[order] = many[place]
        return _told(table, twice)

    return asked.select("p", "sid", "keys", "many").groupBy("p").applyInArrow(run, _ANSWER)


def _among(h: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which pairs of hashes are among those, which are sorted."""
    found = np.zeros(len(h), bool)
    if len(those):
        starts = np.flatnonzero(np.r_[True, those[1:, 0] != those[:-1, 0]])
        first, most = np.searchsorted(those[:, 0], h[:, 0]), int(np.diff(np.r_[starts, len(those)]).max())
        for k in range(most):  # more than one only where first hashes collide
            found |= (those[np.minimum(first + k, len(those) - 1)] == h).all(1)
    return found


def _remove(slices: DataFrame, told: DataFrame, parts: int, width: int, gram: int, kept: bool, spans: bool, whole: bool) -> DataFrame:
    """The columns of rows with n_words, n_removed and kept_sha256 (and kept, spans). told: the wanted (sid, m) and the answers (sid, p, twice)."""
    row = slices.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * kept + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] * spans
    if kept:
        schema = schema.add("kept", T.StringType())
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))

    def run(_: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        texts = own["texts"].combine_chunks().flatten()
        starts: dict[int, np.ndarray] = {}
        answers = told.filter(pa.compute.is_valid(told["twice"])).sort_by("p")
        if answers.num_rows:
            wanted = told["m"].drop_null().to_numpy().view(np.uint64)
            found, part, keys, order = _candidates(own["texts"], width, gram, wanted, parts)
            place = np.cumsum(_firsts(part[order], keys[order])) - 1
            twice = np.empty(len(order), bool)
            twice[order] = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in answers["twice"]])[place]
            for i, w, at in found:
                hit, twice = at[twice[: len(at)]], twice[len(at) :]
                owner = np.searchsorted(w.first, hit, "right") - 1
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else []
                starts |= {i + int(owner[a]): hit[a:b] - w.first[owner[a]] for a, b in zip(cuts, cuts[1:], strict=False)}
        out = []
        for k, text in enumerate(texts):
            words, removed, ranges = (text.as_py() or "").encode().split(), 0, []
            if k in starts:
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, starts[k], 1)
                np.add.at(change, starts[k] + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = int(gone.sum())
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                ranges = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            n, words = len(words), [words[k] for k in np.flatnonzero(~gone)] if removed else words
            left = b" ".join(words)
            out.append([n, removed, hashlib.sha256(left).hexdigest(), *([text.as_py() if whole and not removed else left.decode()] if kept else []), *([ranges] if spans else [])])
        rows = own["rows"].combine_chunks().flatten()
        return pa.Table.from_arrays([*rows.flatten(), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return slices.select("sid", "rows", "texts").groupBy("sid").cogroup(told.groupBy("sid")).applyInArrow(run, schema)


def _among(h: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which pairs of hashes are among those."""
    those = those[np.lexsort((those[:, 1], those[:, 0]))]
    first = np.searchsorted(those[:, 0], h[:, 0])
    found, most = np.zeros(len(h), bool), int(np.unique(those[:, 0], return_counts=True)[1].max())
    for k in range(most):  # more than one only where first hashes collide
        found |= (those[np.minimum(first + k, len(those) - 1)] == h).all(1)
    return found


def deduplicate(docs: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, kept: bool = False, spans: bool = False, whole: bool = False) -> DataFrame:
    """Returns columns of docs with n_words, n_removed and kept_sha256; with kept also the kept
    words joined by one space (with whole, a text that loses nothing comes back as it is, null too), with
    spans the removed ranges of words. Slices go into the index in so many batches, as arriving data would; the result doesn't depend on their number."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = scratch.bucketed(pack(docs, columns, text, batches), "slices", "sid", buckets)
    index = FingerprintIndex(spark, f"{scratch.path}/index", buckets)
    hits = None
    for batch in range(batches):
        found = index.add(fingerprints(slices.where(F.col("batch") == batch), width, gram))
        hits = found if hits is None else hits.union(found)
    hits = scratch.write(hits.distinct(), "hits")
    wanted = scratch.write(index.slices(hits), "wanted")
    scratch.drop("index", "hits")
    parts = max(buckets, wanted.count() * SPACING // PART + 1)
    teams = slices.count() // TOGETHER + 1
    asked = _asked(slices, wanted, parts, teams, width, gram)
    if teams > 1:
        asked = scratch.write(asked, "asked")
        merged = scratch.write(_merged(_merged(asked, "p", "team"), "p"), "merged")
        answers = scratch.write(_answers(asked, merged, teams), "answers")
    else:
        answers = scratch.write(_answers_at_once(asked), "answers")
    scratch.drop("asked", "merged")
    return _remove(slices, wanted.unionByName(answers, allowMissingColumns=True), parts, width, gram, kept, spans, whole)
