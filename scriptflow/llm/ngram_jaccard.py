"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct n-word shingles (hashed to 64 bits). Similar sets are
partitioned into groups: sets that share one of three minimum hashes are compared with the one
among them whose tokens are the most frequent (ties: the largest id), and those that link form a group. Each group keeps the union of its
members' tokens as a bitmap. A set can only link with a member of another group if it shares one
of its first tokens (in an order that puts frequent tokens last) with it, and if the bitmap
leaves room for enough common tokens; only such groups are opened, and their members compared.

The result is exact up to 64-bit hash collisions: the order of tokens, the groups and the
bitmaps only decide what can be skipped safely. Equal sets are one set throughout, so copies
cost nothing but their own rows; sets that are already connected are not compared again.

Null and wordless texts have an empty set and link with nothing. Texts with fewer words than n
have their whole sequence as the one shingle. Repeated rows are separate documents with equal
sets; one with a null key is in the group of its set, whose smallest key is a real one if there is any.
A very long text is a slice of its own. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, kernel
from .components import connected_components
from .scratch import Scratch

#: Buckets of the frequency sketch that orders tokens: a fixed 1 MB, whatever the input.
SKETCH = 1 << 18
#: Members of a connected group are kept in blocks of about so many.
BLOCK = 256
#: Bytes of a prefix token.
KEY_BYTES = 6
#: Prefix tokens that one task compares, about.
TASK_TOKENS = 1_000_000

_SEEDS = [np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over bytes data with the given offsets in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a slice, sorted, and the bounds of each text's."""
    w = kernel.words(data, offsets)
    h, counts = w.hashes(lower=True), w.counts
    tokens = kernel.window_hashes(h, n)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = kernel.windows_inside(w.first, n, len(tokens))
    tokens, owner = tokens[inside], text[: len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first, size = w.first[short], counts[short]
        whole = size.astype(np.uint64) * _SEEDS[0]
        for j in range(n - 1):
            has = size > j
            whole[has] = kernel.mix(whole[has] * np.uint64(31) + h[first[has] + j])
        tokens, owner = np.concatenate([tokens, whole]), np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(counts) + 1))


def _reduce(op: np.ufunc, x: np.ndarray, bounds: np.ndarray, empty: int = 0) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, np.uint64)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = op.reduceat(x, bounds[:-1][some])
    return out


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return kernel.mix(_reduce(np.add, kernel.mix(tokens ^ _SEEDS[0]), bounds) + np.diff(bounds).astype(np.uint64) * _SEEDS[1])


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n tokens any set that links with it holds, at least."""
    return (n * percent + 99) // 100


def prefixes(tokens: np.ndarray, bounds: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the first tokens, rare classes first, of which a linked set holds one at least:
    the upper 48 bits of each key, as bytes. (Keys that agree only there merely add candidates.)"""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    keys = (classes[(tokens >> np.uint64(20)) & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(62)) | (tokens >> np.uint64(2))
    keys = keys[np.lexsort((keys, owner))]
    length = np.where(n > 0, n - least_shared(n, percent) + 1, 0)
    kept = np.arange(len(keys)) - bounds[:-1][owner] < length[owner]
    return keys[kept].view(np.uint8).reshape(-1, 8)[:, 2:], np.concatenate([[0], np.cumsum(length)])


def prefix_keys(raw: np.ndarray) -> np.ndarray:
    """Keys of prefixes() from their bytes."""
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = raw.reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set's tokens, of a power of two of bits, at least twice their number and 64."""
    n = np.diff(bounds)
    bits = (1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)) * (n > 0)
    starts = np.concatenate([[0], np.cumsum(bits)])
    flat = np.zeros(starts[-1], bool)
    owner = np.repeat(np.arange(len(n)), n)
    flat[starts[:-1][owner] + (tokens & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(flat, bitorder="little"), starts // 8


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap folded to size bytes."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size))


def room(n: int, bits: np.ndarray, union: np.ndarray) -> int:
    """The most tokens that a set of n with this bitmap can share with sets of that union."""
    size = min(len(bits), len(union))
    return n - int(np.bitwise_count(fold(bits, size) & ~fold(union, size)).sum())


def _sketch(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class 0 to 3 of each bucket, how far its tokens' count stands out, and the log of the count. Tasks send partial sums."""
    slots = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                tokens, _ = shingle_sets(data, offsets, n)
                total += np.bincount(((tokens >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        parts = total.reshape(slots, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([p.astype(np.int32).tobytes() if p.max() < 1 << 31 else p.tobytes() for p in parts], pa.binary())], names=["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(sums.as_buffer(), np.uint8)
                part = raw.view(np.int32 if len(raw) == SKETCH // slots * 4 else np.int64).astype(np.int64)
                total[slot] = total.get(slot, 0) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slot", "sums"])

    rows = docs.select("_text").mapInArrow(kernel.releasing(count), "slot int, sums binary").repartition(slots, "slot").mapInArrow(add, "slot int, sums binary").collect()
    counts = np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(rows)]) if rows else np.zeros(SKETCH, np.int64)
    spread = 4 * np.sqrt(counts.mean()) + 8
    return np.searchsorted([spread, 16 * spread, 256 * spread], counts - counts.mean()).astype(np.uint8), np.log1p(counts).astype(np.float32)


def _profiles(docs: DataFrame, n: int, percent: int, sketch: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """What the join needs of each text. common: how frequent its tokens are, on the mean; of copies with
    changes, the one nearest to what they all come from has the most."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kernel.slices(batch.column(1)):
                tokens, bounds = shingle_sets(data, offsets, n)
                classes, logs = sent.value
                first, at = prefixes(tokens, bounds, classes, percent)
                sums = np.concatenate([[0.0], np.cumsum(logs[(tokens >> np.uint64(20)) & np.uint64(SKETCH - 1)], dtype=np.float64)])
                common = np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
                bits, bit_at = bitmaps(tokens, bounds)
                lows = [_reduce(np.minimum, kernel.mix(tokens + s), bounds) for s in _SEEDS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), signed(set_ids(tokens, bounds)), pa.array(common), *map(signed, lows), binary(first, at * KEY_BYTES), binary(bits, bit_at)], names=["_key", "n", "sid", "common", "low0", "low1", "low2", "first", "bits"])

    return docs.mapInArrow(kernel.releasing(run), f"_key {docs.schema['_key'].dataType.simpleString()}, n long, sid long, common double, low0 long, low1 long, low2 long, first binary, bits binary")


def _tokens(docs: DataFrame, wanted: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """(sid, tokens) of the wanted (sid, rep) sets. A filter of fixed size keeps most other texts from being read as words."""
    near = filters.mark(docs.select("_key", "_text"), F.xxhash64("_key"), wanted, F.xxhash64("rep"), scratch, name).where("_maybe").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                tokens, bounds = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([signed(set_ids(tokens, bounds)), binary(tokens, bounds * 8)], names=["sid", "tokens"])

    read = near.mapInArrow(kernel.releasing(run), "sid long, tokens binary")
    return read.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Keeps (a, b) whose bitmaps leave room for a link. Reads an, abits, bn, bbits; bn null: b is a group of any sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for an, abits, bn, bbits in zip(*(batch.column(k).to_pylist() for k in ("an", "abits", "bn", "bbits")), strict=True):
                x, y = np.frombuffer(abits, np.uint8), np.frombuffer(bbits, np.uint8)
                if bn is None:
                    kept.append(room(an, x, y) * 100 >= an * percent)
                else:
                    shared = min(room(an, x, y), room(bn, y, x))
                    kept.append(shared * 100 >= (an + bn - shared) * percent)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "an", "abits", "bn", "bbits").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Keeps (a, b) whose token sets link. Reads atokens and btokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("atokens"), batch.column("btokens"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                kept.append(shared * 100 >= (len(x) + len(y) - shared) * percent)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "atokens", "btokens").mapInArrow(run, "a long, b long")


def _with(pairs: DataFrame, what: DataFrame, side: str, *columns: str) -> DataFrame:
    """Joins columns of the set named in pairs' side, with the side's letter before their names."""
    return pairs.join(what.select(F.col("sid").alias(side), *(F.col(c).alias(side + c) for c in columns)), side)


def _candidates(sets: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(a, b): set a shares a first token with a member of group b, and sizes and places of the token
    allow the two to link; they aren't connected yet. sets: sid, n, first, label, gid.

    If the token is the first that two sets of n and m share, at places i and j of their orders, they
    share min(n - i, m - j) at most; so a pair is dropped here only if it would be dropped at its
    first shared token, too. Of a lone set and a larger group only the set asks for the group, of
    two sets of one kind only the one with the smaller label."""
    parts = 4 * tasks
    kinds = (np.uint8, np.uint16, np.uint16, np.int64, np.uint32, np.uint16, np.int64, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                piece = batch.slice(start, 4000)
                first = piece.column(2).cast(pa.large_binary())
                offsets = np.frombuffer(first.buffers()[1], np.int64)[first.offset : first.offset + len(first) + 1]
                keys = np.frombuffer(first.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, KEY_BYTES)
                length = np.diff(offsets) // KEY_BYTES
                owner = np.repeat(np.arange(len(first)), length)
                place = np.minimum(np.arange(len(keys)) - np.repeat(np.cumsum(length) - length, length), 65535)
                part = ((kernel.mix(prefix_keys(keys.ravel())) >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keys, owner, place, part = keys[order], owner[order], place[order], part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
                table = np.stack([piece.column(k).to_numpy() for k in (0, 1, 3, 4)])
                rows = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    who, index = np.unique(owner[a:b], return_inverse=True)
                    sid, n, label, gid = table[:, who]
                    odd = np.flatnonzero((gid != sid) | (label != sid))
                    columns = (keys[a:b], index, place[a:b], sid, n, odd, label[odd], gid[odd])
                    rows.append((part[a], *(np.ascontiguousarray(c.astype(k)).tobytes() for c, k in zip(columns, kinds, strict=True))))
                columns = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["p", *(f"c{k}" for k in range(8))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw, index, place, sid, n, odd, labels, gids = (np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))
                label, gid, lone = sid.copy(), sid.copy(), np.ones(len(sid), bool)
                label[odd], gid[odd], lone[odd] = labels, gids, False
                for to, x in zip(got, (prefix_keys(raw), place.astype(np.int64), sid[index], n.astype(np.int64)[index], label[index], gid[index], lone[index]), strict=True):
                    to.append(x)
        if not got[0]:
            return
        key, place, sid, n, label, gid, lone = map(np.concatenate, got)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        found: list[np.ndarray] = []
        held = 0
        for c in np.flatnonzero(np.diff(cuts) > 1):
            at = order[cuts[c] : cuts[c + 1]]
            if (label[at] == label[at[0]]).all():
                continue
            for a in range(0, len(at), 512):  # a block of sets against all others of the token
                q = at[a : a + 512]
                shared = np.minimum((n[q] - place[q])[:, None], (n[at] - place[at])[None, :])
                ok = shared * (100 + percent) >= percent * (n[q][:, None] + n[at][None, :])
                ok &= (lone[q][:, None] & ~lone[at][None, :]) | ((lone[q][:, None] == lone[at][None, :]) & (label[q][:, None] < label[at][None, :]))
                x, y = np.nonzero(ok)
                if len(x):
                    found.append(np.unique(np.column_stack([sid[q][x], gid[at][y]]), axis=0))
                    held += len(found[-1])
            if held > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                if (held := len(found[0])) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0][:, 0]), pa.array(found[0][:, 1])], names=["a", "b"])
                    found, held = [], 0
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    packed = sets.select("sid", "n", "first", "label", "gid").mapInArrow(pack, "p int, " + ", ".join(f"c{k} binary" for k in range(8)))
    return packed.repartition(tasks, "p").mapInArrow(kernel.releasing(match), "a long, b long").distinct()


def _unions(members: DataFrame) -> DataFrame:
    """(gid, bits): the union of the bitmaps of each group's members, folded to the smallest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["bits"]]
        size = min(map(len, maps))
        return pa.table({"sid": [key[0].as_py()], "bits": pa.array([np.bitwise_or.reduce([fold(m, size) for m in maps]).tobytes()], pa.binary())})

    return members.select("gid", "bits").groupBy("gid").applyInArrow(run, "sid long, bits binary")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Returns key, n_shingles and component_id (the smallest key that links lead to) per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    profiles = scratch.write(_profiles(docs, n, percent, _sketch(docs, n)), "profiles")
    rows = scratch.write(profiles.select("_key", "n", "sid"), "rows")
    sets = profiles.where("n > 0").groupBy("sid").agg(F.min("_key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "common", "low0", "low1", "low2", "first", "bits")))
    sets = scratch.write(sets, "sets")
    scratch.drop("profiles")

    tries = None
    for low in ("low0", "low1", "low2"):
        heads = sets.groupBy(low).agg(F.max(F.struct("common", "sid")).alias("h"), F.count("*").alias("c")).where("c > 1").select(low, F.col("h.sid").alias("b"))
        pairs = sets.join(heads, low).select(F.col("sid").alias("a"), "b").where("a <> b")
        tries = pairs if tries is None else tries.union(pairs)
    tries = _with(_with(tries.distinct(), sets, "a", "n", "bits"), sets, "b", "n", "bits")
    tries = scratch.write(_bounded(tries, percent), "tries")
    wanted = sets.join(tries.select(F.col("a").alias("sid")).union(tries.select("b")).distinct(), "sid").select("sid", "rep")
    tokens = scratch.write(_tokens(docs, wanted, n, scratch, "filter-1"), "tokens")
    near = scratch.write(_linked(_with(_with(tries, tokens, "a", "tokens"), tokens, "b", "tokens"), percent), "near")
    groups = connected_components(near, scratch, "groups")

    sizes = groups.groupBy("component").agg(F.count("*").alias("c"))
    blocks = groups.join(sizes, "component").select(F.col("node").alias("sid"), F.col("component").alias("label"), F.when(F.col("c") <= BLOCK, F.col("component")).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)))).alias("gid"))
    blocks = scratch.write(blocks, "blocks")
    scratch.drop("tokens", "tries")
    marked = filters.mark(sets, F.col("sid"), blocks, F.col("sid"), scratch, "filter")
    lone = marked.where("not _maybe").drop("_maybe").withColumns({"label": F.col("sid"), "gid": F.col("sid")})
    placed = marked.where("_maybe").drop("_maybe").join(blocks, "sid", "left").withColumns({"label": F.coalesce("label", "sid"), "gid": F.coalesce("gid", "sid")}).unionByName(lone)
    total = sets.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // TASK_TOKENS + 1)
    pairs = scratch.write(_candidates(placed, tasks, percent), "pairs")

    of = sets.select("sid", "n", "rep", "bits").join(blocks, "sid", "left").withColumn("gid", F.coalesce("gid", "sid"))
    asked = pairs.select(F.col("b").alias("gid")).distinct()
    unions = _unions(of.where("label is not null").join(asked, "gid", "left_semi")).withColumn("n", F.lit(None).cast("long"))
    lone = of.where("label is null").join(asked, "gid", "left_semi").select("sid", "bits", "n")
    unions = scratch.write(unions.unionByName(lone), "unions")
    opened = _with(_with(pairs, sets, "a", "n", "bits"), unions, "b", "n", "bits")
    opened = scratch.write(_bounded(opened, percent), "opened")
    inside = opened.withColumnRenamed("b", "gid").join(of.select("gid", F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits")), "gid")
    inside = _with(inside, sets, "a", "n", "bits").where(f"an * {percent} <= bn * 100 and bn * {percent} <= an * 100")
    inside = _bounded(inside, percent).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    inside = scratch.write(inside, "inside")
    wanted = sets.join(inside.select(F.col("a").alias("sid")).union(inside.select("b")).distinct(), "sid").select("sid", "rep")
    tokens = scratch.write(_tokens(docs, wanted, n, scratch, "filter-2"), "tokens-2")
    far = scratch.write(_linked(_with(_with(inside, tokens, "a", "tokens"), tokens, "b", "tokens"), percent), "far")
    scratch.drop("tokens-2", "pairs", "opened", "unions")

    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far)
    final = scratch.write(connected_components(links, scratch, "links"), "final")
    scratch.drop("sets", "inside", "blocks")
    owned = rows.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
    smallest = owned.where("c is not null").groupBy("c").agg(F.min("_key").alias("component_id"))
    return owned.join(smallest, "c", "left").select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"))
