"""Approximate nearest neighbours by inner product on a graph from NN-descent.

Every distinct vector is a node with a list of its best neighbours so far. Lists start from the
leaves of random-projection trees (whose upper splits come from a bounded sample; every vector is
indexed). Then rounds follow: around each node, its neighbours and a sample of the nodes that list
it are compared with each other, and what beats an entry of either's list is merged in, until few
lists change. Each round is one Spark job in which packed blocks of nodes are joined three times:
listings with the listed, vectors with the nodes around which they meet, finds with their lists.

A query starts from the list of its own vector and searches greedily: the best nodes not yet
expanded send all their neighbours to be scored, until the best `beam` nodes are all expanded.
What was found is scored again in double precision on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
without an id. Equal vectors are one node with its smallest k + 1 ids, so copies and ties between
them cost nothing; other ties go to the smaller id. Repeated rows are separate candidates, so an id may
come up once for each of its rows. Vectors of different lengths are searched apart. Other columns may have any names. An empty
table gives an empty result. Recall is measured against brute force in the tests.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, rp_forest
from .distributed import hash_sample, ranked
from .embedding_dedup import matrix, usable
from .scratch import Scratch

#: Entries of a node's list, and nodes listing it that take part around it, at most.
NEIGHBOURS, REVERSE = 48, 48
#: Trees and leaf size of the start; entries that each leaf gives.
TREES, LEAF, START = 6, 400, 24
#: Rounds end when a smaller share of entries changes.
SETTLED = 0.02
#: Best nodes that a search keeps, and expands at once.
BEAM, EXPAND = 96, 48
#: Nodes of a block, about.
BLOCK = 4_096

_STATE, _LISTING, _MEMBER, _FIND, _QUERY, _ASK, _SCORE, _COUNT = range(8)
_SCHEMA = "blk int, kind int, n int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"
_KINDS = {
    _STATE: (np.int64, np.float32, np.int64, np.float32, np.uint8),  # node, vector, list, scores, query
    _LISTING: (np.int64, np.int64),  # listed, by
    _MEMBER: (np.int64, np.float32, np.float32, np.int64, np.int64),  # node, vector, worst score, count of centres, centres (~centre: it listed the node)
    _FIND: (np.int64, np.int64, np.float32),  # node, other, score
    _QUERY: (np.int64, np.float32, np.int64, np.float32, np.uint8),  # node, vector, beam, scores, expanded
    _ASK: (np.int64, np.float32, np.float32, np.int64, np.int64),  # query, vector, worst score, count of nodes, nodes
    _SCORE: (np.int64, np.float32, np.float32, np.int64, np.int64),  # query, vector, worst score, count of candidates, candidates
    _COUNT: (np.int64,),
}


class _Rows:
    """Packed rows going out, in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, blk: int, kind: int, *arrays: np.ndarray) -> None:
        packed = [np.ascontiguousarray(a.astype(k, copy=False)).tobytes() for a, k in zip(arrays, _KINDS[kind], strict=True)]
        self.rows.append((int(blk), kind, len(arrays[0]), *packed, *[None] * (5 - len(packed))))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in range(8)]
        self.rows = []
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["blk", "kind", "n", *(f"c{k}" for k in range(5))])


def _read(batches: Iterator[pa.RecordBatch], pass_on: list[pa.RecordBatch] | None = None, passed: tuple[int, ...] = ()) -> dict[int, dict[int, list[np.ndarray]]]:
    """Arrays by block and kind, joined over rows; kinds in passed are kept as they are instead."""
    got: dict[int, dict[int, list[list[np.ndarray]]]] = defaultdict(dict)
    for batch in batches:
        kinds = batch.column(1).to_pylist()
        for k, (blk, kind) in enumerate(zip(batch.column(0).to_pylist(), kinds, strict=True)):
            into = got[blk].setdefault(kind, [[] for _ in _KINDS[kind]])
            for to, column, dtype in zip(into, batch.columns[3:], _KINDS[kind], strict=False):
                to.append(np.frombuffer(column[k].as_buffer(), dtype))
    return {blk: {kind: [np.concatenate(c) for c in columns] for kind, columns in kinds.items()} for blk, kinds in got.items()}


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, flag: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most best distinct others of each owner 0..size-1 as matrices (others -1, scores -inf, flags 0 where missing)."""
    order = np.lexsort((-flag.astype(np.int8), other, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score, flag = owner[new], other[new], score[new], flag[new]
    order = np.lexsort((other, -score, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    kept = place < most
    ids = np.full((size, most), -1, np.int64)
    scores = np.full((size, most), -np.inf, np.float32)
    flags = np.zeros((size, most), np.uint8)
    ids[owner[kept], place[kept]], scores[owner[kept], place[kept]], flags[owner[kept], place[kept]] = other[kept], score[kept], flag[kept]
    return ids, scores, flags


def _few(listed: np.ndarray, by: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Of those that list a node REVERSE at most, by a hash of both and the turn."""
    mixed = by.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + listed.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn)
    order = np.lexsort((kernel.mix(mixed), listed))
    listed, by = listed[order], by[order]
    kept = np.arange(len(listed)) - np.searchsorted(listed, listed) < REVERSE
    return listed[kept], by[kept]


def _by_block(values: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, indices into values) of each block."""
    order = np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.r_[True, blocks[order][1:] != blocks[order][:-1], True]) if len(order) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(blocks[order[a]]), order[a:b]


def _send_grouped(out: _Rows, kind: int, owner: np.ndarray, target: np.ndarray, value: np.ndarray, ids: np.ndarray, vectors: np.ndarray, worst: np.ndarray, block_of: object) -> None:
    """To each block, the owners with values there: id, vector, worst score, count of values, values."""
    for blk, at in _by_block(target, block_of(target)):
        at = at[np.argsort(owner[at], kind="stable")]
        who, counts = np.unique(owner[at], return_counts=True)
        out.add(blk, kind, ids[who], vectors[who], worst[who], counts, value[at])


def _fresh_finds(out: _Rows, owner: np.ndarray, other: np.ndarray, score: np.ndarray, block_of: object) -> None:
    for blk, at in _by_block(owner, block_of(owner)):
        out.add(blk, _FIND, owner[at], other[at], score[at])


def _graph(nodes: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """The settled state: rows of kinds _STATE and _LISTING. nodes: node, vec, leaves, is_query."""
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BLOCK + 1)
    block_of = _Blocks(total, tasks)

    def start(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table["vec"].combine_chunks()).astype(np.float32)
        node, out = table["node"].to_numpy(), _Rows()
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        for idx in rp_forest.leaves(unit, LEAF, 0.0, np.random.default_rng(key[0].as_py())):
            for a in range(0, len(idx), LEAF):  # a leaf that no split parts is met in pieces
                part = idx[a : a + LEAF]
                score = x[part] @ x[part].T
                np.fill_diagonal(score, -np.inf)
                k = min(START, len(part) - 1)
                if k > 0:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    _fresh_finds(out, np.repeat(node[part], k), node[part][top].ravel(), np.take_along_axis(score, top, 1).ravel(), block_of)
        return pa.Table.from_batches([out.batch()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, x, out = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(np.float32), _Rows()
            query = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for blk, at in _by_block(node, block_of(node)):
                out.add(blk, _STATE, node[at], x[at], np.full((len(at), NEIGHBOURS), -1), np.full((len(at), NEIGHBOURS), -np.inf), query[at])
            yield out.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, kinds in _read(batches).items():
            node, x, ids, scores, query = kinds[_STATE]
            order = np.argsort(node)
            node, x, query = node[order], x.reshape(len(node), -1)[order], query[order]
            ids, scores = ids.reshape(len(node), -1)[order], scores.reshape(len(node), -1)[order]
            have = ids >= 0
            owner = np.repeat(np.arange(len(node)), have.sum(1))
            other, score = ids[have], scores[have]
            if _FIND in kinds:
                owner = np.concatenate([owner, np.searchsorted(node, kinds[_FIND][0])])
                other, score = np.concatenate([other, kinds[_FIND][1]]), np.concatenate([score, kinds[_FIND][2]])
            new, best, _ = _best(owner, other, score, np.zeros(len(owner), np.uint8), len(node), NEIGHBOURS)
            out = _Rows()
            for a in range(0, len(node), 1024):
                out.add(blk, _STATE, node[a : a + 1024], x[a : a + 1024], new[a : a + 1024], best[a : a + 1024], query[a : a + 1024])
            listed, by = new[new >= 0], np.repeat(node, (new >= 0).sum(1))
            listed, by = _few(listed, by, turn)  # so a hub's block gets so many of each block, not all that list it
            for to, at in _by_block(listed, block_of(listed)):
                out.add(to, _LISTING, listed[at], by[at])
            changed = int((np.sort(new, 1) != np.sort(ids, 1)).any(1).sum()) if not have.any() else int((~np.isin(new * np.int64(1 << 31) + np.arange(len(node))[:, None], ids * np.int64(1 << 31) + np.arange(len(node))[:, None])).sum())
            out.add(blk, _COUNT, np.array([changed]))
            yield out.batch()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            if _STATE not in kinds:
                continue
            node, x, ids, scores, _ = kinds[_STATE]
            order = np.argsort(node)
            node, x, ids = node[order], x.reshape(len(node), -1)[order], ids.reshape(len(node), -1)[order]
            worst = scores.reshape(len(node), -1)[order][:, -1]
            have, out = ids >= 0, _Rows()
            owner, centre = np.repeat(np.arange(len(node)), have.sum(1)), ids[have]
            value = centre
            if _LISTING in kinds:
                owner = np.concatenate([owner, np.searchsorted(node, kinds[_LISTING][0])])
                value = np.concatenate([value, ~kinds[_LISTING][1]])
                centre = np.concatenate([centre, kinds[_LISTING][1]])
            _send_grouped(out, _MEMBER, owner, centre, value, node, x, worst, block_of)
            yield out.batch()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            member, x, worst, counts, values = kinds[_MEMBER]
            x = x.reshape(len(member), -1)
            order = np.argsort(member, kind="stable")  # a node can come from one block only, in one row
            who = np.repeat(np.arange(len(member)), counts)
            listed = values < 0
            centre = np.where(listed, ~values, values)
            # a centre's own entries first (it listed them), then those that list it, in an order by hash that each round draws anew
            drawn = kernel.mix(member[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + centre.astype(np.uint64) + np.uint64(turn << 48))
            rank = np.where(listed, np.uint64(0), np.uint64(1) + (drawn >> np.uint64(1)))
            order = np.lexsort((rank, centre))
            who, centre, listed = who[order], centre[order], listed[order]
            cuts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1], True])
            own: list[np.ndarray] = []
            a_of, b_of, s_of, held, out = [], [], [], 0, _Rows()

            def flush() -> None:
                nonlocal a_of, b_of, s_of, held
                if a_of:
                    a, b, s = map(np.concatenate, (a_of, b_of, s_of))
                    key = np.unique(a * len(member) + b, return_index=True)[1]
                    a, b, s = a[key], b[key], s[key]
                    order = np.lexsort((-s, a))
                    a, b, s = a[order], b[order], s[order]
                    kept = np.arange(len(a)) - np.searchsorted(a, a) < NEIGHBOURS
                    a_of, b_of, s_of, held = [a[kept]], [b[kept]], [s[kept]], int(kept.sum())

            for c in range(len(cuts) - 1):
                m = who[cuts[c] : cuts[c + 1]]
                fixed = int(listed[cuts[c] : cuts[c + 1]].sum())
                m = np.unique(m[: fixed + REVERSE])
                g = x[m] @ x[m].T
                np.fill_diagonal(g, -np.inf)
                i, j = np.nonzero(g > worst[m][:, None])
                a_of.append(m[i])
                b_of.append(m[j])
                s_of.append(g[i, j])
                held += len(i)
                if held > 3_000_000:
                    flush()
            flush()
            del own
            if a_of:
                _fresh_finds(out, member[a_of[0]], member[b_of[0]], s_of[0], block_of)
            yield out.batch()

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "blk")

    turn = 0
    leaves = nodes.select(F.posexplode("leaves").alias("tree", "leaf"), "node", "vec")
    finds = leaves.groupBy("tree", "leaf").applyInArrow(start, _SCHEMA)
    state = nodes.select("node", "vec", "is_query").mapInArrow(pack, _SCHEMA)
    state = scratch.write(deal(state.union(finds)).mapInArrow(merge, _SCHEMA), "graph-0")
    while True:
        turn += 1
        around = deal(state.where(F.col("kind").isin(_STATE, _LISTING))).mapInArrow(meet, _SCHEMA)
        finds = deal(around).mapInArrow(join, _SCHEMA)
        state = scratch.write(deal(state.where(F.col("kind") == _STATE).union(finds)).mapInArrow(merge, _SCHEMA), f"graph-{turn}")
        scratch.drop(f"graph-{turn - 1}")
        counts = state.where(F.col("kind") == _COUNT).select("c0").collect()  # one number a block
        if sum(int(np.frombuffer(r["c0"], np.int64)[0]) for r in counts) <= SETTLED * total * NEIGHBOURS:
            return state


class _Blocks:
    """The block of a node; nodes of one leaf of the first tree have neighbouring numbers, so mostly one block."""

    def __init__(self, total: int, blocks: int):
        self.size, self.blocks = max(1, -(-total // blocks)), blocks

    def __call__(self, node: np.ndarray) -> np.ndarray:
        return node // self.size


def _search(state: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(q, node) for the beam of each query node, by greedy search on the graph."""
    tasks = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BLOCK + 1)
    block_of = _Blocks(total, tasks)
    graph = state.where(F.col("kind").isin(_STATE, _LISTING))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, kinds in _read(batches).items():
            node, x, ids, scores, query = kinds[_STATE]
            at, out = np.flatnonzero(query), _Rows()
            if len(at):
                beam, best = np.full((len(at), BEAM), -1, np.int64), np.full((len(at), BEAM), -np.inf, np.float32)
                beam[:, :NEIGHBOURS], best[:, :NEIGHBOURS] = ids.reshape(len(node), -1)[at], scores.reshape(len(node), -1)[at]
                out.add(blk, _QUERY, node[at], x.reshape(len(node), -1)[at], beam, best, np.zeros(beam.shape))
            yield out.batch()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            node, x, beam, best, done = kinds[_QUERY]
            beam, done, out = beam.reshape(len(node), BEAM), done.reshape(len(node), BEAM), _Rows()
            open_ = (beam >= 0) & (done == 0)
            open_ &= np.cumsum(open_, axis=1) <= EXPAND
            owner = np.repeat(np.arange(len(node)), open_.sum(1))
            _send_grouped(out, _ASK, owner, beam[open_], beam[open_], node, x.reshape(len(node), -1), best.reshape(len(node), BEAM)[:, -1], block_of)
            yield out.batch()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            if _ASK not in kinds:
                continue
            node, _, ids, _, _ = kinds[_STATE]
            listed, by = kinds.get(_LISTING, (np.empty(0, np.int64), np.empty(0, np.int64)))
            listed, by = _few(listed, by, 0)
            have = ids.reshape(len(node), -1) >= 0
            start = np.concatenate([np.repeat(node, have.sum(1)), listed])
            end = np.concatenate([ids[ids >= 0], by])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
            query, x, worst, counts, wanted = kinds[_ASK]
            x, out = x.reshape(len(query), -1), _Rows()
            owner = np.repeat(np.arange(len(query)), counts)
            first, n = np.searchsorted(start, wanted), np.searchsorted(start, wanted, "right") - np.searchsorted(start, wanted)
            cuts = np.searchsorted(owner, np.arange(0, len(query) + 1, 256))
            for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):  # some queries at a time
                if a == b:
                    continue
                size = n[a:b]
                at = np.repeat(first[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                pair = np.unique(np.repeat(owner[a:b], size) * total + end[at])
                _send_grouped(out, _SCORE, pair // total, pair % total, pair % total, query, x, worst, block_of)
                yield out.batch()
            yield out.batch()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            if _SCORE not in kinds:
                continue
            node, x = kinds[_STATE][0], kinds[_STATE][1]
            order = np.argsort(node)
            node, x = node[order], x.reshape(len(order), -1)[order]
            query, v, worst, counts, values = kinds[_SCORE]
            v, out = v.reshape(len(query), -1), _Rows()
            owner = np.repeat(np.arange(len(query)), counts)
            for a in range(0, len(values), 200_000):
                own, other = owner[a : a + 200_000], values[a : a + 200_000]
                got = np.einsum("ij,ij->i", v[own], x[np.searchsorted(node, other)])
                kept = (got > worst[own]) & (other != query[own])
                _fresh_finds(out, query[own][kept], other[kept], got[kept], block_of)
            yield out.batch()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, kinds in _read(batches).items():
            if _QUERY not in kinds:
                continue
            node, x, beam, best, done = kinds[_QUERY]
            order = np.argsort(node)
            node, x = node[order], x.reshape(len(node), -1)[order]
            beam, best, done = (m.reshape(len(order), BEAM)[order] for m in (beam, best, done))
            open_ = (beam >= 0) & (done == 0)
            done = np.where(open_ & (np.cumsum(open_, axis=1) <= EXPAND), 1, done).astype(np.uint8)
            have = beam >= 0
            owner, other, s, flag = np.repeat(np.arange(len(node)), have.sum(1)), beam[have], best[have], done[have]
            if _FIND in kinds:
                owner = np.concatenate([owner, np.searchsorted(node, kinds[_FIND][0])])
                other, s = np.concatenate([other, kinds[_FIND][1]]), np.concatenate([s, kinds[_FIND][2]])
                flag = np.concatenate([flag, np.zeros(len(kinds[_FIND][0]), np.uint8)])
            beam, best, done = _best(owner, other, s, flag, len(node), BEAM)
            out = _Rows()
            out.add(blk, _QUERY, node, x, beam, best, done)
            out.add(blk, _COUNT, np.array([int(((beam >= 0) & (done == 0)).sum())]))
            yield out.batch()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            node, _, beam, _, _ = kinds[_QUERY]
            have = beam.reshape(len(node), BEAM) >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, have.sum(1))), pa.array(beam[beam >= 0])], names=["q", "node"])

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "blk")

    queries = scratch.write(graph.where(F.col("kind") == _STATE).mapInArrow(begin, _SCHEMA), "search-0")
    turn = 0
    while True:
        turn += 1
        asked = queries.where(F.col("kind") == _QUERY).mapInArrow(ask, _SCHEMA)
        wider = deal(graph.union(asked)).mapInArrow(expand, _SCHEMA)
        scored = deal(graph.where(F.col("kind") == _STATE).union(wider)).mapInArrow(score, _SCHEMA)
        queries = scratch.write(deal(queries.where(F.col("kind") == _QUERY).union(scored)).mapInArrow(gather, _SCHEMA), f"search-{turn}")
        scratch.drop(f"search-{turn - 1}")
        left = queries.where(F.col("kind") == _COUNT).select("c0").collect()
        if not sum(int(np.frombuffer(r["c0"], np.int64)[0]) for r in left):
            break
    return queries.where(F.col("kind") == _QUERY).mapInArrow(found, "q long, node long")


def search(table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row for which is_query
    (over key) holds, nearest first, ties to the smaller id; never the query's own row. A query row
    that is repeated gives its result once."""
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = table.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(table[key].cast("long").alias("vec_id"), table[vector].cast("array<double>").alias("vec"), "_query")
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).withColumn("nid", F.xxhash64("vec"))
    rows = scratch.write(rows, "rows")
    vectors = rows.groupBy("nid").agg(F.first("vec").alias("vec"), F.max("_query").alias("is_query"))
    first = rows.select("nid", "vec_id", F.row_number().over(Window.partitionBy("nid").orderBy("vec_id")).alias("r")).where(F.col("r") <= k + 1)
    ids = first.groupBy("nid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = scratch.write(vectors.join(ids, "nid"), "vectors")
    pairs = None
    for dim in sorted(r["d"] for r in vectors.select(F.size("vec").alias("d")).distinct().collect()):
        same = vectors.where(F.size("vec") == dim)
        total = same.count()
        sample = np.array(hash_sample(same.select("nid", "vec"), "nid", rp_forest.SAMPLE).select("vec").toPandas()["vec"].tolist(), np.float64).reshape(-1, dim)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        depth = int(np.clip(np.ceil(np.log2(max(1, total / (4 * LEAF)))), 0, max(0, np.log2(max(1, len(sample) / 4)))))
        forest = spark.sparkContext.broadcast(rp_forest.fit(sample, TREES, depth, 10))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                leaf = np.empty((len(x), TREES), np.int32)
                for t, tree in enumerate(forest.value):  # noqa: B023
                    at, to = tree.route(x, 0.0)
                    leaf[at, t] = to
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, leaf.size + 1, TREES), pa.int32()), pa.array(leaf.ravel()))], names=["nid", "vec", "is_query", "ids", "leaves"])

        routed = same.select("nid", "vec", "is_query", "ids").mapInArrow(route, "nid long, vec array<double>, is_query boolean, ids array<long>, leaves array<int>")
        nodes = ranked(routed, [F.get("leaves", 0), F.col("nid")], scratch, f"nodes-{dim}").withColumnRenamed("rank", "node")
        inner = Scratch(spark, f"graph-{dim}")
        beams = _search(_graph(nodes, total, inner), total, inner)
        own = nodes.where("is_query").select(F.col("node").alias("q"), "node")
        beams = beams.union(own)
        asked = nodes.select(F.col("node").alias("q"), F.col("nid").alias("qnid"), F.col("vec").alias("qvec"))
        product = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scored = beams.join(asked, "q").join(nodes.select("node", "vec", "ids"), "node").select("qnid", product.alias("score"), "ids", (F.col("q") == F.col("node")).alias("own"))
        pairs = scored if pairs is None else pairs.union(scored)
    if pairs is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = rows.where("_query").select(F.col("nid").alias("qnid"), F.col("vec_id").alias("query_id")).distinct()
    at = F.array_position("ids", F.col("query_id")).cast("int")
    others = F.when(F.col("own") & (at > 0), F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.size("ids")))).otherwise(F.col("ids"))
    flat = wanted.join(pairs, "qnid").select("qnid", "query_id", "score", F.explode(others).alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "qnid").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
