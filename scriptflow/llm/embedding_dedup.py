"""Near-duplicate embeddings by a forest of random-projection trees.

Many trees split the vectors at random hyperplanes; vectors near a hyperplane go to both sides.
Upper splits are fitted on a bounded sample and route every vector; a task splits its leaf
further. Within leaves vectors are compared by cosine in double precision, and so many links as
connect what is linked are kept; those of all trees are united, and connected components give the
groups. How many vectors each one links with is then counted within its group, exactly, so a group
of any size costs a row a vector and task, never one a pair.

Only vectors of one label and one length are compared. Equal vectors are one vector throughout,
so exact copies cost nothing but their rows. A leaf or group too large for one task is cut into chunks of
which every two meet in one task. Vectors that are null, zero or hold null or non-finite
components, and those without a label, link with nothing. Repeated rows are separate vectors
that link with each other. A cosine of just the threshold links. Other columns may have any names; an
empty table gives an empty result. Recall is measured against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rp_forest
from .components import connected_components
from .distributed import hash_sample
from .scratch import Scratch

TREES, LEAF = 8, 192
#: Distance from a cut, for unit vectors, within which a vector goes to both sides.
SPILL = 0.02
#: Vectors that one task takes of a leaf of the fitted splits; larger leaves are cut into chunks.
CHUNK = 8_192
#: Vectors that a leaf of the fitted splits should have, about.
COARSE = 2_048


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _tree(near: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, block: int = 2048) -> np.ndarray:
    """Pairs of places 0..size-1 that connect what links connect, one pair a place at most. near: which of some places link with which of others."""
    free, found = np.ones(size, bool), [np.empty((0, 2), np.int64)]
    while free.any():
        front = np.flatnonzero(free)[:1]
        free[front] = False
        while len(front):
            reached = []
            for a in range(0, len(front), block):
                rows, rest = front[a : a + block], np.flatnonzero(free)
                if not len(rest):
                    break
                hit = near(rows, rest)
                some = hit.any(0)
                found.append(np.column_stack([rows[hit.argmax(0)[some]], rest[some]]))
                free[rest[some]] = False
                reached.append(rest[some])
            front = np.concatenate(reached) if reached else front[:0]
    return np.concatenate(found)


def _connecting(x: np.ndarray, ids: np.ndarray, least: float, side: np.ndarray | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within the leaves of a task's vectors; with side, only between rows of different sides."""
    norms = np.linalg.norm(x, axis=1)
    found = [np.empty((0, 2), np.int64)]
    for idx in rp_forest.leaves(x / norms[:, None], LEAF, SPILL, np.random.default_rng(seed)):

        def near(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            r, c = idx[rows], idx[cols]  # noqa: B023
            hit = (x[r] @ x[c].T) / (norms[r][:, None] * norms[c]) >= least
            return hit if side is None else hit & (side[r][:, None] != side[c])

        if len(idx) <= 2 * LEAF:  # most leaves hold no or few links: one product tells
            every = near(np.arange(len(idx)), np.arange(len(idx)))
            np.fill_diagonal(every, False)
            linked = np.flatnonzero(every.any(0))
            if len(linked):
                found.append(idx[linked[_tree(lambda r, c: every[np.ix_(linked[r], linked[c])], len(linked))]])  # noqa: B023
        else:
            found.append(idx[_tree(near, len(idx))])
    both = ids[np.unique(np.concatenate(found), axis=0)]
    return both[:, 0], both[:, 1]


def _degrees(x: np.ndarray, n: np.ndarray, least: float, side: np.ndarray | None) -> np.ndarray:
    """For each row the copies (n) of the others that it links with; with side, only those of the other side."""
    norms, out = np.linalg.norm(x, axis=1), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1024):
        rows = slice(a, a + 1024)
        hit = (x[rows] @ x.T) / (norms[rows][:, None] * norms) >= least
        if side is not None:
            hit &= side[rows][:, None] != side
        else:
            hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
        out[rows] = hit @ n
    return out


def _chunked(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds i, j and side, and k, the number of chunks of the row's group: a group of more than CHUNK rows is cut into chunks of which every two meet."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k")).where("k > 1")
    counts = scratch.write(counts, name)
    placed = rows.join(F.broadcast(counts) if counts.limit(10_000).count() < 10_000 else counts, by, "left")
    chunk = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j"), chunk.alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    return placed.withColumn("m", F.explode(F.when(F.col("k") > 1, meets).otherwise(alone))).select("*", "m.i", "m.j", "m.side").drop("m")


def degrees(vectors: DataFrame, groups: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(id, others): the copies of other vectors that each vector in a group links with. All links lie within groups, so
    counting them there is exact; a task takes some small groups, or two chunks of a large one, and gives a row a vector."""
    rows = vectors.join(groups, "id").select("id", "n", "vec", "component")
    buckets = rows.count() // COARSE + 1
    placed = _chunked(rows, ["component"], scratch, "large")
    task = F.when(F.col("k") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("component")
        component, dims = table["component"].to_numpy(), table["vec"]
        cuts = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True])
        side = table["side"].to_numpy() if key[1].as_py() != key[2].as_py() else None
        n, found = table["n"].to_numpy(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.append(_degrees(matrix(dims.slice(a, b - a).combine_chunks()), n[a:b], least, None if side is None else side[a:b]))
        return pa.table({"id": table["id"], "others": pa.array(np.concatenate(found), pa.int64())})

    return placed.select(task.alias("task"), "i", "j", "side", "component", "id", "n", "vec").groupBy("task", "i", "j").applyInArrow(count, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def links(vectors: DataFrame, least: float, scratch: Scratch, trees: int = TREES) -> DataFrame:
    """(a, b): ids of linked vectors, as many pairs as connect what the trees find. vectors: id long, vec array<double>, cell (label)."""
    stats = vectors.groupBy("cell", F.size("vec").alias("dim")).count()
    sizes = stats.groupBy("dim").agg(F.max("count").alias("n")).collect()
    out = None
    for row in sorted(sizes):
        dim, most = row["dim"], row["n"]
        same = vectors.where(F.size("vec") == dim)
        sample = hash_sample(same.select("id", "vec"), "id", rp_forest.SAMPLE).select("vec").toPandas()["vec"]
        x = np.array(sample.tolist(), np.float64).reshape(len(sample), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        depth = int(np.clip(np.ceil(np.log2(max(1, most / COARSE))), 0, max(0, np.log2(max(1, len(x) / 4)))))
        forest = same.sparkSession.sparkContext.broadcast(rp_forest.fit(x, trees, depth, 8))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2000):
                    part = batch.slice(start, 2000)
                    v = matrix(part.column(1))
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    for t, tree in enumerate(forest.value):  # noqa: B023
                        rows, leaf = tree.route(unit, SPILL)
                        taken = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf.astype(np.int32))], names=["id", "vec", "cell", "tree", "leaf"])

        kind = same.schema["cell"].dataType.simpleString()
        routed = scratch.write(same.select("id", "vec", "cell").mapInArrow(route, f"id long, vec array<double>, cell {kind}, tree int, leaf int"), f"routed-{dim}")
        placed = _chunked(routed, ["cell", "tree", "leaf"], scratch, f"large-{dim}").select("cell", "tree", "leaf", "i", "j", "side", "id", "vec")

        def compare(key: tuple, table: pa.Table) -> pa.Table:
            i, j = key[3].as_py(), key[4].as_py()
            side = table["side"].to_numpy() if i != j else None
            p, q = _connecting(matrix(table["vec"].combine_chunks()), table["id"].to_numpy(), least, side, 7 * key[1].as_py() + 1)
            return pa.table({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

        found = placed.groupBy("cell", "tree", "leaf", "i", "j").applyInArrow(compare, "a long, b long")
        out = found if out is None else out.union(found)
    if out is None:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return out.distinct()


def deduplicate(table: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES) -> DataFrame:
    """key, n_links (vectors linked directly), component_id (smallest key that links lead to) and kept (key = component_id) per row."""
    scratch = Scratch(table.sparkSession, "embeddings")
    rows = table.select(table[key].cast("long").alias("_key"), table[vector].cast("array<double>").alias("vec"), table[label].alias("cell"))
    good = usable(F.col("vec")) & F.col("cell").isNotNull()
    rows = rows.withColumn("id", F.when(good, F.xxhash64("cell", "vec")))
    rows = scratch.write(rows, "rows")
    copies = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("cell").alias("cell"))
    vectors = scratch.write(copies, "vectors")
    found = scratch.write(links(vectors, least, scratch, trees), "links")
    groups = scratch.write(connected_components(found, scratch, "groups").withColumnRenamed("node", "id"), "placed")
    degree = degrees(vectors, groups, least, scratch)
    placed = vectors.select("id", "n").join(degree, "id", "left").join(groups, "id", "left")
    placed = placed.select("id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"))
    own = rows.select("_key", "id").join(placed, "id", "left")
    smallest = own.where("c is not null").groupBy("c").agg(F.min("_key").alias("least"))
    out = own.join(smallest, "c", "left").withColumn("component_id", F.coalesce("least", "_key"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))
