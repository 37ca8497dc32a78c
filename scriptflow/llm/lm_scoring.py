"""Cross-entropy difference scores from two matched n-gram models.

The background model counts the words and word pairs of all documents, the target model those of
the target documents. Every word (A-Z in lower case) and every pair has a count of its own, by a
63-bit hash, in tables that grow with the corpus: texts are packed into slices, each slice asks for
the keys it holds, keys are dealt by their leading bits, added up, and the sums go back to the
slices that asked. A key that is in many texts is sent once by each slice. The driver gets three sums.

The models are matched: they share the vocabulary of all documents, and background counts are scaled
to the target's total, so that smoothing weighs the same in both. A text with words is the sequence
of its words and an end; each is predicted from the one before, the first from an end. Its loss is -log2
of the probability interpolated from its pair, its word and a uniform share. Every context is followed
by one thing, so the probabilities behind each context add up to 1 over the vocabulary, and losses are
cross-entropies. A document's score is its mean target loss minus its mean background loss, the
end included, so the lower, the more like the target.

Null and wordless texts have 0 tokens and null losses. Without target documents both models are
uniform there and scores follow the background alone. Repeated rows count as often as they occur, and
a repeated or null key in the table of targets changes nothing. A very long text is a slice of its
own. There are no ties; other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters, kernel
from .scratch import Scratch

#: Words that the uniform share is spread over at least; over all distinct words if there are more.
WORDS = 1 << 18
#: Weight of a pair's smoothing by its word, of a word's by the uniform share.
PAIR_MASS, WORD_MASS = 20.0, 0.1
#: Bytes of text in a slice, at most for each group of keys, and the least number of groups as a power of 2.
_SLICE, _GROUP, _BITS = 4 << 20, 8 << 20, 8
_ODD = np.uint64(1)
#: The key of a text's end, which is also what stands before its first word.
_END = np.uint64(0x5851F42D4C957F2C)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their place, compressed."""
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _texts(row: dict) -> pa.Array:
    """The texts of a slice."""
    offsets = _unpacked(row["offsets"]).astype(np.int64)
    data = pa.decompress(row["data"], int(offsets[-1]), "zstd") if offsets[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), data])


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys (even) with an end behind each text that has words, pair keys (odd) of each with what stands before it, and words by text."""
    words, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, data, offsets in kernel.slices(texts):
        w = kernel.words(data, offsets)
        words.append(np.insert(w.hashes(lower=True) & ~_ODD, w.first[1:][w.counts > 0], _END))
        counts.append(w.counts)
    keys = np.concatenate(words)
    before = np.r_[_END, keys[:-1]] if len(keys) else keys
    return keys, kernel.mix(before * np.uint64(3) + keys) | _ODD, np.concatenate(counts)


def _slices(texts: DataFrame, kind: T.DataType) -> DataFrame:
    """Texts packed into slices: sid, keys, target (a byte for each text), offsets, data, size. Slices have random ids, so they are to be written once."""
    schema = T.StructType([T.StructField("sid", T.StringType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("target", "offsets", "data")), T.StructField("size", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = np.array(batch.column(2).to_pylist(), np.uint8)
            for i, j, data, offsets in kernel.slices(batch.column(1), _SLICE):
                keys = batch.column(0).slice(i, j - i)
                one = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.concat_arrays([keys]))
                blobs = [target[i:j].tobytes(), _packed(offsets), pa.compress(data.tobytes(), "zstd", asbytes=True)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), one, *(pa.array([b], pa.binary()) for b in blobs), pa.array([len(data)], pa.int64())], names=schema.names)

    return texts.select("_key", "_text", "_target").mapInArrow(pack, schema)


def _asked(slices: DataFrame, bits: int) -> DataFrame:
    """What each slice asks of each group of keys: its distinct keys in order, as differences, and how often it and its target texts have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, pairs, counts = _keys(_texts(row))
                if not len(words):
                    continue
                chosen = np.repeat(np.frombuffer(row["target"], np.uint8), counts + (counts > 0))
                keys, at, n = np.unique(np.concatenate([words, pairs]), return_inverse=True, return_counts=True)
                hits = np.bincount(at, weights=np.concatenate([chosen, chosen]), minlength=len(keys))
                group = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                parts = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
                blobs = ([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts], [_packed(n[a:b]) for a, b in parts], [_packed(hits[a:b]) for a, b in parts])
                yield pa.RecordBatch.from_arrays([pa.array([row["sid"]] * len(parts), pa.string()), pa.array(group[cuts]), *(pa.array(b, pa.binary()) for b in blobs)], names=["sid", "part", "keys", "n", "hits"])

    return slices.select("sid", "target", "offsets", "data").mapInArrow(ask, "sid string, part long, keys binary, n binary, hits binary")


def _answer(table: pa.Table) -> pa.Table:
    """The sums of a group's keys for each slice that asked; the first row has the group's words, and their sums."""
    asked = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    ends = np.cumsum([len(x) for x in asked])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([_unpacked(x) for x in table.column(c).to_pylist()]), minlength=len(keys)).astype(np.int64) for c in ("n", "hits")]
    word = (keys & _ODD) == 0
    rows = table.num_rows
    told = [[int(x), *[0] * (rows - 1)] for x in (word.sum(), sums[0][word].sum(), sums[1][word].sum())]
    back = [pa.array([_packed(s[x]) for x in np.split(at, ends[:-1])], pa.binary()) for s in sums]
    return pa.table([table.column("sid"), table.column("part"), *back, *(pa.array(x, pa.int64()) for x in told)], names=["sid", "part", "n", "hits", "vocabulary", "total", "chosen"])


def _losses(words: np.ndarray, pairs: np.ndarray, scale: float, whole: float, vocabulary: int) -> np.ndarray:
    """-log2 of each word's probability, from the counts of its word, of its pair and of the word before."""
    words, pairs = words * scale, pairs * scale
    before = np.r_[words[-1:], words[:-1]]  # the last is an end, and so is what stands before the first
    share = (words + WORD_MASS) / (whole + WORD_MASS * vocabulary)
    return -np.log2((pairs + PAIR_MASS * share) / (before + PAIR_MASS))


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss and score. target: (key) of target documents."""
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    wanted = target.select(target[key].alias("_wanted")).where("_wanted is not null").distinct()
    marked = filters.mark(texts, F.xxhash64("_key"), wanted, F.xxhash64("_wanted"), scratch, "filter")
    near = marked.where("_maybe").join(wanted, F.col("_key") == F.col("_wanted"), "left").select("_key", "_text", F.col("_wanted").isNotNull().alias("_target"))
    flagged = near.union(marked.where("not _maybe").select("_key", "_text", F.lit(False)))
    kind = docs.schema[key].dataType
    slices = scratch.write(_slices(flagged, kind), "slices")
    size = slices.agg(F.sum("size")).first()[0] or 0
    bits = max(_BITS, (size // _GROUP).bit_length())
    answers = scratch.write(_asked(slices, bits).groupBy("part").applyInArrow(_answer, "sid string, part long, n binary, hits binary, vocabulary long, total long, chosen long"), "answers")
    vocabulary, total, chosen = (x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("total"), F.sum("chosen")).first())
    vocabulary, whole = max(WORDS, vocabulary), max(float(chosen), 1.0)
    # without target words the target's counts are all 0, and so is its total
    models = ((1.0, float(chosen)), (whole / max(total, 1), whole if total else 0.0))
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score"))])

    def run(slice_: pa.Table, told: pa.Table) -> pa.Table:
        row = slice_.select(["target", "offsets", "data"]).to_pylist()[0]
        words, pairs, n = _keys(_texts(row))
        keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        told = told.sort_by("part")
        events = n + (n > 0)
        first, means = np.concatenate([[0], np.cumsum(events)]), []
        for column, (scale, all_) in zip(("hits", "n"), models, strict=True):
            sums = np.concatenate([np.empty(0, np.uint64), *(_unpacked(x) for x in told.column(column).to_pylist())]).astype(np.float64)
            if len(sums) != len(keys):
                raise ValueError(f"{len(sums)} counts for {len(keys)} keys")
            own = sums[at]
            losses = np.concatenate([[0.0], np.cumsum(_losses(own[: len(words)], own[len(words) :], scale, all_, vocabulary))])
            means.append(np.diff(losses[first]) / np.maximum(events, 1))
        none = n == 0
        values = slice_.column("keys").combine_chunks().flatten()
        return pa.table([values, pa.array(n, pa.int64()), *(pa.array(x, mask=none) for x in (*means, means[0] - means[1]))], names=schema.names)

    return slices.drop("size").groupBy("sid").cogroup(answers.select("sid", "part", "n", "hits").groupBy("sid")).applyInArrow(run, schema)
