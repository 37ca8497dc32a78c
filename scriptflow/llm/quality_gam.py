"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after the other, on binned values, so that the
sum of a feature's trees is a lookup table over its bins; then pairs of features that explain
most of what is left get two-dimensional tables in the same way. Scoring adds table entries.

Features are shapes of the whole text, counted on its bytes and words; no identifier, language
or source goes in. Null texts count as empty and get a score like any other text; very long ones are
a slice of their own. Labels come from at most `most` rows, those with the smallest hash of their id:
that is the one bound. Repeated rows train and are scored each; rows with a null id are scored and
don't train; an id with both labels counts for both. Scores that tie are equal. The features' column
is named x, and score beside it, so those two names are taken; others may clash. Without labelled
rows every text scores 0.5, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .distributed import hash_sample

#: At most so many labelled rows train the model.
TRAIN_ROWS = 20_000

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": [10], "stop": [33, 46, 63], "comma": [44, 58, 59], "pipe": [124], "junk": [35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 123, 125, 126], "other": range(128, 256)}
_TABLES = {name: np.isin(np.arange(256), list(of)) for name, of in _CLASSES.items()}
FEATURES = ["log_words", "word_len", *(f"{k}_share" for k in _CLASSES), "again_share", "distinct_share", "bang_share", "long_share", "caps_words", "line_words"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    w = kernel.words(data, offsets)
    h, n = w.hashes(lower=True), w.counts.astype(float)
    size = np.diff(offsets).astype(float)
    safe_n, safe_size = np.maximum(n, 1), np.maximum(size, 1)

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[bounds]).astype(float)

    columns = [np.log1p(n), np.minimum(per_text(w.ends - w.starts, w.first) / safe_n, 100)]
    columns += [per_text(table[data], offsets) / safe_size for table in _TABLES.values()]
    text_of = np.repeat(np.arange(len(n)), w.counts)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    order = np.lexsort((h, text_of))
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[order][1:] != h[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    last, first = data[w.ends - 1], data[w.starts]
    caps = _TABLES["upper"][first] & (w.ends - w.starts > 1) & _TABLES["upper"][data[np.minimum(w.starts + 1, len(data) - 1)]] if len(h) else np.zeros(0, bool)
    columns += [per_text(again, w.first) / safe_n, per_text(new, w.first) / safe_n, per_text(last == 33, w.first) / safe_n, per_text(w.ends - w.starts > 20, w.first) / safe_n, per_text(caps, w.first) / safe_n, np.minimum(n / (per_text(data == 10, offsets) + 1), 1000)]
    return np.column_stack(columns)


@dataclass
class Gam:
    """Bias, and a lookup table for each feature and for some pairs of features."""

    edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), int)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a regression tree with so many leaves over ordered bins."""
    cuts, cg, ch = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gains = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(m[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)) for a, b in zip(cuts, cuts[1:], strict=False)])


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 150, pairs: int = 4, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Fits by cyclic boosting of the logistic loss. Without rows, every text scores 0.5; with one class only, near it."""
    if not len(x):
        return Gam([])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    bins = model.bins(x)
    logit = model.logits(bins)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            r, h = residual()
            step = rate * _tree(np.bincount(bins[:, j], r, len(table)), np.bincount(bins[:, j], h, len(table)), 3, ridge)
            table += step
            logit += step[bins[:, j]]
    shape = [len(t) for t in model.tables]

    def sums(a: int, b: int, r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = bins[:, a] * shape[b] + bins[:, b]
        return (np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (r, h))

    def pair_tree(a: int, b: int) -> tuple[float, np.ndarray]:
        """The best cut of a, then of b on either side: four leaves."""
        r, h = residual()
        g, s = sums(a, b, r, h)
        best: tuple[float, np.ndarray] = (0.0, np.zeros((shape[a], shape[b])))
        for cut in range(1, shape[a]):
            out, gained = np.zeros((shape[a], shape[b])), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                leaf = _tree(gs := g[side].sum(0), hs := s[side].sum(0), 2, ridge)
                out[side] = leaf
                gained += float((leaf * gs - leaf**2 * (hs + ridge / len(hs)) / 2).sum())
            if gained > best[0]:
                best = gained, out
        return best

    ordered = sorted(((pair_tree(a, b)[0], a, b) for a in range(len(shape)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gained, a, b in ordered[:pairs] if gained > 0]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * pair_tree(a, b)[1]
            table += step
            logit += step[bins[:, a], bins[:, b]]
    return model


def featurise(docs: DataFrame, keys: list[Column], text: str = "text") -> DataFrame:
    """keys and one array column x of FEATURES for every text."""
    kept = docs.select(*keys, docs[text].cast("string").alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kernel.slices(batch.column(batch.num_columns - 1)):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), lists], names=schema.names)

    return kept.mapInArrow(kernel.releasing(run), schema)


def train(features_of: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", label: str = "quality", most: int = TRAIN_ROWS) -> Gam:
    """Fits on labelled rows for which usable holds, a column over key; at most `most` rows, by hash of the key."""
    marked = labels.select(labels[key].alias("_key"), labels[label].cast("double").alias("y")).where("y is not null").distinct()
    rows = hash_sample(features_of.where(usable).join(marked, F.col(key) == F.col("_key")).select("x", "y", key), key, most).toPandas()
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def score(features_of: DataFrame, model: Gam) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) in place of x."""
    sent = features_of.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.concatenate(x.to_numpy()).reshape(len(x), len(FEATURES)) if len(x) else np.empty((0, len(FEATURES)))))

    return features_of.withColumn("score", scored("x")).drop("x")
