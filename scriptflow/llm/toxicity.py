"""Toxicity scores from a learned lexicon, matched with at most one typing error.

Words and word beginnings that labelled toxic documents have far more often than others form the
lexicon. It is kept as a trie; the Levenshtein automaton of distance one runs over the trie, and
the product is turned into one deterministic automaton over bytes, which reads all words of a
slice at once. A hit counts by its context: hits inside quotation marks are kept apart from
others, and the heaviest window of words tells a burst of abuse from a single mention. A
logistic model over these few figures gives the score.

Words are runs of letters, digits and bytes beyond ASCII, in lower case (ASCII and Latin-1). Null
and empty texts have no hits and get the score of a text without any. Lexicon and model come
from at most `most` labelled ids, those with the smallest hash, with one text each (of several, the
one with the smallest hash): that is the one bound. An id with both labels counts for both. All
texts are scored whole, very long ones in a slice of their own; repeated rows get their score each,
rows with a null id too. Scores that tie are equal; other columns may have any names. Without
labelled rows every text scores 0.5, and an empty table gives an empty result.

Words that begin like a learned beginning are matched by that beginning, also with an error behind
it; an error within a whole word is allowed in words of 5 letters or more that 2 % of the toxic
training documents hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .distributed import hash_sample
from .scratch import Scratch

#: At most so many labelled rows train lexicon and model.
TRAIN_ROWS = 20_000
#: A term is in at least so many toxic training documents, and at least this log odds ratio apart.
MIN_DOCS, MIN_LOG_ODDS = 4, 2.5
#: Beginnings have 3 to 8 characters. Words of 5 or more that this share of the toxic documents has
#: are also matched with one error; an invented or chance word isn't.
STEM_CHARS, FUZZY_CHARS, FUZZY_SHARE = range(3, 9), 5, 0.02
#: Words on either side of a hit that make its window.
CONTEXT = 8
FEATURES = ["hits", "near_hits", "stem_hits", "quoted", "density", "window"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals in lower case."""
    out = _LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first token of each text."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = _IN_WORD[data]
    start, end = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] |= inner[1:-1][cuts]
    end[cuts - 1] |= inner[1:-1][cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


class Automaton:
    """A deterministic automaton over bytes for whole words, whole words with one error, and beginnings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], common: set[str] | None = None):
        children: list[dict[int, int]] = [{}]
        inner = [False]  # inside a character of several bytes
        word: dict[int, float] = {}
        stem: dict[int, float] = {}
        fuzzy: set[int] = set()
        for terms, weights in ((words, word), (stems, stem)):
            for term, weight in terms.items():
                node = 0
                raw = term.encode()
                for k, b in enumerate(raw):
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                        inner.append(k + 1 < len(raw) and 0x80 <= raw[k + 1] < 0xC0)
                    node = children[node][b]
                weights[node] = max(weight, weights.get(node, 0))
                if terms is words and len(term) >= FUZZY_CHARS and (common is None or term in common):
                    fuzzy.add(node)
        useful = set(fuzzy)  # nodes on the way to a word that may have an error
        for node in range(len(children) - 1, -1, -1):
            if any(c in useful for c in children[node].values()):
                useful.add(node)

        def next_chars(node: int) -> list[int]:
            out, todo = [], list(children[node].values())
            while todo:
                n = todo.pop()
                (todo.extend(children[n].values()) if inner[n] else out.append(n))
            return [n for n in out if n in useful]

        jumps = [next_chars(n) if n in useful and not inner[n] else [] for n in range(len(children))]
        used = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int32)
        self.classes[0x80:0xC0] = 1
        self.classes[0xC0:] = 2
        for k, b in enumerate(used):
            self.classes[b] = 3 + k
        symbols = [(65, False), (0x80, True), (0xC0, False), *((b, 0x80 <= b < 0xC0) for b in used)]
        names = [None, None, None, *used]

        def close(states: set) -> frozenset:
            out = set(states)
            for node, errors, skip in states:
                if node >= 0 and not errors and not inner[node]:
                    out |= {(n, 1, False) for n in jumps[node]}
            return frozenset(out)

        def step(states: frozenset, k: int) -> frozenset:
            byte, tail = names[k], symbols[k][1]
            out = set()
            for node, errors, skip in states:
                if node < 0:
                    out.add((node, 0, False))
                    continue
                if skip and tail:
                    out.add((node, errors, True))
                    continue
                if byte is not None and byte in children[node]:
                    n = children[node][byte]
                    if not errors and n in stem:
                        out.add((-1 - n, 0, False))
                    if not errors or n in useful:
                        out.add((n, errors, False))
                if not errors and not tail and not inner[node] and node in useful:
                    out.add((node, 1, True))
                    out |= {(n, 1, True) for n in jumps[node]}
            return close(out)

        start, dead = close({(0, 0, False)}), frozenset()
        ids, order, rows = {dead: 0, start: 1}, [dead, start], []
        for states in order:
            row = []
            for k in range(len(symbols)):
                to = step(states, k)
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
            rows.append(row)
        self.next = np.array(rows, np.int32)
        self.word, self.near, self.stem = (np.zeros(len(order), np.float32) for _ in range(3))
        for k, states in enumerate(order):
            for node, errors, _ in states:
                if node < 0:
                    self.stem[k] = max(self.stem[k], stem[-1 - node])
                elif node in word and not errors:
                    self.word[k] = max(self.word[k], word[node])
                elif node in fuzzy and errors:
                    self.near[k] = max(self.near[k], word[node])
        self.longest = max((len(t.encode()) for t in [*words, *stems]), default=0) + 4

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last state of each token; tokens too long for any word keep what their beginning found."""
        state = np.ones(len(starts), np.int32)
        size, live = ends - starts, np.arange(len(starts))
        classes = self.classes[data]
        for i in range(self.longest):
            live = live[size[live] > i]
            if not len(live):
                break
            now = self.next[state[live], classes[starts[live] + i]]
            state[live] = now
            live = live[now > 0]
        long = size > self.longest
        state[long & (self.stem[state] == 0)] = 0
        return state


def quoted(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether places lie within quotation marks: an odd number of plain ones since the line's start, or open paired ones."""
    plain = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 34, out=plain[1:])
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[1:] |= data == 10
    line = np.maximum.accumulate(np.where(first, np.arange(len(data) + 1), 0))
    change = np.zeros(len(data) + 1, np.int32)
    if len(data) > 2:
        curly = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
        change[np.flatnonzero(curly & (data[2:] == 0x9C)) + 1] += 1
        change[np.flatnonzero(curly & (data[2:] == 0x9D)) + 1] -= 1
    depth = np.cumsum(change)
    return ((plain[at] - plain[line[at]]) % 2 == 1) | (depth[at] - depth[line[at]] > 0)


def features(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    low = lowered(data)
    starts, ends, first = tokens(low, offsets)
    state = automaton.run(low, starts, ends)
    n, texts = np.diff(first), len(offsets) - 1
    weight = np.maximum(np.maximum(automaton.word[state], automaton.stem[state]), automaton.near[state] / 2)
    hit = np.flatnonzero(weight)
    owner = np.searchsorted(first, hit, "right") - 1
    inside = quoted(data, offsets, starts[hit])
    of = lambda mask: np.bincount(owner[mask], minlength=texts).astype(float)
    s = state[hit]
    exact, begins = automaton.word[s] > 0, (automaton.stem[s] > 0) & (automaton.word[s] == 0)
    near = ~exact & ~begins
    window = np.zeros(texts)
    if len(hit):
        sums = np.concatenate([[0], np.cumsum(np.where(inside, 0, weight[hit]))])
        a, b = np.searchsorted(hit, np.maximum(hit - CONTEXT, first[owner])), np.searchsorted(hit, np.minimum(hit + CONTEXT + 1, first[owner + 1]))
        np.maximum.at(window, owner, sums[b] - sums[a])
    return np.column_stack([np.log1p(of(exact & ~inside)), np.log1p(of(near & ~inside)), np.log1p(of(begins & ~inside)), np.log1p(of(inside)), np.log1p(100 * of(~inside) / np.maximum(n, 1)), np.log1p(window)])


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray  # the last one is the bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a figure that would count against is left out. Zeros without rows."""
    used = np.ones(x.shape[1] + 1, bool)
    full = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    while len(x):
        w[:] = 0
        part, penalty = full[:, used], np.full(used.sum(), ridge)
        penalty[-1], v = 1e-3, np.zeros(used.sum())
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(penalty), part.T @ (y - p) - penalty * v)
            v += step
            if np.abs(step).max() < 1e-6:
                break
        w[used] = v
        if (w[:-1] >= 0).all():
            break
        used[:-1] &= w[:-1] >= 0
    return w


def choose(counts: pd.DataFrame, toxic: int, other: int) -> tuple[dict[str, float], dict[str, float], set[str]]:
    """Words and beginnings with their log odds ratios, and the common words, from (term, n1, n0); beginnings end with *."""
    counts = counts.assign(w=np.log((counts["n1"] + 0.5) / (toxic + 1)) - np.log((counts["n0"] + 0.5) / (other + 1)))
    apart = counts[(counts["w"] >= MIN_LOG_ODDS) & (counts["n1"] >= MIN_DOCS)]
    is_stem = apart["term"].str.endswith("*")
    words = {r.term: (float(r.w), int(r.n1)) for r in apart[~is_stem].itertuples()}
    most: dict[str, int] = {}
    for term, (_, n1) in words.items():
        for k in STEM_CHARS:
            most[term[:k]] = max(n1, most.get(term[:k], 0))
    stems: dict[str, float] = {}
    for r in sorted(apart[is_stem].itertuples(), key=lambda r: (len(r.term), r.term)):
        stem = r.term[:-1]
        if not any(stem.startswith(s) for s in stems) and r.n1 > 1.3 * most.get(stem, 0):
            stems[stem] = float(r.w)
    words = {t: x for t, x in words.items() if not any(t.startswith(s) for s in stems)}
    return {t: w for t, (w, _) in words.items()}, stems, {t for t, (_, n1) in words.items() if n1 >= FUZZY_SHARE * toxic}


def _terms(text: str) -> set[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    low = lowered(data)
    starts, ends, _ = tokens(low, np.array([0, len(data)]))
    raw = low.tobytes()
    words = {raw[a:b].decode(errors="ignore") for a, b in zip(starts, ends, strict=True)}
    return words | {f"{w[:k]}*" for w in words for k in STEM_CHARS if len(w) >= k}


def sample(docs: DataFrame, labels: DataFrame, usable: Column, key: str, label: str, most: int) -> DataFrame:
    """(_text, y) of at most `most` labelled keys for which usable holds, one text each. The keys are few, so they are broadcast; the rows are written once."""
    marked = labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("y")).withColumn(key, F.col("_key")).where(usable).where("y is not null").select("_key", "y").distinct()
    marked = hash_sample(marked, "_key", most)
    labelled = docs.select(docs[key].alias("_doc"), docs["text"].cast("string").alias("_text")).join(F.broadcast(marked), F.col("_doc") == F.col("_key"))
    one = labelled.groupBy("_key", "y").agg(F.min_by(F.coalesce("_text", F.lit("")), F.xxhash64("_text")).alias("_text"))
    return Scratch(docs.sparkSession, "toxicity").write(one.select("_text", "y"), "sample")


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", label: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """Learns lexicon and weights. Without labelled rows every text scores 0.5."""
    rows = sample(docs, labels, usable, key, label, most)
    context = docs.sparkSession.sparkContext
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)

    def count(only: int | None, known: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            keep = known.value if known else None
            for batch in batches:
                for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    if only is None or y == only:
                        terms = _terms(text.as_py() or "")
                        found[y].update(terms & keep if keep is not None else terms)
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[y][t] for t in names], pa.int64()) for y in (1, 0))], names=["term", "n1", "n0"])

        return rows.where(F.col("y").isin(0, 1)).mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))

    least = max(MIN_DOCS, toxic // 500)
    frequent = {r["term"] for r in count(1, None).where(F.col("n1") >= least).select("term").collect()}
    counts = count(None, context.broadcast(frequent)).toPandas() if frequent else pd.DataFrame({"term": [], "n1": [], "n0": []})
    counts = counts[counts["n1"] >= least]
    automaton = Automaton(*choose(counts, toxic, other)) if len(counts) else Automaton({}, {})
    data = featurise(rows, [F.col("y")], "_text", automaton).toPandas()
    return Model(automaton, logistic(np.array(data["x"].tolist(), float).reshape(len(data), len(FEATURES)), data["y"].to_numpy(float)))


def featurise(docs: DataFrame, keys: list[Column], text: str, automaton: Automaton) -> DataFrame:
    return _apply(docs, keys, text, automaton, None)


def score(docs: DataFrame, model: Model, keys: list[Column], text: str = "text") -> DataFrame:
    """keys and score (0 to 1, higher: label 1 likelier) of every text."""
    return _apply(docs, keys, text, model.automaton, model)


def _apply(docs: DataFrame, keys: list[Column], text: str, automaton: Automaton, model: Model | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((automaton, model))
    kept = docs.select(*keys, docs[text].cast("string").alias("_t"))
    out = T.StructField("score", T.DoubleType()) if model else T.StructField("x", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*kept.schema.fields[:-1], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, model = sent.value
        for batch in batches:
            for i, j, data, offsets in kernel.slices(batch.column(batch.num_columns - 1)):
                x = features(data, offsets, automaton)
                last = pa.array(model.score(x)) if model else pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), last], names=schema.names)

    return kept.mapInArrow(run, schema)
