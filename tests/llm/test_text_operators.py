import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptflow.llm import kernel, license_scan, lm_scoring, ngram_jaccard, quality_gam, queries, sentencepiece_codec, source_mix, substring_dedup, toxicity

from . import helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x1c 𝒳", max_size=20), max_size=8), st.integers(1, 40))
def test_kernel_finds_words_and_hashes_them_alike(texts, budget):
    import pyarrow as pa

    got, hashes = [], {}
    for _, _, data, offsets in kernel.slices(pa.array(texts, pa.string()), budget):
        w = kernel.words(data, offsets)
        flat = [bytes(data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
        got += [flat[w.first[i] : w.first[i + 1]] for i in range(len(offsets) - 1)]
        for word, h in zip(flat, w.hashes(), strict=True):
            assert hashes.setdefault(word, h) == h
    assert got == [t.encode().split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_sliding_matches_plain():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 5, 26):
        assert kernel.sliding(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_is_exact(spark, seed):
    rows = helpers.corpus(seed)
    got = {}
    for r in ngram_jaccard.join(helpers.documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], (r["n_shingles"], r["component_id"]))
    sets = {i: helpers.shingles(t) for i, t in rows}
    want = helpers.components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 5


def test_jaccard_join_of_nothing_and_of_many_near_copies(spark):
    assert ngram_jaccard.join(helpers.documents(spark, [])).collect() == []
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: helpers.shingles(t) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.join(helpers.documents(spark, rows)).collect()}
    assert got == helpers.components(sets)


def test_null_ids_link_like_others(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q w e r t y")]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_jaccard.join(helpers.documents(spark, rows)).collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 5)])
def test_substring_dedup_is_exact_for_any_batches(spark, seed, batches, monkeypatch):
    if batches > 1:  # many slices, merged in two steps
        monkeypatch.setattr(substring_dedup, "SLICE", 2_000)
        monkeypatch.setattr(substring_dedup, "TOGETHER", 3)
    rows = helpers.corpus(seed)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring_dedup.deduplicate(helpers.documents(spark, rows), ["doc_id"], batches=batches, kept=True).collect())
    want = []
    for (i, _), (words, gone) in zip(rows, helpers.windows_removed([t for _, t in rows]), strict=True):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 300


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.deduplicate(helpers.documents(spark, []), ["doc_id"]).collect() == []


def test_index_compacts_its_runs_and_can_be_opened_again(spark, tmp_path):
    from scriptflow.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    docs = helpers.documents(spark, [(i, t) for i, (_, t) in enumerate(helpers.corpus(4))])
    packed = scratch.bucketed(substring_dedup.pack(docs.repartition(14), ["doc_id"], "text", 7), "slices", "sid", 4)
    prints = scratch.write(substring_dedup.fingerprints(packed), "prints")
    folder, hits, seen = f"file://{tmp_path}/index", [], 0
    for k in range(7):  # a fresh object each time, as a later job would have
        index = substring_dedup.FingerprintIndex(spark, folder, 3)
        part = prints.where(F.pmod("sid", F.lit(7)) == k)
        hits.append({r["m"] for r in index.add(part).collect()})
        seen += part.count()
        assert sum(r.count() for r in index.runs()) == seen
    index = substring_dedup.FingerprintIndex(spark, folder)
    assert index.buckets == 3 and [len(level) for level in index.levels] == [1, 2]
    want = {r["m"] for r in prints.groupBy("m").agg(F.count("*").alias("c"), F.max("many").alias("many")).where("c > 1 or many").collect()}
    assert set().union(*hits) == want and want
    history = index.runs()[-1].select("m").distinct()
    plan = history.join(index.runs()[0].select("m"), "m", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_windows_are_told_apart_by_both_hashes():
    these = np.array([[5, 1], [5, 2], [9, 9]], np.uint64)
    asked = np.array([[5, 2], [5, 3], [9, 9], [9, 8], [1, 1], [5, 1]], np.uint64)
    assert substring_dedup._among(asked, these).tolist() == [True, False, True, False, False, True]


def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    sources = ["b", "a", "é", None, "Z", "hot"]
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(sources) if i % 3 else "hot") for i in range(300)]
    rows += [(900, None, "a"), (901, "", "empty"), (5, rows[5][1], rows[5][2])]
    out = source_mix.mix(helpers.documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [r["positions"][0] for r in out if r["positions"]] == sorted(r["positions"][0] for r in out if r["positions"])
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) == -(-r["taken"] // r["size"]) if r["size"] else r["taken"] == 0
    want = helpers.mix_targets(sizes)
    for s, group in helpers.by_key(out, "source").items():
        assert {r["source_size"] for r in group} == {sizes[s]}
        assert group[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in group) - want[s]) <= 1
    again = source_mix.mix(helpers.documents(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert source_mix.mix(helpers.documents(spark, [])).collect() == []


def test_demand_is_inverted(spark):
    shares = [k / 20 for k in range(21)]
    for schedule in ((1.5, 1.0, 0.5), (0.0, 2.0), (1.0, 0.0, 0.0, 3.0)):
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r[0] for r in df.select(source_mix.invert_demand(F.col("s"), schedule)).collect()]
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        back = np.interp(got, grid, area / area[-1])
        assert back == pytest.approx(shares, abs=1e-4)


def labelled(spark, seed=2, n=500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "plain", "Words", "of", "text", "mill", "stone"]) + rng.choice(["", "s", ",", "."]) for _ in range(rng.randint(5, 60))]
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        if junk:
            words = [w + "%%%" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "nincompoop", "numbskull"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 5000)]
    return helpers.documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    x = quality_gam.featurise(docs, [docs["doc_id"]])
    model = quality_gam.train(x, labels, queries.fold("doc_id", 5) > 0)
    scores = {r["doc_id"]: r["score"] for r in quality_gam.score(x, model).collect()}
    held = [r for r in labels.where("quality is not null and doc_id is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good = [scores[r["doc_id"]] for r in held if r["quality"]]
    bad = [scores[r["doc_id"]] for r in held if not r["quality"]]
    assert min(good) > max(bad)
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 503
    empty = quality_gam.train(x.limit(0), labels, F.lit(True))
    assert {r["score"] for r in quality_gam.score(x, empty).collect()} == {0.5}


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, queries.fold("doc_id", 4) != 2)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, [docs["doc_id"]]).collect()}
    held = [r for r in labels.where("toxic is not null and doc_id is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert min(scores[r["doc_id"]] for r in held if r["toxic"]) > max(scores[r["doc_id"]] for r in held if not r["toxic"])
    more = helpers.documents(spark, [(1, "you blokhead"), (2, "you plain stone"), (3, 'the word "blockhead" is plain'), (4, "you blockhead blockhead")])
    s = {r["doc_id"]: r["score"] for r in toxicity.score(more, model, [more["doc_id"]]).collect()}
    assert s[4] > s[2] and s[1] >= s[2] and s[3] < s[4]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé", max_size=8))
def test_automaton_knows_words_within_one_error(text):
    words = ["abcab", "aébca", "bbbbbb", "cab"]
    a = test_automaton_knows_words_within_one_error.__dict__.setdefault("a", toxicity.Automaton(dict.fromkeys(words, 1.0), {"cc": 1.0}))
    data = np.frombuffer(text.encode(), np.uint8)
    state = a.run(data, np.array([0]), np.array([len(data)]))[0]
    assert (a.word[state] > 0) == (text in words)
    assert (a.stem[state] > 0) == text.startswith("cc")
    if not text.startswith("cc"):
        assert (a.near[state] > 0) == any(distance(text, w) == 1 for w in words if len(w) >= 5) or text in words


def test_lm_scores_match_plain_counts(spark):
    docs = helpers.documents(spark, [(1, "a b a b"), (2, "a b c"), (3, "x y z z"), (4, None), (5, " "), (1, "a b a b")])
    out = sorted((r.asDict() for r in lm_scoring.score(docs, spark.createDataFrame([(1,), (None,), (77,)], "doc_id long")).collect()), key=lambda r: r["doc_id"])
    assert [r["n_tokens"] for r in out] == [4, 4, 3, 4, 0, 0]
    assert out[-1]["score"] is None and out[-2]["target_loss"] is None
    assert out[0]["score"] < out[2]["score"] < out[3]["score"]
    total, words, pairs = 10.0, {"a": 4.0, "b": 4.0, "": 2.0}, {("", "a"): 2.0, ("a", "b"): 4.0, ("b", "a"): 2.0, ("b", ""): 2.0}

    def chance(before, w):
        share = (words.get(w, 0) + lm_scoring.WORD_MASS) / (total + lm_scoring.WORD_MASS * lm_scoring.WORDS)
        return (pairs.get((before, w), 0) + lm_scoring.PAIR_MASS * share) / (words.get(before, 0) + lm_scoring.PAIR_MASS)

    want = -np.log2([chance(x, y) for x, y in [("", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("b", "")]])
    assert out[0]["target_loss"] == pytest.approx(want.mean(), rel=1e-6)
    for before in ("", "a", "b", "never"):  # a distribution over the vocabulary
        assert sum(chance(before, w) for w in words) + (lm_scoring.WORDS - len(words)) * chance(before, "never") == pytest.approx(1)
    assert lm_scoring.score(docs.limit(0), docs.select("doc_id")).collect() == []


def test_lm_counts_of_rare_words_and_pairs_are_their_own(spark):
    """More distinct pairs than any table of fixed size that a model was given."""
    n, most = 2_400, 1_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {most}), k -> concat('w', id * {most} + k)), ' ')").alias("text"))
    out = lm_scoring.score(docs, docs.where("doc_id < 600").select("doc_id"))
    total, target, words = n * (most + 1), 600 * (most + 1), max(lm_scoring.WORDS, n * most + 1)

    def loss(pair, texts, scale):
        """The first word, behind any text's start; the others, each seen once if at all; the end."""
        p, t, share = pair * scale, texts * scale, lambda c: (c + lm_scoring.WORD_MASS) / (target + lm_scoring.WORD_MASS * words)
        chances = [(p + lm_scoring.PAIR_MASS * share(p)) / (t + lm_scoring.PAIR_MASS), *[(p + lm_scoring.PAIR_MASS * share(p)) / (p + lm_scoring.PAIR_MASS)] * (most - 1), (p + lm_scoring.PAIR_MASS * share(t)) / (p + lm_scoring.PAIR_MASS)]
        return -np.log2(chances).mean()

    seen = out.groupBy((F.col("doc_id") < 600).alias("t")).agg(F.count("*"), F.min("target_loss"), F.max("target_loss"), F.min("background_loss"), F.max("background_loss")).collect()
    for chosen, rows, *bounds in seen:
        assert rows == (600 if chosen else n - 600)
        assert bounds == pytest.approx([loss(int(chosen), 600, 1.0)] * 2 + [loss(1, n, target / total)] * 2, rel=1e-6)


def test_licenses_are_found_and_inherited(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/x.txt", "no words of it"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/y.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore " + "text " * 50), ("a/b/c/d/z.txt", None), ("w.txt", ""), (None, "x"), ("a/x.txt", "no words of it"),
        ("q/v.txt", "something about a license that fits no notice at all"),
    ]
    files = spark.createDataFrame([(k, p, t, "clash", 1) for k, (p, t) in enumerate(rows)], "k int, path string, text string, license string, line int")
    out = {r["k"]: (r["own_license"], r["license"], r["origin"], r["inherited_from"]) for r in license_scan.scan(files, ["k"]).collect()}
    assert out == {
        0: ("MIT", "MIT", "header", None), 1: (None, "MIT", "inherited", ""), 2: ("Apache-2.0", "Apache-2.0", "header", None), 3: ("GPL-3.0", "GPL-3.0", "header", None),
        4: (None, "Apache-2.0", "inherited", "a/b"), 5: (None, "MIT", "inherited", ""), 6: (None, None, "none", None), 7: (None, "MIT", "inherited", ""), 8: (None, "MIT", "inherited", ""),
    }
    assert license_scan.scan(files.limit(0), ["k"]).collect() == []


def test_whole_licenses_and_wrapped_headers_are_found(spark):
    from pathlib import Path

    common, body = Path("/usr/share/common-licenses"), Path(license_scan.__file__).parent / "licenses/MIT.txt"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(f"{k}/{name}", (common / k).read_text(), want) for k, want in names.items() for name in ("COPYING", "notes.txt")]
    gpl = """    Foo is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.

    Foo is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with Foo.  If not, see <https://www.gnu.org/licenses/>."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    code = "\nint main(void) { return loop(values, 3); }\n" * 40
    commented = lambda mark, text: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    starred = lambda text: "/*\n" + commented(" *", text) + "\n */"
    mit = "\n".join(body.read_text().split("\n")[4:])
    bsd = "Copyright (c) 2019 A. Writer\n" + "\n".join((common / "BSD").read_text().split("\n")[1:])
    for k, (text, want) in enumerate([(gpl.format(3), "GPL-3.0"), (gpl.format(2), "GPL-2.0"), (gpl.format(3).replace("GNU General", "GNU Lesser General"), "LGPL-3.0"), (mpl, "MPL-2.0"), (mit, "MIT"), (bsd, "BSD-3-Clause"), (license_scan.license_texts.HEADERS["Apache-2.0"][0], "Apache-2.0")]):
        rows += [(f"h{k}/a.py", commented("#", text) + code, want), (f"h{k}b/a.c", starred(text) + code, want), (f"h{k}c/a.c", "/*\n" + text + "\n*/" + code, want)]
    prose = "The rights of the reader to the text of this book are those of any reader of the works in the library, and the copyright of it is with the author of the book. " * 8
    rows += [("none/a.txt", prose, None), ("none/b.c", "/* " + prose + " */" + code, None)]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "k int, path string, text string")
    out = {r["k"]: r["own_license"] for r in license_scan.scan(files, ["k"]).collect()}
    assert {rows[k][0]: v for k, v in out.items()} == {p: want for p, _, want in rows}


def test_license_plans_stay_small(spark, monkeypatch):
    """Each exchange is a thread and more of a plan in the driver; 52 of them took its memory."""
    plans, write = [], license_scan.Scratch.write

    def written(self, df, *a, **b):
        plans.append(df)
        return write(self, df, *a, **b)

    monkeypatch.setattr(license_scan.Scratch, "write", written)
    files = spark.createDataFrame([(k, f"a/{k}.txt", "Released under the MIT License.") for k in range(9)], "k int, path string, text string")
    plans.append(license_scan.scan(files, ["k"]))
    nodes = [line.strip("+-*:() 0123456789").split(" ")[0] for df in plans for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert 1 <= nodes.count("Exchange") + nodes.count("BroadcastExchange") <= 10


def test_toxicity_trains_on_a_bounded_sample_of_repeated_ids(spark):
    rows = [(k % 3, f"text {k}") for k in range(60)] + [(None, "x"), (7, None)]
    docs = helpers.documents(spark, rows)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (7, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, F.lit(True), "doc_id", "toxic", 10)
    assert sorted(r["y"] for r in got.collect()) == [0, 0, 1, 1, 1] and got.where("_text = ''").count() == 1
    assert toxicity.sample(docs, labels, F.lit(True), "doc_id", "toxic", 2).count() <= 2
    assert toxicity.sample(docs.limit(0), labels, F.lit(True), "doc_id", "toxic", 2).count() == 0


@pytest.fixture(scope="module")
def codec():
    with open(queries.piece_model(), "rb") as f:
        return sentencepiece_codec.PieceCodec(f.read())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"abcdeINGtionsé漢字𝒳🙂 ▁\n\t0123<>x/.,\"'", "the", " in", "tion", "   "]), max_size=40).map("".join))
def test_codec_equals_the_library(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    line, decoded = codec.parts(text)
    assert line == " ".join(map(str, [*ids, library.eos_id()]))
    assert decoded == library.decode(ids) == codec.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_decoding_equals_the_library(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids)


def test_codec_on_long_runs_and_spark_rows(spark, codec, library):
    for n in (33, 64, 113, 1000, 4099):
        assert codec.encode(" " * n + "x" + " " * n) == library.encode(" " * n + "x" + " " * n)
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (4, "a" * 3000)]
    out = sentencepiece_codec.encode(helpers.documents(spark, rows), queries.piece_model(), digests=True).collect()
    for (i, t), r in zip(rows, out, strict=True):
        assert (r["doc_id"], r["ids"], r["decoded"], r["n_tokens"]) == (i, [*library.encode(t or ""), 2], t or "", len(r["ids"]))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
