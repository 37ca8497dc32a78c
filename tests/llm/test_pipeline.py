import hashlib

import pytest

import corpus_pipeline
import __spark_entry__
from scriptflow.llm import queries, sentencepiece_codec

from . import helpers

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = queries.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(names) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "passages", "mixing", "tokens"]
    quality = stages["quality"](spark, docs, SF)
    assert quality.columns == corpus_pipeline.COLUMNS
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in quality.collect()}
    right = [(labels[i] == 1) == (i in kept) for i in labels]
    assert sum(right) >= 0.95 * len(right)

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = stages["near_duplicates"](spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS
    best = helpers.components({i: helpers.shingles(t) for i, t in rows.items()})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in rows if best[i] == i)

    cut = {r["doc_id"]: r for r in stages["passages"](spark, docs, SF).collect()}
    assert set(cut) == set(rows)
    for i, (words, gone) in zip(rows, helpers.windows_removed(list(rows.values())), strict=True):
        want = " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else rows[i]
        assert cut[i]["text"] == want and (cut[i]["n_chars"] == len(want) or not any(gone))

    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    plan = {r["doc_id"]: r for r in queries.op3_source_mix(spark, SF).collect()}
    assert counts == {i: -(-r["taken"] // r["size"]) for i, r in plan.items() if r["taken"]}

    with open(queries.piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read())
    for r in stages["tokens"](spark, docs.limit(20), SF).collect():
        line, decoded = codec.parts(rows[r["doc_id"]])
        assert (r["ids_sha256"], r["decoded_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (line, decoded))


def _texts(*seeds, n=60):
    import random

    return [" ".join(random.Random(k).choice(["a", "b", "c", "dd", "eee", "f1"]) + str(random.Random(k * 1000 + j).randint(0, 300)) for j in range(n)) for k in seeds]


def _stage(spark, name, rows, tmp_path, parquet):
    docs = helpers.documents(spark, rows)
    if parquet:
        path = f"{tmp_path}/{name}"
        docs.select(*corpus_pipeline.COLUMNS).write.parquet(path)
        docs = spark.read.parquet(path)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("parquet", [False, True])
def test_stages_decide_by_row(spark, tmp_path, parquet):
    a, b, c = _texts(1, 2, 3)
    rows = [(1, a), (3, a), (3, b), (None, a), (None, c), (2, ""), (2, ""), (4, None), (5, c), (5, c), (None, b)]
    near = [(1, a), (3, b), (2, ""), (2, ""), (4, None), (5, c)]
    assert _stage(spark, "near_duplicates", rows, tmp_path, parquet) == sorted(near, key=str)

    once = [r for r in rows if r[1]]  # one source: its target is its size, so each row with words comes once
    assert _stage(spark, "mixing", rows, tmp_path, parquet) == sorted(once, key=str)

    mixed = [(i, f"{k} {t}" if t else t) for k, (i, t) in enumerate(rows)]
    flags = helpers.windows_removed([t for _, t in mixed])
    cut = [(i, " ".join(w for w, g in zip(ws, gone, strict=True) if not g) if any(gone) else t) for (i, t), (ws, gone) in zip(mixed, flags, strict=True)]
    assert any(any(gone) for _, gone in flags)
    assert _stage(spark, "passages", mixed, tmp_path, parquet) == sorted(cut, key=str)


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF).collect())
    best = helpers.components({i: helpers.shingles(t) for i, t, _ in rows})
    rows = [r for r in rows if best[r[0]] == r[0]]
    cut = []
    for (i, t, s), (words, gone) in zip(rows, helpers.windows_removed([t for _, t, _ in rows]), strict=True):
        cut.append((i, " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else t, s))
    with open(queries.piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read())
    want = []
    for i, t, n in helpers.mix_passes(cut):
        line, decoded = codec.parts(t)
        want += [(i, *(hashlib.sha256(x.encode()).hexdigest() for x in (line, decoded)))] * n
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)
    assert len(want) > 100


def test_stages_take_odd_documents(spark):
    odd = helpers.documents(spark, [(1, None), (None, "a b c"), (2, ""), (2, ""), (3, "plain text of a few words")])
    counts = {"near_duplicates": 5, "passages": 5, "mixing": 2, "tokens": 5}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF).collect()
        assert len(got) == counts.get(name, len(got)) <= 5
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages_send_small_batches(spark, tmp_path):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(40, numPartitions=1).selectExpr("id doc_id", "repeat(cast(id as string), 500000) text", "'en' lang", "'web' source", "500000 n_chars")
    docs.write.parquet(f"{tmp_path}/long")
    docs = spark.read.parquet(f"{tmp_path}/long").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    try:
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)["tokens"](spark, docs, SF)
        got = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 40 and max(r["size"] for r in got) < 10_000_000
        spark.conf.set(key, "1m")
        dict(corpus_pipeline.STAGES)["tokens"](spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_workers_give_memory_back():
    """In a process of its own: what is freed below memory that is still held goes back once a task is over."""
    import subprocess
    import sys

    code = r"""
import re
from scriptflow.llm import kernel

held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
kept = []

def run(batches):
    blocks = [bytearray(60_000) for _ in range(2000)]
    kept.append(bytearray(60_000))
    yield from batches

before = held()
assert list(kernel.releasing(run)(iter([1, 2]))) == [1, 2]
assert held() - before < 40, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
