from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptflow.llm import embedding_dedup, nn_search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("vec", T.StringType())])


def vectors(spark, n=1500, dim=24, seed=1):
    """Random vectors of three labels with clusters, copies and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(6):
        centre = rng.standard_normal(dim)
        at = rng.choice(n, 40, replace=False)
        x[at] = centre + rng.standard_normal((40, dim)) * (0.1 + 0.05 * c)
    x[n - 30 :] = x[0]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3) if c_ok(i) else None, "a", "b") for i in range(n)]
    odd = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (None, rows[5][1], 1), (7, rows[7][1], rows[7][2])]
    return rows + [(*o, "a", "b") for o in odd]


def c_ok(i):
    return i % 50 != 9


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_links_match_brute_force(spark):
    rows = vectors(spark)
    out = embedding_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    use = [r for r in rows if good(r[1]) and r[2] is not None]
    degree, parent = {}, list(range(len(use)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, r in enumerate(use):
        for j, s in enumerate(use[:k]):
            if r[2] == s[2] and len(r[1]) == len(s[1]):
                a, b = np.array(r[1]), np.array(s[1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    degree[k], degree[j] = degree.get(k, 0) + 1, degree.get(j, 0) + 1
                    parent[max(find(k), find(j))] = min(find(k), find(j))
    least = {}
    for k, r in enumerate(use):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = sorted((str(r[0]), degree.get(k, 0), least.get(find(k), r[0])) for k, r in enumerate(use))
    lone = sorted((str(r[0]), 0, r[0]) for r in rows if not (good(r[1]) and r[2] is not None))
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in out)
    assert got == sorted(want + lone)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert sum(degree.values()) > 500


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [12, 1500])
def test_search_recall_and_ties(spark, n):
    rows = [r for r in vectors(spark, max(n, 60)) if n > 60 or (r[0] is not None and r[0] < n) or not good(r[1])]
    out = nn_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    use = [r for r in rows if good(r[1]) and r[0] is not None]
    found, hits, wanted = {}, 0, 0
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for k, q in enumerate(use):
        if q[0] % 20:
            continue
        others = [(-float(np.dot(q[1], r[1])), r[0]) for j, r in enumerate(use) if j != k and len(r[1]) == len(q[1])]
        best = [i for _, i in sorted(others)[:20]]
        got = [i for _, i, _ in sorted(found.pop(q[0], []))]
        assert len(got) == len(best)
        hits, wanted = hits + (Counter(got) & Counter(best)).total(), wanted + len(best)
    assert not found
    assert hits >= (0.97 if n > 60 else 1) * wanted
    for r in out[:50]:
        pair = [np.array(next(x[1] for x in use if x[0] == i)) for i in (r["query_id"], r["vec_id"])]
        assert r["score"] == pytest.approx(pair[0] @ pair[1])


def test_search_of_nothing(spark):
    assert nn_search.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_samples_are_the_smallest_hashes(spark):
    from scriptflow.llm.distributed import hash_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    for most in (0, 1, 100, 5_000, 30_000):
        want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(most).collect()]
        assert [r["k"] for r in hash_sample(df, "k", most).collect()] == want


def test_samples_of_nearly_all_rows(spark):
    """Where the bound on the hash takes in every row."""
    from scriptflow.llm.distributed import hash_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    for most in (18_900, 19_500, 19_999, 20_000):
        want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(most).collect()]
        assert [r["k"] for r in hash_sample(df, "k", most).collect()] == want
