"""Euclidean silhouette and the inverted-file index against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.operators import neighbours as N
from hubflow.operators import silhouette as S


def _points(spark, x, labels):
    rows = [(i, None if v is None else [float(a) for a in v], l) for i, (v, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def _brute(x, labels):
    x, labels = np.asarray(x, float), np.asarray(labels)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, l in enumerate(labels):
        own = labels == l
        if own.sum() < 2 or own.all():
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == o].mean() for o in set(labels) - {l})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return out


def test_known_value(spark):
    df = _points(spark, [[0.0], [1.0], [5.0], [7.0]], [0, 0, 1, 1])
    assert S.euclidean_score(df).first()[0] == pytest.approx(0.720299, abs=1e-6)


@pytest.mark.parametrize("cell", [7, 10_000])
def test_silhouette_equals_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (30, 5)) for c in (0, 4, 1000)] + [np.full((20, 5), 1000.25)])
    labels = [*([0] * 30), *([1] * 30), *([2] * 49), 3]                 # a single point, many equal ones
    got = {r["vec_id"]: r["silhouette"] for r in S.euclidean_samples(_points(spark, x, labels), cell=cell).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(_brute(x, labels), abs=1e-9)
    some = S.euclidean_samples(_points(spark, x, labels), cell=cell, targets=F.col("vec_id") % 50 == 0).collect()
    assert {r["vec_id"]: pytest.approx(r["silhouette"]) for r in some} == {i: got[i] for i in (0, 50, 100)}


def test_silhouette_of_odd_rows(spark):
    x = [[0.0, 0], [0, 0], [3, 4], None, [1, 1], [3, 4]]
    df = _points(spark, x, [0, 0, 1, 1, None, 1]).withColumn("r", F.lit("a")).withColumn("x", F.lit(1))
    got = {r["vec_id"]: r["silhouette"] for r in S.euclidean_samples(df).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 5: 1.0}
    one = _points(spark, [[1.0], [2.0]], [7, 7])
    assert [r["silhouette"] for r in S.euclidean_samples(one).collect()] == [0.0, 0.0]
    assert S.euclidean_samples(one.limit(0)).count() == 0
    assert S.euclidean_poor_fit(one, 0.1).count() == 2


def test_labellings_share_one_pass(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    a = rng.integers(0, 3, 60)
    df = _points(spark, x, a.tolist()).withColumn("other", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    rows = df.orderBy("vec_id").collect()
    got = {r["labelling"]: r["silhouette"] for r in S.euclidean_scores(df, ["label", "other"], cell=16).collect()}
    assert got["label"] == pytest.approx(np.mean(_brute(x, a)))
    assert got["other"] == pytest.approx(np.mean(_brute(x, [r["other"] for r in rows])))


# ------------------------------------------------------------------- index
def _neighbours(x, targets, k):
    x = np.asarray(x, float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for t in targets:
        s = np.round(unit @ unit[t], 12)
        s[t] = -np.inf
        by = np.lexsort((np.arange(len(x)), -s))[:k]
        out[t] = [(int(i), pytest.approx(s[i], abs=1e-9)) for i in by]
    return out


def _found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["target_id"], r["rank"])):
        out.setdefault(r["target_id"], []).append((r["similar_id"], r["similarity"]))
    return out


def _cloud(n=1500, groups=40, d=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 2
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * .5
    x[100:600] = x[100]                                                # a third of all rows are equal
    return x


@pytest.mark.parametrize("cell", [97, 32_768])
def test_exact_search_equals_brute_force(spark, cell):
    x = _cloud()
    df = _points(spark, x, [0] * len(x))
    index = N.build_index(df, cell=cell)
    wanted = list(range(0, len(x), 50))
    got = _found(N.search_index(index, df.filter("vec_id % 50 = 0"), top_k=4, probes=2, cell=cell).collect())
    assert got == _neighbours(x, wanted, 4)


def test_index_recall_and_pruning(spark):
    x = _cloud(3000, 60, seed=9)
    df = _points(spark, x, [0] * len(x))
    index = N.build_index(df)
    want = _neighbours(x, range(0, 3000, 50), 5)
    got = _found(N.search_index(index, df.filter("vec_id % 50 = 0"), exact=False).collect())
    hit = sum(len({i for i, _ in got[t]} & {i for i, _ in want[t]}) for t in want)
    assert hit / (5 * len(want)) >= 0.9
    assert len(index.centroids) == 54 and index.sizes.sum() == 3000


def test_index_on_odd_vectors_and_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [float("nan"), 1.0]),
            ("f", [0.0, 3.0]), ("f", [0.0, 1.0]), ("g", [1.0, None]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    index = N.build_index(df)
    got = _found(N.search_index(index, df.filter("vec_id in ('a', 'c', 'e')"), top_k=3).collect())
    assert got == {"a": [("b", 1.0), ("f", 0.0), ("f", 0.0)]}
    other = spark.createDataFrame([("new", [0.0, 2.0])], df.schema)
    assert _found(N.search_index(index, other, top_k=2).collect()) == {"new": [("f", 1.0), ("f", 1.0)]}
    assert N.search_index(N.build_index(df.limit(0)), df).count() == 0
    assert N.search_index(index, df.limit(0)).count() == 0
