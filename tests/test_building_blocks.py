"""Embedding, clustering and model building blocks against NumPy or plain rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.operators import cluster as C
from hubflow.operators.embed import contrastive_embedding, link_embedding, propagate
from hubflow.operators.flow import hub_flow
from hubflow.operators.predict import FEATURES, evaluate, feature_importance, fit_delay_model

COLS = ["a", "b"]


def _graph(spark, n=14, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    nodes = spark.createDataFrame([(f"h{i}", float(x[i, 0]), float(x[i, 1])) for i in range(n)],
                                  "hub_id string, a double, b double")
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j and rng.random() < 0.3]
    return x, pairs, nodes, spark.createDataFrame([(f"h{i}", f"h{j}") for i, j in pairs], "src string, dst string")


def _mean_in(x, pairs):
    out = np.zeros_like(x)
    for j in range(len(x)):
        into = [i for i, k in pairs if k == j]
        if into:
            out[j] = x[into].mean(axis=0)
    return out


def test_propagate_two_hops(spark):
    x, pairs, nodes, edges = _graph(spark)
    want = np.concatenate([x, _mean_in(x, pairs), _mean_in(_mean_in(x, pairs), pairs)], axis=1)
    got = {r["hub_id"]: r["h"] for r in propagate(nodes, edges, COLS, hops=2).collect()}
    assert np.allclose([got[f"h{i}"] for i in range(len(x))], want)


@pytest.mark.parametrize("make", [link_embedding, contrastive_embedding])
def test_embeddings_are_complete_and_finite(spark, make):
    _, _, nodes, edges = _graph(spark)
    emb, loss = make(nodes, edges, COLS, dim=4, hops=2, max_iter=10)
    rows = emb.collect()
    assert len(rows) == 14 and all(len(r["embedding"]) == 4 for r in rows)
    assert all(math.isfinite(v) for r in rows for v in r["embedding"])


def _blobs(spark):
    rng = np.random.default_rng(1)
    centre = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0]])
    x = np.concatenate([c + rng.normal(scale=0.3, size=(25, 3)) for c in centre])
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")


def test_kmeans_cost_and_labels_follow_from_its_centres(spark):
    x, points = _blobs(spark)
    model = C.kmeans_fit(points, 3, n_init=4)
    centres = np.array(model.clusterCenters())
    d = ((x[:, None] - centres) ** 2).sum(axis=2)
    got = {r["vec_id"]: r["cluster"] for r in C.assign_clusters(model, points).collect()}
    assert [got[i] for i in range(len(x))] == d.argmin(axis=1).tolist()
    assert model.summary.trainingCost == pytest.approx(d.min(axis=1).sum())
    choice = C.kmeans_best_k(points, max_k=4, n_init=2).collect()
    assert [r["k"] for r in choice if r["best"]] == [3]


def test_pca_equals_numpy(spark):
    x, points = _blobs(spark)
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in C.pca_2d(points.withColumn("label", F.lit(0))).collect()}
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    mine = np.array([got[i] for i in range(len(x))])
    for k in (0, 1):
        assert np.allclose(np.abs(mine[:, k]), np.abs(want[:, k]), atol=1e-6)


def _rows(spark):
    rng = np.random.default_rng(2)
    rows = [(*[float(v) for v in rng.normal(size=len(FEATURES))], i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, ",".join(f"{f} double" for f in FEATURES) + ", is_test boolean")
    return df.withColumn("delay_mins", F.round(F.col(FEATURES[7]) * 100 + F.col(FEATURES[10]) * 10).cast("bigint"))


def test_importance_finds_the_driving_feature(spark):
    model = fit_delay_model(_rows(spark), "gradient_boosting", n_trees=10)
    imp = feature_importance(model).collect()
    assert imp[0]["feature"] == FEATURES[7]
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_evaluate_on_a_fixed_predictor(spark):
    class RouteMean:
        def transform(self, df):
            return df.withColumn("prediction", F.col(FEATURES[7]) * 100)

    rows = _rows(spark)
    test = rows.filter("is_test").toPandas()
    y, p = test["delay_mins"].to_numpy(float), test[FEATURES[7]].to_numpy() * 100
    r = evaluate(RouteMean(), rows, "m").first()
    assert r["mae"] == pytest.approx(np.abs(y - p).mean()) and r["n_test"] == len(y)
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_whole_flow_on_the_fixture(spark, f1):
    out = hub_flow(f1, dim=2, hops=1, max_k=2, n_init=1)
    hubs = {r["hub_id"] for r in out["embeddings"].collect()}
    assert {r["hub_id"] for r in out["labels"].collect()} == hubs
    assert out["clustered"].count() == out["kpis"].count()
    assert out["interpretation"].count() == out["labels"].select("cluster_label").distinct().count()
    assert out["poor_fit"].columns == ["hub_id", "cluster_label", "silhouette", "total_outgoing_flow",
                                       "avg_segment_delay"]
    assert out["boundary"].count() >= 0
