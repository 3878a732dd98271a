"""Coreset k-means, counting selection and the embedding fit."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.functions import ranking
from hubflow.operators import cluster, coreset, embed
from hubflow.operators import silhouette as S


def _blobs(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [9, 9, 9]], float)
    x = centres[rng.choice(4, n, p=[.35, .35, .28, .02])] + rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_coreset_weights_and_costs_stand_for_all_rows(spark):
    df = _blobs(spark)
    core = coreset.coreset(df, size=400).toPandas()
    assert 200 < len(core) < 600 and core.w.sum() == pytest.approx(3000, rel=.15)
    choice = coreset.choose_k(df, max_k=5, n_init=10, size=400)
    scores = {r["k"]: r for r in choice.scores.collect()}
    assert choice.best == 4 and scores[4]["best"] and sorted(scores) == [2, 3, 4, 5]
    for k in (2, 4):
        full = cluster.kmeans_fit(df, k, n_init=10).summary.trainingCost
        assert scores[k]["inertia"] <= 1.15 * full
    label = coreset.label_points(df, {4: choice.centres[4]})
    assert S.euclidean_score(label, label="k4").first()[0] == pytest.approx(scores[4]["silhouette"])


def test_choice_on_few_equal_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    two = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)] + [(9, None)], schema)
    choice = coreset.choose_k(two)
    assert [tuple(r) for r in choice.scores.collect()] == [(2, 0.0, 1.0, True)]
    assert coreset.choose_k(two.filter("vec_id % 2 = 0")).best is None
    assert coreset.choose_k(two.limit(0)).scores.count() == 0


def test_percentiles_by_counting(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=9000) * 1e-7, rng.lognormal(12, 4, 9000), np.full(9000, 3.25)])
    y = rng.integers(-5, 5, len(x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double").repartition(4)
    wanted = [("x", .1), ("x", .5), ("x", .99), ("y", .5), ("z", .5), ("x", 0.0), ("x", 1.0), ("x", .123456)]
    got = ranking.exact_percentiles(df, wanted)
    col = {"x": x, "y": y}
    for (c, p), v in zip(wanted, got):
        assert v is None if c == "z" else v == pytest.approx(np.percentile(col[c], p * 100), rel=1e-12)


def _graph(spark, n=40):
    """Two groups with edges inside them only, and features that tell them apart weakly."""
    rng = np.random.default_rng(1)
    nodes = [(f"h{i}", float(i % 2) + rng.normal() * .3, rng.normal(), 2 * (i % 2) + rng.normal()) for i in range(n)]
    edges = [(f"h{i}", f"h{j}") for i in range(n) for j in range(n) if i != j and i % 2 == j % 2 and rng.random() < .4]
    return (spark.createDataFrame(nodes, "hub_id string, a double, b double, c double"),
            spark.createDataFrame(edges, "src string, dst string"))


def test_embedding_fit_converges_and_ranks_edges(spark):
    nodes, edges = _graph(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        emb, loss = embed.link_embedding(nodes, edges, ["a", "b", "c"], dim=8, hops=5)
    assert 2 < len(loss) < 100 and all(b <= a for a, b in zip(loss, loss[1:]))
    z = {r["hub_id"]: np.array(r["embedding"]) for r in emb.collect()}
    assert len(z) == 40 and all(len(v) == 8 for v in z.values())
    linked = {(r["src"], r["dst"]) for r in edges.collect()}
    pos = [z[a] @ z[b] for a, b in linked]
    neg = [z[a] @ z[b] for a in z for b in z if a != b and (a, b) not in linked]
    auc = np.mean([np.mean(p > np.array(neg)) for p in pos])
    assert auc > .75


def test_whitened_fit_has_no_gradient_left(spark):
    nodes, edges = _graph(spark)
    h = embed.propagate(nodes, edges, ["a", "b", "c"], 5)
    w = embed.whitening(h, 18)
    x = np.array([r["h"] for r in h.collect()]) @ w
    assert np.allclose(x.T @ x / len(x), np.eye(w.shape[1]), atol=1e-6)
    pairs = edges.withColumn("y", F.lit(1.0)).unionByName(embed.negative_edges(nodes, edges).withColumn("y", F.lit(0.0)))
    pairs = (pairs.join(h.select(F.col("hub_id").alias("src"), F.col("h").alias("hi")), "src")
             .join(h.select(F.col("hub_id").alias("dst"), F.col("h").alias("hj")), "dst").select("y", "hi", "hj"))
    fit = embed.fit_bilinear(pairs, 18, w, 5e-4, 100)
    assert fit.converged and np.allclose(fit.matrix, fit.matrix.T)
    few = embed.fit_bilinear(pairs, 18, w, 5e-4, 1)
    assert not few.converged
    with pytest.warns(UserWarning, match="gradient norm"):
        embed._checked(few, 1)
    assert embed.fit_bilinear(pairs.filter("y = 1"), 18, w, 5e-4, 5) is None
