"""All fits of a search share their passes over the points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.operators import cluster


def test_fits_share_passes_and_equal_sparks(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (1000, 1004, 1009)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    passes, one = [], cluster._assigned_sums
    monkeypatch.setattr(cluster, "_assigned_sums", lambda x, c: passes.append(len(c)) or one(x, c))
    fits = cluster.kmeans_fits(df, [2, 3, 4], n_init=3, max_iter=40)
    assert len(passes) <= 40 and passes[0] == 9                # not passes of every fit in turn
    feats = cluster._features(df, "embedding")
    for k, fit in fits.items():
        sparks = [KMeans(k=k, seed=42 + i, maxIter=40).fit(feats) for i in range(3)]
        best = min(sparks, key=lambda m: m.summary.trainingCost)
        assert fit.summary.trainingCost == pytest.approx(best.summary.trainingCost, rel=1e-6)
        assert np.allclose(fit.centres, best.clusterCenters(), atol=1e-3)
        got = cluster.assign_clusters(fit, df).orderBy("vec_id").select("cluster").toPandas()["cluster"]
        want = best.transform(feats).orderBy("vec_id").select(F.col("prediction")).toPandas()["prediction"]
        assert (got == want).all()
