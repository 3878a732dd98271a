"""Known values of FIXTURES.md section 5 and clustering invariants."""

import pytest
from pyspark.sql import functions as F

from hubflow.operators.cluster import davies_bouldin, silhouette_samples, silhouette_score
from hubflow.operators.eda import skewness_report, vif


def test_population_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = skewness_report(df, ["x"]).first()
    assert r.skewness == pytest.approx(1.018234, abs=1e-6)
    assert r.interpretation == "Highly Positive Skew"


def test_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = df.agg(F.percentile("x", 0.1).alias("p"), F.percentile("x", 0.5).alias("m")).first()
    assert r.p == pytest.approx(1.3) and r.m == pytest.approx(2.5)


def test_silhouette_squared(spark):
    pts = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1), (4, [7.0], 1)],
                                "vec_id bigint, embedding array<double>, label int")
    assert silhouette_score(pts).first().silhouette == pytest.approx(0.911318, abs=1e-6)
    s = silhouette_samples(pts).collect()
    assert all(-1 <= r.silhouette <= 1 for r in s)


def test_silhouette_singleton_is_zero(spark):
    pts = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [1.5], 1)],
                                "vec_id bigint, embedding array<double>, label int")
    s = {r.vec_id: r.silhouette for r in silhouette_samples(pts).collect()}
    assert s[1] == 0.0


def test_davies_bouldin_two_clusters(spark):
    pts = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1), (4, [7.0], 1)],
                                "vec_id bigint, embedding array<double>, label int")
    # S0 = 0.5, S1 = 1, centroid distance 5.5 -> (1.5 / 5.5) for both
    assert davies_bouldin(pts).first().davies_bouldin == pytest.approx(1.5 / 5.5)


def test_vif_dependent_columns_infinite(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 3.0), (4.0, 1.0, 5.0)], "a double, b double, c double")
    v = vif(df, ["a", "b", "c"]).collect()
    assert all(r.vif == float("inf") for r in v)


def test_vif_independent(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "a double, b double")
    assert [r.vif for r in vif(df, ["a", "b"]).collect()] == [1.0, 1.0]
