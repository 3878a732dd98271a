"""Distributed exact percentile, dense rank and row index versus numpy/pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hubflow.functions import ranking


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_percentile_with_ties(spark, seed):
    rng = random.Random(seed)
    vals = [float(rng.choice([1, 2, 2, 3, 5, 8, 13])) + (rng.random() if seed else 0.0)
            for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert ranking.exact_percentile(df, "x", p) == pytest.approx(
            float(np.percentile(vals, p * 100)), abs=1e-12)
    assert ranking.exact_percentile(df.filter("x is null"), "x", 0.5) is None


def test_dense_rank_and_row_index(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = {r.id: r.rk for r in ranking.dense_rank(df, F.desc("v"), "v", "rk").collect()}
    pdf = pd.DataFrame(rows, columns=["id", "v"])
    exp = pdf.set_index("id")["v"].rank(method="dense", ascending=False).astype(int).to_dict()
    assert got == exp
    idx = sorted(r.ix for r in ranking.row_index(df, [F.col("v"), F.col("id")], "ix").collect())
    assert idx == list(range(500))
