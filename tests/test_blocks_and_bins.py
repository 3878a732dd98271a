"""Silhouettes in blocks of clusters, binned densities, malformed CSV rows."""

import numpy as np
import pytest

from hubflow.functions.columns import raw_columns
from hubflow.operators import cluster, eda
from hubflow.sources.csvsource import read_raw_csv_checked


def test_squared_silhouette_in_blocks_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(rng.integers(0, 9))) for i in range(80)]
    rows += [(80, [9.0, 9.0, 9.0], 50), (81, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r["vec_id"]: r["silhouette"] for r in cluster.silhouette_samples(df).collect()}
    monkeypatch.setattr(cluster, "MAX_CLUSTERS", 3)
    got = {r["vec_id"]: r["silhouette"] for r in cluster.silhouette_samples(df).collect()}
    assert got == pytest.approx(want) and len(got) == 81


def test_binned_density_is_within_its_error(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), int(b), 5) for a, b in zip(rng.lognormal(3, 1, 4000), rng.integers(-9, 200, 4000))]
    df = spark.createDataFrame(rows, "a double, b int, c int")
    exact = {(r.column_name, r.grid_index): r for r in eda.kde_curves(df, ["a", "b"]).collect()}
    for error in (1e-3, 1e-6):
        rows = eda.kde_curves_binned(df, ["a", "b"], error=error).collect()
        assert len(rows) == 128
        for r in rows:
            e = exact[r.column_name, r.grid_index]
            assert abs(r.kernel_mean - e.kernel_mean) <= error + 1e-9
            assert r.x == pytest.approx(e.x) and r.bandwidth == pytest.approx(e.bandwidth)


def test_malformed_rows_are_set_apart(spark, tmp_path):
    cols = raw_columns()
    good = ",".join(str(i) for i in range(len(cols)))
    path = str(tmp_path / "raw.csv")
    with open(path, "w") as f:
        f.write("\n".join([",".join(cols), good, "1,2,3", good + ",one,too,many", good]) + "\n")
    rows, bad = read_raw_csv_checked(spark, path)
    assert rows.columns == cols and rows.count() == 2
    assert sorted(r[0] for r in bad.collect()) == sorted(["1,2,3", good + ",one,too,many"])
    with pytest.raises(ValueError):
        broken = str(tmp_path / "broken.csv")
        open(broken, "w").write("nr,legs\n1,2\n")
        read_raw_csv_checked(spark, broken)
