"""Write-and-read-back of the sinks and the raw CSV source."""

import os
import tempfile

from hubflow.functions.columns import raw_columns
from hubflow.sources import sinks
from hubflow.sources.csvsource import read_raw_csv


def test_raw_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="hubflow-csv-")
    p = os.path.join(d, "raw.csv")
    cols = raw_columns()
    with open(p, "w") as fh:
        fh.write(",".join(cols) + "\n")
        fh.write(",".join("?" if i % 3 else "7" for i in range(len(cols))) + "\n")
    df = read_raw_csv(spark, p)
    assert df.columns == cols and df.count() == 1
    assert all(t == "string" for _, t in df.dtypes)


def test_missing_csv_raises(spark):
    import pytest
    with pytest.raises(Exception):
        read_raw_csv(spark, "/nonexistent/raw.csv").count()


def test_table_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="hubflow-sink-")
    df = spark.createDataFrame([("a", 1, [1.0, 2.0])], "hub_id string, n bigint, embedding array<double>")
    sinks.write_table(df, os.path.join(d, "emb"), fmt="parquet")
    back = spark.read.parquet(os.path.join(d, "emb")).collect()
    assert back[0].embedding == [1.0, 2.0]
    flat = df.drop("embedding")
    sinks.write_table(flat, os.path.join(d, "flat"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(d, "flat")).count() == 1


def test_patterns_csv_header(spark):
    d = tempfile.mkdtemp(prefix="hubflow-pat-")
    df = spark.createDataFrame([("A -> B", 3)], "pattern string, frequency bigint")
    sinks.save_patterns(df, os.path.join(d, "patterns"))
    back = spark.read.option("header", True).csv(os.path.join(d, "patterns"))
    assert back.columns == ["pattern", "Frequency"]
