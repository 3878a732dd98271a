"""Shuffle files of written rounds."""

import time

from hubflow.operators.routes import k_best_by_deviation
from hubflow.session import cut_lineage, is_written

SCHEMA = "src string, dst string, weight double, avg_delay double"


def _files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}


def _left(spark, before):
    until = time.time() + 10
    while (new := _files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return new


def test_a_released_write_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key), _files(spark)
    out = cut_lineage(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count(), release=True)
    assert spark.conf.get(key) == was
    assert sorted(r.k for r in out.collect()) == list(range(7))
    assert not _left(spark, before)


def test_routes_leave_no_shuffle_files_and_read_written_edges(spark):
    rows = [("a", "b", 1.0, 0.0), ("b", "c", 1.0, 0.0), ("a", "c", 3.0, 1.0), ("c", None, 1.0, 0.0), ("a", "a", 1.0, 0.0)]
    edges = cut_lineage(spark.createDataFrame(rows, SCHEMA), release=True)
    assert is_written(edges) and not is_written(edges.filter("true"))
    pairs = spark.createDataFrame([("a", "c")], "source string, target string")
    before = _files(spark)
    got = k_best_by_deviation(edges, pairs, top_k=2)
    assert not _left(spark, before)
    assert [(r.path, r.total_weight) for r in got.orderBy("rank").collect()] == [("a -> b -> c", 2.0), ("a -> c", 3.0)]
    assert edges.count() == 5
