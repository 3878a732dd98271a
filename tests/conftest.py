import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("hubflow-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hubflow-test-ckpt-"))
    yield s


# FIXTURES.md micro-fixture F1: (leg, leg_type, stage, milestone, hub, planned, effective)
F1 = [
    ("101", "OUT", "CheckIn", "RCS", "A", 100, 130),
    ("101", "OUT", "Transport_Seg1", "DEP", "A", 200, 260),
    ("101", "OUT", "Transport_Seg1", "RCF", "B", 300, 450),
    ("101", "OUT", "Delivery", "DLV", "B", 400, 400),
    ("102", "OUT", "CheckIn", "RCS", "A", 100, 90),
    ("102", "OUT", "Transport_Seg1", "DEP", "A", 150, 150),
    ("102", "OUT", "Transport_Seg1", "RCF", "B", 250, 290),
    ("102", "OUT", "Transport_Seg2", "DEP", "B", 260, 0),
    ("102", "OUT", "Transport_Seg2", "RCF", "C", 500, 620),
    ("102", "OUT", "Delivery", "DLV", "C", 50, 80),
    ("103", "IN_1", "CheckIn", "RCS", "none", 0, 0),
    ("103", "IN_1", "Transport_Seg1", "DEP", "none", 20, 25),
    ("103", "IN_1", "Transport_Seg1", "RCF", "C", 60, 61),
]


@pytest.fixture(scope="session")
def f1(spark):
    from hubflow.functions.columns import delay_expr, non_empty
    rows = [(leg, p, e, hub, ms, st, lt, i) for i, (leg, lt, st, ms, hub, p, e) in enumerate(F1)]
    df = spark.createDataFrame(
        rows, "leg_id string, planned_mins bigint, effective_mins bigint, hub_id string, "
              "milestone string, stage_group string, leg_type string, seq bigint")
    return df.withColumn("delay_mins", delay_expr()).filter(non_empty())
