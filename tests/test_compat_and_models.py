"""Quirk reproduction (compat=True), raw-to-long path, and model persistence."""

import os
import tempfile

from pyspark.sql import functions as F

from hubflow.functions.columns import raw_columns, rename_map
from hubflow.operators.clean import clean_summary, clean_wide
from hubflow.operators.journeys import transits, unpivot_long
from hubflow.operators.kpis import hub_kpis
from hubflow.operators.network import with_reverse_edges, embed_edges


def _raw_row():
    r = {c: "?" for c in raw_columns()}
    r.update({"nr": "1", "legs": "1", "o_legid": "9", "o_rcs_p": "10", "o_rcs_e": "12",
              "o_dep_1_p": "20", "o_dep_1_e": "25", "o_dep_1_place": "128",
              "o_rcf_1_p": "30", "o_rcf_1_e": "41", "o_rcf_1_place": "815",
              "o_dlv_p": "50", "o_dlv_e": "48", "o_hops": "1",
              "i2_legid": "5", "i2_dep_1_place": "777", "i2_rcs_p": "5", "i2_rcs_e": "6"})
    return [r[c] for c in raw_columns()]


def test_rename_map_rule():
    m = rename_map()
    assert len(m) == 98 and len(set(m.values())) == 98
    assert m["i2_dep_1_place"] == "IN_2_Dep_Seg1_Hub_ID"
    assert rename_map(compat=True)["i2_dep_1_place"] == "IN_1_Dep_Seg1_Hub_ID"


def test_clean_and_unpivot(spark):
    raw = spark.createDataFrame([_raw_row()], ",".join(f"{c} string" for c in raw_columns()))
    c = clean_wide(raw)
    assert len(c.columns) == 98
    assert dict(c.dtypes)["OUT_CheckIn_Planned_Mins"] == "bigint"
    assert dict(c.dtypes)["IN_1_CheckIn_Planned_Mins"] == "string"  # no numeric text at all
    s = clean_summary(spark, c).first()
    assert s.total_columns == 98 and s.numeric_columns + s.non_numeric_columns == 98
    long_df = unpivot_long(c)
    got = {(r.leg_type, r.milestone, r.hub_id, r.delay_mins) for r in long_df.collect()}
    assert ("OUT", "RCS", "128", 2) in got and ("OUT", "DLV", "815", -2) in got
    assert ("IN_2", "RCS", "777", 1) in got


def test_compat_quirks(spark):
    raw = spark.createDataFrame([_raw_row()], ",".join(f"{c} string" for c in raw_columns()))
    c = clean_wide(raw, compat=True)
    assert len(c.columns) == 97  # duplicate target dropped
    long_df = unpivot_long(c, compat=True)
    got = {(r.leg_type, r.milestone, r.hub_id) for r in long_df.collect()}
    assert ("IN_2", "RCS", "none") in got       # IN_2 lost its first hub
    assert ("OUT", "DLV", "815.0") in got       # DLV hub split from "815"
    k = {r.hub_id for r in hub_kpis(long_df).collect()}
    assert {"815", "815.0"} <= k


def test_reverse_edges(f1):
    e = embed_edges(transits(f1, "embed"))
    r = with_reverse_edges(e)
    assert r.count() == 2 * e.count()
    assert r.filter((F.col("src") == "B") & (F.col("dst") == "A")).count() == 1


def test_model_save_and_load(spark, f1):
    from pyspark.ml import PipelineModel
    from hubflow.operators.predict import delay_features, fit_delay_model, save_model
    f = delay_features(transits(f1, "predict"), hub_kpis(f1, sort=False))
    f = f.withColumn("is_test", F.lit(False))
    m = fit_delay_model(f, "gradient_boosting", n_trees=3)
    path = os.path.join(tempfile.mkdtemp(prefix="hubflow-model-"), "m")
    save_model(m, path)
    back = PipelineModel.load(path)
    assert back.transform(f.withColumn("label", F.col("delay_mins").cast("double"))).count() == 8
