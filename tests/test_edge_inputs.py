"""Edge inputs of FIXTURES.md section 4."""

import pytest
from pyspark.sql import functions as F

from hubflow.functions.columns import delay_expr
from hubflow.operators import cost as C
from hubflow.operators.kpis import hub_kpis
from hubflow.operators.paths import betweenness, k_best_routes

SCHEMA = ("leg_id string, planned_mins bigint, effective_mins bigint, hub_id string, "
          "milestone string, stage_group string, leg_type string, seq bigint")


def _ms(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("delay_mins", delay_expr())


def test_every_hub_single_row_std_zero(spark):
    df = _ms(spark, [("1", 10, 20, "A", "DEP", "Transport_Seg1", "OUT", 0),
                     ("2", 10, 30, "B", "DEP", "Transport_Seg1", "OUT", 0)])
    k = {r.hub_id: r for r in hub_kpis(df).collect()}
    assert k["A"].std_delay == 0.0 and k["B"].std_delay == 0.0
    assert k["B"].delay_rank == 1 and k["A"].delay_rank == 2


def test_one_row(spark):
    df = _ms(spark, [("1", 10, 20, "A", "DEP", "Transport_Seg1", "OUT", 0)])
    r = hub_kpis(df).collect()
    assert len(r) == 1 and r[0].median_delay == 10.0 and r[0].delay_rank == 1


def test_disconnected_graph(spark):
    e = spark.createDataFrame(
        [("a", "b", 1.0, 0.0), ("b", "c", 1.0, 0.0), ("x", "y", 1.0, 0.0)],
        "src string, dst string, weight double, avg_delay double")
    bc = {r.hub_id: r.centrality for r in betweenness(e).collect()}
    assert set(bc) == {"a", "b", "c", "x", "y"}
    assert bc["b"] == pytest.approx(1.0 / (4 * 3)) and bc["x"] == 0.0
    pairs = spark.createDataFrame([("a", "y"), ("a", "c")], "source string, target string")
    r = k_best_routes(e, pairs, top_k=3).collect()
    assert [(x.source, x.target, x.path) for x in r] == [("a", "c", "a -> b -> c")]


def test_scenarios_without_saving_and_zero_cost(spark):
    totals = spark.createDataFrame([(1000.0,)], "total_cost double")
    sc = C.scenarios_frame(spark, [("none", 0.0, 500.0), ("free", 10.0, 0.0)])
    r = {x.scenario: x for x in C.scenario_roi(totals, sc).collect()}
    assert r["none"].payback_months == float("inf")
    assert r["free"].implementation_cost == 1.0
    assert r["free"].payback_months == pytest.approx(1.0 / (100.0 / 12))


def test_no_late_rows_gives_empty_patterns(spark):
    from hubflow.operators.patterns import late_patterns
    df = _ms(spark, [("1", 10, 20, "A", "DEP", "Transport_Seg1", "OUT", 0)])
    assert late_patterns(df, 30).count() == 0


def test_question_marks_in_ids_and_numbers(spark):
    from hubflow.functions.columns import normalise_hub, to_number
    df = spark.createDataFrame([("?", "?"), ("12", "7.0"), (None, "x")], "h string, v string")
    r = df.select(normalise_hub("h").alias("h"), to_number("v").alias("v")).collect()
    assert [x.h for x in r] == ["none", "12", "none"]
    assert [x.v for x in r] == [None, 7.0, None]
