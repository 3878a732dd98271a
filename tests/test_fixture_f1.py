"""Worked values of FIXTURES.md section 3 on the 13-row micro-fixture."""

import pytest
from pyspark.sql import functions as F

from hubflow.operators import cost as C
from hubflow.operators.journeys import transits
from hubflow.operators.kpis import hub_kpis
from hubflow.operators.network import embed_edges, flow_paths, router_edges
from hubflow.operators.patterns import late_patterns
from hubflow.operators.predict import delay_features


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_all_zero_row_dropped(f1):
    assert f1.count() == 12


def test_hub_kpis(f1):
    k = {r.hub_id: r for r in hub_kpis(f1).collect()}
    assert set(k) == {"A", "B", "C"}
    a, b, c = k["A"], k["B"], k["C"]
    assert (a.total_outgoing_flow, a.avg_segment_delay, a.median_delay, a.max_delay, a.delay_rank) \
        == (4, 20.0, 15.0, 60, 3)
    assert a.std_delay == pytest.approx(31.622777, abs=1e-6)
    assert (b.total_outgoing_flow, b.avg_segment_delay, b.median_delay, b.max_delay, b.delay_rank) \
        == (4, 47.5, 20.0, 150, 2)
    assert b.std_delay == pytest.approx(70.887234, abs=1e-6)
    assert (c.total_outgoing_flow, c.median_delay, c.max_delay, c.delay_rank) == (3, 30.0, 120, 1)
    assert c.avg_segment_delay == pytest.approx(50.333333, abs=1e-6)
    assert c.std_delay == pytest.approx(62.051054, abs=1e-6)


def test_embed_edges(f1):
    e = embed_edges(transits(f1, "embed"))
    assert rows(e, "src", "dst", "flow_volume", "avg_delay") == [("A", "B", 2, 30.0), ("B", "C", 1, 0.0)]


def test_router_edges_compat(f1):
    e = router_edges(transits(f1, "router", compat=True))
    got = {(r.src, r.dst): r for r in e.collect()}
    assert set(got) == {("A", "B"), ("B", "B"), ("B", "C"), ("C", "nan")}
    exp = {("A", "B"): (2, 30.0, 42.426407, 67.879870), ("B", "B"): (2, 95.0, 77.781746, 150.557540),
           ("B", "C"): (1, 0.0, 0.0, 25.0), ("C", "nan"): (2, 60.5, 84.145707, 119.239520)}
    for k, (vol, avg, std, w) in exp.items():
        r = got[k]
        assert r.volume == vol and r.avg_delay == pytest.approx(avg)
        assert r.std_delay == pytest.approx(std, abs=1e-6) and r.weight == pytest.approx(w, abs=1e-6)


def test_router_edges_default_null_sink(f1):
    e = router_edges(transits(f1, "router"))
    assert rows(e, "src", "dst", "volume")[-1] == ("C", None, 2) or \
        ("C", None, 2) in rows(e, "src", "dst", "volume")


def test_predictor_rows(f1):
    kp = hub_kpis(f1, sort=False)
    f = delay_features(transits(f1, "predict"), kp)
    assert f.count() == 8
    assert {r.route_id for r in f.collect()} == {"A_B", "B_B", "B_C", "C_nan", "none_C"}


def test_costs(f1):
    r = C.cost_rows(transits(f1, "cost"))
    assert r.count() == 6
    t = C.network_totals(r).first()
    assert t.total_delay_cost == pytest.approx(1275.0)
    assert t.total_penalty_cost == pytest.approx(3.0)
    assert t.total_cost == pytest.approx(1278.0)
    assert t.avg_cost_per_shipment == pytest.approx(213.0)


def test_flow_paths(f1):
    p = flow_paths(transits(f1, "flow"), top_n=None)
    assert rows(p, "src", "dst", "flow_count", "avg_delay") == \
        [("A", "B", 2, 30.0), ("B", "C", 1, 0.0), ("C", "A", 1, 30.0)]


def test_late_patterns(f1):
    p = late_patterns(f1, 30)
    assert rows(p, "pattern", "frequency") == [("A -> B", 1), ("B -> C", 1)]


def test_empty_input(spark, f1):
    empty = f1.limit(0)
    assert hub_kpis(empty).count() == 0
    assert late_patterns(empty).count() == 0
    assert embed_edges(transits(empty, "embed")).count() == 0


def test_single_row_hubs_get_median_std(spark, f1):
    extra = f1.limit(0).unionByName(f1).union(
        f1.filter(F.col("hub_id") == "A").limit(1).withColumn("hub_id", F.lit("Z")))
    k = {r.hub_id: r for r in hub_kpis(extra).collect()}
    stds = sorted(k[h].std_delay for h in "ABC")
    assert k["Z"].std_delay == pytest.approx(stds[1])


def test_all_equal_delays_rank_one(spark):
    df = spark.createDataFrame(
        [("1", 10, 20, "A", "DEP", "Transport_Seg1", "OUT", 0),
         ("2", 10, 20, "B", "DEP", "Transport_Seg1", "OUT", 0)],
        "leg_id string, planned_mins bigint, effective_mins bigint, hub_id string, "
        "milestone string, stage_group string, leg_type string, seq bigint")
    from hubflow.functions.columns import delay_expr
    k = hub_kpis(df.withColumn("delay_mins", delay_expr())).collect()
    assert {r.delay_rank for r in k} == {1}
    assert {r.std_delay for r in k} == {0.0}
