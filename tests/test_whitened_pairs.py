"""Link prediction writes whitened pairs and shuffles the lines once."""

import numpy as np
import pytest

from hubflow.operators import embed, flow, kpis
from hubflow.operators.journeys import transits, with_successor, written_successors


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(5)
    nodes = [(str(i), *map(float, rng.normal(size=3))) for i in range(40)]
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2)) if a != b}
    return (spark.createDataFrame(nodes, "hub_id string, a double, b double, c double"),
            spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string"))


def test_written_pairs_hold_whitened_features_only(graph, monkeypatch):
    nodes, edges = graph
    written, plain = [], embed.cut_lineage
    monkeypatch.setattr(embed, "cut_lineage", lambda df: written.append(df.schema) or plain(df))
    embed.link_embedding(nodes, edges, ["a", "b", "c"], dim=8, hops=5)
    pairs = [s for s in written if "y" in s.names]
    assert len(pairs) == 1 and all(f.dataType.simpleString() == "double" for f in pairs[0])


def test_fit_is_that_of_whole_features(graph):
    nodes, edges = graph
    h = embed.propagate(nodes, edges, ["a", "b", "c"], 5)
    w = embed.whitening(h, 18)
    y = edges.selectExpr("src", "dst", "1D as y").unionByName(
        embed.negative_edges(nodes, edges).selectExpr("src", "dst", "0D as y"))
    whole = (y.join(h.selectExpr("hub_id as src", "h as hi"), "src")
             .join(h.selectExpr("hub_id as dst", "h as hj"), "dst").select("y", "hi", "hj"))
    fit = embed.fit_bilinear(whole, 18, w, 5e-4, 100)
    _, loss = embed.link_embedding(nodes, edges, ["a", "b", "c"], dim=8, hops=5)
    assert np.allclose(loss, fit.loss, rtol=0, atol=1e-12)
    rows = embed.whitened_pairs(h, y, w, "hub_id").collect()
    assert len(rows) == whole.count() and len(rows[0]) == 1 + 2 * w.shape[1]


def test_nodes_without_features_fit_too(spark, graph):
    _, edges = graph
    flat = spark.range(40).selectExpr("cast(id as string) as hub_id", "0D as a")
    emb, loss = embed.link_embedding(flat, edges, ["a"], dim=4, hops=2)
    assert np.allclose(loss, np.log(2)) and all(r["embedding"] == [0.0] * 4 for r in emb.collect())


def test_lines_are_written_once(f1, monkeypatch):
    lines = written_successors(f1)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(kpis.hub_kpis(lines)) == rows(kpis.hub_kpis(f1))
    cols = ["leg_id", "src", "dst", "delay_mins"]
    assert rows(transits(None, "embed", successors=lines).select(cols)) == rows(
        transits(None, "embed", successors=with_successor(f1)).select(cols))
    read, plain = [], flow.hub_kpis
    monkeypatch.setattr(flow, "hub_kpis", lambda df, **kw: read.append(df) or plain(df, **kw))
    flow.hub_flow(f1, dim=2, hops=1, max_k=2, n_init=1)
    assert "dst" in read[0].columns
