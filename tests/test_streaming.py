"""The streaming KPI monitor agrees with the batch operator on the same rows."""

import os
import tempfile

import pytest

from hubflow.operators.kpis import hub_kpis
from hubflow.streaming.hub_monitor import milestone_stream, start_monitor


def test_stream_matches_batch(spark, f1):
    base = tempfile.mkdtemp(prefix="hubflow-stream-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    f1.filter("leg_id = '101'").write.parquet(src, mode="append")
    f1.filter("leg_id <> '101'").write.parquet(src, mode="append")
    q = start_monitor(milestone_stream(spark, src), out, ck, available_now=True)
    q.awaitTermination(120)
    got = {r.hub_id: r for r in spark.read.parquet(out).collect()}
    exp = {r.hub_id: r for r in hub_kpis(f1).collect()}
    assert set(got) == set(exp)
    for h in exp:
        assert got[h].total_outgoing_flow == exp[h].total_outgoing_flow
        assert got[h].avg_segment_delay == pytest.approx(exp[h].avg_segment_delay)
        assert got[h].delay_rank == exp[h].delay_rank
