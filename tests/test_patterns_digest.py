"""Late sequences counted by digest against the plain form."""

import random

import pytest

from hubflow.operators.patterns import late_patterns, late_patterns_by_digest

SCHEMA = "leg_id string, planned_mins bigint, seq bigint, hub_id string, delay_mins bigint"


def _same(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r) for r in late_patterns_by_digest(df, **kw).collect()]
    kw.pop("chunk", None)
    assert got == [tuple(r) for r in late_patterns(df, **kw).collect()]
    return got


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_digest_equals_plain_form_with_many_ties(spark, chunk):
    rnd = random.Random(2)
    rows = [(f"L{leg}", rnd.randint(0, 3), i, rnd.choice(["1", "10", "2", "A", "none"]), rnd.choice([0, 31, 90]))
            for leg in range(60) for i in range(rnd.randint(0, 9))]
    _same(spark, rows, chunk=chunk)
    _same(spark, rows, chunk=chunk, top_n=200)


def test_a_leg_with_a_third_of_all_rows(spark):
    rows = [("0", t % 50, t, f"h{t % 13}", 60) for t in range(4000)]
    rows += [(f"L{leg}", t, t, f"h{t}", 60) for leg in range(2000) for t in range(4)]
    got = _same(spark, rows, top_n=2)
    assert got[0] == ("h0 -> h1 -> h2 -> h3", 2000) and got[1][1] == 1 and got[1][0].count("->") == 3999


def test_no_late_rows(spark):
    assert _same(spark, [("a", 1, 1, "x", 5)]) == []
