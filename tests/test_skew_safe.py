"""The skew-safe successor path equals the window path, also with a hot leg."""

from pyspark.sql import functions as F

from hubflow.operators.journeys import with_successor


def _pairs(df):
    return sorted((r.leg_id, r.seq, r.src, r.dst) for r in df.select("leg_id", "seq", "src", "dst").collect())


def test_skew_safe_matches_window_on_fixture(f1):
    assert _pairs(with_successor(f1)) == _pairs(with_successor(f1, skew_safe=True, partitions=3))


def test_skew_safe_hot_leg(spark):
    # one leg with 3000 rows plus 200 small legs; hubs cycle so successors are checkable
    hot = spark.range(3000).select(
        F.lit("0").alias("leg_id"), (F.col("id") % 7 * 10).alias("planned_mins"),
        F.lit(5).cast("bigint").alias("effective_mins"),
        F.concat(F.lit("h"), (F.col("id") % 11).cast("string")).alias("hub_id"),
        F.lit("DEP").alias("milestone"), F.lit("Transport_Seg1").alias("stage_group"),
        F.lit("OUT").alias("leg_type"), F.col("id").alias("seq"),
        F.lit(0).cast("bigint").alias("delay_mins"))
    small = spark.range(600).select(
        (F.col("id") % 200).cast("string").alias("leg_id"), F.col("id").alias("planned_mins"),
        F.lit(5).cast("bigint").alias("effective_mins"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("hub_id"),
        F.lit("DEP").alias("milestone"), F.lit("Transport_Seg1").alias("stage_group"),
        F.lit("OUT").alias("leg_type"), F.col("id").alias("seq"),
        F.lit(0).cast("bigint").alias("delay_mins"))
    df = hot.unionByName(small)
    a = _pairs(with_successor(df))
    b = _pairs(with_successor(df, skew_safe=True, partitions=8))
    assert a == b
