"""Frequent late hub sequences (M8: A11 + A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import cut_lineage, drop_tables


def late_sequences(long_df: DataFrame, min_delay_threshold: int = 30) -> DataFrame:
    """Per leg, the hubs of its late milestones in path order, joined
    with ``' -> '``. ``'none'`` hubs are kept, as in the source.

    The ordered list is the output value itself (one string per leg), so
    the per-leg state is the size of that string; it is built by a
    sort-free ``collect_list`` of ``(planned, seq, hub)`` structs after
    map-side partial aggregation, then sorted inside the row.
    """
    late = long_df.filter(F.col("delay_mins") > min_delay_threshold)
    order = ["planned_mins", "seq"] if "seq" in long_df.columns else ["planned_mins"]
    g = late.groupBy("leg_id").agg(
        F.sort_array(F.collect_list(F.struct(*order, "hub_id"))).alias("steps"))
    return g.select("leg_id", F.array_join(
        F.transform("steps", lambda s: s["hub_id"]), " -> ").alias("pattern"))


def late_patterns(long_df: DataFrame, min_delay_threshold: int = 30,
                  top_n: int | None = 10) -> DataFrame:
    """Count identical late sequences; the ``top_n`` most frequent
    (ties by pattern text). Empty input gives an empty table."""
    counts = late_sequences(long_df, min_delay_threshold).groupBy("pattern").agg(
        F.count("*").alias("frequency"))
    if top_n is None:
        return counts
    return counts.orderBy(F.desc("frequency"), "pattern").limit(top_n)


def late_steps(long_df: DataFrame, min_delay_threshold: int = 30) -> DataFrame:
    """Written (leg_id, pos, hub_id): each late milestone's place in its leg.

    Milestones are range-partitioned by leg and path order, so a leg that holds
    a large share of all rows is numbered in many tasks: inside a block of one
    leg by a window, across blocks by an offset. Only legs that cross a
    partition border have one, two rows a border at most, which are broadcast."""
    order = ["planned_mins", "seq"] if "seq" in long_df.columns else ["planned_mins"]
    late = long_df.filter(F.col("delay_mins") > min_delay_threshold).select("leg_id", *order, "hub_id")
    blocks = cut_lineage(late.repartitionByRange("leg_id", *order).withColumn("_p", F.spark_partition_id()))
    size = blocks.groupBy("leg_id", "_p").agg(F.count("*").alias("_n"))
    crossing = size.groupBy("leg_id").agg(F.count("*").alias("_k")).filter("_k > 1").select("leg_id")
    earlier = Window.partitionBy("leg_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.join(crossing, "leg_id", "left_semi").select(
        "leg_id", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("leg_id", "_p").orderBy(*order)
    out = cut_lineage(blocks.withColumn("_r", F.row_number().over(inside))
                      .join(F.broadcast(offset), ["leg_id", "_p"], "left")
                      .select("leg_id", (F.col("_r") + F.coalesce("_off", F.lit(0))).alias("pos"), "hub_id"))
    drop_tables(blocks)
    return out


def sequence_digests(steps: DataFrame) -> DataFrame:
    """(leg_id, n, d1, d2): a digest of each leg's hubs in order. It is a sum over
    (place, hub), so blocks of a leg combine in any order, in the map tasks."""
    part = lambda seed: F.sum(F.xxhash64("pos", "hub_id", F.lit(seed)).cast("decimal(38,0)"))
    return steps.groupBy("leg_id").agg(F.count("*").alias("n"), part(1).alias("d1"), part(2).alias("d2"))


def _spelled(steps: DataFrame, legs: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(leg_id, text) of the places ``first`` to ``last``; a text that goes on
    beyond ``last`` ends in the separator."""
    some = steps.join(legs.select("leg_id", "n"), "leg_id").filter(F.col("pos") >= first)
    if last is not None:
        some = some.filter(F.col("pos") <= last)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hub_id"))), lambda s: s["hub_id"]), " -> ")
    more = F.lit("") if last is None else F.when(F.max("n") > last, " -> ").otherwise("")
    return some.groupBy("leg_id").agg(F.concat(text, more).alias("text"))


def late_patterns_by_digest(long_df: DataFrame, min_delay_threshold: int = 30, top_n: int = 10,
                            chunk: int = 64) -> DataFrame:
    """M8/A11/A12 for legs of any length: sequences are counted by digest, and
    only the ``top_n`` most frequent are spelled. Equal frequencies go by text:
    where too many tie, ``chunk`` places at a time decide. Same result as
    ``late_patterns``."""
    steps = late_steps(long_df, min_delay_threshold)
    counts = cut_lineage(sequence_digests(steps).groupBy("n", "d1", "d2").agg(
        F.count("*").alias("frequency"), F.min("leg_id").alias("leg_id")))
    best = [r["frequency"] for r in counts.orderBy(F.desc("frequency")).limit(top_n).collect()]
    least = best[-1] if best else 0
    need = sum(f == least for f in best)
    chosen = counts.filter(F.col("frequency") > least)
    tied = counts.filter(F.col("frequency") == least)
    first = 1
    while need and tied.count() > need:
        pieces = cut_lineage(tied.join(_spelled(steps, tied, first, first + chunk - 1), "leg_id"))
        cut = [r["text"] for r in pieces.orderBy("text").limit(need).collect()][-1]
        sure = cut_lineage(pieces.filter(F.col("text") < cut).drop("text"))
        chosen, need = chosen.unionByName(sure), need - sure.count()
        tied, first = cut_lineage(pieces.filter(F.col("text") == cut).drop("text")), first + chunk
        drop_tables(pieces)
    chosen = cut_lineage(chosen.unionByName(tied) if need else chosen)
    return (_spelled(steps, chosen).join(chosen.select("leg_id", "frequency"), "leg_id")
            .select(F.col("text").alias("pattern"), "frequency").orderBy(F.desc("frequency"), "pattern"))
