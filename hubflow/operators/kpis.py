"""Per-hub delay KPIs (A1, A2, W2, P19, O1) and hub quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.columns import NO_HUB, non_empty, to_number
from hubflow.functions.ranking import dense_rank, exact_percentile, exact_percentiles
from hubflow.session import cut_lineage

KPI_COLUMNS = ["hub_id", "total_outgoing_flow", "avg_segment_delay", "std_delay",
               "median_delay", "max_delay", "delay_rank"]

# --- fixed values: quadrant names ---
QUADRANTS = ["Critical Bottleneck", "Efficient Major Hub", "Inefficient Small Hub",
             "Efficient Small Hub"]
# --- end of fixed values ---


def hub_kpis(long_df: DataFrame, min_volume: int = 1, sort: bool = True) -> DataFrame:
    """A1 + A2 + P19 + W2 (+ O1 when ``sort``).

    One ``groupBy(hub_id)``: count, mean, sample std, exact median and max of
    the delay. The aggregation is partial (map-side) so a hub holding a third
    of all rows is pre-aggregated per task before the shuffle; the exact
    median keeps a per-hub value->count map, bounded by distinct delays.

    Single-row hubs have no sample std; it is filled with the median std of
    all hubs **before** the volume filter (quirk Q11). The hub table is
    written once; the exact median and the dense rank (1 = worst mean delay)
    are computed from it with distributed helpers (no single-partition
    window: hubs grow with the data), so the milestones are read once.
    """
    df = long_df
    if "delay_mins" not in df.columns:
        df = df.withColumn("delay_mins",
                           (to_number("effective_mins") - to_number("planned_mins")).cast("bigint"))
    df = df.filter(F.col("delay_mins").isNotNull() & F.col("hub_id").isNotNull()
                   & (F.col("hub_id") != NO_HUB) & non_empty())
    # rows first combine per (hub, delay) in the map tasks, which also splits
    # a hot hub; mean, deviation and the exact median follow from the counts
    d, c = F.col("delay_mins").cast("double"), F.col("_c")
    counts = df.groupBy("hub_id", "delay_mins").agg(
        F.count("leg_id").alias("_legs"), F.count("*").alias("_c"))
    mean = F.col("_s") / F.col("_n")
    # squared differences from the mean over the counts: sums of squares would cancel in large hubs
    away = lambda x: x["d"].cast("double") - mean
    spread = F.aggregate("_cells", F.lit(0.0), lambda a, x: a + away(x) * away(x) * x["c"])
    agg = counts.groupBy("hub_id").agg(
        F.sum("_legs").alias("total_outgoing_flow"), F.sum("_c").alias("_n"),
        F.sum(d * c).alias("_s"), F.percentile("delay_mins", 0.5, c).alias("median_delay"),
        F.max("delay_mins").alias("max_delay"),
        F.collect_list(F.struct(F.col("delay_mins").alias("d"), F.col("_c").alias("c"))).alias("_cells"))
    agg = agg.select("hub_id", "total_outgoing_flow", mean.alias("avg_segment_delay"),
                     F.when(F.col("_n") > 1, F.sqrt(spread / (F.col("_n") - 1))).alias("std_delay"),
                     "median_delay", "max_delay")
    agg = cut_lineage(agg)  # the hub table, written once and reused below
    med = exact_percentile(agg, "std_delay", 0.5)
    filled = agg.withColumn("std_delay", F.coalesce(
        "std_delay", F.lit(med).cast("double"), F.lit(0.0)))
    kept = filled.filter(F.col("total_outgoing_flow") >= min_volume)
    ranked = dense_rank(kept, F.desc("avg_segment_delay"), "avg_segment_delay", "delay_rank")
    ranked = ranked.select(*KPI_COLUMNS)
    if sort:
        ranked = ranked.orderBy(F.desc("total_outgoing_flow"), "hub_id")
    return ranked


def hub_quadrants(kpis: DataFrame, min_flow_percentile: float = 0.10) -> DataFrame:
    """Keep hubs with flow >= the p-th percentile (linear interpolation),
    then split at the medians of flow and mean delay of the kept hubs
    (``>`` is high, ``<=`` low). The hub table is written once and the
    cut-offs are exact distributed percentiles over it."""
    k = cut_lineage(kpis)
    cut = exact_percentile(k, "total_outgoing_flow", min_flow_percentile)
    kept = k.filter(F.col("total_outgoing_flow") >= F.lit(cut))
    mf, md = exact_percentiles(kept, [("total_outgoing_flow", 0.5), ("avg_segment_delay", 0.5)])
    hi_f = F.col("total_outgoing_flow") > F.lit(mf)
    hi_d = F.col("avg_segment_delay") > F.lit(md)
    cat = (F.when(hi_f & hi_d, QUADRANTS[0]).when(hi_f, QUADRANTS[1])
           .when(hi_d, QUADRANTS[2]).otherwise(QUADRANTS[3]))
    return kept.withColumn("hub_category", cat)
