"""Parquet sources: the driver's TPC-H-style tables and the journey adapters.

``journeys_long`` turns ``lineitem JOIN orders`` into the long milestone log
(one row per milestone: leg, planned/effective minutes, hub, stage), the
central fact table of every operator. ``journeys_wide`` pivots the same lines
into the 98-column all-text "raw" journey format, so the cleaning and
unpivot operators run on data that grows with the tables too.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow.functions.columns import (
    LEG_PREFIXES, NO_HUB, SEGMENTS, delay_expr, non_empty, raw_columns)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# --- fixed values of the adapter: line number -> (milestone, stage group) ---
LINE_STAGES = [
    ("RCS", "CheckIn"),
    ("DEP", "Transport_Seg1"),
    ("RCF", "Transport_Seg1"),
    ("DEP", "Transport_Seg2"),
    ("RCF", "Transport_Seg2"),
    ("DEP", "Transport_Seg3"),
    ("DLV", "Delivery"),
]
# Raw slots of a leg, filled from line numbers 1..7; of line 6 the lines with
# an even part key are the third arrival, so all eight slots occur.
SLOTS = ["rcs", "dep_1", "rcf_1", "dep_2", "rcf_2", "dep_3", "dlv", "rcf_3"]
# The r-th repeat of an (order, line) goes to this leg, from the fifth on of a
# further process.
REPEAT_LEGS = ["o", "i1", "i2", "i3"]
# --- end of fixed values ---

#: lines that one task of the journey join and its windows sorts
TASK_LINES = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan of one driver table (pruning/pushdown left to Catalyst)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _by_order(li: DataFrame, od: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by order key over as many tasks as the lines ask for.

    The join and the windows over a leg sort what one task holds several times
    over. Left alone, adaptive execution merges shuffle partitions up to a size
    in compressed bytes, whatever the sorts then take in memory. The count reads
    file footers only; tables that the cores share out anyway stay as they are."""
    n = -(-li.count() // TASK_LINES)
    if n <= li.sparkSession.sparkContext.defaultParallelism:
        return li, od
    return li.repartition(n, "l_orderkey"), od.repartition(n, "o_orderkey")


def _lines(spark: SparkSession, sf_dir: str, hub: str) -> DataFrame:
    """``lineitem JOIN orders`` projected to what a milestone needs.

    ``hub='supplier'`` uses the supplier key as hub id; ``hub='nation'`` the
    supplier's nation name (a 25-hub network for path queries). Supplier 0 is
    the "no hub" marker in both. The dimension joins are plain equi-joins:
    Catalyst broadcasts them only when their size statistics are under
    ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks at runtime.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li, od = _by_order(li, od)
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    if hub == "supplier":
        hub_col = F.col("l_suppkey").cast("string")
    elif hub == "nation":
        sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        sn = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select("s_suppkey", "n_name")
        j = j.join(sn, j.l_suppkey == sn.s_suppkey, "left")
        hub_col = F.col("n_name")
    else:
        raise ValueError(f"unknown hub kind {hub!r}")
    planned = (F.col("l_quantity") * 60).cast("bigint")
    return j.select(
        F.col("l_orderkey").alias("leg_id"),
        "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
        planned.alias("planned_mins"),
        F.greatest(F.lit(0).cast("bigint"),
                   planned + F.datediff("l_shipdate", "o_orderdate")).alias("effective_mins"),
        F.when(F.col("l_suppkey") == 0, F.lit(NO_HUB))
         .otherwise(F.coalesce(hub_col, F.lit(NO_HUB))).alias("hub_id"),
    )


def journeys_long(spark: SparkSession, sf_dir: str, hub: str = "supplier") -> DataFrame:
    """Milestone log from the driver tables.

    Columns: ``leg_id BIGINT, planned_mins, effective_mins, hub_id, milestone,
    stage_group, leg_type, delay_mins, seq``. ``seq`` is the position of the
    row inside its leg in the total order ``(planned_mins, l_linenumber,
    l_shipdate, l_partkey, l_suppkey)``, so ``(planned_mins, seq)`` is a
    unique, deterministic path order (quirk Q4). The window partitions by the
    join key, so it reuses the join's shuffle when the join is a sort-merge.
    """
    lines = _lines(spark, sf_dir, hub)
    stages = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"))
                       for m, s in LINE_STAGES])
    st = F.element_at(stages, F.col("l_linenumber"))
    df = lines.select(
        "leg_id", "planned_mins", "effective_mins", "hub_id",
        st["m"].alias("milestone"), st["s"].alias("stage_group"),
        F.lit("OUT").alias("leg_type"),
        "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
    ).withColumn("delay_mins", delay_expr()).filter(non_empty())
    order = Window.partitionBy("leg_id").orderBy(
        "planned_mins", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return df.select(
        "leg_id", "planned_mins", "effective_mins", "hub_id", "milestone",
        "stage_group", "leg_type", "delay_mins",
        F.row_number().over(order).cast("bigint").alias("seq"))


def journeys_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same journeys in the 98-column raw text format (all STRING).

    Every line fills one slot of one leg. The r-th repeat of an (order, line)
    pair, ordered by ``(shipdate, partkey, suppkey, quantity)``, goes to leg
    OUT, IN_1, IN_2, IN_3 for r = 1..4 and from r = 5 on to further process
    rows of the order, so no line is lost at any repeat count. Each leg has a
    leg id of its own; a leg without lines is all ``?``, as is a missing slot
    and any effective time of 0. One window clustered by order, then one
    aggregation per process of at most 32 entries.
    """
    lines = _lines(spark, sf_dir, "supplier")
    repeat = Window.partitionBy("leg_id", "l_linenumber").orderBy(
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    third = (F.col("l_linenumber") == 6) & (F.col("l_partkey") % 2 == 0)
    slot = F.element_at(F.array(*[F.lit(x) for x in SLOTS]),
                        F.when(third, 8).otherwise(F.col("l_linenumber")))
    leg = F.element_at(F.array(*[F.lit(x) for x in REPEAT_LEGS]),
                       (F.col("_r") % len(REPEAT_LEGS) + 1).cast("int"))
    placed = (lines.withColumn("_r", F.row_number().over(repeat) - 1)
              .withColumn("_process", F.floor(F.col("_r") / len(REPEAT_LEGS)).cast("bigint"))
              .select("leg_id", "_process", F.concat_ws("_", leg, slot).alias("at"),
                      F.struct(F.col("planned_mins").alias("p"), F.col("effective_mins").alias("e"),
                               F.col("l_suppkey").alias("s")).alias("v")))
    g = placed.groupBy("leg_id", "_process").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    order = F.col("leg_id").cast("string")
    exprs = {"nr": F.when(F.col("_process") == 0, order).otherwise(
                 F.concat_ws("-", order, F.col("_process").cast("string"))),
             "legs": F.lit("0")}
    for k, leg_name in enumerate(REPEAT_LEGS):
        at = {x: F.try_element_at("m", F.lit(f"{leg_name}_{x}")) for x in SLOTS}
        filled = F.coalesce(*[v["p"] for v in at.values()]).isNotNull()
        exprs[f"{leg_name}_legid"] = F.when(
            filled, (F.col("leg_id") * 1000 + F.col("_process") * 4 + k).cast("string"))
        for x, v in at.items():
            exprs[f"{leg_name}_{x}_p"] = v["p"].cast("string")
            exprs[f"{leg_name}_{x}_e"] = F.when(v["e"] != 0, v["e"].cast("string"))
            if x not in ("rcs", "dlv"):
                exprs[f"{leg_name}_{x}_place"] = v["s"].cast("string")
        hops = sum(F.when(at[f"dep_{n}"].isNotNull(), 1).otherwise(0) for n in SEGMENTS)
        exprs[f"{leg_name}_hops"] = F.when(filled, hops.cast("string"))
    return g.select(*[F.coalesce(exprs[c], F.lit("?")).alias(c) for c in raw_columns()])


__all__ = ["read_table", "journeys_long", "journeys_wide", "TABLES", "LINE_STAGES",
           "SEGMENTS", "LEG_PREFIXES"]
