"""Wide -> long unpivot (U1/U2) and hub-to-hub path reconstruction.

``transits`` is the one place the "next hub within a leg" window is built;
the five consumers of the source each filter it differently, kept here as
named variants so a caller can build the window once, ``persist`` it, and
derive every edge table from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions.columns import (
    CHECKIN, DEP, ARR, DELIVERY, LEG_PREFIXES, NO_HUB, SEGMENTS, SUFFIXES,
    canonical_hub, delay_expr, is_transport, non_empty, normalise_hub, stage_column, to_number)
from hubflow.session import cut_lineage

VARIANTS = ("embed", "router", "predict", "cost", "flow")
MISSING = "nan"  # text of a missing successor in compat mode (quirk Q7)


def unpivot_long(clean: DataFrame, compat: bool = False) -> DataFrame:
    """One row per milestone from the cleaned wide table.

    Per leg prefix: RCS at the first hub, DEP/RCF for segments 1..3 (only
    where the hub and planned columns exist), DLV at the last non-empty
    arrival hub. One ``explode`` over an array of structs per leg prefix, each
    reading that leg's columns only (pass a written table: its columns are
    stored apart, so the four passes read every value once), and no shuffle.
    All legs in one array make a method too large for the JVM to compile.
    Times are coerced to numbers (invalid -> 0), hubs normalised, delay
    computed and all-zero rows dropped.

    Plan-time pruning: a milestone whose planned and effective columns both
    stayed text in cleaning holds no numeric value at all (that is what
    the cleaning guard established), so both times are 0 and the row would
    be dropped; such milestones are left out of the array.
    """
    types = dict(clean.dtypes)
    cols = set(clean.columns)

    def minutes(c):
        if c not in cols:
            return F.lit(None).cast("double")
        if types[c] == "string":
            return to_number(c)
        return F.col(c).cast("double")

    def always_empty(p, e):
        return all(c not in cols or types[c] == "string" for c in (p, e))

    parts = []
    seq = 0
    for leg in LEG_PREFIXES.values():
        items = []
        leg_id = f"{leg}_Leg_ID"
        if leg_id not in cols:
            continue
        first = f"{leg}_{DEP}_Seg1_Hub_ID"
        first_hub = F.col(first) if first in cols else F.lit(NO_HUB)
        last = [f"{leg}_{ARR}_Seg{s}_Hub_ID" for s in reversed(SEGMENTS)]
        last_hub = F.coalesce(
            *[F.when(~F.col(c).cast("string").isin("0", "?"), F.col(c)) for c in last if c in cols],
            F.lit(NO_HUB))
        specs = [(f"{leg}_{CHECKIN}_Planned_Mins", f"{leg}_{CHECKIN}_Effective_Mins",
                  first_hub, "RCS", CHECKIN)]
        for s in SEGMENTS:
            for kind, milestone in ((DEP, "DEP"), (ARR, "RCF")):
                base = f"{leg}_{kind}_Seg{s}"
                hub_c, p_c, e_c = (f"{base}_{SUFFIXES[k]}" for k in ("place", "p", "e"))
                if hub_c in cols and p_c in cols:
                    specs.append((p_c, e_c, F.col(hub_c), milestone, f"Transport_Seg{s}"))
        specs.append((f"{leg}_{DELIVERY}_Planned_Mins", f"{leg}_{DELIVERY}_Effective_Mins",
                      last_hub, "DLV", DELIVERY))
        for p_c, e_c, hub, milestone, stage in specs:
            if not always_empty(p_c, e_c):
                items.append(F.struct(
                    F.col(leg_id).cast("string").alias("leg_id"),
                    minutes(p_c).alias("p"), minutes(e_c).alias("e"),
                    hub.cast("string").alias("hub"),
                    F.lit(milestone).alias("milestone"), F.lit(stage).alias("stage_group"),
                    F.lit(leg).alias("leg_type"), F.lit(seq).cast("bigint").alias("seq")))
            seq += 1
        if items:
            parts.append(clean.select(F.explode(F.array(*items)).alias("m")).select("m.*"))
    if not any(f"{leg}_Leg_ID" in cols for leg in LEG_PREFIXES.values()):
        raise ValueError("no leg id column in the cleaned table")
    schema = ("leg_id string, planned_mins bigint, effective_mins bigint, hub_id string, "
              "milestone string, stage_group string, leg_type string, delay_mins bigint, "
              "seq bigint")
    if not parts:
        return clean.sparkSession.createDataFrame([], schema)
    x = reduce(DataFrame.unionByName, parts)
    hub = normalise_hub("hub")
    if not compat:
        hub = canonical_hub(hub)
    if compat:
        # The source turned a float hub into text like "128.0" for DLV rows
        # only; reproduce by appending ".0" to numeric DLV hubs (quirk Q3).
        hub = F.when((F.col("milestone") == "DLV") & F.col("hub").rlike(r"^\d+$"),
                     F.concat(F.col("hub"), F.lit(".0"))).otherwise(hub)
    out = x.select(
        "leg_id",
        F.coalesce("p", F.lit(0.0)).cast("bigint").alias("planned_mins"),
        F.coalesce("e", F.lit(0.0)).cast("bigint").alias("effective_mins"),
        hub.alias("hub_id"), "milestone", "stage_group", "leg_type", "seq")
    return out.filter(non_empty()).withColumn("delay_mins", delay_expr()).select(
        "leg_id", "planned_mins", "effective_mins", "hub_id", "milestone",
        "stage_group", "leg_type", "delay_mins", "seq")


def with_successor(long_df: DataFrame, compat: bool = False,
                   skew_safe: bool = False, partitions: int | None = None) -> DataFrame:
    """``src``/``dst`` = this hub and the next one in the leg.

    Order is ``(planned_mins, seq)`` within ``leg_id`` (quirk Q4). Default:
    one hash shuffle by leg and a ``lead`` window; legs are journeys, so
    their size is bounded by the journey, and the window buffer spills if
    one is large.

    ``skew_safe=True`` is for inputs where one leg id may hold a large share
    of all rows (e.g. scrubbed ``'0'`` leg ids): rows are range-partitioned
    on the full sort key ``(leg_id, planned_mins, seq)``, so a hot leg is
    split over many tasks; ``lead`` runs per (partition, leg) block; the
    last row of each block takes the first hub of the same leg's next block,
    found from a table with one row per block (a leg spans at most
    ``partitions`` blocks, so that window is bounded). The partitioned rows
    are written once and read back, so this path runs a job when called.
    """
    order = ["planned_mins", "seq"] if "seq" in long_df.columns else ["planned_mins"]
    if "delay_mins" not in long_df.columns:
        long_df = long_df.withColumn(
            "delay_mins", to_number("effective_mins") - to_number("planned_mins"))
    if not skew_safe:
        w = Window.partitionBy("leg_id").orderBy(*order)
        nxt = F.lead("hub_id").over(w)
    else:
        spark = long_df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        cols = long_df.columns
        r = long_df.repartitionByRange(n, "leg_id", *order).withColumn(
            "_blk", F.spark_partition_id())
        wb = Window.partitionBy("_blk", "leg_id").orderBy(*order)
        r = r.withColumn("_in", F.lead("hub_id").over(wb)) \
             .withColumn("_last", F.lead(F.lit(1)).over(wb).isNull())
        # written once: a second evaluation of the range partitioning could
        # draw other borders, and blocks would not fit their rows
        r = cut_lineage(r)
        first = r.groupBy("_blk", "leg_id").agg(
            F.min_by("hub_id", F.struct(*order)).alias("_first"))
        nb = first.withColumn(
            "_next", F.lead("_first").over(Window.partitionBy("leg_id").orderBy("_blk"))) \
            .select("_blk", "leg_id", "_next")
        long_df = r.join(nb, ["_blk", "leg_id"], "left")
        nxt = F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_in"))
        long_df = long_df.withColumn("_dst", nxt).select(*cols, "_dst")
        nxt = F.col("_dst")
    if compat:
        nxt = F.coalesce(nxt, F.lit(MISSING))
    out = long_df.withColumn("src", F.col("hub_id")).withColumn("dst", nxt)
    return out.drop("_dst") if skew_safe else out


def written_successors(long_df: DataFrame) -> DataFrame:
    """The milestones with ``src`` and ``dst``, written once for consumers that
    would each shuffle the lines again (hub KPIs and edges). Path order, milestone
    and leg type, which only the window needs or nobody reads, are left out."""
    s = cut_lineage(with_successor(long_df).drop("src", "seq", "milestone", "leg_type"))
    return s.withColumn("src", F.col("hub_id"))


def transits(long_df: DataFrame, variant: str = "embed", compat: bool = False,
             successors: DataFrame | None = None, skew_safe: bool = False) -> DataFrame:
    """Filter the successor table the way each consumer of the source does.

    ==========  ===========  =================  ==========  =========
    variant     'none' hubs  missing successor  self-loops  stages
    ==========  ===========  =================  ==========  =========
    embed       removed      dropped            dropped     transport
    router      removed      kept (NULL dst)    kept        transport
    predict     kept         kept (NULL dst)    kept        transport
    cost        kept         dropped            kept        transport
    flow        removed      dropped            dropped     all
    ==========  ===========  =================  ==========  =========

    With ``compat=True`` a missing successor is the text ``'nan'`` (as in
    the source), so the "kept" variants carry a ``'nan'`` sink node.
    ``successors`` lets callers pass a persisted ``with_successor`` result.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    s = successors if successors is not None else with_successor(long_df, compat, skew_safe)
    return s.filter(variant_condition(variant, stage_column(s), compat))


def variant_condition(variant: str, stage: str = "stage_group", compat: bool = False):
    """The row predicate of a transit variant (see ``transits``), usable in
    filters and in conditional aggregates (several variants in one pass)."""
    src, dst = F.col("src"), F.col("dst")
    conds = []
    if variant != "flow":
        conds.append(is_transport(stage))
    if variant in ("embed", "router", "flow"):
        conds += [src != NO_HUB, F.coalesce(dst != NO_HUB, F.lit(True))]
    if variant in ("embed", "flow"):
        conds += [dst.isNotNull(), src != dst]
        if compat:
            conds.append(dst != MISSING)
    if variant == "cost":
        conds += [dst.isNotNull(), src.isNotNull()]
        if compat:
            conds += [src != MISSING, dst != MISSING]
    if variant in ("router", "predict", "cost"):
        conds.append(F.col("delay_mins").isNotNull())
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return F.coalesce(cond, F.lit(False))
