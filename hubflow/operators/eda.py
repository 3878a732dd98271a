"""Exploratory statistics: correlation (E1/X7), VIF (E2), skewness (E3),
histograms (E4), stage delay profile (X4) and a 2-D density grid (X5).

Everything is a single-pass global or per-column aggregation; the only
values brought to the driver are p x p moment sums for the VIF inverse.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: skewness interpretation labels ---
SKEW_LABELS = ["Highly Positive Skew", "Highly Negative Skew", "Fairly Symmetrical",
               "Moderate Skew"]
# --- end of fixed values ---


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot numeric columns to ``(column_name, value DOUBLE)`` (narrow)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in cols])).alias("kv")).select("kv.*")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """E1 + X7: Pearson correlation of every ordered column pair, long form
    ``(feature_x, feature_y, correlation)``; one aggregation job for all
    pairs (each ``corr`` is a mergeable moment aggregate)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = []
    for i, (a, b) in enumerate(pairs):
        items.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                              F.col(f"`{i}`").alias("correlation")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("feature_x"), F.lit(a).alias("feature_y"),
                                  F.col(f"`{i}`").alias("correlation")))
    return row.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def vif(df: DataFrame, cols: list[str], singular_tol: float = 1e-10) -> DataFrame:
    """Variance inflation factors of a regression **without intercept**
    (uncentred R^2, as the source's statsmodels call).

    ``VIF_i = G_ii * (G^-1)_ii`` with the Gram matrix ``G = X'X``: one
    aggregation of p(p+1)/2 sums, inverted on the driver (p x p). A
    rank-deficient ``G`` gives ``Infinity`` for every column.
    """
    spark = df.sparkSession
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = df.agg(*[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double"))
                 .alias(f"g{i}_{j}") for i, j in pairs]).first()
    p = len(cols)
    g = np.zeros((p, p))
    for i, j in pairs:
        v = r[f"g{i}_{j}"] or 0.0
        g[i, j] = g[j, i] = v
    d = np.sqrt(np.clip(np.diag(g), 1e-300, None))
    corr = g / np.outer(d, d)  # scale-free copy to judge singularity
    if p == 0 or np.linalg.matrix_rank(corr, tol=singular_tol) < p:
        vals = [float("inf")] * p
    else:
        inv = np.linalg.inv(corr)
        vals = [float(np.diag(inv)[i]) for i in range(p)]
    out = spark.createDataFrame(list(zip(cols, vals)), "feature string, vif double")
    return out.orderBy(F.desc("vif"), "feature")


def skewness_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population skewness per column (Spark's ``skewness`` is the biased
    form) with the 4-way interpretation label."""
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"s{i}")
                   for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("skewness"))
             for i, c in enumerate(cols)]
    s = row.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    k = F.col("skewness")
    label = (F.when(k > 1, SKEW_LABELS[0]).when(k < -1, SKEW_LABELS[1])
             .when((k > -0.5) & (k < 0.5), SKEW_LABELS[2]).otherwise(SKEW_LABELS[3]))
    return s.withColumn("interpretation", label)


def _bin(x, lo, hi, bins):
    """0-based equal-width bin; the top edge is inclusive; a zero range is bin 0."""
    width = hi - lo
    raw = F.floor((x - lo) * bins / width).cast("int")
    return F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))


def histogram(df: DataFrame, cols: list[str], bins: int = 30, max_columns: int = 9) -> DataFrame:
    """Equal-width histogram of (at most) the first 9 numeric columns.

    Per-column min/max is a ``groupBy(column)`` of p rows, joined back with
    a broadcast whose size is bounded by the number of columns; the counts
    are a second partial aggregation by ``(column, bin)``."""
    cols = cols[:max_columns]
    lv = _long(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = lv.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = lv.join(F.broadcast(rng), "column_name").withColumn(
        "bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    h = b.groupBy("column_name", "bin", "lo", "hi").agg(F.count("*").alias("count"))
    w = (F.col("hi") - F.col("lo")) / bins
    return h.select("column_name", "bin",
                    (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                    "count")


def kde_curves(df: DataFrame, cols: list[str], grid_points: int = 64) -> DataFrame:
    """KDE curves for the histogram panels: Gaussian kernel, Scott's bandwidth
    ``bw = std * n^(-1/5)``, evaluated on ``grid_points`` over [min, max].

    Returns ``column_name, grid_index, x, kernel_mean, bandwidth, density`` where
    ``kernel_mean`` is the average kernel value at the grid point and
    ``density = kernel_mean / (bw * sqrt(2 pi))``. One pass counts the distinct
    values of all columns; statistics and kernel sums read that table, so a
    value meets the grid once, however often it occurs."""
    from hubflow.session import cut_lineage
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    values = cut_lineage(df.select(F.explode(pairs).alias("v")).select("v.*").filter(F.col("x").isNotNull())
                         .groupBy("column_name", "x").agg(F.count("*").alias("c")))
    n = F.sum("c")
    mean = F.sum(F.col("x") * F.col("c")) / n
    stats = values.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                              n.alias("n"), mean.alias("mean"))
    spread = (values.join(F.broadcast(stats), "column_name")          # one row per column
              .groupBy("column_name", "lo", "hi", "n")
              .agg(F.sum(F.col("c") * F.pow(F.col("x") - F.col("mean"), 2)).alias("ss"))
              .withColumn("bw", F.sqrt(F.col("ss") / (F.col("n") - 1))
                          * F.pow(F.col("n").cast("double"), F.lit(-0.2))))
    g = (values.join(F.broadcast(spread), "column_name")
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
         .withColumn("pos", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (grid_points - 1)))
    k = F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("pos")) / F.col("bw"), 2))
    agg = g.groupBy("column_name", "i", "pos", "bw", "n").agg(F.sum(k).alias("ksum"))
    return agg.select(
        "column_name", F.col("i").alias("grid_index"), F.col("pos").alias("x"),
        (F.col("ksum") / F.col("n")).alias("kernel_mean"), F.col("bw").alias("bandwidth"),
        (F.col("ksum") / F.col("n") / (F.col("bw") * float(np.sqrt(2 * np.pi)))).alias("density"))


def kde_curves_binned(df: DataFrame, cols: list[str], grid_points: int = 64, error: float = 1e-6) -> DataFrame:
    """``kde_curves`` by linear binning: every value is split between the two
    neighbouring points of a fine grid, and the kernel sum runs over the grid.

    Splitting replaces the kernel by its linear interpolation, which is off by at
    most (step / bandwidth)^2 / 8 (the kernel's second derivative is at most 1 in
    size), so the step is chosen for ``kernel_mean`` to be within ``error`` of the
    exact one. The grid's size follows range / bandwidth, not the distinct values;
    rows are combined per grid point in the map tasks."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    values = df.select(F.explode(pairs).alias("v")).select("v.*").filter(F.col("x").isNotNull())
    stats = (values.groupBy("column_name")
             .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.stddev_samp("x").alias("sd"))
             .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
             .withColumn("cells", F.greatest(F.lit(1), F.ceil(
                 (F.col("hi") - F.col("lo")) / (F.col("bw") * float(np.sqrt(8 * error))))).cast("bigint"))
             .withColumn("step", (F.col("hi") - F.col("lo")) / F.col("cells")))
    from hubflow.session import cut_lineage
    stats = cut_lineage(stats)                                         # one row per column
    at = (F.col("x") - F.col("lo")) / F.col("step")
    cell = F.least(F.floor(at), F.col("cells") - 1)
    part = lambda c, w: F.struct(c.cast("bigint").alias("cell"), w.alias("w"))
    binned = (values.join(F.broadcast(stats), "column_name")
              .withColumn("at", F.when(F.col("step") > 0, at).otherwise(F.lit(0.0)))
              .withColumn("cell", F.when(F.col("step") > 0, cell).otherwise(F.lit(0)))
              .select("column_name", F.explode(F.array(
                  part(F.col("cell"), 1 - (F.col("at") - F.col("cell"))),
                  part(F.col("cell") + 1, F.col("at") - F.col("cell")))).alias("p"))
              .groupBy("column_name", "p.cell").agg(F.sum("p.w").alias("w")).filter("w > 0"))
    g = (binned.join(F.broadcast(stats), "column_name")
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
         .withColumn("pos", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (grid_points - 1)))
    u = (F.col("lo") + F.col("cell") * F.col("step") - F.col("pos")) / F.col("bw")
    agg = g.groupBy("column_name", "i", "pos", "bw", "n").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("ksum"))
    return agg.select(
        "column_name", F.col("i").alias("grid_index"), F.col("pos").alias("x"),
        (F.col("ksum") / F.col("n")).alias("kernel_mean"), F.col("bw").alias("bandwidth"),
        (F.col("ksum") / F.col("n") / (F.col("bw") * float(np.sqrt(2 * np.pi)))).alias("density"))


def stage_delay_histogram(long_df: DataFrame, bins: int = 30,
                          stage: str = "stage_group") -> DataFrame:
    """X4 (violin data): equal-width delay histogram per stage. Per-stage
    ranges are a ``groupBy(stage)`` (one row per stage of the fixed stage
    vocabulary, so the broadcast is bounded); counts are a partial
    aggregation by ``(stage, bin)``."""
    d = long_df.select(F.col(stage).alias("stage_group"),
                       F.col("delay_mins").cast("double").alias("value")) \
        .filter(F.col("value").isNotNull())
    rng = d.groupBy("stage_group").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = d.join(F.broadcast(rng), "stage_group").withColumn(
        "bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    h = b.groupBy("stage_group", "bin", "lo", "hi").agg(F.count("*").alias("count"))
    w = (F.col("hi") - F.col("lo")) / bins
    return h.select("stage_group", "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count")


def stage_delay_profile(long_df: DataFrame) -> DataFrame:
    """Delay distribution per stage: count, min, quartiles, max, mean."""
    # distinct delays are counted first: few stages, so their rows must combine
    # in the map tasks, and the exact quartiles follow from the counts
    counts = long_df.filter(F.col("delay_mins").isNotNull()).groupBy("stage_group", "delay_mins").agg(
        F.count("*").alias("c"))
    at = lambda p: F.percentile("delay_mins", p, F.col("c"))
    return counts.groupBy("stage_group").agg(
        F.sum("c").alias("n"), F.min("delay_mins").alias("min_delay"),
        at(0.25).alias("q1_delay"), at(0.5).alias("median_delay"), at(0.75).alias("q3_delay"),
        F.max("delay_mins").alias("max_delay"),
        (F.sum(F.col("delay_mins").cast("double") * F.col("c")) / F.sum("c")).alias("mean_delay"))


def density_grid(kpis: DataFrame, x: str = "total_outgoing_flow",
                 y: str = "avg_segment_delay", bins: int = 20) -> DataFrame:
    """Hub count per cell of a ``bins x bins`` grid over two KPI columns.
    The hub table is written once; its ranges are one distributed
    aggregation (four numbers)."""
    from hubflow.session import cut_lineage
    k = cut_lineage(kpis.select(F.col(x).cast("double").alias("xv"),
                                F.col(y).cast("double").alias("yv")))
    r = k.agg(F.min("xv"), F.max("xv"), F.min("yv"), F.max("yv")).first()
    g = k.select(_bin(F.col("xv"), F.lit(r[0]), F.lit(r[1]), bins).alias("x_bin"),
                 _bin(F.col("yv"), F.lit(r[2]), F.lit(r[3]), bins).alias("y_bin"))
    return g.groupBy("x_bin", "y_bin").agg(F.count("*").alias("hubs"))
