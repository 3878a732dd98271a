"""Distributed ranking and exact quantiles (no single-partition row windows).

A window without ``partitionBy`` moves every row into one task. The helpers
here range-partition on the ordering, number the rows inside each range
partition, *write that table once* and add each partition's offset, taken
from the written table (one row per partition). Reading both from the same
written table matters: a range partitioning that is evaluated twice samples
its borders twice, and numbers and offsets would not fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import cut_lineage


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _numbered(df: DataFrame, order: list[Column], step: Column | None = None) -> DataFrame:
    """The written table of ``df`` with ``_p`` (range partition), ``_rn``
    (running count, or sum of ``step``, inside it) and ``_off`` (total of the
    partitions before it)."""
    w = Window.partitionBy("_p").orderBy(*order)
    run = F.row_number().over(w).cast("bigint") if step is None else F.sum(step).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    local = cut_lineage(df.repartitionByRange(_partitions(df), *order)
                        .withColumn("_p", F.spark_partition_id()).withColumn("_rn", run))
    ends = local.groupBy("_p").agg(F.max("_rn").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "_p")      # one row per partition


def dense_rank(df: DataFrame, order: Column, value: str, out: str) -> DataFrame:
    """``df`` plus ``out`` = dense rank of ``value`` under ``order`` (1 first).

    Distinct values are numbered and joined back on the value (NULL values
    get NULL)."""
    d = df.select(value).filter(F.col(value).isNotNull()).distinct()
    ranks = _numbered(d, [order]).select(value, (F.col("_off") + F.col("_rn")).cast("int").alias(out))
    return df.join(ranks, value, "left")


def row_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` plus ``out`` = 0-based position in ``order`` (must be total)."""
    return _numbered(df, order).withColumn(
        out, F.col("_off") + F.col("_rn") - 1).drop("_p", "_rn", "_off")


BINS = 1024        # bins that an interval is cut into in one round
FETCH = 4096       # rows of an interval that are fetched instead of cut further


def exact_percentile(df: DataFrame, col: str, p: float) -> float | None:
    """Exact linear-interpolated ``p``-percentile of ``col`` (NULLs ignored)."""
    return exact_percentiles(df, [(col, p)])[0]


def exact_percentiles(df: DataFrame, wanted: list[tuple[str, float]]) -> list[float | None]:
    """Exact linear-interpolated percentiles of several columns of a (written)
    table, by counting: no sort, no range shuffle.

    Each wanted rank lies in an interval of values, at first the column's whole
    range. A round counts the values of all open intervals in ``BINS`` bins, in
    one pass with one row per bin (combined in the map tasks), and keeps the bin
    that holds the rank; an interval of one value, or of at most ``FETCH`` rows,
    which are then fetched, is done. A bin shrinks to its own least and greatest
    value, so the rounds follow the bits of a double at worst."""
    cols = sorted({c for c, _ in wanted})
    value = {c: F.col(c).cast("double") for c in cols}
    ends = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(cols)
                    for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    size = {c: ends[f"n{i}"] for i, c in enumerate(cols)}
    whole = {c: (ends[f"lo{i}"], ends[f"hi{i}"]) for i, c in enumerate(cols)}
    ranks = {(c, k) for c, p in wanted if size[c]
             for k in (math.floor(p * (size[c] - 1)), math.ceil(p * (size[c] - 1)))}
    # rank -> (low, high, rows in the interval, rows below it)
    at = {(c, k): (*whole[c], size[c], 0) for c, k in ranks}
    found: dict[tuple[str, int], float] = {}
    while at:
        for key, (lo, hi, _, _) in list(at.items()):
            if lo == hi:
                found[key] = lo
                del at[key]
        small = {(c, lo, hi, below) for (c, _), (lo, hi, n, below) in at.items() if n <= FETCH}
        inside = lambda c, lo, hi: (value[c] >= F.lit(lo)) & (value[c] <= F.lit(hi))
        for c, lo, hi, below in small:
            rows = sorted(r[0] for r in df.filter(inside(c, lo, hi)).select(value[c]).collect())
            for key in [k for k, (a, b, _, z) in at.items() if (k[0], a, b, z) == (c, lo, hi, below)]:
                found[key] = rows[key[1] - below]
                del at[key]
        open_ = sorted({(c, lo, hi, below) for (c, _), (lo, hi, _, below) in at.items()})
        if not open_:
            break
        cells = []
        for j, (c, lo, hi, _) in enumerate(open_):
            place = F.least(F.floor((value[c] - F.lit(lo)) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1))
            cells.append(F.when(inside(c, lo, hi), F.struct(F.lit(j).alias("j"), place.cast("int").alias("b"),
                                                            value[c].alias("v"))))
        bins: dict[int, list] = {}
        for r in (df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.*")
                  .groupBy("j", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                  .orderBy("j", "b").collect()):                   # BINS rows per interval at most
            bins.setdefault(r["j"], []).append(r)
        for key, (lo, hi, _, below) in list(at.items()):
            start = below
            for r in bins[open_.index((key[0], lo, hi, below))]:
                if key[1] < start + r["n"]:
                    at[key] = (r["lo"], r["hi"], r["n"], start)
                    break
                start += r["n"]
    out = []
    for c, p in wanted:
        if not size[c]:
            out.append(None)
            continue
        pos = p * (size[c] - 1)
        lo, hi = found[c, math.floor(pos)], found[c, math.ceil(pos)]
        out.append(lo + (pos - math.floor(pos)) * (hi - lo))
    return out
