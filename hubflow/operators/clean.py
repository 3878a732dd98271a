"""Cleaning of the raw wide journey table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubflow.functions.columns import LEG_PREFIXES, rename_map, to_number


def is_id_column(name: str) -> bool:
    """Id columns are recognised by name (``_ID`` anywhere)."""
    return "_ID" in name


def clean_wide(raw: DataFrame, compat: bool = False,
               numeric_columns: set[str] | None = None) -> DataFrame:
    """P1-P6 in one projection.

    Rename by the generated map, keep the first of duplicate targets, make
    id columns text with ``?``/NULL -> ``'0'``, and coerce every other
    column to BIGINT minutes (invalid -> 0) **if** it holds at least one
    numeric value; columns without any numeric text stay text (NULL -> '0').
    The "has a number" guard is a single global aggregation (one row of
    counts) over all candidate columns, so the data is scanned once for it;
    callers that know which (cleaned) columns are numeric can pass
    ``numeric_columns`` and skip that pass.
    """
    mapping = rename_map(compat)
    names = [mapping.get(c, c) for c in raw.columns]
    keep, seen = [], set()
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(i)
    renamed = raw.select(*[F.col(f"`{raw.columns[i]}`").alias(names[i]) for i in keep])
    others = [c for c in renamed.columns if not is_id_column(c)]
    numeric = set()
    if numeric_columns is not None:
        numeric = {c for c in others if c in numeric_columns}
    elif others:
        counts = renamed.agg(*[F.count(to_number(c)).alias(c) for c in others]).first()
        numeric = {c for c in others if counts[c] > 0}
    def leg_of(c):
        return next((leg for leg in LEG_PREFIXES.values() if c.startswith(f"{leg}_")), "")

    # one expression per leg and kind over an array of its columns: written out
    # per column, the generated method is beyond what the JVM compiles
    kinds = {"id": _clean_id, "number": _clean_number}
    groups, exprs = {}, []
    for c in renamed.columns:
        kind = "id" if is_id_column(c) else "number" if c in numeric else None
        if kind is None:
            exprs.append(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")).alias(c))
        else:
            members = groups.setdefault((kind, leg_of(c)), [])
            exprs.append(F.col(f"_{kind}_{leg_of(c)}")[len(members)].alias(c))
            members.append(F.col(f"`{c}`").cast("string"))
    arrays = [F.transform(F.array(*members), kinds[kind]).alias(f"_{kind}_{leg}")
              for (kind, leg), members in groups.items()]
    return renamed.select("*", *arrays).select(*exprs)


def _clean_id(s: F.Column) -> F.Column:
    s = F.translate(s, "?", "0")
    return F.when(s.isNull() | (s == "nan"), F.lit("0")).otherwise(s)


def _clean_number(s: F.Column) -> F.Column:
    return F.coalesce(to_number(s), F.lit(0.0)).cast("bigint")


def clean_summary(spark: SparkSession, clean: DataFrame) -> DataFrame:
    """Total / numeric / non-numeric column counts of a cleaned table."""
    n_num = sum(isinstance(f.dataType, T.NumericType) for f in clean.schema.fields)
    n = len(clean.columns)
    return spark.createDataFrame(
        [(n, n_num, n - n_num)],
        "total_columns bigint, numeric_columns bigint, non_numeric_columns bigint")


def numeric_metrics(df: DataFrame) -> list[str]:
    """Numeric metric columns, without ids, hubs, places and hop counts."""
    drop = {"Total_Incoming_Legs", "All_process_ID", "OUT_Leg_ID", "IN_1_Leg_ID",
            "IN_2_Leg_ID", "IN_3_Leg_ID", "IN_1_Hops", "IN_2_Hops", "IN_3_Hops", "OUT_Hops"}
    out = []
    for f in df.schema.fields:
        n = f.name
        if n in drop or "_Hub_ID" in n or "_place" in n or n.lower() in ("leg_id", "seq"):
            continue
        if isinstance(f.dataType, T.NumericType):
            out.append(n)
    return out
