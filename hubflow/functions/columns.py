"""Column-level helpers: the raw journey schema rule and scalar expressions.

All expressions are built-in Catalyst expressions (no Python UDFs), so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values of the raw journey format (must match the source data) ---
# Raw leg prefixes and the leg types they become.
LEG_PREFIXES = {"i1": "IN_1", "i2": "IN_2", "i3": "IN_3", "o": "OUT"}
# Raw milestone tokens and their cleaned names.
CHECKIN, DEP, ARR, DELIVERY = "CheckIn", "Dep", "Arr", "Delivery"
# Raw time/place suffixes and their cleaned names.
SUFFIXES = {"p": "Planned_Mins", "e": "Effective_Mins", "place": "Hub_ID"}
# Header columns: raw name -> cleaned name.
HEADER = {"nr": "All_process_ID", "legs": "Total_Incoming_Legs"}
# Hub text that means "no hub".
MISSING_TEXT = "?"  # a missing value in raw text
NO_HUB_TEXT = ["0", "0.0", "nan", "?"]
NO_HUB = "none"
SEGMENTS = (1, 2, 3)
# --- end of fixed values ---


def raw_columns() -> list[str]:
    """The 98 raw column names, in file order (``nr, legs`` then 4 x 24)."""
    cols = list(HEADER)
    for p in LEG_PREFIXES:
        cols += [f"{p}_legid", f"{p}_rcs_p", f"{p}_rcs_e"]
        for s in SEGMENTS:
            for kind in ("dep", "rcf"):
                cols += [f"{p}_{kind}_{s}_p", f"{p}_{kind}_{s}_e", f"{p}_{kind}_{s}_place"]
        cols += [f"{p}_dlv_p", f"{p}_dlv_e", f"{p}_hops"]
    return cols


def raw_schema() -> T.StructType:
    """All-string schema for the raw CSV (no inference; ``?`` is text)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in raw_columns()])


def rename_map(compat: bool = False) -> dict[str, str]:
    """Raw -> cleaned column names, generated from the naming rule.

    ``compat=True`` reproduces the source's duplicate target for
    ``i2_dep_1_place`` (it lands on IN_1's first hub column and is then
    dropped as a duplicate, quirk Q1).
    """
    out = dict(HEADER)
    for p, leg in LEG_PREFIXES.items():
        out[f"{p}_legid"] = f"{leg}_Leg_ID"
        out[f"{p}_hops"] = f"{leg}_Hops"
        for suf, name in SUFFIXES.items():
            if suf != "place":
                out[f"{p}_rcs_{suf}"] = f"{leg}_{CHECKIN}_{name}"
                out[f"{p}_dlv_{suf}"] = f"{leg}_{DELIVERY}_{name}"
            for s in SEGMENTS:
                out[f"{p}_dep_{s}_{suf}"] = f"{leg}_{DEP}_Seg{s}_{name}"
                out[f"{p}_rcf_{s}_{suf}"] = f"{leg}_{ARR}_Seg{s}_{name}"
    if compat:
        out["i2_dep_1_place"] = out["i1_dep_1_place"]
    return out


def to_number(c: Column | str) -> Column:
    """Text -> DOUBLE; anything non-numeric (``?``, junk, NaN) becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    # a failed parse costs an exception each: the usual sign of a missing value is not parsed
    # (nanvl: the parse stands in the plan, and in the generated code, only once)
    return F.nanvl(F.when(s != MISSING_TEXT, s.try_cast("double")), F.lit(None).cast("double"))


def to_minutes(c: Column | str) -> Column:
    """Text -> BIGINT minutes via DOUBLE (``'128.0'`` must parse, quirk Q12)."""
    return to_number(c).cast("bigint")


def normalise_hub(c: Column | str) -> Column:
    """Hub text -> STRING id; ``0, 0.0, nan, ?`` and NULL become ``'none'``."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.isNull() | s.isin(*NO_HUB_TEXT), F.lit(NO_HUB)).otherwise(s)


def canonical_hub(c: Column | str) -> Column:
    """Strip a float suffix (``'128.0'`` -> ``'128'``), quirk Q3."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"\.0$", "")


def delay_expr(planned: str = "planned_mins", effective: str = "effective_mins") -> Column:
    """Delay = effective - planned, but 0 when either time is 0 (quirk Q5)."""
    p, e = F.col(planned), F.col(effective)
    return F.when((e != 0) & (p != 0), e - p).otherwise(F.lit(0).cast("bigint"))


def non_empty(planned: str = "planned_mins", effective: str = "effective_mins") -> Column:
    """Rows where at least one of the two times is non-zero."""
    return ~((F.col(planned) == 0) & (F.col(effective) == 0))


def is_transport(stage_col: str = "stage_group") -> Column:
    """Transport-stage predicate (substring test, NULL counts as false)."""
    return F.coalesce(F.col(stage_col).contains("Transport"), F.lit(False))


def segment_number(stage_col: str = "stage_group") -> Column:
    """First run of digits in the stage name, default 1."""
    return F.coalesce(
        F.regexp_extract(F.col(stage_col), r"(\d+)", 1).try_cast("int"), F.lit(1))


def stage_column(df) -> str:
    """``stage_group`` if present, else ``stage`` (plan-time fallback)."""
    return "stage_group" if "stage_group" in df.columns else "stage"
