"""SQL text for the wide-format oracles: raw table, cleaning, unpivot.

Written by hand from the format's description; nothing is imported from the
Spark modules, so a wrong mapping or a lost line on either side shows.
"""

from __future__ import annotations

from hubflow.plans.sqlparts import lines_sql

# Fixed values: (raw prefix, leg type, repeats of an (order, line) it takes)
LEGS = (("i1", "IN_1", 1), ("i2", "IN_2", 2), ("i3", "IN_3", 3), ("o", "OUT", 0))
# Fixed values: (raw slot, cleaned name, milestone, stage group, condition of its lines)
SLOTS = (
    ("rcs", "CheckIn", "RCS", "CheckIn", "l_linenumber = 1"),
    ("dep_1", "Dep_Seg1", "DEP", "Transport_Seg1", "l_linenumber = 2"),
    ("rcf_1", "Arr_Seg1", "RCF", "Transport_Seg1", "l_linenumber = 3"),
    ("dep_2", "Dep_Seg2", "DEP", "Transport_Seg2", "l_linenumber = 4"),
    ("rcf_2", "Arr_Seg2", "RCF", "Transport_Seg2", "l_linenumber = 5"),
    ("dep_3", "Dep_Seg3", "DEP", "Transport_Seg3", "l_linenumber = 6 AND l_partkey % 2 <> 0"),
    ("rcf_3", "Arr_Seg3", "RCF", "Transport_Seg3", "l_linenumber = 6 AND l_partkey % 2 = 0"),
    ("dlv", "Delivery", "DLV", "Delivery", "l_linenumber = 7"),
)


def raw_wide_sql() -> str:
    """CTE ``raw_wide``: one text row per process, ``?`` where nothing is."""
    sel = ["CASE WHEN process = 0 THEN leg_id::VARCHAR ELSE leg_id || '-' || process END AS nr", "'0' AS legs"]
    for raw, _, repeat in LEGS:
        number = {"o": 0, "i1": 1, "i2": 2, "i3": 3}[raw]
        here = f"leg = {repeat}"
        sel.append(f"coalesce(max(CASE WHEN {here} THEN (leg_id * 1000 + process * 4 + {number})::VARCHAR END), '?') "
                   f"AS {raw}_legid")
        for slot, _, _, _, cond in SLOTS:
            on = f"{here} AND {cond}"
            sel.append(f"coalesce(max(CASE WHEN {on} THEN planned_mins END)::VARCHAR, '?') AS {raw}_{slot}_p")
            sel.append(f"coalesce(max(CASE WHEN {on} AND effective_mins <> 0 THEN effective_mins END)::VARCHAR, '?') "
                       f"AS {raw}_{slot}_e")
            if slot not in ("rcs", "dlv"):
                sel.append(f"coalesce(max(CASE WHEN {on} THEN l_suppkey END)::VARCHAR, '?') AS {raw}_{slot}_place")
        dep = " OR ".join(f"({c})" for s, _, _, _, c in SLOTS if s.startswith("dep"))
        sel.append(f"CASE WHEN count(*) FILTER ({here}) = 0 THEN '?' ELSE "
                   f"(count(DISTINCT l_linenumber) FILTER ({here} AND ({dep})))::VARCHAR END AS {raw}_hops")
    return f"""
    wl AS ({lines_sql('supplier')}),
    wr AS (SELECT *, row_number() OVER (PARTITION BY leg_id, l_linenumber
             ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) - 1 AS rk FROM wl),
    wp AS (SELECT *, rk // 4 AS process, rk % 4 AS leg FROM wr),
    raw_wide AS (SELECT {', '.join(sel)} FROM wp GROUP BY leg_id, process)"""


def _renamed(compat: bool) -> list[tuple[str, str]]:
    """(raw, cleaned) names in file order; ``compat`` keeps the duplicate."""
    out = [("nr", "All_process_ID"), ("legs", "Total_Incoming_Legs")]
    for raw, leg, _ in LEGS:
        out.append((f"{raw}_legid", f"{leg}_Leg_ID"))
        for slot, name, *_ in SLOTS:
            out += [(f"{raw}_{slot}_p", f"{leg}_{name}_Planned_Mins"),
                    (f"{raw}_{slot}_e", f"{leg}_{name}_Effective_Mins")]
            if slot not in ("rcs", "dlv"):
                out.append((f"{raw}_{slot}_place", f"{leg}_{name}_Hub_ID"))
        out.append((f"{raw}_hops", f"{leg}_Hops"))
    if compat:
        out = [(r, "IN_1_Dep_Seg1_Hub_ID" if r == "i2_dep_1_place" else n) for r, n in out]
        kept, seen = [], set()
        for r, n in out:
            if n not in seen:
                seen.add(n)
                kept.append((r, n))
        out = kept
    return out


def clean_wide_sql(compat: bool = False) -> str:
    """CTE ``clean_w``: every value as text, as numbers print the same way."""
    sel = []
    for raw, name in _renamed(compat):
        if "_ID" in name:
            sel.append(f"replace({raw}, '?', '0') AS {name}")
        else:
            sel.append(f"coalesce(CAST(TRY_CAST({raw} AS DOUBLE) AS BIGINT)::VARCHAR, '0') AS {name}")
    # a column without any number keeps its text
    text = [(raw, name) for raw, name in _renamed(compat) if "_ID" not in name]
    flags = ", ".join(f"count(TRY_CAST({r} AS DOUBLE)) AS n_{r}" for r, _ in text)
    swap = ", ".join(f"CASE WHEN n_{r} > 0 THEN clean_v.{n} ELSE raw_{r} END AS {n}" for r, n in text)
    raws = ", ".join(f"{r} AS raw_{r}" for r, _ in text)
    return (f"clean_n AS (SELECT {flags} FROM raw_wide), "
            f"clean_v AS (SELECT {', '.join(sel)}, {raws} FROM raw_wide), "
            f"clean_w AS (SELECT clean_v.* EXCLUDE ({', '.join('raw_' + r for r, _ in text)}) "
            f"REPLACE ({swap}) FROM clean_v, clean_n)")


def clean_summary_sql() -> str:
    text = [raw for raw, name in _renamed(False) if "_ID" not in name]
    numeric = " + ".join(f"CAST(n_{r} > 0 AS BIGINT)" for r in text)
    n = len(_renamed(False))
    return (f"SELECT CAST({n} AS BIGINT) AS total_columns, {numeric} AS numeric_columns, "
            f"{n} - ({numeric}) AS non_numeric_columns FROM clean_n")


def unpivot_sql(compat: bool = False) -> str:
    """CTE ``unpiv``: the long milestone rows of ``clean_w``."""
    cols = {n for _, n in _renamed(compat)}
    parts, seq = [], 0      # seq counts the slots that have a hub column
    for _, leg, _ in LEGS:
        first = f"{leg}_Dep_Seg1_Hub_ID" if f"{leg}_Dep_Seg1_Hub_ID" in cols else "'none'"
        known = lambda c: f"CASE WHEN {c} NOT IN ('0', '?') THEN {c} END"
        last = (f"coalesce({known(f'{leg}_Arr_Seg3_Hub_ID')}, {known(f'{leg}_Arr_Seg2_Hub_ID')}, "
                f"{known(f'{leg}_Arr_Seg1_Hub_ID')}, 'none')")
        for slot, name, milestone, stage, _ in SLOTS:
            hub = {"rcs": first, "dlv": last}.get(slot, f"{leg}_{name}_Hub_ID")
            if slot not in ("rcs", "dlv") and hub not in cols:
                continue
            parts.append(f"SELECT {leg}_Leg_ID AS leg_id, {leg}_{name}_Planned_Mins AS p, "
                         f"{leg}_{name}_Effective_Mins AS e, {hub} AS hub, '{milestone}' AS milestone, "
                         f"'{stage}' AS stage_group, '{leg}' AS leg_type, {seq} AS seq FROM clean_w")
            seq += 1
    u = " UNION ALL ".join(parts)
    none = "CASE WHEN hub IN ('0', '0.0', 'nan', '?') THEN 'none' ELSE hub END"
    if compat:
        hub_sql = (f"CASE WHEN milestone = 'DLV' AND regexp_full_match({none}, '[0-9]+') "
                   f"THEN hub || '.0' ELSE {none} END")
    else:
        hub_sql = f"regexp_replace({none}, '[.]0$', '')"

    def num(x):
        return f"CAST(trunc(coalesce(TRY_CAST({x} AS DOUBLE), 0.0)) AS BIGINT)"
    return f"""
    u0 AS ({u}),
    u1 AS (SELECT leg_id, {num('p')} AS planned_mins, {num('e')} AS effective_mins,
             {hub_sql} AS hub_id, milestone, stage_group, leg_type, CAST(seq AS BIGINT) AS seq FROM u0),
    unpiv AS (SELECT leg_id, planned_mins, effective_mins, hub_id, milestone, stage_group,
             leg_type, CASE WHEN effective_mins <> 0 AND planned_mins <> 0
               THEN effective_mins - planned_mins ELSE CAST(0 AS BIGINT) END AS delay_mins, seq
             FROM u1 WHERE NOT (planned_mins = 0 AND effective_mins = 0))"""
