"""Shared SQL text for the DuckDB oracles (ANSI SQL over the driver views).

These strings restate, in plain SQL, what the Spark operators compute, so
the driver can compare both engines on the same parquet tables.
"""

from __future__ import annotations

# Written out here, not taken from the Spark modules, so that a wrong mapping
# on either side shows.
_MILESTONE = ("CASE l_linenumber WHEN 1 THEN 'RCS' WHEN 2 THEN 'DEP' WHEN 3 THEN 'RCF' "
              "WHEN 4 THEN 'DEP' WHEN 5 THEN 'RCF' WHEN 6 THEN 'DEP' WHEN 7 THEN 'DLV' END")
_STAGE = ("CASE WHEN l_linenumber = 1 THEN 'CheckIn' WHEN l_linenumber IN (2, 3) THEN 'Transport_Seg1' "
          "WHEN l_linenumber IN (4, 5) THEN 'Transport_Seg2' WHEN l_linenumber = 6 THEN 'Transport_Seg3' "
          "WHEN l_linenumber = 7 THEN 'Delivery' END")


def lines_sql(hub: str = "supplier") -> str:
    """``lineitem JOIN orders`` with planned/effective minutes and the hub."""
    if hub == "supplier":
        hub_expr = "CAST(l.l_suppkey AS VARCHAR)"
        extra = ""
    else:
        hub_expr = "coalesce(sn.n_name, 'none')"
        extra = ("LEFT JOIN (SELECT s.s_suppkey, n.n_name FROM supplier s "
                 "JOIN nation n ON s.s_nationkey = n.n_nationkey) sn "
                 "ON l.l_suppkey = sn.s_suppkey")
    return f"""
    SELECT l.l_orderkey AS leg_id, l.l_linenumber, l.l_shipdate, l.l_partkey,
           l.l_suppkey, l.l_quantity,
           CAST(l.l_quantity * 60 AS BIGINT) AS planned_mins,
           greatest(CAST(0 AS BIGINT), CAST(l.l_quantity * 60 AS BIGINT)
             + date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)))
             AS effective_mins,
           CASE WHEN l.l_suppkey = 0 THEN 'none' ELSE {hub_expr} END AS hub_id
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {extra}"""


def journeys_cte(hub: str = "supplier", name: str = "journeys") -> str:
    """CTE body list ``lines_x, ms_x, <name>`` for the milestone log."""
    return f"""
    {name}_lines AS ({lines_sql(hub)}),
    {name}_ms AS (
      SELECT leg_id, planned_mins, effective_mins, hub_id,
             {_MILESTONE} AS milestone, {_STAGE} AS stage_group, 'OUT' AS leg_type,
             CASE WHEN effective_mins <> 0 AND planned_mins <> 0
                  THEN effective_mins - planned_mins ELSE CAST(0 AS BIGINT) END AS delay_mins,
             l_linenumber, l_shipdate, l_partkey, l_suppkey
      FROM {name}_lines WHERE NOT (planned_mins = 0 AND effective_mins = 0)),
    {name} AS (
      SELECT leg_id, planned_mins, effective_mins, hub_id, milestone, stage_group,
             leg_type, delay_mins,
             CAST(row_number() OVER (PARTITION BY leg_id ORDER BY planned_mins,
                  l_linenumber, l_shipdate, l_partkey, l_suppkey) AS BIGINT) AS seq
      FROM {name}_ms)"""


def successors_cte(src: str = "journeys", name: str = "succ") -> str:
    """W1 in SQL: next hub within the leg by ``(planned_mins, seq)``."""
    return f"""
    {name} AS (
      SELECT *, hub_id AS src,
             lead(hub_id) OVER (PARTITION BY leg_id ORDER BY planned_mins, seq) AS dst
      FROM {src})"""


def transit_filter(variant: str) -> str:
    """WHERE clause of each transit variant (see ``operators.journeys``)."""
    t = "stage_group LIKE '%Transport%'"
    return {
        "embed": f"{t} AND src <> 'none' AND dst <> 'none' AND dst IS NOT NULL AND src <> dst",
        "router": f"{t} AND src <> 'none' AND (dst IS NULL OR dst <> 'none') "
                  "AND delay_mins IS NOT NULL",
        "predict": f"{t} AND delay_mins IS NOT NULL",
        "cost": f"{t} AND dst IS NOT NULL AND src IS NOT NULL AND delay_mins IS NOT NULL",
        "flow": "src <> 'none' AND dst <> 'none' AND dst IS NOT NULL AND src <> dst",
    }[variant]


def transits_ctes(hub: str = "supplier", variants=("embed",)) -> str:
    """``WITH`` list: journeys, successors and one CTE per variant ``t_<v>``."""
    parts = [journeys_cte(hub), successors_cte()]
    parts += [f"t_{v} AS (SELECT * FROM succ WHERE {transit_filter(v)})" for v in variants]
    return ",\n".join(parts)


def hub_kpis_cte(name: str = "kpis", src: str = "journeys", min_volume: int = 1) -> str:
    """A1 + A2 + W2 in SQL."""
    return f"""
    {name}_agg AS (
      SELECT hub_id, count(leg_id) AS total_outgoing_flow,
             avg(delay_mins) AS avg_segment_delay,
             stddev_samp(delay_mins) AS std_delay,
             quantile_cont(delay_mins, 0.5) AS median_delay,
             max(delay_mins) AS max_delay
      FROM {src}
      WHERE delay_mins IS NOT NULL AND hub_id IS NOT NULL AND hub_id <> 'none'
        AND NOT (planned_mins = 0 AND effective_mins = 0)
      GROUP BY hub_id),
    {name}_filled AS (
      SELECT hub_id, total_outgoing_flow, avg_segment_delay,
             coalesce(std_delay, (SELECT quantile_cont(std_delay, 0.5) FROM {name}_agg), 0.0)
               AS std_delay,
             CAST(median_delay AS DOUBLE) AS median_delay, max_delay
      FROM {name}_agg WHERE total_outgoing_flow >= {min_volume}),
    {name} AS (
      SELECT *, CAST(dense_rank() OVER (ORDER BY avg_segment_delay DESC) AS INTEGER) AS delay_rank
      FROM {name}_filled)"""
