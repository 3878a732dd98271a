"""The registered queries, one per operator group of the blueprint.

Each builder reads the driver tables at ``sf_dir`` (through the journey
adapters), runs the library operators, and returns a DataFrame whose
columns are named exactly like the oracle SQL's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.operators import kpis as K
from hubflow.plans import sqlparts as S
from hubflow.plans.registry import register
from hubflow.sources.tables import journeys_long

KPI_DOUBLES = ("avg_segment_delay", "std_delay", "median_delay")


# ---------------------------------------------------------------- hub KPIs
@register("hub_kpis", doubles=KPI_DOUBLES, ops="P12-P15 P19 A1 A2 W2 O1",
          sql=f"WITH {S.journeys_cte()}, {S.hub_kpis_cte()} SELECT * FROM kpis")
def q_hub_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-supplier-hub delay KPIs with dense delay rank."""
    return K.hub_kpis(journeys_long(spark, sf_dir, "supplier"))


# ------------------------------------------------------- transits and edges
def _succ(spark, sf_dir, hub="supplier"):
    from hubflow.operators.journeys import with_successor
    return with_successor(journeys_long(spark, sf_dir, hub))


def _t(spark, sf_dir, variant, hub="supplier"):
    from hubflow.operators.journeys import transits
    return transits(None, variant, successors=_succ(spark, sf_dir, hub))


EMBED_EDGES_SQL = """SELECT src, dst, count(leg_id) AS flow_volume, avg(delay_mins) AS avg_delay
FROM t_embed GROUP BY src, dst"""
ROUTER_EDGES_SQL = """SELECT src, dst, avg_delay, volume, std_delay,
  greatest(0.1, avg_delay + 0.5 * std_delay + 50.0 / (volume + 1)) AS weight
FROM (SELECT src, dst, avg(delay_mins) AS avg_delay, count(leg_id) AS volume,
             coalesce(stddev_samp(delay_mins), 0.0) AS std_delay
      FROM t_router GROUP BY src, dst) e"""


@register("transit_edges_embed", doubles=("avg_delay",), ops="W1(V1) P16 P17 P20 A3 G1",
          sql=f"WITH {S.transits_ctes(variants=('embed',))} {EMBED_EDGES_SQL}")
def q_transit_edges_embed(spark, sf_dir):
    """Embed-graph edges: movement count and mean delay per hub pair."""
    from hubflow.operators.network import embed_edges
    return embed_edges(_t(spark, sf_dir, "embed"))


@register("transit_edges_router", doubles=("avg_delay", "std_delay", "weight"),
          ops="W1(V2) A4 G3",
          sql=f"WITH {S.transits_ctes(variants=('router',))} {ROUTER_EDGES_SQL}")
def q_transit_edges_router(spark, sf_dir):
    """Router-graph edges with the composite cost weight."""
    from hubflow.operators.network import router_edges
    return router_edges(_t(spark, sf_dir, "router")).select(
        "src", "dst", "avg_delay", "volume", "std_delay", "weight")


@register("graph_counts", ops="A15 G13", sql=f"""
WITH {S.transits_ctes(variants=('embed', 'router'))},
ee AS (SELECT DISTINCT src, dst FROM t_embed),
re AS (SELECT DISTINCT src, dst FROM t_router)
SELECT 'embed' AS graph,
  (SELECT count(*) FROM (SELECT src AS h FROM ee UNION SELECT dst FROM ee) n WHERE h IS NOT NULL) AS n_nodes,
  (SELECT count(*) FROM ee) AS n_edges
UNION ALL
SELECT 'router',
  (SELECT count(*) FROM (SELECT src AS h FROM re UNION SELECT dst FROM re) n WHERE h IS NOT NULL),
  (SELECT count(*) FROM re)""")
def q_graph_counts(spark, sf_dir):
    """Node and edge counts of the embed and router graphs."""
    from hubflow.operators.network import edge_volumes, graph_counts
    from hubflow.session import cut_lineage
    # one pass over the milestones for both graphs; the edge table is small
    g = cut_lineage(edge_volumes(_succ(spark, sf_dir), ("embed", "router")))
    e = graph_counts(g.filter(F.col("n_embed") > 0))
    r = graph_counts(g.filter(F.col("n_router") > 0))
    return (e.select(F.lit("embed").alias("graph"), "*")
            .unionByName(r.select(F.lit("router").alias("graph"), "*")))


NODES_SQL = f"""WITH {S.transits_ctes(variants=('embed',))}, {S.hub_kpis_cte()},
nodes AS (SELECT src AS hub_id FROM t_embed UNION SELECT dst FROM t_embed)
SELECT n.hub_id, coalesce(k.total_outgoing_flow, 0) AS total_outgoing_flow,
       coalesce(k.avg_segment_delay, 0.0) AS avg_segment_delay,
       coalesce(k.std_delay, 0.0) AS std_delay
FROM nodes n LEFT JOIN kpis k ON n.hub_id = k.hub_id"""


def _network_nodes(spark, sf_dir):
    from hubflow.operators.journeys import transits
    from hubflow.operators.network import embed_edges, graph_nodes, node_features
    long_df = journeys_long(spark, sf_dir, "supplier")
    nodes = graph_nodes(embed_edges(transits(long_df, "embed")))
    return node_features(nodes, K.hub_kpis(long_df, sort=False))


@register("network_nodes", doubles=("avg_segment_delay", "std_delay"), ops="A15 J1 J7",
          sql=NODES_SQL)
def q_network_nodes(spark, sf_dir):
    """Embed-graph nodes with their KPI features (missing -> 0)."""
    return _network_nodes(spark, sf_dir)


@register("standardised_nodes", ops="G2 J1",
          doubles=("z_total_outgoing_flow", "z_avg_segment_delay", "z_std_delay"),
          sql=f"""WITH base AS ({NODES_SQL})
SELECT hub_id,
  (total_outgoing_flow - avg(total_outgoing_flow) OVER ()) /
    CASE WHEN coalesce(stddev_pop(total_outgoing_flow) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(total_outgoing_flow) OVER () END AS z_total_outgoing_flow,
  (avg_segment_delay - avg(avg_segment_delay) OVER ()) /
    CASE WHEN coalesce(stddev_pop(avg_segment_delay) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(avg_segment_delay) OVER () END AS z_avg_segment_delay,
  (std_delay - avg(std_delay) OVER ()) /
    CASE WHEN coalesce(stddev_pop(std_delay) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(std_delay) OVER () END AS z_std_delay
FROM base""")
def q_standardised_nodes(spark, sf_dir):
    """Z-scored node features (population std, zero variance -> /1)."""
    from hubflow.operators.network import standardise
    cols = ["total_outgoing_flow", "avg_segment_delay", "std_delay"]
    z = standardise(_network_nodes(spark, sf_dir), cols, suffix="_z")
    return z.select("hub_id", *[F.col(c + "_z").alias("z_" + c) for c in cols])


FLOW_TOP_SQL = f"""WITH {S.transits_ctes(variants=('flow',))},
p AS (SELECT src, dst, count(leg_id) AS flow_count, avg(delay_mins) AS avg_delay
      FROM t_flow GROUP BY src, dst),
top AS (SELECT * FROM p ORDER BY flow_count DESC, src, dst LIMIT 15)"""


@register("flow_paths_top", doubles=("avg_delay",), ops="W1(V5) A6 O3",
          sql=f"{FLOW_TOP_SQL} SELECT * FROM top")
def q_flow_paths_top(spark, sf_dir):
    """Top 15 hub-to-hub flows over all stages."""
    from hubflow.operators.network import flow_paths
    return flow_paths(_t(spark, sf_dir, "flow"), top_n=15)


@register("sankey_nodes", ops="X2 O7", sql=f"""{FLOW_TOP_SQL},
n AS (SELECT src AS hub_id FROM top UNION SELECT dst FROM top)
SELECT hub_id, CAST(row_number() OVER (ORDER BY hub_id) - 1 AS INTEGER) AS node_index FROM n""")
def q_sankey_nodes(spark, sf_dir):
    """Node list (with index) of the top-15 flow Sankey."""
    from hubflow.operators.network import flow_paths, sankey_nodes
    return sankey_nodes(flow_paths(_t(spark, sf_dir, "flow"), top_n=15))


# ------------------------------------------------------------------- costs
COST_ROWS_SQL = f"""WITH {S.transits_ctes(variants=('cost',))}, {S.hub_kpis_cte()},
rows_ AS (SELECT *, delay_mins * 5.0 AS delay_cost,
                 greatest(0.0, (delay_mins - 60) / 60.0) * 0.02 * 100.0 AS penalty_cost
          FROM t_cost),
cr AS (SELECT *, delay_cost + penalty_cost AS total_cost FROM rows_)"""


@register("delay_costs_hub", ops="W1(V4) F1 A7 J6",
          doubles=("total_cost", "avg_delay", "cost_per_shipment"), sql=f"""{COST_ROWS_SQL}
SELECT h.src AS hub_id, h.total_cost, h.shipments, h.avg_delay, k.total_outgoing_flow,
       h.total_cost / h.shipments AS cost_per_shipment
FROM (SELECT src, sum(total_cost) AS total_cost, count(leg_id) AS shipments,
             avg(delay_mins) AS avg_delay FROM cr GROUP BY src) h
LEFT JOIN kpis k ON h.src = k.hub_id""")
def q_delay_costs_hub(spark, sf_dir):
    """Per-hub delay cost table (signed cost, penalty, flow)."""
    from hubflow.operators import cost as C
    from hubflow.operators.journeys import transits
    long_df = journeys_long(spark, sf_dir, "supplier")
    rows = C.cost_rows(transits(long_df, "cost"))
    return C.hub_costs(rows, K.hub_kpis(long_df, sort=False)).select(
        "hub_id", "total_cost", "shipments", "avg_delay", "total_outgoing_flow",
        "cost_per_shipment")


TOTALS_SQL = """SELECT coalesce(sum(total_cost), 0.0) AS total_cost,
  coalesce(sum(delay_cost), 0.0) AS total_delay_cost,
  coalesce(sum(penalty_cost), 0.0) AS total_penalty_cost,
  avg(total_cost) AS avg_cost_per_shipment,
  coalesce(sum(CASE WHEN delay_cost > 0 THEN delay_cost END), 0.0) AS late_delay_cost,
  count(*) AS movements FROM cr"""


@register("delay_costs_total", ops="A8 F1",
          doubles=("total_cost", "total_delay_cost", "total_penalty_cost",
                   "avg_cost_per_shipment", "late_delay_cost"),
          sql=f"{COST_ROWS_SQL} {TOTALS_SQL}")
def q_delay_costs_total(spark, sf_dir):
    """Network delay-cost totals (one row)."""
    from hubflow.operators import cost as C
    return C.network_totals(C.cost_rows(_t(spark, sf_dir, "cost")))


# --- fixed values: the three what-if scenarios of the ROI query ---
SCENARIOS = [
    ("Hub capacity expansion", 15.0, 250000.0),
    ("Dynamic re-routing", 8.0, 0.0),
    ("Status quo", 0.0, 50000.0),
]
# --- end of fixed values ---


def _scen_values():
    return ", ".join(f"('{n}', {p}, {c})" for n, p, c in SCENARIOS)


@register("scenario_roi", ops="F2 O6",
          doubles=("annual_savings", "implementation_cost", "payback_months", "roi_3year_pct"),
          sql=f"""{COST_ROWS_SQL}, tot AS ({TOTALS_SQL}),
sc(name, delay_reduction_pct, implementation_cost) AS (VALUES {_scen_values()}),
s2 AS (SELECT name AS scenario,
              (SELECT total_cost FROM tot) * delay_reduction_pct / 100 AS annual_savings,
              greatest(1.0, implementation_cost) AS implementation_cost FROM sc)
SELECT scenario, annual_savings, implementation_cost,
  CASE WHEN annual_savings > 0 THEN implementation_cost / (annual_savings / 12)
       ELSE CAST('Infinity' AS DOUBLE) END AS payback_months,
  (annual_savings * 3 - implementation_cost) / implementation_cost * 100 AS roi_3year_pct
FROM s2""")
def q_scenario_roi(spark, sf_dir):
    """ROI of three improvement scenarios against the current delay cost."""
    from hubflow.operators import cost as C
    totals = C.network_totals(C.cost_rows(_t(spark, sf_dir, "cost")))
    return C.scenario_roi(totals, C.scenarios_frame(spark, SCENARIOS))


# ---------------------------------------------------------------- patterns
LATE_SQL = f"""WITH {S.journeys_cte()},
seqs AS (SELECT leg_id, string_agg(hub_id, ' -> ' ORDER BY planned_mins, seq) AS pattern
         FROM journeys WHERE delay_mins > 30 GROUP BY leg_id)
SELECT pattern, count(*) AS frequency FROM seqs GROUP BY pattern
ORDER BY frequency DESC, pattern LIMIT 10"""


@register("late_patterns", ops="A11 A12 M8", sql=LATE_SQL)
def q_late_patterns(spark, sf_dir):
    """Top 10 hub sequences of late milestones (delay > 30 min)."""
    from hubflow.operators.patterns import late_patterns
    return late_patterns(journeys_long(spark, sf_dir, "supplier"), 30, 10)


@register("late_patterns_digest", ops="A11 A12 M8", sql=LATE_SQL)
def q_late_patterns_digest(spark, sf_dir):
    """The same, counted by sequence digest, for legs of any length."""
    from hubflow.operators.patterns import late_patterns_by_digest
    return late_patterns_by_digest(journeys_long(spark, sf_dir, "supplier"), 30, 10)


# --------------------------------------------------------------------- EDA
EDA_COLS = ["planned_mins", "effective_mins", "delay_mins"]


def _eda_input(spark, sf_dir):
    from hubflow.operators.clean import numeric_metrics
    long_df = journeys_long(spark, sf_dir, "supplier")
    return long_df, numeric_metrics(long_df)


def _pairs_sql():
    parts = []
    for a in EDA_COLS:
        for b in EDA_COLS:
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, "
                         f"corr({a}, {b}) AS correlation FROM journeys")
    return " UNION ALL ".join(parts)


@register("corr_matrix", doubles=("correlation",), ops="P18 E1 X7",
          sql=f"WITH {S.journeys_cte()} {_pairs_sql()}")
def q_corr_matrix(spark, sf_dir):
    """Pearson correlations of planned, effective and delay minutes (long form)."""
    from hubflow.operators.eda import correlation_matrix
    df, cols = _eda_input(spark, sf_dir)
    return correlation_matrix(df, cols)


def _vif_sql():
    a, b, c = EDA_COLS
    g = {}
    for x in EDA_COLS:
        for y in EDA_COLS:
            g[(x, y)] = f"sum(CAST({x} AS DOUBLE) * CAST({y} AS DOUBLE))"
    return f"""WITH {S.journeys_cte()},
gm AS (SELECT {g[(a, b)]} / sqrt({g[(a, a)]} * {g[(b, b)]}) AS x,
              {g[(a, c)]} / sqrt({g[(a, a)]} * {g[(c, c)]}) AS y,
              {g[(b, c)]} / sqrt({g[(b, b)]} * {g[(c, c)]}) AS z FROM journeys),
d AS (SELECT *, 1 + 2 * x * y * z - x * x - y * y - z * z AS det FROM gm)
SELECT '{a}' AS feature, CASE WHEN det > 1e-12 THEN (1 - z * z) / det
                          ELSE CAST('Infinity' AS DOUBLE) END AS vif FROM d
UNION ALL SELECT '{b}', CASE WHEN det > 1e-12 THEN (1 - y * y) / det
                        ELSE CAST('Infinity' AS DOUBLE) END FROM d
UNION ALL SELECT '{c}', CASE WHEN det > 1e-12 THEN (1 - x * x) / det
                        ELSE CAST('Infinity' AS DOUBLE) END FROM d"""


@register("vif", doubles=("vif",), ops="E2", sql=_vif_sql())
def q_vif(spark, sf_dir):
    """No-intercept variance inflation factors of the three minute columns."""
    from hubflow.operators.eda import vif
    df, cols = _eda_input(spark, sf_dir)
    return vif(df, cols)


def _skew_sql():
    parts = []
    for c in EDA_COLS:
        parts.append(f"""SELECT '{c}' AS column_name, avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5)
          AS skewness FROM (SELECT CAST({c} AS DOUBLE) AS v, avg(CAST({c} AS DOUBLE)) OVER () AS m
          FROM journeys) t""")
    return f"""WITH {S.journeys_cte()}, sk AS ({' UNION ALL '.join(parts)})
SELECT column_name, skewness, CASE WHEN skewness > 1 THEN 'Highly Positive Skew'
  WHEN skewness < -1 THEN 'Highly Negative Skew'
  WHEN skewness > -0.5 AND skewness < 0.5 THEN 'Fairly Symmetrical'
  ELSE 'Moderate Skew' END AS interpretation FROM sk"""


@register("skewness_report", doubles=("skewness",), ops="E3", sql=_skew_sql())
def q_skewness_report(spark, sf_dir):
    """Population skewness and its label per minute column."""
    from hubflow.operators.eda import skewness_report
    df, cols = _eda_input(spark, sf_dir)
    return skewness_report(df, cols)


def _hist_sql(bins=30):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM journeys" for c in EDA_COLS)
    return f"""WITH {S.journeys_cte()}, lv AS ({parts}),
rng AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM lv GROUP BY column_name),
b AS (SELECT lv.column_name, lo, hi, CASE WHEN hi - lo = 0 THEN 0 ELSE
        least(CAST(floor((value - lo) * {bins} / (hi - lo)) AS INTEGER), {bins - 1}) END AS bin
      FROM lv JOIN rng ON lv.column_name = rng.column_name WHERE value IS NOT NULL)
SELECT column_name, bin, lo + bin * (hi - lo) / {bins} AS bin_start,
       lo + (bin + 1) * (hi - lo) / {bins} AS bin_end, count(*) AS count
FROM b GROUP BY column_name, bin, lo, hi"""


@register("histogram", doubles=("bin_start", "bin_end"), ops="E4", sql=_hist_sql())
def q_histogram(spark, sf_dir):
    """30-bin histograms of the numeric milestone columns."""
    from hubflow.operators.eda import histogram
    df, cols = _eda_input(spark, sf_dir)
    return histogram(df, cols, bins=30)


@register("stage_delay_profile", ops="X4",
          doubles=("q1_delay", "median_delay", "q3_delay", "mean_delay"),
          sql=f"""WITH {S.journeys_cte()}
SELECT stage_group, count(delay_mins) AS n, min(delay_mins) AS min_delay,
  CAST(quantile_cont(delay_mins, 0.25) AS DOUBLE) AS q1_delay,
  CAST(quantile_cont(delay_mins, 0.5) AS DOUBLE) AS median_delay,
  CAST(quantile_cont(delay_mins, 0.75) AS DOUBLE) AS q3_delay,
  max(delay_mins) AS max_delay, avg(delay_mins) AS mean_delay
FROM journeys GROUP BY stage_group""")
def q_stage_delay_profile(spark, sf_dir):
    """Delay distribution summary per stage group."""
    from hubflow.operators.eda import stage_delay_profile
    return stage_delay_profile(journeys_long(spark, sf_dir, "supplier"))


def _bin_sql(col, lo, hi, bins):
    return (f"CASE WHEN {hi} - {lo} = 0 THEN 0 ELSE least(CAST(floor(({col} - {lo}) * {bins} "
            f"/ ({hi} - {lo})) AS INTEGER), {bins - 1}) END")


@register("density_grid", ops="X5", sql=f"""WITH {S.journeys_cte()}, {S.hub_kpis_cte()},
r AS (SELECT min(CAST(total_outgoing_flow AS DOUBLE)) AS xlo, max(CAST(total_outgoing_flow AS DOUBLE)) AS xhi,
             min(avg_segment_delay) AS ylo, max(avg_segment_delay) AS yhi FROM kpis)
SELECT {_bin_sql('CAST(total_outgoing_flow AS DOUBLE)', 'xlo', 'xhi', 20)} AS x_bin,
       {_bin_sql('avg_segment_delay', 'ylo', 'yhi', 20)} AS y_bin, count(*) AS hubs
FROM kpis, r GROUP BY 1, 2""")
def q_density_grid(spark, sf_dir):
    """20 x 20 hub-count grid over flow and mean delay."""
    from hubflow.operators.eda import density_grid
    return density_grid(K.hub_kpis(journeys_long(spark, sf_dir, "supplier"), sort=False))


@register("hub_quadrants", doubles=KPI_DOUBLES, ops="A13 X1",
          sql=f"""WITH {S.journeys_cte()}, {S.hub_kpis_cte()},
c AS (SELECT quantile_cont(total_outgoing_flow, 0.1) AS cut FROM kpis),
kept AS (SELECT * FROM kpis WHERE total_outgoing_flow >= (SELECT cut FROM c)),
m AS (SELECT quantile_cont(total_outgoing_flow, 0.5) AS mf,
             quantile_cont(avg_segment_delay, 0.5) AS md FROM kept)
SELECT kept.*, CASE
  WHEN total_outgoing_flow > mf AND avg_segment_delay > md THEN 'Critical Bottleneck'
  WHEN total_outgoing_flow > mf THEN 'Efficient Major Hub'
  WHEN avg_segment_delay > md THEN 'Inefficient Small Hub'
  ELSE 'Efficient Small Hub' END AS hub_category
FROM kept, m""")
def q_hub_quadrants(spark, sf_dir):
    """Hubs above the 10th flow percentile in four flow/delay quadrants."""
    return K.hub_quadrants(K.hub_kpis(journeys_long(spark, sf_dir, "supplier"), sort=False))


# --------------------------------------------------- wide format: clean/U1
def _clean(spark, sf_dir):
    from hubflow.operators.clean import clean_wide
    return clean_wide(_raw_wide(spark, sf_dir))


def _raw_wide(spark, sf_dir):
    # written once: the numeric guard of cleaning and its output both read it
    from hubflow.session import cut_lineage
    from hubflow.sources.tables import journeys_wide
    return cut_lineage(journeys_wide(spark, sf_dir))


def _wide_sql(tail: str) -> str:
    from hubflow.plans import widesql as W
    return f"WITH {W.raw_wide_sql()}, {W.clean_wide_sql()}{tail}"


@register("clean_wide", ops="P1-P6 P11", sql=_wide_sql(" SELECT * FROM clean_w"))
def q_clean_wide(spark, sf_dir):
    """The raw 98-column journey table after renaming and type cleaning.

    Printed as text: which columns become numbers depends on the data, and a
    SQL text has fixed column types; ``clean_summary`` checks their number."""
    clean = _clean(spark, sf_dir)
    return clean.select(*[F.col(c).cast("string").alias(c) for c in clean.columns])


@register("clean_summary", ops="P8", sql=_wide_sql(
    " " + __import__("hubflow.plans.widesql", fromlist=["x"]).clean_summary_sql()))
def q_clean_summary(spark, sf_dir):
    """Column counts of the cleaned wide table (total / numeric / text)."""
    from hubflow.operators.clean import clean_summary
    return clean_summary(spark, _clean(spark, sf_dir))


@register("unpivot_long", ops="U1 U2 P9 P10 P12 P13",
          sql=_wide_sql(", " + __import__("hubflow.plans.widesql", fromlist=["x"]).unpivot_sql()
                        + " SELECT * FROM unpiv"))
def q_unpivot_long(spark, sf_dir):
    """Wide journeys unpivoted to one row per milestone."""
    from hubflow.operators.journeys import unpivot_long
    return unpivot_long(_clean(spark, sf_dir))


# ------------------------------------------- cluster metrics on embeddings
def _vectors(spark, sf_dir):
    from hubflow.sources.tables import read_table
    return read_table(spark, sf_dir, "embeddings")


VEC_STATS_SQL = """pe AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM p),
cs AS (SELECT label, list(s ORDER BY i) AS s, list(m ORDER BY i) AS centroid FROM
        (SELECT label, i, sum(v) AS s, avg(v) AS m FROM pe GROUP BY label, i) t GROUP BY label),
cn AS (SELECT label, count(*) AS n, sum(list_dot_product(x, x)) AS q FROM p GROUP BY label),
c AS (SELECT cn.label, n, q, s, centroid FROM cn JOIN cs ON cn.label = cs.label)"""
VEC_BASE_SQL = f"""p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x
       FROM embeddings WHERE label IS NOT NULL),
{VEC_STATS_SQL}"""

SIL_CTES_SQL = """d AS (SELECT p.vec_id, p.label AS plabel, c.label AS clabel, c.n,
        c.n * list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.s) + c.q AS tot
      FROM p, c),
ab AS (SELECT vec_id, plabel AS label, max(CASE WHEN clabel = plabel THEN n END) AS own_n,
        max(CASE WHEN clabel = plabel AND n > 1 THEN tot / (n - 1) END) AS a,
        min(CASE WHEN clabel <> plabel THEN tot / n END) AS b
      FROM d GROUP BY vec_id, plabel),
sil AS (SELECT vec_id, label, CASE WHEN own_n <= 1 OR b IS NULL THEN 0.0
               ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""
SIL_SQL = f"WITH {VEC_BASE_SQL}, {SIL_CTES_SQL}"


@register("silhouette_samples", doubles=("silhouette",), ops="C3 J8",
          sql=f"{SIL_SQL} SELECT * FROM sil")
def q_silhouette_samples(spark, sf_dir):
    """Per-vector squared-Euclidean silhouette, label as cluster."""
    from hubflow.operators.cluster import silhouette_samples
    return silhouette_samples(_vectors(spark, sf_dir))


@register("silhouette_score", doubles=("silhouette",), ops="C3",
          sql=f"{SIL_SQL} SELECT avg(silhouette) AS silhouette FROM sil")
def q_silhouette_score(spark, sf_dir):
    """Mean silhouette of the labelled vectors."""
    from hubflow.operators.cluster import silhouette_score
    return silhouette_score(_vectors(spark, sf_dir))


@register("poor_fit_points", doubles=("silhouette",), ops="C6 J9",
          sql=f"{SIL_SQL} SELECT * FROM sil WHERE silhouette < 0.1")
def q_poor_fit_points(spark, sf_dir):
    """Vectors whose silhouette is below 0.1."""
    from hubflow.operators.cluster import poor_fit_points
    return poor_fit_points(_vectors(spark, sf_dir), 0.1)


EUCLID_SQL = """WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
sz AS (SELECT label, count(*) AS n FROM p GROUP BY label),
ds AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s FROM p a JOIN p b ON {only}
       GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id, ds.label, max(CASE WHEN other = ds.label AND n > 1 THEN s / (n - 1) END) AS a,
              min(CASE WHEN other <> ds.label THEN s / n END) AS b
       FROM ds JOIN sz ON sz.label = ds.other GROUP BY vec_id, ds.label),
eu AS (SELECT vec_id, label, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0
              ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


@register("silhouette_euclidean", doubles=("silhouette",), ops="C3 J8",
          sql=f"{EUCLID_SQL.format(only='true')} SELECT * FROM eu")
def q_silhouette_euclidean(spark, sf_dir):
    """Per-vector Euclidean silhouette, label as cluster, all points against all."""
    from hubflow.operators.silhouette import euclidean_samples
    return euclidean_samples(_vectors(spark, sf_dir))


@register("silhouette_euclidean_score", doubles=("silhouette",), ops="C3",
          sql=f"{EUCLID_SQL.format(only='true')} SELECT avg(silhouette) AS silhouette FROM eu")
def q_silhouette_euclidean_score(spark, sf_dir):
    """Mean Euclidean silhouette of the labelled vectors."""
    from hubflow.operators.silhouette import euclidean_score
    return euclidean_score(_vectors(spark, sf_dir))


@register("silhouette_euclidean_targets", doubles=("silhouette",), ops="C3",
          sql=f"{EUCLID_SQL.format(only='a.vec_id % 50 = 0')} SELECT * FROM eu")
def q_silhouette_euclidean_targets(spark, sf_dir):
    """Euclidean silhouette of the stated query set (ids divisible by 50)
    against all vectors, the form for tables too large for all targets."""
    from hubflow.operators.silhouette import euclidean_samples
    return euclidean_samples(_vectors(spark, sf_dir), targets=F.col("vec_id") % 50 == 0)


@register("poor_fit_euclidean", doubles=("silhouette",), ops="C6 J9",
          sql=f"{EUCLID_SQL.format(only='true')} SELECT * FROM eu WHERE silhouette < 0.1")
def q_poor_fit_euclidean(spark, sf_dir):
    """Vectors whose Euclidean silhouette is below 0.1."""
    from hubflow.operators.silhouette import euclidean_poor_fit
    return euclidean_poor_fit(_vectors(spark, sf_dir), 0.1)


@register("davies_bouldin", doubles=("davies_bouldin",), ops="C4", sql=f"""WITH {VEC_BASE_SQL},
sp AS (SELECT p.label, avg(list_distance(p.x, c.centroid)) AS s
       FROM p JOIN c ON p.label = c.label GROUP BY p.label),
cc AS (SELECT c.label, c.centroid, sp.s FROM c JOIN sp ON c.label = sp.label),
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) AS r
      FROM cc a JOIN cc b ON a.label <> b.label GROUP BY a.label)
SELECT avg(coalesce(r, 0.0)) AS davies_bouldin FROM cc LEFT JOIN r ON cc.label = r.label""")
def q_davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of the labelled vectors."""
    from hubflow.operators.cluster import davies_bouldin
    return davies_bouldin(_vectors(spark, sf_dir))


@register("boundary_points", doubles=("margin_ratio",), ops="C7 W4", sql=f"""WITH {VEC_BASE_SQL},
dd AS (SELECT e.vec_id, e.label, list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid) AS d,
              row_number() OVER (PARTITION BY e.vec_id ORDER BY
                list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid)) AS rn
       FROM embeddings e, c),
m AS (SELECT vec_id, label, max(CASE WHEN rn = 1 THEN d END) / max(CASE WHEN rn = 2 THEN d END)
             AS margin_ratio FROM dd GROUP BY vec_id, label)
SELECT vec_id, margin_ratio, label AS assigned_cluster FROM m WHERE margin_ratio > 0.85""")
def q_boundary_points(spark, sf_dir):
    """Vectors nearly equidistant to their two nearest label centroids."""
    from hubflow.operators.cluster import boundary_points
    return boundary_points(_vectors(spark, sf_dir))


@register("dim_variance", doubles=("variance",), ops="C8 O5", sql="""
SELECT CAST(i AS INTEGER) AS dimension, var_pop(v) AS variance FROM
  (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i
   FROM embeddings) t GROUP BY i""")
def q_dim_variance(spark, sf_dir):
    """Population variance of each embedding dimension."""
    from hubflow.operators.cluster import dim_variance
    return dim_variance(_vectors(spark, sf_dir))


@register("similar_vectors", doubles=("similarity",), ops="C10 O5", sql="""
WITH t AS (SELECT min(vec_id) AS target_id FROM embeddings GROUP BY label),
s AS (SELECT t.target_id, e.vec_id AS similar_id,
             list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
               AS similarity
      FROM t JOIN embeddings q ON q.vec_id = t.target_id
      JOIN embeddings e ON e.vec_id <> t.target_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id
        ORDER BY similarity DESC, similar_id) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5""")
def q_similar_vectors(spark, sf_dir):
    """Top-5 cosine neighbours of the first vector of every label."""
    from hubflow.operators.cluster import similar_vectors
    v = _vectors(spark, sf_dir)
    targets = v.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return similar_vectors(v, targets, top_k=5)


@register("nearest_vectors", doubles=("similarity",), ops="C10 O5", sql="""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT q.vec_id AS target_id, e.vec_id AS similar_id, round(list_cosine_similarity(q.x, e.x), 12) AS similarity
      FROM v q JOIN v e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id
        ORDER BY similarity DESC, similar_id) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5""")
def q_nearest_vectors(spark, sf_dir):
    """Top-5 cosine neighbours among all vectors of the query set (ids divisible
    by 50), over an inverted-file index searched to the distance bound."""
    from hubflow.operators.neighbours import build_index, search_index
    v = _vectors(spark, sf_dir)
    return search_index(build_index(v), v.filter("vec_id % 50 = 0"), top_k=5)


@register("nearest_vectors_probed", doubles=("similarity",), ops="C10 O5")
def q_nearest_vectors_probed(spark, sf_dir):
    """The same from the eight nearest lists only (approximate; recall is tested)."""
    from hubflow.operators.neighbours import build_index, search_index
    v = _vectors(spark, sf_dir)
    return search_index(build_index(v), v.filter("vec_id % 50 = 0"), top_k=5, exact=False)


# ------------------------------------------------- hub cluster analysis
def _clustered(spark, sf_dir):
    from hubflow.operators.cluster import attach_clusters
    from hubflow.sources.tables import read_table
    labels = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("hub_id"),
        F.col("s_nationkey").alias("cluster_label"))
    return attach_clusters(K.hub_kpis(journeys_long(spark, sf_dir, "supplier"), sort=False), labels)


CLUSTERED_SQL = f"""WITH {S.journeys_cte()}, {S.hub_kpis_cte()},
cl AS (SELECT k.*, s.s_nationkey AS cluster_label FROM kpis k
       LEFT JOIN supplier s ON k.hub_id = CAST(s.s_suppkey AS VARCHAR)),
summ AS (SELECT cluster_label, count(*) AS hub_count, avg(total_outgoing_flow) AS avg_flow,
           CAST(sum(total_outgoing_flow) AS BIGINT) AS total_flow,
           avg(avg_segment_delay) AS avg_delay, avg(std_delay) AS avg_std_delay
         FROM cl WHERE cluster_label IS NOT NULL GROUP BY cluster_label)"""
SUMMARY_DOUBLES = ("avg_flow", "avg_delay", "avg_std_delay")


@register("cluster_summary", doubles=SUMMARY_DOUBLES, ops="A9 J5 C2(labels)",
          sql=f"{CLUSTERED_SQL} SELECT * FROM summ")
def q_cluster_summary(spark, sf_dir):
    """Per-cluster hub statistics (cluster = supplier nation)."""
    from hubflow.operators.cluster import cluster_summary
    return cluster_summary(_clustered(spark, sf_dir))


# fixed values: the texts below are those of CLUSTER_TYPES in operators/cluster.py
@register("cluster_interpretation", doubles=SUMMARY_DOUBLES + ("flow_share_pct",),
          ops="C5 A16", sql=f"""{CLUSTERED_SQL},
net AS (SELECT sum(total_outgoing_flow) AS tf, avg(total_outgoing_flow) AS af,
               avg(avg_segment_delay) AS ad FROM cl)
SELECT summ.*, CASE WHEN tf > 0 THEN total_flow / tf * 100 ELSE 0.0 END AS flow_share_pct,
  CASE WHEN avg_flow > af AND avg_delay > ad THEN 'CRITICAL BOTTLENECK - High volume with delays'
       WHEN avg_flow > af THEN 'EFFICIENT MAJOR HUB - High volume, well-performing'
       WHEN avg_delay > ad THEN 'INEFFICIENT SMALL HUB - Low volume but problematic'
       ELSE 'STANDARD HUB - Low volume, acceptable performance' END AS cluster_type,
  CASE WHEN avg_flow > af AND avg_delay > ad
         THEN 'Priority 1: Urgent capacity expansion or process optimization needed'
       WHEN avg_flow > af THEN 'Monitor closely and replicate best practices'
       WHEN avg_delay > ad THEN 'Investigate operational issues or consider consolidation'
       ELSE 'Standard operations, routine monitoring' END AS recommendation
FROM summ, net""")
def q_cluster_interpretation(spark, sf_dir):
    """Cluster business type and recommendation versus network means."""
    from hubflow.operators.cluster import cluster_interpretation
    return cluster_interpretation(_clustered(spark, sf_dir))


@register("cluster_top_hubs", doubles=("avg_segment_delay",), ops="W3", sql=f"""{CLUSTERED_SQL},
r AS (SELECT cluster_label, CAST(row_number() OVER (PARTITION BY cluster_label
        ORDER BY total_outgoing_flow DESC, hub_id) AS INTEGER) AS rank,
        hub_id, total_outgoing_flow, avg_segment_delay FROM cl WHERE cluster_label IS NOT NULL)
SELECT * FROM r WHERE rank <= 5""")
def q_cluster_top_hubs(spark, sf_dir):
    """Five busiest hubs per cluster."""
    from hubflow.operators.cluster import cluster_top_hubs
    return cluster_top_hubs(_clustered(spark, sf_dir))


@register("executive_table", doubles=("avg_flow", "avg_delay"), ops="X3 A10",
          sql=f"""{CLUSTERED_SQL} SELECT cluster_label, count(*) AS hubs,
  avg(total_outgoing_flow) AS avg_flow, avg(avg_segment_delay) AS avg_delay
FROM cl GROUP BY cluster_label""")
def q_executive_table(spark, sf_dir):
    """Executive dashboard table: hubs, mean flow, mean delay per cluster."""
    from hubflow.operators.cluster import executive_table
    return executive_table(_clustered(spark, sf_dir))


@register("hub_profiles", doubles=("avg_segment_delay", "std_delay"), ops="X6",
          sql=f"""{CLUSTERED_SQL} SELECT hub_id, total_outgoing_flow, avg_segment_delay,
  std_delay, max_delay, cluster_label FROM cl""")
def q_hub_profiles(spark, sf_dir):
    """Hub profile columns with cluster label."""
    from hubflow.operators.cluster import hub_profiles
    return hub_profiles(_clustered(spark, sf_dir))


# ----------------------------------------------------- graph measures
def _nation_router(spark, sf_dir):
    from hubflow.operators.network import router_edges
    return router_edges(_t(spark, sf_dir, "router", hub="nation"))


NATION_EDGES_SQL = f"""{S.transits_ctes(hub='nation', variants=('router',))},
re AS ({ROUTER_EDGES_SQL}),
nodes AS (SELECT src AS node FROM re WHERE src IS NOT NULL
          UNION SELECT dst FROM re WHERE dst IS NOT NULL)"""


def _apsp_sql(edge_filter: str = "TRUE", unit: bool = False, sources: str = "") -> str:
    only = f"du.s IN (SELECT node FROM {sources}) AND " if sources else ""
    start = f" WHERE node IN (SELECT node FROM {sources})" if sources else ""
    scale = f" * (SELECT count(*) FROM gn) / (SELECT count(*) FROM {sources})" if sources else ""
    w = "CAST(1000000 AS BIGINT)" if unit else "CAST(round(weight * 1000000) AS BIGINT)"
    sq = []
    prev = "d1"
    for k in (2, 4, 8, 16):
        sq.append(f"""d{k} AS (SELECT a.s, b.v, min(a.d + b.d) AS d FROM {prev} a
                 JOIN {prev} b ON a.v = b.s GROUP BY a.s, b.v)""")
        prev = f"d{k}"
    return f"""ge AS (SELECT src, dst, {w} AS w FROM re
          WHERE dst IS NOT NULL AND src <> dst AND {edge_filter}),
gn AS (SELECT node FROM nodes WHERE node IN (SELECT src FROM re WHERE {edge_filter})
       OR node IN (SELECT dst FROM re WHERE {edge_filter})),
d0 AS (SELECT node AS s, node AS v, CAST(0 AS BIGINT) AS d FROM gn
       UNION ALL SELECT src, dst, w FROM ge),
d1 AS (SELECT s, v, min(d) AS d FROM d0 GROUP BY s, v),
{', '.join(sq)},
dag AS (SELECT du.s, ge.src AS u, ge.dst AS v FROM d16 du JOIN ge ON du.v = ge.src
        JOIN d16 dv ON dv.s = du.s AND dv.v = ge.dst WHERE {only}du.d + ge.w = dv.d),
paths(s, last, path) AS (SELECT node, node, [node] FROM gn{start}
        UNION ALL SELECT p.s, g.v, list_append(p.path, g.v) FROM paths p
        JOIN dag g ON g.s = p.s AND g.u = p.last),
sig AS (SELECT s, last AS t, count(*) AS sigma FROM paths GROUP BY s, last),
inter AS (SELECT s, last AS t, unnest(path[2:len(path) - 1]) AS v FROM paths WHERE len(path) > 2),
bcs AS (SELECT i.v, sum(1.0 / sg.sigma) AS b FROM inter i JOIN sig sg ON i.s = sg.s AND i.t = sg.t
        GROUP BY i.v),
nn AS (SELECT count(*) AS n FROM gn),
bc AS (SELECT gn.node AS hub_id, coalesce(b, 0.0) *
         CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 0.0 END{scale} AS centrality
       FROM gn LEFT JOIN bcs ON gn.node = bcs.v, nn)"""


@register("betweenness", doubles=("centrality",), ops="G5 G3",
          sql=f"WITH RECURSIVE {NATION_EDGES_SQL}, {_apsp_sql()} SELECT * FROM bc")
def q_betweenness(spark, sf_dir):
    """Weighted directed betweenness of the nation-hub router graph."""
    from hubflow.operators.paths import betweenness
    return betweenness(_nation_router(spark, sf_dir))


@register("betweenness_unweighted", doubles=("centrality",), ops="G7",
          sql=f"WITH RECURSIVE {NATION_EDGES_SQL}, {_apsp_sql(unit=True)} SELECT * FROM bc")
def q_betweenness_unweighted(spark, sf_dir):
    """Hop-count betweenness on the whole nation router graph."""
    from hubflow.operators.paths import betweenness
    return betweenness(_nation_router(spark, sf_dir), weight=None)


PIVOTS = 4
PIVOT_SQL = f"""{S.transits_ctes(hub='supplier', variants=('router',))},
re AS ({ROUTER_EDGES_SQL}),
nodes AS (SELECT src AS node FROM re WHERE src IS NOT NULL
          UNION SELECT dst FROM re WHERE dst IS NOT NULL),
piv AS (SELECT node FROM nodes ORDER BY CAST(node AS BIGINT) LIMIT {PIVOTS})"""


@register("betweenness_pivots", doubles=("centrality",), ops="G5",
          sql=f"""WITH RECURSIVE {PIVOT_SQL}, {_apsp_sql(sources='piv')}
SELECT * FROM bc""")
def q_betweenness_pivots(spark, sf_dir):
    """Weighted betweenness of the supplier-hub graph, which grows with the
    tables, estimated from the pivots of smallest id."""
    from hubflow.operators.network import router_edges
    from hubflow.operators.paths import betweenness, nodes_of
    from hubflow.session import cut_lineage
    e = cut_lineage(router_edges(_t(spark, sf_dir, "router")))
    pivots = nodes_of(e).orderBy(F.col("node").cast("bigint")).limit(PIVOTS)
    return betweenness(e, sources=cut_lineage(pivots))


HUB_EDGES_SQL = f"""{S.transits_ctes(hub='supplier', variants=('router',))},
re AS ({ROUTER_EDGES_SQL}),
nodes AS (SELECT src AS node FROM re WHERE src IS NOT NULL
          UNION SELECT dst FROM re WHERE dst IS NOT NULL)"""


def _hub_router(spark, sf_dir):
    from hubflow.operators.network import router_edges
    from hubflow.session import cut_lineage
    return cut_lineage(router_edges(_t(spark, sf_dir, "router")), release=True)


@register("betweenness_hubs", doubles=("centrality",), ops="G5",
          sql=f"WITH RECURSIVE {HUB_EDGES_SQL}, {_apsp_sql()} SELECT * FROM bc")
def q_betweenness_hubs(spark, sf_dir):
    """Exact weighted betweenness of the supplier-hub graph."""
    from hubflow.operators.paths import betweenness
    return betweenness(_hub_router(spark, sf_dir))


@register("betweenness_sampled", doubles=("centrality", "error"), ops="G5")
def q_betweenness_sampled(spark, sf_dir):
    """Betweenness of the supplier-hub graph from sampled shortest paths, with
    the error that holds for all hubs with a chance of 0.9."""
    from hubflow.operators.centrality import sampled_betweenness
    return sampled_betweenness(_hub_router(spark, sf_dir))


@register("betweenness_sampled_inside", ops="G5", sql=f"""WITH {HUB_EDGES_SQL}
SELECT node AS hub_id, true AS inside FROM nodes""")
def q_betweenness_sampled_inside(spark, sf_dir):
    """Whether each hub's exact betweenness lies within the sampled one's error."""
    from hubflow.operators.centrality import sampled_betweenness
    from hubflow.operators.paths import betweenness
    e = _hub_router(spark, sf_dir)
    exact = betweenness(e).withColumnRenamed("centrality", "exact")
    return sampled_betweenness(e).join(exact, "hub_id").select(
        "hub_id", (F.abs(F.col("centrality") - F.col("exact")) <= F.col("error")).alias("inside"))


@register("bottlenecks", doubles=("centrality_score", "avg_hub_delay"), ops="G6 J10 O2",
          sql=f"""WITH RECURSIVE {NATION_EDGES_SQL}, {_apsp_sql()}, {S.hub_kpis_cte()}
SELECT bc.hub_id, bc.centrality AS centrality_score, k.total_outgoing_flow AS flow_volume,
       k.avg_segment_delay AS avg_hub_delay
FROM bc JOIN kpis k ON bc.hub_id = k.hub_id
ORDER BY centrality_score DESC, hub_id LIMIT 10""")
def q_bottlenecks(spark, sf_dir):
    """Top-10 bottleneck hubs: centrality with flow and mean delay."""
    from hubflow.operators.paths import betweenness, bottlenecks
    kp = K.hub_kpis(journeys_long(spark, sf_dir, "nation"), sort=False)
    return bottlenecks(betweenness(_nation_router(spark, sf_dir)), kp, top_n=10)


def _routes_sql(edges: str, pairs: int) -> str:
    return f"""WITH RECURSIVE {edges},
e AS (SELECT src, dst, weight, avg_delay FROM re WHERE dst IS NOT NULL AND src <> dst),
pairs AS (SELECT src AS source, dst AS target FROM re WHERE dst IS NOT NULL AND src <> dst
          ORDER BY volume DESC, src, dst LIMIT {pairs}),
two AS (SELECT p.source, p.target, e.weight AS cost FROM pairs p
          JOIN e ON e.src = p.source AND e.dst = p.target
        UNION ALL SELECT p.source, p.target, a.weight + b.weight FROM pairs p
          JOIN e a ON a.src = p.source JOIN e b ON b.src = a.dst AND b.dst = p.target
          WHERE a.dst <> p.target),
ub AS (SELECT source, target, max(cost) AS ub FROM
         (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY cost) AS rn FROM two) x
       WHERE rn <= 3 GROUP BY source, target HAVING count(*) = 3),
rp(source, target, last, path, cost, delay) AS (
  SELECT source, target, source, [source], CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM pairs
  UNION ALL SELECT rp.source, rp.target, e.dst, list_append(rp.path, e.dst),
         rp.cost + e.weight, rp.delay + e.avg_delay
  FROM rp JOIN e ON e.src = rp.last JOIN ub ON ub.source = rp.source AND ub.target = rp.target
  WHERE rp.last <> rp.target AND NOT list_contains(rp.path, e.dst)
    AND rp.cost + e.weight <= ub.ub + 1e-9),
r AS (SELECT source, target, CAST(row_number() OVER (PARTITION BY source, target
        ORDER BY cost, path) AS INTEGER) AS rank, array_to_string(path, ' -> ') AS path,
        CAST(len(path) - 1 AS INTEGER) AS hops, cost AS total_weight, delay AS total_avg_delay
      FROM rp WHERE last = target)
SELECT * FROM r WHERE rank <= 3"""


@register("k_best_routes", doubles=("total_weight", "total_avg_delay"), ops="G4",
          sql=_routes_sql(NATION_EDGES_SQL, 5))
def q_k_best_routes(spark, sf_dir):
    """Three cheapest simple routes between the ends of the 5 busiest routes."""
    from hubflow.operators.paths import k_best_routes
    e = _nation_router(spark, sf_dir)
    ok = e.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    pairs = ok.orderBy(F.desc("volume"), "src", "dst").limit(5).select(
        F.col("src").alias("source"), F.col("dst").alias("target"))
    return k_best_routes(e, pairs, top_k=3)


SUPPLIER_PAIRS = 20


def _hub_routes_sql(pairs: int) -> str:
    """Partial routes are listed only while cost and shortest rest stay within a
    bound: the third-least cost of leaving the source by some edge and going on
    by a shortest way that cannot come back to the source."""
    square = ",\n".join(f"""m{2 * k} AS (SELECT a.s, b.v, min(a.d + b.d) AS d FROM m{k} a JOIN m{k} b ON a.v = b.s
    GROUP BY a.s, b.v)""" for k in (1, 2, 4, 8))
    return f"""WITH RECURSIVE {HUB_EDGES_SQL},
e AS MATERIALIZED (SELECT src, dst, weight, avg_delay FROM re WHERE dst IS NOT NULL AND src <> dst),
pairs AS MATERIALIZED (SELECT src AS source, dst AS target FROM re WHERE dst IS NOT NULL AND src <> dst
          ORDER BY volume DESC, src, dst LIMIT {pairs}),
m1 AS (SELECT s, v, min(d) AS d FROM
    (SELECT src AS s, dst AS v, weight AS d FROM e UNION ALL SELECT node, node, 0 FROM nodes) x GROUP BY s, v),
{square},
h AS MATERIALIZED (SELECT s AS node, v AS target, d FROM m16 WHERE v IN (SELECT target FROM pairs)),
first AS (SELECT p.source, p.target, e.weight + h.d AS cost FROM pairs p JOIN e ON e.src = p.source
          JOIN h ON h.node = e.dst AND h.target = p.target JOIN h hs ON hs.node = p.source AND hs.target = p.target
          LEFT JOIN m16 back ON back.s = e.dst AND back.v = p.source
          WHERE back.d IS NULL OR h.d < back.d + hs.d - 1e-6),
ub AS MATERIALIZED (SELECT source, target, max(cost) AS ub FROM
         (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY cost) AS rn FROM first) x
       WHERE rn <= 3 GROUP BY source, target HAVING count(*) = 3),
rp(source, target, last, path, cost, delay) AS (
  SELECT source, target, source, [source], CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM pairs
  UNION ALL SELECT rp.source, rp.target, e.dst, list_append(rp.path, e.dst),
         rp.cost + e.weight, rp.delay + e.avg_delay
  FROM rp JOIN e ON e.src = rp.last JOIN h ON h.node = e.dst AND h.target = rp.target
  JOIN ub ON ub.source = rp.source AND ub.target = rp.target
  WHERE rp.last <> rp.target AND NOT list_contains(rp.path, e.dst)
    AND rp.cost + e.weight + h.d <= ub.ub + 1e-6),
r AS (SELECT source, target, CAST(row_number() OVER (PARTITION BY source, target
        ORDER BY cost, path) AS INTEGER) AS rank, array_to_string(path, ' -> ') AS path,
        CAST(len(path) - 1 AS INTEGER) AS hops, cost AS total_weight, delay AS total_avg_delay
      FROM rp WHERE last = target)
SELECT * FROM r WHERE rank <= 3"""


@register("k_best_routes_hubs", doubles=("total_weight", "total_avg_delay"), ops="G4",
          sql=_hub_routes_sql(SUPPLIER_PAIRS))
def q_k_best_routes_hubs(spark, sf_dir):
    """Three cheapest simple routes between the ends of the 20 busiest routes
    of the supplier-hub graph, which grows with the tables, by deviations."""
    from hubflow.operators.routes import k_best_by_deviation
    e = _hub_router(spark, sf_dir)
    ok = e.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    pairs = ok.orderBy(F.desc("volume"), "src", "dst").limit(SUPPLIER_PAIRS).select(
        F.col("src").alias("source"), F.col("dst").alias("target"))
    return k_best_by_deviation(e, pairs, top_k=3)


# ------------------------------------------------------ delay features (M1-M3)
FEATURE_DOUBLES = ("avg_delay_source", "avg_delay_target", "std_delay_source",
                   "std_delay_target", "route_avg_delay", "route_std_delay", "delay_risk_score")


@register("delay_features", doubles=FEATURE_DOUBLES, ops="W1(V3) P21 A5 A14 J2 J3 J4 M1 M2 M3",
          sql=f"""WITH {S.transits_ctes(variants=('predict',))}, {S.hub_kpis_cte()},
t AS (SELECT leg_id, seq, src, dst, delay_mins, planned_mins,
        src || '_' || coalesce(dst, 'nan') AS route_id,
        coalesce(TRY_CAST(regexp_extract(stage_group, '(\\d+)', 1) AS INTEGER), 1) AS segment_number,
        (leg_id % 5) = 0 AS is_test FROM t_predict),
j AS (SELECT t.*, ks.total_outgoing_flow AS flow_source, ks.avg_segment_delay AS avg_delay_source,
        ks.std_delay AS std_delay_source, kt.total_outgoing_flow AS flow_target,
        kt.avg_segment_delay AS avg_delay_target, kt.std_delay AS std_delay_target
      FROM t LEFT JOIN kpis ks ON t.src = ks.hub_id LEFT JOIN kpis kt ON t.dst = kt.hub_id),
rs AS (SELECT route_id, avg(delay_mins) AS route_avg_delay, stddev_samp(delay_mins) AS route_std_delay,
        count(delay_mins) AS route_volume FROM j GROUP BY route_id),
f AS (SELECT j.leg_id, j.seq, j.src, j.dst, j.route_id, j.segment_number,
        coalesce(flow_source, 0) AS flow_source, coalesce(flow_target, 0) AS flow_target,
        avg_delay_source, avg_delay_target,
        coalesce(std_delay_source, 0.0) AS std_delay_source,
        coalesce(std_delay_target, 0.0) AS std_delay_target,
        route_avg_delay, coalesce(route_std_delay, 0.0) AS route_std_delay,
        coalesce(route_volume, 1) AS route_volume,
        coalesce(planned_mins, 0) AS planned_duration,
        coalesce(flow_source, 0) * coalesce(flow_target, 0) AS hub_interaction,
        coalesce(avg_delay_source, 0.0) + coalesce(avg_delay_target, 0.0) AS delay_risk_score,
        delay_mins, is_test
      FROM j LEFT JOIN rs ON j.route_id = rs.route_id)
SELECT leg_id, seq, src, dst, route_id, segment_number, flow_source, flow_target,
  coalesce(avg_delay_source, (SELECT avg(avg_delay_source) FROM f), 0.0) AS avg_delay_source,
  coalesce(avg_delay_target, (SELECT avg(avg_delay_target) FROM f), 0.0) AS avg_delay_target,
  std_delay_source, std_delay_target,
  coalesce(route_avg_delay, (SELECT avg(route_avg_delay) FROM f), 0.0) AS route_avg_delay,
  route_std_delay, route_volume, planned_duration, hub_interaction, delay_risk_score,
  delay_mins, is_test FROM f""")
def q_delay_features(spark, sf_dir):
    """The 13 delay-prediction features per transport movement, with split flag."""
    from hubflow.operators.journeys import transits
    from hubflow.operators.predict import delay_features
    long_df = journeys_long(spark, sf_dir, "supplier")
    return delay_features(transits(long_df, "predict"), K.hub_kpis(long_df, sort=False))


# ------------------------------------------------- embeddings
NODE_COLS = ["total_outgoing_flow", "avg_segment_delay", "std_delay"]


def _embed_graph(spark, sf_dir):
    """(standardised node features, embed edges) of the supplier-hub graph."""
    from hubflow.operators.journeys import transits, written_successors
    from hubflow.operators.network import embed_edges, graph_nodes, node_features, standardise
    from hubflow.session import cut_lineage, drop_tables
    lines = written_successors(journeys_long(spark, sf_dir, "supplier"))
    # edges and hub KPIs are small aggregates used several times: write once
    edges = cut_lineage(embed_edges(transits(None, "embed", successors=lines)))
    kp = cut_lineage(K.hub_kpis(lines, sort=False))
    drop_tables(lines)
    nodes = node_features(graph_nodes(edges), kp)
    z = standardise(nodes, NODE_COLS)
    return z, edges


NBR_SQL = f"""WITH base AS ({NODES_SQL}),
z AS (SELECT hub_id,
  (total_outgoing_flow - avg(total_outgoing_flow) OVER ()) /
    CASE WHEN coalesce(stddev_pop(total_outgoing_flow) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(total_outgoing_flow) OVER () END AS f,
  (avg_segment_delay - avg(avg_segment_delay) OVER ()) /
    CASE WHEN coalesce(stddev_pop(avg_segment_delay) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(avg_segment_delay) OVER () END AS a,
  (std_delay - avg(std_delay) OVER ()) /
    CASE WHEN coalesce(stddev_pop(std_delay) OVER (), 0) = 0 THEN 1
         ELSE stddev_pop(std_delay) OVER () END AS s
FROM base),
{S.transits_ctes(variants=('embed',))},
ed AS (SELECT DISTINCT src, dst FROM t_embed),
m AS (SELECT ed.dst, avg(z.f) AS f, avg(z.a) AS a, avg(z.s) AS s
      FROM ed JOIN z ON ed.src = z.hub_id GROUP BY ed.dst)
SELECT z.hub_id, coalesce(m.f, 0.0) AS nbr_total_outgoing_flow,
       coalesce(m.a, 0.0) AS nbr_avg_segment_delay, coalesce(m.s, 0.0) AS nbr_std_delay
FROM z LEFT JOIN m ON z.hub_id = m.dst"""


@register("neighbour_mean", ops="G8 G2 J1", doubles=tuple(f"nbr_{c}" for c in NODE_COLS), sql=NBR_SQL)
def q_neighbour_mean(spark, sf_dir):
    """One-hop mean of standardised in-neighbour features per hub."""
    from hubflow.operators.embed import neighbour_mean
    z, edges = _embed_graph(spark, sf_dir)
    return neighbour_mean(z, edges, NODE_COLS)


# Hub vectors of a checkable operator; the label is a rule on the id.
HUB_VEC_SQL = f"""hv AS ({NBR_SQL}),
p AS (SELECT hub_id AS vec_id, CAST(CAST(hub_id AS BIGINT) % 3 AS INTEGER) AS label,
      [nbr_total_outgoing_flow, nbr_avg_segment_delay, nbr_std_delay] AS x FROM hv)"""


def _hub_vectors(spark, sf_dir):
    from hubflow.operators.embed import neighbour_mean
    from hubflow.session import cut_lineage
    z, edges = _embed_graph(spark, sf_dir)
    n = neighbour_mean(z, edges, NODE_COLS)
    return cut_lineage(n.select("hub_id", (F.col("hub_id").cast("bigint") % 3).cast("int").alias("label"),
                                F.array(*[F.col(f"nbr_{c}") for c in NODE_COLS]).alias("embedding")))


@register("poor_fit_hubs", doubles=("silhouette", "avg_segment_delay"), ops="C6 J8 J9",
          sql=f"""WITH {HUB_VEC_SQL}, {VEC_STATS_SQL}, {SIL_CTES_SQL},
{S.journeys_cte()}, {S.hub_kpis_cte()}
SELECT vec_id AS hub_id, label AS cluster_label, silhouette, total_outgoing_flow, avg_segment_delay
FROM sil LEFT JOIN kpis ON sil.vec_id = kpis.hub_id WHERE silhouette < 0.1""")
def q_poor_fit_hubs(spark, sf_dir):
    """Hubs that fit their cluster badly, with flow and delay."""
    from hubflow.operators.flow import poor_fit_hubs
    kp = K.hub_kpis(journeys_long(spark, sf_dir, "supplier"), sort=False)
    return poor_fit_hubs(_hub_vectors(spark, sf_dir), kp)


@register("similar_hubs", doubles=("similarity",), ops="C10 O5", sql=f"""WITH {HUB_VEC_SQL},
s AS (SELECT a.vec_id AS target_id, b.vec_id AS similar_id,
        round(list_cosine_similarity(a.x, b.x), 9) AS similarity
      FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.label = 0),
r AS (SELECT target_id, max(similarity) AS similarity FROM s GROUP BY target_id)
SELECT * FROM r""")
def q_similar_hubs(spark, sf_dir):
    """Best cosine neighbour's similarity of every third hub (text ids)."""
    from hubflow.operators.cluster import similar_vectors
    v = _hub_vectors(spark, sf_dir)
    return similar_vectors(v, v.filter("label = 0").select("hub_id"), top_k=1, key="hub_id").select(
        "target_id", "similarity")


@register("negative_edges", ops="G9")
def q_negative_edges(spark, sf_dir):
    """Seeded sample of min(E, 2N) non-edges of the supplier-hub graph."""
    from hubflow.operators.embed import negative_edges
    z, edges = _embed_graph(spark, sf_dir)
    return negative_edges(z, edges, seed=42)


@register("negative_edges_check", ops="G9", sql=f"""
WITH {S.transits_ctes(variants=('embed',))},
e AS (SELECT DISTINCT src, dst FROM t_embed),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT least((SELECT count(*) FROM e), 2 * (SELECT count(*) FROM n),
             (SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1) - (SELECT count(*) FROM e)) AS pairs,
       CAST(0 AS BIGINT) AS self_pairs, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS edges_drawn""")
def q_negative_edges_check(spark, sf_dir):
    """Size of the negative sample and what must not be in it."""
    from hubflow.operators.embed import negative_edges
    from hubflow.session import cut_lineage
    z, edges = _embed_graph(spark, sf_dir)
    edges = cut_lineage(edges)
    pairs = cut_lineage(negative_edges(z, edges, seed=42))
    drawn = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").count()
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("src") == F.col("dst")).alias("self_pairs"),
                     (F.count("*") - F.count_distinct("src", "dst")).alias("repeated")
                     ).withColumn("edges_drawn", F.lit(drawn).cast("bigint"))


@register("link_embedding", ops="G8 G9 G10 G12")
def q_link_embedding(spark, sf_dir):
    """16-d hub embeddings from link prediction on the supplier-hub graph."""
    from hubflow.operators.embed import link_embedding
    z, edges = _embed_graph(spark, sf_dir)
    emb, _ = link_embedding(z, edges, NODE_COLS, dim=16, hops=5)
    return emb


@register("contrastive_embedding", ops="G11 G12")
def q_contrastive_embedding(spark, sf_dir):
    """16-d hub embeddings from the true-versus-permuted contrastive task."""
    from hubflow.operators.embed import contrastive_embedding
    z, edges = _embed_graph(spark, sf_dir)
    emb, _ = contrastive_embedding(z, edges, NODE_COLS, dim=16, hops=5)
    return emb


# ------------------------------------------------ models (rows-only checks)
def _features(spark, sf_dir):
    from hubflow.operators.journeys import transits
    from hubflow.operators.predict import delay_features
    long_df = journeys_long(spark, sf_dir, "supplier")
    return delay_features(transits(long_df, "predict"), K.hub_kpis(long_df, sort=False))


def _fitted(spark, sf_dir, model_type, **kw):
    from hubflow.operators.predict import fit_delay_model
    from hubflow.session import cut_lineage
    f = cut_lineage(_features(spark, sf_dir))
    return fit_delay_model(f, model_type, **kw), f


@register("gbt_delay", ops="M4 M6")
def q_gbt_delay(spark, sf_dir):
    """GBT (150 x depth 5) delay model: MAE and R^2 on the test legs."""
    from hubflow.operators.predict import evaluate
    model, f = _fitted(spark, sf_dir, "gradient_boosting")
    return evaluate(model, f, "gradient_boosting")


@register("rf_delay", ops="M5 M6")
def q_rf_delay(spark, sf_dir):
    """Random forest (150 trees, depth 12) delay model: MAE and R^2 on the test legs."""
    from hubflow.operators.predict import evaluate
    model, f = _fitted(spark, sf_dir, "random_forest", max_depth=12)
    return evaluate(model, f, "random_forest")


@register("feature_importance", ops="M7 O4")
def q_feature_importance(spark, sf_dir):
    """GBT feature importances, largest first."""
    from hubflow.operators.predict import feature_importance
    model, _ = _fitted(spark, sf_dir, "gradient_boosting")
    return feature_importance(model)


@register("kmeans_best_k", ops="C1")
def q_kmeans_best_k(spark, sf_dir):
    """Inertia and silhouette for k = 2..8; best k flagged."""
    from hubflow.operators.cluster import kmeans_best_k
    return kmeans_best_k(_vectors(spark, sf_dir), max_k=8, n_init=10)


@register("kmeans_choose_k", ops="C1")
def q_kmeans_choose_k(spark, sf_dir):
    """Inertia and Euclidean silhouette for k = 2..10, fitted on one coreset and
    scored on all vectors; best k flagged."""
    from hubflow.operators.coreset import choose_k
    return choose_k(_vectors(spark, sf_dir)).scores


def _flow(spark, sf_dir):
    from hubflow.operators.flow import hub_flow
    return hub_flow(journeys_long(spark, sf_dir, "supplier"))


@register("flow_clustered", ops="C2 J5 (whole flow)")
def q_flow_clustered(spark, sf_dir):
    """Hub KPIs with the cluster that the whole flow gives each hub."""
    return _flow(spark, sf_dir)["clustered"]


@register("flow_interpretation", ops="C5 A16 (whole flow)")
def q_flow_interpretation(spark, sf_dir):
    """Business type and recommendation of the whole flow's clusters."""
    return _flow(spark, sf_dir)["interpretation"]


@register("kmeans_clusters", ops="C2")
def q_kmeans_clusters(spark, sf_dir):
    """KMeans (k=10, best of 20 starts) cluster of every vector."""
    from hubflow.operators.cluster import kmeans_clusters
    return kmeans_clusters(_vectors(spark, sf_dir), k=10, n_init=20)


@register("pca_2d", ops="C9")
def q_pca_2d(spark, sf_dir):
    """2-component PCA of the centred vectors, with label."""
    from hubflow.operators.cluster import pca_2d
    return pca_2d(_vectors(spark, sf_dir))


# ------------------------------------------------------- chart data extras
@register("network_drawing", ops="X8 G7 G3",
          doubles=("avg_delay", "weight", "src_size", "dst_size"),
          sql=f"""WITH RECURSIVE {NATION_EDGES_SQL}, {_apsp_sql(unit=True)}
SELECT re.src, re.dst, re.avg_delay, re.volume, re.weight,
       10 + 100 * s.centrality AS src_size, 10 + 100 * d.centrality AS dst_size
FROM re LEFT JOIN bc s ON re.src = s.hub_id LEFT JOIN bc d ON re.dst = d.hub_id""")
def q_network_drawing(spark, sf_dir):
    """Router edges with node sizes 10 + 100 x hop-count betweenness."""
    from hubflow.operators.network import network_drawing
    from hubflow.operators.paths import betweenness
    e = _nation_router(spark, sf_dir)
    bc = betweenness(e, weight=None)
    return network_drawing(e, bc).select("src", "dst", "avg_delay", "volume", "weight",
                                         "src_size", "dst_size")


@register("kde_curve", ops="E4", doubles=("x", "kernel_mean", "bandwidth"), sql=f"""
WITH {S.journeys_cte()},
b AS (SELECT column_name, CAST(x AS DOUBLE) AS x FROM
        (SELECT planned_mins, effective_mins, delay_mins FROM journeys) j
        UNPIVOT (x FOR column_name IN (planned_mins, effective_mins, delay_mins))),
st AS (SELECT column_name, min(x) AS lo, max(x) AS hi, count(x) AS n,
              stddev_samp(x) * power(CAST(count(x) AS DOUBLE), -0.2) AS bw FROM b GROUP BY column_name),
g AS (SELECT column_name, CAST(i AS INTEGER) AS grid_index, lo + (hi - lo) * i / 63 AS pos, bw, n
      FROM st, range(64) t(i))
SELECT g.column_name, grid_index, pos AS x,
       sum(exp(-0.5 * power((b.x - pos) / bw, 2))) / n AS kernel_mean, bw AS bandwidth
FROM g JOIN b ON g.column_name = b.column_name GROUP BY g.column_name, grid_index, pos, bw, n""")
def q_kde_curve(spark, sf_dir):
    """Gaussian KDE of every numeric milestone column on a 64-point grid."""
    from hubflow.operators.eda import kde_curves
    return kde_curves(*_eda_input(spark, sf_dir)).select(
        "column_name", "grid_index", "x", "kernel_mean", "bandwidth")


@register("kde_binned_inside", ops="E4", sql="""SELECT column_name, CAST(i AS INTEGER) AS grid_index, true AS inside
FROM (VALUES ('planned_mins'), ('effective_mins'), ('delay_mins')) c(column_name), range(64) t(i)""")
def q_kde_binned_inside(spark, sf_dir):
    """Whether the binned kernel densities are within their stated error of the exact ones."""
    from hubflow.operators.eda import kde_curves, kde_curves_binned
    df, cols = _eda_input(spark, sf_dir)
    exact = kde_curves(df, cols).select("column_name", "grid_index", F.col("kernel_mean").alias("exact"))
    return kde_curves_binned(df, cols, error=1e-5).join(exact, ["column_name", "grid_index"]).select(
        "column_name", "grid_index", (F.abs(F.col("kernel_mean") - F.col("exact")) <= 1.01e-5).alias("inside"))


@register("stage_delay_histogram", ops="X4", doubles=("bin_start", "bin_end"), sql=f"""
WITH {S.journeys_cte()},
lv AS (SELECT stage_group, CAST(delay_mins AS DOUBLE) AS value FROM journeys
       WHERE delay_mins IS NOT NULL),
rng AS (SELECT stage_group, min(value) AS lo, max(value) AS hi FROM lv GROUP BY stage_group),
b AS (SELECT lv.stage_group, lo, hi, {_bin_sql('value', 'lo', 'hi', 30)} AS bin
      FROM lv JOIN rng ON lv.stage_group = rng.stage_group)
SELECT stage_group, bin, lo + bin * (hi - lo) / 30 AS bin_start,
       lo + (bin + 1) * (hi - lo) / 30 AS bin_end, count(*) AS count
FROM b GROUP BY stage_group, bin, lo, hi""")
def q_stage_delay_histogram(spark, sf_dir):
    """30-bin delay histogram per stage (violin data)."""
    from hubflow.operators.eda import stage_delay_histogram
    return stage_delay_histogram(journeys_long(spark, sf_dir, "supplier"))


@register("embedding_loss", ops="G12")
def q_embedding_loss(spark, sf_dir):
    """Objective history of the link-prediction embedding fit."""
    from hubflow.operators.embed import link_embedding
    z, edges = _embed_graph(spark, sf_dir)
    _, loss = link_embedding(z, edges, NODE_COLS, dim=16, hops=5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(loss)],
                                 "iteration int, loss double")


# ------------------------------------------------ source-compatible variant
def _compat_sql():
    from hubflow.plans import widesql as W
    return (f"WITH {W.raw_wide_sql()}, {W.clean_wide_sql(compat=True)}, "
            f"{W.unpivot_sql(compat=True)}, {S.hub_kpis_cte(src='unpiv')} SELECT * FROM kpis")


@register("hub_kpis_compat", doubles=KPI_DOUBLES, ops="Q1 Q3 compat: P2 U1 A1", sql=_compat_sql())
def q_hub_kpis_compat(spark, sf_dir):
    """Hub KPIs through the raw wide path with the source's quirks reproduced
    (duplicate IN_2 hub column dropped, DLV hubs split as 'x.0')."""
    from hubflow.operators.clean import clean_wide
    from hubflow.operators.journeys import unpivot_long
    c = clean_wide(_raw_wide(spark, sf_dir), compat=True)
    return K.hub_kpis(unpivot_long(c, compat=True))
