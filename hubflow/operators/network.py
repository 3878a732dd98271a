"""Edge tables and graph-shaped outputs built from transits.

A3/G1 embed graph, A4/G3 cost-weighted router graph, A15 node list, G13
counts, J1 node features, G2 standardisation, A6/X2 flow paths and Sankey
nodes, X8 network drawing data. All are ``groupBy``/``join`` plans: edges
shuffle once on ``(src, dst)`` with map-side partial aggregation, so a hot
route is pre-aggregated per task before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def embed_edges(t_embed: DataFrame) -> DataFrame:
    """A3: per directed hub pair, movement count and mean delay (V1 input)."""
    return t_embed.groupBy("src", "dst").agg(
        F.count("leg_id").alias("flow_volume"),
        F.avg("delay_mins").alias("avg_delay"))


def router_edges(t_router: DataFrame, min_weight: float = 0.1,
                 delay_coef: float = 1.0, std_coef: float = 0.5,
                 volume_coef: float = 50.0) -> DataFrame:
    """A4 + G3: route statistics and the composite cost weight

    ``weight = max(0.1, avg_delay + 0.5*std_delay + 50/(volume+1))``,
    std of a single movement counted as 0.
    """
    e = t_router.groupBy("src", "dst").agg(
        F.avg("delay_mins").alias("avg_delay"),
        F.count("leg_id").alias("volume"),
        F.coalesce(F.stddev_samp("delay_mins"), F.lit(0.0)).alias("std_delay"))
    w = (F.col("avg_delay") * delay_coef + F.col("std_delay") * std_coef
         + F.lit(volume_coef) / (F.col("volume") + 1))
    return e.withColumn("weight", F.greatest(F.lit(min_weight), w))


def edge_volumes(successors: DataFrame, variants=("embed", "router")) -> DataFrame:
    """Several edge variants in ONE pass over the successor table:
    per ``(src, dst)`` the movement count of each variant (``n_<variant>``),
    with map-side partial aggregation. Filter ``n_<variant> > 0`` to get
    that variant's edge set."""
    from hubflow.operators.journeys import variant_condition
    from hubflow.functions.columns import stage_column
    stage = stage_column(successors)
    conds = {v: variant_condition(v, stage) for v in variants}
    any_v = None
    for c in conds.values():
        any_v = c if any_v is None else any_v | c
    return successors.filter(any_v).groupBy("src", "dst").agg(
        *[F.count(F.when(c, F.lit(1))).alias(f"n_{v}") for v, c in conds.items()])


def with_reverse_edges(edges: DataFrame) -> DataFrame:
    """G1 ``include_reverse_edges``: add every edge flipped (attributes kept)."""
    flipped = edges.withColumnRenamed("src", "_d").withColumnRenamed("dst", "src") \
        .withColumnRenamed("_d", "dst").select(*edges.columns)
    return edges.unionByName(flipped)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct hubs at either end of an edge (NULL ends excluded)."""
    ends = edges.select(F.col("src").alias("hub_id")).union(edges.select(F.col("dst").alias("hub_id")))
    return ends.filter(F.col("hub_id").isNotNull()).distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    """Node and edge counts of an edge table as one row.

    Both counts are global aggregates of already-aggregated tables,
    combined as scalar subqueries (no join)."""
    n_nodes = graph_nodes(edges).select(F.count("*")).scalar()
    n_edges = edges.select(F.count("*")).scalar()
    return edges.sparkSession.range(1).select(
        n_nodes.alias("n_nodes"), n_edges.alias("n_edges"))


def node_features(nodes: DataFrame, kpis: DataFrame) -> DataFrame:
    """Graph nodes with (flow, mean delay, std delay) KPIs, missing -> 0."""
    k = kpis.select("hub_id", "total_outgoing_flow", "avg_segment_delay", "std_delay")
    return nodes.join(k, "hub_id", "left").na.fill(
        0, subset=["total_outgoing_flow", "avg_segment_delay", "std_delay"])


def standardise(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Z-score with the population std; a zero-variance column divides by 1.

    The table is written once; means and stds are one distributed
    aggregation over it (2 x len(cols) numbers reach the driver)."""
    from hubflow.session import cut_lineage
    out = cut_lineage(df)
    m = out.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                  for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        mu = m[f"m{i}"] if m[f"m{i}"] is not None else 0.0
        sd = m[f"s{i}"] if m[f"s{i}"] else 1.0
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd))
    return out


def flow_paths(t_flow: DataFrame, top_n: int | None = 15) -> DataFrame:
    """A6 (+O3): movement count and mean delay per hub pair over all stages,
    the ``top_n`` busiest pairs (ties broken by the pair ids)."""
    p = t_flow.groupBy("src", "dst").agg(
        F.count("leg_id").alias("flow_count"),
        F.avg("delay_mins").alias("avg_delay"))
    if top_n is None:
        return p
    return p.orderBy(F.desc("flow_count"), "src", "dst").limit(top_n)


def sankey_nodes(top_paths: DataFrame) -> DataFrame:
    """Set union of the ends of the top paths, with a dense index."""
    nodes = graph_nodes(top_paths)
    return nodes.withColumn("node_index",
                            F.row_number().over(Window.orderBy("hub_id")).cast("int") - 1)


def network_drawing(edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """Router edges with both ends' node size ``10 + 100 * centrality``."""
    size = centrality.select("hub_id", (10 + 100 * F.col("centrality")).alias("node_size"))
    s = size.withColumnRenamed("hub_id", "src").withColumnRenamed("node_size", "src_size")
    d = size.withColumnRenamed("hub_id", "dst").withColumnRenamed("node_size", "dst_size")
    return edges.join(s, "src", "left").join(d, "dst", "left")
