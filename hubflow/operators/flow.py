"""The whole analysis as one flow: milestones to labelled, interpreted hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.operators import cluster as C
from hubflow.operators.coreset import choose_k, label_points
from hubflow.operators.embed import link_embedding
from hubflow.operators.journeys import transits, written_successors
from hubflow.operators.kpis import hub_kpis
from hubflow.operators.network import embed_edges, graph_nodes, node_features, standardise
from hubflow.operators.silhouette import euclidean_samples
from hubflow.session import cut_lineage, drop_tables

NODE_COLS = ["total_outgoing_flow", "avg_segment_delay", "std_delay"]


def poor_fit_hubs(points: DataFrame, kpis: DataFrame, threshold: float = 0.1,
                  label: str = "label", vec: str = "embedding", euclidean: bool = False) -> DataFrame:
    """C6 + J9: hubs whose silhouette is below ``threshold``, worst first, with
    their flow and mean delay (NULL for hubs without KPIs). ``euclidean`` takes
    the Euclidean form instead of the squared one."""
    samples = euclidean_samples if euclidean else C.silhouette_samples
    poor = samples(points, label=label, vec=vec, key="hub_id").filter(F.col("silhouette") < threshold)
    k = kpis.select("hub_id", "total_outgoing_flow", "avg_segment_delay")
    return (poor.join(k, "hub_id", "left")
            .select("hub_id", F.col("label").alias("cluster_label"), "silhouette",
                    "total_outgoing_flow", "avg_segment_delay")
            .orderBy("silhouette", "hub_id"))


def hub_flow(long_df: DataFrame, dim: int = 16, hops: int = 5, max_k: int = 10,
             n_init: int = 10, seed: int = 42, poor_fit: float = 0.1) -> dict[str, DataFrame]:
    """KPIs, hub embeddings, KMeans with the k of the best Euclidean silhouette
    (fits on one coreset, scores on all hubs), labels joined to the KPIs, and
    the reports on them.

    Returns ``kpis``, ``embeddings``, ``loss``, ``choice`` (scores per k),
    ``labels``, ``clustered``, ``interpretation``, ``boundary`` (by the fitted
    centres) and ``poor_fit``.
    """
    lines = written_successors(long_df)
    kpis = cut_lineage(hub_kpis(lines, sort=False))
    edges = cut_lineage(embed_edges(transits(None, "embed", successors=lines)))
    drop_tables(lines)
    nodes = standardise(node_features(graph_nodes(edges), kpis), NODE_COLS)
    embeddings, loss = link_embedding(nodes, edges, NODE_COLS, dim=dim, hops=hops, seed=seed)
    embeddings = cut_lineage(embeddings)
    choice = choose_k(embeddings, max_k=max_k, n_init=n_init, seed=seed, key="hub_id")
    if choice.best is None:                       # fewer than two different hubs
        labels = cut_lineage(embeddings.select("hub_id", F.lit(0).alias("cluster_label")))
        found = []
    else:
        k = choice.best
        labels = cut_lineage(label_points(embeddings, {k: choice.centres[k]}, key="hub_id").select(
            "hub_id", F.col(f"k{k}").alias("cluster_label")))
        found = [(i, [float(x) for x in c]) for i, c in enumerate(choice.centres[k])]
    centres = embeddings.sparkSession.createDataFrame(found, "label int, centroid array<double>")
    points = embeddings.join(labels.withColumnRenamed("cluster_label", "label"), "hub_id")
    clustered = C.attach_clusters(kpis, labels)
    return {"kpis": kpis, "embeddings": embeddings, "loss": loss, "choice": choice.scores, "labels": labels,
            "clustered": clustered, "interpretation": C.cluster_interpretation(clustered),
            "boundary": C.boundary_points(points, centres, key="hub_id"),
            "poor_fit": poor_fit_hubs(points, kpis, poor_fit, euclidean=True)}
