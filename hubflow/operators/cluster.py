"""Cluster quality and embedding analysis.

Vectors are ``ARRAY<DOUBLE>`` columns. Per-cluster state (counts, vector
sums, centroids) is k rows of d numbers; it reaches every point as one
scalar-subquery array (no join, no pairs): each point then scores itself
against the k clusters with higher-order array functions in the JVM. The
silhouette is the squared-Euclidean form (Spark's ``ClusteringEvaluator``),
which decomposes exactly into those per-cluster sums, so the work is
O(n * k) instead of the O(n^2) point pairs of the Euclidean form.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubflow.operators.neighbours import best_rows

# --- fixed values: cluster business types and recommendations ---
CLUSTER_TYPES = [
    ("CRITICAL BOTTLENECK - High volume with delays",
     "Priority 1: Urgent capacity expansion or process optimization needed"),
    ("EFFICIENT MAJOR HUB - High volume, well-performing",
     "Monitor closely and replicate best practices"),
    ("INEFFICIENT SMALL HUB - Low volume but problematic",
     "Investigate operational issues or consider consolidation"),
    ("STANDARD HUB - Low volume, acceptable performance",
     "Standard operations, routine monitoring"),
]
# --- end of fixed values ---


def as_vector(col: str) -> F.Column:
    return F.col(col).cast("array<double>")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sqnorm(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def _vec_sum(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Per-cluster element-wise vector sum via ``posexplode`` + ``groupBy``
    (partial aggregation; a hot cluster is summed per task first)."""
    e = vectors.select(key, F.posexplode(vec).alias("pos", "v"))
    s = e.groupBy(key, "pos").agg(F.sum("v").alias("v"))
    return s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("sv")) \
        .select(key, F.transform("sv", lambda x: x["v"]).alias("vsum"))


def cluster_stats(points: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """k rows: ``label, n, vsum, sqsum, centroid`` (d numbers per row)."""
    p = points.select(F.col(label).alias("label"), as_vector(vec).alias("x")) \
        .filter(F.col("label").isNotNull())
    cnt = p.groupBy("label").agg(F.count("*").alias("n"),
                                 F.sum(_sqnorm(F.col("x"))).alias("sqsum"))
    vs = _vec_sum(p, "label", "x")
    st = cnt.join(vs, "label")
    return st.withColumn("centroid", F.transform("vsum", lambda v: v / F.col("n")))


MAX_CLUSTERS = 10_000  # clusters whose k x d state is shipped to a task at once


def checked_stats(points: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``cluster_stats`` written once (k rows) and size-checked: the per-point
    scoring ships all k rows to every task, so k must stay bounded."""
    from hubflow.session import cut_lineage
    stats = cut_lineage(cluster_stats(points, label, vec))
    k = stats.count()
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} clusters exceed MAX_CLUSTERS={MAX_CLUSTERS}")
    return stats


def _stats_array(stats: DataFrame):
    """All k cluster rows as one array value (scalar subquery)."""
    return stats.select(F.collect_list(F.struct("label", "n", "vsum", "sqsum", "centroid"))).scalar()


def silhouette_samples(points: DataFrame, label: str = "label", vec: str = "embedding",
                       key: str = "vec_id") -> DataFrame:
    """C3 (per point): squared-Euclidean silhouette.

    Mean squared distance from x to cluster C is
    ``(n_C |x|^2 - 2 x.S_C + Q_C) / n_C`` (own cluster: divided by n_C - 1);
    ``s = (b - a) / max(a, b)``, 0 for a singleton cluster."""
    from hubflow.session import cut_lineage
    stats = cut_lineage(cluster_stats(points, label, vec))
    blocks = max(1, -(-stats.count() // MAX_CLUSTERS))
    p = points.select(key, F.col(label).alias("label"), as_vector(vec).alias("x")) \
        .filter(F.col("label").isNotNull())
    if blocks == 1:
        found = _against(p, stats)
    else:
        # more clusters than a task should hold: every block of them scores all
        # points, and the parts are put together per row
        p = cut_lineage(p.withColumn("_row", F.monotonically_increasing_id()))
        dealt = cut_lineage(stats.withColumn("_blk", F.pmod(F.xxhash64("label"), F.lit(blocks))))
        found = None
        for k in range(blocks):
            part = _against(p, dealt.filter(F.col("_blk") == k))
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("_row", key, "label").agg(
            F.max("own_n").alias("own_n"), F.max("a").alias("a"), F.min("b").alias("b"))
    s = F.when(F.col("own_n") <= 1, F.lit(0.0)).when(F.col("b").isNull(), F.lit(0.0)) \
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return found.select(key, "label", F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def _against(p: DataFrame, stats: DataFrame) -> DataFrame:
    """Every point's mean squared distance to its own cluster (``a``, with the
    cluster's size) and the least to another (``b``), of the clusters in ``stats``."""
    arr = _stats_array(stats)
    scored = p.withColumn("x2", _sqnorm(F.col("x"))).withColumn("cl", arr)
    d = F.transform("cl", lambda c: F.struct(
        c["label"].alias("label"), c["n"].alias("n"),
        (c["n"] * F.col("x2") - 2 * _dot(F.col("x"), c["vsum"]) + c["sqsum"]).alias("tot")))
    scored = scored.withColumn("d", d)
    own = F.get(F.filter("d", lambda s: s["label"] == F.col("label")), F.lit(0))
    others = F.filter("d", lambda s: s["label"] != F.col("label"))
    return scored.select(*[c for c in p.columns if c != "x"], own["n"].alias("own_n"),
                         F.when(own["n"] > 1, own["tot"] / (own["n"] - 1)).alias("a"),
                         F.array_min(F.transform(others, lambda s: s["tot"] / s["n"])).alias("b"))


def silhouette_score(points: DataFrame, **kw) -> DataFrame:
    """Mean silhouette as one row."""
    return silhouette_samples(points, **kw).agg(F.avg("silhouette").alias("silhouette"))


def poor_fit_points(points: DataFrame, threshold: float = 0.1, **kw) -> DataFrame:
    """Points whose silhouette is below ``threshold``, worst first."""
    s = silhouette_samples(points, **kw)
    return s.filter(F.col("silhouette") < threshold).orderBy("silhouette", kw.get("key", "vec_id"))


def _dist(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, v: acc + v))


def davies_bouldin(points: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """C4: Davies-Bouldin index with Euclidean distances.

    ``S_i`` = mean distance of cluster i's points to its centroid (one pass
    over the points); then over the k centroids ``max_j (S_i+S_j)/d_ij``,
    averaged. The centroid array reaches each point as a scalar subquery."""
    stats = checked_stats(points, label, vec)
    cents = stats.select(F.collect_list(F.struct("label", "centroid"))).scalar()
    p = points.select(F.col(label).alias("label"), as_vector(vec).alias("x")) \
        .filter(F.col("label").isNotNull())
    own = F.filter("cents", lambda c: c["label"] == F.col("label"))[0]["centroid"]
    spread = p.withColumn("cents", cents).withColumn("dd", _dist(F.col("x"), own)).groupBy("label") \
        .agg(F.avg("dd").alias("s"))
    sc = stats.join(spread, "label").select("label", "centroid", "s")
    allc = sc.select(F.collect_list(F.struct("label", "centroid", "s"))).scalar()
    others = F.filter("allc", lambda c: c["label"] != F.col("label"))
    ratio = F.array_max(F.transform(
        others, lambda c: (F.col("s") + c["s"]) / _dist(F.col("centroid"), c["centroid"])))
    return sc.withColumn("allc", allc).select(F.coalesce(ratio, F.lit(0.0)).alias("r")).agg(
        F.avg("r").alias("davies_bouldin"))


def boundary_points(points: DataFrame, centres: DataFrame | None = None, ratio: float = 0.85,
                    label: str = "label", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """C7 + W4: nearest / second-nearest centre distance ratio; rows above
    ``ratio`` are boundary points. ``centres`` (label, centroid) defaults to
    the label means; pass a fitted model's centres to reuse it."""
    if centres is None:
        centres = checked_stats(points, label, vec).select("label", "centroid")
    arr = centres.select(F.collect_list("centroid")).scalar()
    p = points.select(key, F.col(label).alias("assigned_cluster"), as_vector(vec).alias("x"))
    d = F.sort_array(F.transform("cents", lambda c: _dist(F.col("x"), c)))
    m = p.withColumn("cents", arr).withColumn("d", d).withColumn(
        "margin_ratio", F.when(F.size("d") >= 2, F.col("d")[0] / F.col("d")[1]))
    return m.filter(F.col("margin_ratio") > ratio).select(key, "margin_ratio", "assigned_cluster") \
        .orderBy(F.desc("margin_ratio"), key)


def dim_variance(points: DataFrame, vec: str = "embedding") -> DataFrame:
    """Population variance per embedding dimension, largest first."""
    e = points.select(F.posexplode(as_vector(vec)).alias("dimension", "v"))
    return e.groupBy("dimension").agg(F.var_pop("v").alias("variance")) \
        .orderBy(F.desc("variance"), "dimension")


def similar_vectors(points: DataFrame, targets: DataFrame, top_k: int = 5,
                    vec: str = "embedding", key: str = "vec_id",
                    block: int = 10_000) -> DataFrame:
    """For each target id, the ``top_k`` most cosine-similar other points.

    Ids may be of any type and keep it. Targets are taken in blocks of
    ``block`` rows, each captured in a task closure, so any number of them
    works: one pass over the points per block. Each partition computes its
    local top-k per target with one matrix product (``mapInPandas``, Arrow
    batches); only k x targets rows per partition are shuffled for the final
    per-target ranking, so no target ever gathers all candidates in one task.
    Unknown targets give no rows."""
    from hubflow.functions.ranking import row_index
    numbered = row_index(targets.select(key).distinct().join(
        points.select(key, as_vector(vec).alias("tx")), key), [F.col(key)], "_i")
    n = numbered.count()
    parts = [_similar_to(points, [(r[key], r["tx"]) for r in numbered.filter(
        (F.col("_i") >= lo) & (F.col("_i") < lo + block)).select(key, "tx").collect()], top_k, vec, key)
        for lo in range(0, max(n, 1), block)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _similar_to(points: DataFrame, tv: list[tuple], top_k: int, vec: str, key: str) -> DataFrame:
    kind = points.schema[key].dataType
    out_schema = T.StructType([
        T.StructField("target_id", kind), T.StructField("similar_id", kind),
        T.StructField("similarity", T.DoubleType())])
    if not tv:
        return points.sparkSession.createDataFrame([], out_schema).withColumn("rank", F.lit(1))
    tids = [t for t, _ in tv]
    tmat = np.array([np.asarray(x, dtype=float) for _, x in tv])
    tn = np.linalg.norm(tmat, axis=1)
    tmat = tmat / np.where(tn == 0, 1, tn)[:, None]
    cand = points.select(F.col(key).alias("cid"), as_vector(vec).alias("cx"))

    tarr = np.array(tids)

    def local_topk(batches):
        parts = []
        for pdf in batches:
            step = max(1, STRIPE // len(tids))
            for lo in range(0, len(pdf), step):
                some = pdf.iloc[lo:lo + step]
                cm = np.stack([np.asarray(v, dtype=float) for v in some["cx"]])
                cn = np.linalg.norm(cm, axis=1)
                sims = tmat @ (cm / np.where(cn == 0, 1, cn)[:, None]).T
                cids = np.array(some["cid"].tolist())
                names, order = np.unique(cids, return_inverse=True)
                # a target is no neighbour of its own: one place per target at most
                at = np.minimum(np.searchsorted(names, tarr), len(names) - 1)
                sims[(order[None, :] == at[:, None]) & (names[at] == tarr)[:, None]] = -np.inf
                row, col = best_rows(sims, order, top_k)
                parts.append(pd.DataFrame({"target_id": tarr[row], "similar_id": cids[col],
                                           "similarity": sims[row, col]}))
                if sum(map(len, parts)) > 4 * top_k * len(tids):
                    parts = [_trim(pd.concat(parts), top_k)]
        if parts:
            yield _trim(pd.concat(parts), top_k)

    local = cand.mapInPandas(local_topk, out_schema)
    w = Window.partitionBy("target_id").orderBy(F.desc("similarity"), "similar_id")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


STRIPE = 1 << 21    # similarities held at once


def _trim(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["target_id", "similarity", "similar_id"],
                          ascending=[True, False, True])
    return pdf.groupby("target_id", sort=False).head(k)


def pca_2d(points: DataFrame, vec: str = "embedding", key: str = "vec_id",
           label: str | None = "label") -> DataFrame:
    """2-component PCA of mean-centred vectors (Spark ML ``PCA`` does not
    centre at transform). Component signs are fixed so the largest-magnitude
    loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    stats = points.select(as_vector(vec).alias("x"))
    d = len(points.select(as_vector(vec)).first()[0])
    mean = stats.select(F.array(*[F.avg(F.col("x")[i]) for i in range(d)])).scalar()
    keep = [key] + ([label] if label else [])
    c = points.select(*keep, as_vector(vec).alias("x")).withColumn("mu", mean)
    c = c.select(*keep, F.zip_with("x", "mu", lambda a, m: a - m).alias("xc"))
    c = c.withColumn("features", array_to_vector("xc"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(c)
    pcm = model.pc.toArray()
    signs = [1.0 if pcm[np.argmax(np.abs(pcm[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(c).withColumn("pca", vector_to_array("pc"))
    return out.select(*keep, (F.col("pca")[0] * signs[0]).alias("pc1"),
                      (F.col("pca")[1] * signs[1]).alias("pc2"))


# ------------------------------------------------------------ KMeans
def _features(points: DataFrame, vec: str):
    from pyspark.ml.functions import array_to_vector
    return points.withColumn("features", array_to_vector(as_vector(vec)))


STEP = 1 << 17       # distances of a Lloyd step held at once
MOVED = 1e-4         # a fit has converged when no centre moves farther (Spark's default)


@dataclass
class KMeansFit:
    """Centres of a fit and the cost of its last assignment."""
    centres: np.ndarray
    summary: SimpleNamespace

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def _starts(points: DataFrame, todo: list[tuple[int, int]], vec: str, parallelism: int) -> list[np.ndarray]:
    """Spark's k-means|| centres for every (k, seed)."""
    from pyspark.ml.clustering import KMeans
    from concurrent.futures import ThreadPoolExecutor
    feats = _features(points, vec).persist()

    def start(job):
        k, seed = job
        m = KMeans(k=k, seed=seed, maxIter=0, featuresCol="features", predictionCol="cluster").fit(feats)
        return np.array(m.clusterCenters())

    # starts are independent Spark jobs: submit them concurrently, as
    # spark.ml's own tuning does with its ``parallelism`` parameter
    with ThreadPoolExecutor(max_workers=max(1, min(len(todo), parallelism))) as ex:
        out = list(ex.map(start, todo))
    feats.unpersist()
    return out


def _assigned_sums(x: DataFrame, centres: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(cost, rows, sums) of the clusters of every set of centres, from one pass:
    a task returns one row, whose size follows the centres only."""
    dim = centres[0].shape[1]
    shift = centres[0][0]
    flat = np.concatenate(centres) - shift
    ends = np.cumsum([len(c) for c in centres])
    shared = x.sparkSession.sparkContext.broadcast((flat, ends, shift))

    def run(batches):
        flat, ends, shift = shared.value
        half = (flat * flat).sum(1) / 2
        cost, n, sums = np.zeros(len(ends)), np.zeros(len(flat)), np.zeros(flat.shape)
        for b in batches:
            rows = np.asarray(b.column("x").flatten(), dtype=float).reshape(-1, dim) - shift
            step = max(1, STEP // len(flat))
            for lo in range(0, len(rows), step):
                r = rows[lo:lo + step]
                d = half - r @ flat.T
                hot = np.zeros(d.shape)
                every, xx = np.arange(len(r)), (r * r).sum(1)
                for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                    at = start + d[:, start:end].argmin(1)
                    hot[every, at] = 1.0
                    cost[i] += np.maximum(xx + 2 * d[every, at], 0).sum()
                n += hot.sum(0)
                sums += hot.T @ r
        yield pa.record_batch([pa.array([np.concatenate([cost, n, sums.ravel()])], pa.list_(pa.float64()))], names=["s"])

    total = sum(np.array(r["s"]) for r in x.mapInArrow(run, "s array<double>").collect())
    shared.unpersist()
    cost, n, sums = np.split(total, [len(centres), len(centres) + len(flat)])
    sums = sums.reshape(flat.shape) + n[:, None] * shift
    return [(float(c), n[lo:hi], sums[lo:hi]) for c, lo, hi in zip(cost, [0, *ends[:-1]], ends)]


def kmeans_fits(points: DataFrame, ks: list[int], n_init: int = 10, seed: int = 42, vec: str = "embedding",
                max_iter: int = 300, parallelism: int = 8) -> dict[int, KMeansFit]:
    """KMeans for every k, each the best of ``n_init`` starts by training cost.

    Lloyd's steps on all rows. All fits that still move share a step's pass over
    the points, so there are as many passes as the longest fit has steps, not as
    all fits together have."""
    from hubflow.session import cut_lineage, drop_tables
    todo = [(k, seed + i) for k in ks for i in range(n_init)]
    centres = _starts(points, todo, vec, parallelism)
    costs = [0.0] * len(todo)
    table = cut_lineage(points.select(as_vector(vec).alias("x")))
    # few tasks keep what a pass sends to the driver small, however many files there are
    x = table.coalesce(4 * table.sparkSession.sparkContext.defaultParallelism)
    moving = list(range(len(todo)))
    for _ in range(max_iter):
        still = []
        for i, (cost, n, sums) in zip(moving, _assigned_sums(x, [centres[i] for i in moving])):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[i])
            if (((new - centres[i]) ** 2).sum(1) > MOVED ** 2).any():
                still.append(i)
            costs[i], centres[i] = cost, new
        moving = still
        if not moving:
            break
    drop_tables(table)
    best: dict[int, int] = {}
    for i, (k, _) in enumerate(todo):
        if k not in best or costs[i] < costs[best[k]]:
            best[k] = i
    return {k: KMeansFit(centres[i], SimpleNamespace(trainingCost=costs[i])) for k, i in best.items()}


def kmeans_fit(points: DataFrame, k: int, n_init: int = 10, seed: int = 42,
               vec: str = "embedding", max_iter: int = 300, parallelism: int = 8) -> KMeansFit:
    """KMeans with ``n_init`` restarts; keeps the lowest training cost."""
    return kmeans_fits(points, [k], n_init, seed, vec, max_iter, parallelism)[k]


def kmeans_best_k(points: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42,
                  vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For k = 2..max_k the inertia and squared-Euclidean silhouette; the
    first k with the best silhouette is flagged ``best``."""
    from hubflow.operators.coreset import label_points
    from hubflow.session import cut_lineage
    from pyspark.ml.evaluation import ClusteringEvaluator
    spark = points.sparkSession
    rows = []
    if max_k >= 2:
        fits = kmeans_fits(points, list(range(2, max_k + 1)), n_init, seed, vec)
        labelled = cut_lineage(label_points(points, {k: m.centres for k, m in fits.items()}, vec, key))
        feats = _features(labelled, vec)
        for k, m in fits.items():
            sil = ClusteringEvaluator(featuresCol="features", predictionCol=f"k{k}").evaluate(feats)
            rows.append((k, float(m.summary.trainingCost), float(sil)))
    best_k = max(rows, key=lambda r: (r[2], -r[0]))[0] if rows else None
    return spark.createDataFrame(
        [(k, c, s, k == best_k) for k, c, s in rows],
        "k int, inertia double, silhouette double, best boolean")


def kmeans_clusters(points: DataFrame, k: int, n_init: int = 20, seed: int = 42,
                    vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Cluster label per point from the best of ``n_init`` fits."""
    return assign_clusters(kmeans_fit(points, k, n_init, seed, vec), points, vec, key)


def assign_clusters(model: KMeansFit, points: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Cluster of every point under a fit."""
    from hubflow.operators.coreset import label_points
    return label_points(points, {0: model.centres}, vec, key).select(key, F.col("k0").alias("cluster"))


# --------------------------------------------------- hub cluster analysis
def attach_clusters(kpis: DataFrame, labels: DataFrame) -> DataFrame:
    """Hub KPIs left-joined with ``(hub_id, cluster_label)``; hubs
    without a label keep NULL (quirk Q10)."""
    return kpis.join(labels.select("hub_id", F.col("cluster_label").cast("int")), "hub_id", "left")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per cluster hub count, mean/total flow, mean of mean delay, mean std."""
    return clustered.filter(F.col("cluster_label").isNotNull()).groupBy("cluster_label").agg(
        F.count("*").alias("hub_count"),
        F.avg("total_outgoing_flow").alias("avg_flow"),
        F.sum("total_outgoing_flow").alias("total_flow"),
        F.avg("avg_segment_delay").alias("avg_delay"),
        F.avg("std_delay").alias("avg_std_delay"))


def cluster_interpretation(clustered: DataFrame) -> DataFrame:
    """C5 + A16: cluster stats, flow share of the network, and the 4-way
    business type by comparing the cluster's mean flow and mean delay with
    the network means (the hub table is written once; the network sums and
    means are one distributed aggregation over it)."""
    from hubflow.session import cut_lineage
    clustered = cut_lineage(clustered)
    tot = clustered.agg(F.sum("total_outgoing_flow"), F.avg("total_outgoing_flow"),
                        F.avg("avg_segment_delay")).first()
    net = clustered.withColumn("_tf", F.lit(tot[0])).withColumn("_af", F.lit(tot[1])) \
        .withColumn("_ad", F.lit(tot[2]))
    s = net.filter(F.col("cluster_label").isNotNull()).groupBy("cluster_label").agg(
        F.count("*").alias("hub_count"),
        F.avg("total_outgoing_flow").alias("avg_flow"),
        F.sum("total_outgoing_flow").alias("total_flow"),
        F.avg("avg_segment_delay").alias("avg_delay"),
        F.avg("std_delay").alias("avg_std_delay"),
        F.first("_tf").alias("_tf"), F.first("_af").alias("_af"), F.first("_ad").alias("_ad"))
    share = F.when(F.col("_tf") > 0, F.col("total_flow") / F.col("_tf") * 100) \
        .otherwise(F.lit(0.0))
    hi_f = F.col("avg_flow") > F.col("_af")
    hi_d = F.col("avg_delay") > F.col("_ad")

    def pick(i):
        return (F.when(hi_f & hi_d, CLUSTER_TYPES[0][i]).when(hi_f, CLUSTER_TYPES[1][i])
                .when(hi_d, CLUSTER_TYPES[2][i]).otherwise(CLUSTER_TYPES[3][i]))
    return s.withColumn("flow_share_pct", share).withColumn("cluster_type", pick(0)) \
        .withColumn("recommendation", pick(1)).drop("_tf", "_af", "_ad")


def cluster_top_hubs(clustered: DataFrame, n: int = 5, salts: int = 64) -> DataFrame:
    """The ``n`` busiest hubs of each cluster (ties by hub id).

    Two-stage top-n so a cluster holding most hubs is not ranked in one
    task: first per (cluster, hash salt of the hub), then per cluster over
    at most ``n * salts`` survivors."""
    order = [F.desc("total_outgoing_flow"), F.col("hub_id")]
    c = clustered.filter(F.col("cluster_label").isNotNull()).withColumn(
        "_salt", F.pmod(F.xxhash64("hub_id"), F.lit(salts)))
    w1 = Window.partitionBy("cluster_label", "_salt").orderBy(*order)
    c = c.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy("cluster_label").orderBy(*order)
    return c.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= n) \
        .select("cluster_label", "rank", "hub_id", "total_outgoing_flow", "avg_segment_delay")


def executive_table(clustered: DataFrame) -> DataFrame:
    """Hub count, mean flow and mean delay per cluster label."""
    return clustered.groupBy("cluster_label").agg(
        F.count("*").alias("hubs"),
        F.avg("total_outgoing_flow").alias("avg_flow"),
        F.avg("avg_segment_delay").alias("avg_delay"))


def hub_profiles(clustered: DataFrame) -> DataFrame:
    """The profile columns of the parallel-coordinates chart."""
    return clustered.select("hub_id", "total_outgoing_flow", "avg_segment_delay",
                            "std_delay", "max_delay", "cluster_label")
