"""Hub embeddings from the transit graph (G8-G12), re-aimed for Spark.

* G8: K-hop mean propagation ``h_{k+1}(v) = avg(h_k(u) for u -> v)``, each
  hop one join with the edge table and one ``groupBy(dst)`` (partial
  aggregation), the state written to the checkpoint folder between hops.
* G9: negative pairs from a seeded hash of (node, draw), minus existing
  edges (``left_anti``), deduplicated: no pair enumeration.
* G10/G11: a bilinear logistic regression ``sigma(x_i' S x_j)`` on whitened
  propagated features x = h W (balanced classes, L2 = weight decay, no
  intercept), fitted by Newton steps whose sums Spark adds up. The embedding is
  ``z = x P`` with ``P P' = S_+`` (the positive part of the learned S), so
  ``z_i . z_j`` approximates the learned score. The loss of every accepted step
  is returned (G12).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.session import cut_lineage, drop_tables


def propagate(nodes: DataFrame, edges: DataFrame, cols: list[str], hops: int = 2,
              key: str = "hub_id") -> DataFrame:
    """``key, h`` where ``h = concat(h_0, ..., h_hops)`` (ARRAY<DOUBLE>).

    Nodes without in-neighbours get 0 for the aggregated hops (mean
    aggregation over an empty neighbourhood)."""
    cur = nodes.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("h0"))
    acc = cur
    e = edges.select("src", "dst")
    p = len(cols)
    for k in range(1, hops + 1):
        prev = cur.select(F.col(key).alias("src"), F.col(f"h{k - 1}").alias("x"))
        m = e.join(prev, "src").groupBy("dst").agg(
            *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)])
        m = m.select(F.col("dst").alias(key), F.array(*[F.col(f"m{i}") for i in range(p)])
                     .alias(f"h{k}"))
        cur = cut_lineage(nodes.select(key).join(m, key, "left").select(
            key, F.coalesce(F.col(f"h{k}"), F.array_repeat(F.lit(0.0), p)).alias(f"h{k}")))
        acc = acc.join(cur, key)
    return acc.select(key, F.concat(*[F.col(f"h{k}") for k in range(hops + 1)]).alias("h"))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, cols: list[str],
                   key: str = "hub_id") -> DataFrame:
    """G8 (one hop) in column form: mean of each feature over in-neighbours."""
    prev = nodes.select(F.col(key).alias("src"), *[F.col(c).cast("double").alias(c) for c in cols])
    m = edges.select("src", "dst").join(prev, "src").groupBy("dst").agg(
        *[F.avg(c).alias(f"nbr_{c}") for c in cols])
    out = nodes.select(key).join(m.withColumnRenamed("dst", key), key, "left")
    return out.na.fill(0.0, subset=[f"nbr_{c}" for c in cols])


def _node_index(nodes: DataFrame, key: str, seed: int) -> DataFrame:
    """Dense 0-based node index in a seeded hash order (distributed)."""
    from hubflow.functions.ranking import row_index
    d = nodes.select(key).distinct().withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    return row_index(d, [F.col("_h"), F.col(key)], "idx").select(key, "idx")


def negative_edges(nodes: DataFrame, edges: DataFrame, seed: int = 42,
                   key: str = "hub_id", oversample: int = 3) -> DataFrame:
    """``min(E, 2N, number of non-edges)`` node pairs that are not edges
    (no self pairs).

    Every node draws partners by hashing ``(seed, node, draw)`` into the dense
    node index; existing edges are removed with a ``left_anti`` join and
    duplicates dropped. Draws multiply until the target is met. Where a node
    would draw as often as there are nodes, and on graphs where most pairs
    are edges, every node's partners are listed instead: such a list is
    linear in the edges (more than half of the N * (N - 1) pairs are edges) or
    in the draws. The first ``target`` pairs in hash order are kept (a
    sampling operator, so the limit is the feature)."""
    idx = cut_lineage(_node_index(nodes, key, seed))
    n = idx.count()
    e = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    n_e = e.count()
    inside = (e.join(idx.select(F.col(key).alias("src")), "src", "left_semi")
              .join(idx.select(F.col(key).alias("dst")), "dst", "left_semi").count())
    target = min(n_e, 2 * n, n * (n - 1) - inside)
    if target <= 0:
        return nodes.sparkSession.createDataFrame([], "src string, dst string")
    draws = oversample * (-(-target // n))
    while True:
        listed = draws >= n or 2 * inside > n * (n - 1)
        cand = idx.select(F.col(key).alias("src"),
                          F.explode(F.sequence(F.lit(0), F.lit((n if listed else draws) - 1))).alias("draw"))
        pick = F.col("draw").cast("bigint") if listed else \
            F.pmod(F.xxhash64(F.lit(seed), "src", "draw"), F.lit(n))
        cand = cand.withColumn("j", pick)
        cand = cand.join(idx.select(F.col("idx").alias("j"), F.col(key).alias("dst")), "j")
        cand = cand.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
        cand = cut_lineage(cand.join(e, ["src", "dst"], "left_anti"))
        if listed or cand.count() >= target:
            break
        drop_tables(cand)
        draws *= 4
    # first ``target`` pairs in a seeded hash order, ranked distributively
    # (target grows with the node count, so no single-task top-k)
    from hubflow.functions.ranking import row_index
    h = cand.withColumn("_h", F.xxhash64(F.lit(seed + 1), "src", "dst"))
    ranked = row_index(h, [F.col("_h"), F.col("src"), F.col("dst")], "_i")
    return ranked.filter(F.col("_i") < target).select("src", "dst")


EIGEN_LEAST = 1e-6   # share of the largest eigenvalue below which a direction is left out
TOLERANCE = 1e-8     # gradient norm at which a fit has converged


def whitening(h: DataFrame, p: int) -> np.ndarray:
    """(p, r) matrix that gives the rows of ``h`` unit second moments in r
    independent directions. Propagated features are nearly collinear; directions
    whose eigenvalue is below ``EIGEN_LEAST`` of the largest are left out. The
    Gram matrix is one aggregation: a row of p * p sums per task."""
    def partial(batches):
        total, n = np.zeros((p, p)), 0
        for b in batches:
            x = np.asarray(b.column("h").flatten(), dtype=float).reshape(-1, p)
            total, n = total + x.T @ x, n + len(x)
        yield pa.record_batch([pa.array([n]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "g"])

    rows = h.select("h").mapInArrow(partial, "n bigint, g array<double>").collect()
    n = sum(r["n"] for r in rows)
    gram = sum((np.array(r["g"]) for r in rows), np.zeros(p * p)).reshape(p, p) / max(n, 1)
    vals, vecs = np.linalg.eigh(gram)
    keep = vals > EIGEN_LEAST * max(vals.max(), 1e-300)
    return vecs[:, keep] / np.sqrt(vals[keep])


@dataclass
class BilinearFit:
    """Symmetric matrix of the fitted score, its loss per accepted step, and the
    gradient norm it ended with."""
    matrix: np.ndarray
    loss: list[float]
    gradient: float

    @property
    def converged(self) -> bool:
        return self.gradient <= TOLERANCE


def fit_bilinear(pairs: DataFrame, p: int, w: np.ndarray, reg: float, max_iter: int) -> BilinearFit | None:
    """Logistic regression of ``y`` on ``x_i' S x_j`` with x = h W (whitened) for
    ``pairs`` (y, hi, hj), classes balanced, ridge ``reg``: Newton steps, halved
    where the loss would rise. A step is one pass over the pairs; each task
    returns its sums of loss, gradient and curvature, whose size depends on r only.
    None where a class is missing."""
    size = {r["y"]: r["n"] for r in pairs.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    r = w.shape[1]
    up = np.triu_indices(r)
    double = np.where(up[0] == up[1], 1.0, 2.0)       # S[a, b] and S[b, a] share a parameter
    q = len(double)
    share = {y: 0.5 / n for y, n in size.items()}

    def sums(theta):
        def run(batches):
            total = np.zeros(1 + q + q * q)
            for b in batches:
                xi, xj = (np.asarray(b.column(c).flatten(), dtype=float).reshape(-1, p) @ w for c in ("hi", "hj"))
                y = np.asarray(b.column("y"))
                c = np.where(y == 1, share[1.0], share[0.0])
                f = (xi[:, up[0]] * xj[:, up[1]] + xi[:, up[1]] * xj[:, up[0]]) / 2 * double
                z = f @ theta
                total[0] += (c * (np.logaddexp(0, z) - y * z)).sum()
                prob = np.exp(-np.logaddexp(0, -z))
                total[1:1 + q] += f.T @ (c * (prob - y))
                total[1 + q:] += ((f * (c * prob * (1 - prob))[:, None]).T @ f).ravel()
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["s"])

        rows = pairs.mapInArrow(run, "s array<double>").collect()
        s = sum((np.array(x["s"]) for x in rows), np.zeros(1 + q + q * q))
        return (s[0] + reg / 2 * theta @ theta, s[1:1 + q] + reg * theta,
                s[1 + q:].reshape(q, q) + reg * np.eye(q))

    theta = np.zeros(q)
    loss, grad, curve = sums(theta)
    history = [loss]
    for _ in range(max_iter):
        if np.linalg.norm(grad) <= TOLERANCE:
            break
        step = np.linalg.solve(curve, grad)
        for _ in range(30):
            new = sums(theta - step)
            if new[0] <= loss:
                break
            step = step / 2
        else:
            break
        theta, (loss, grad, curve) = theta - step, new
        history.append(loss)
    m = np.zeros((r, r))
    m[up] = theta
    m[up[1], up[0]] = theta
    return BilinearFit(m, [float(x) for x in history], float(np.linalg.norm(grad)))


def _checked(fit: BilinearFit | None, max_iter: int) -> BilinearFit | None:
    if fit is not None and not fit.converged:
        warnings.warn(f"embedding fit stopped after {len(fit.loss) - 1} of {max_iter} steps "
                      f"with gradient norm {fit.gradient:.2e}", stacklevel=3)
    return fit


def _project(h: DataFrame, w: np.ndarray, m: np.ndarray, dim: int, key: str) -> DataFrame:
    """Embedding z = h W P with P P' the positive part of ``m``."""
    vals, vecs = np.linalg.eigh(m)
    order = np.argsort(vals)[::-1]
    proj = w @ (vecs[:, order] * np.sqrt(np.clip(vals[order], 0, None)))
    p = proj.shape[0]
    proj = np.hstack([proj, np.zeros((p, max(0, dim - proj.shape[1])))])[:, :dim]
    # fix the arbitrary eigenvector sign: largest-magnitude loading positive
    for j in range(dim):
        col = proj[:, j]
        if col[np.argmax(np.abs(col))] < 0:
            proj[:, j] = -col
    kind = h.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            z = np.asarray(b.column("h").flatten(), dtype=float).reshape(-1, p) @ proj
            yield pa.record_batch([b.column(key), pa.array(list(z), pa.list_(pa.float64()))], names=[key, "embedding"])

    return h.select(key, "h").mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def link_embedding(nodes: DataFrame, edges: DataFrame, cols: list[str], dim: int = 16,
                   hops: int = 5, weight_decay: float = 5e-4, max_iter: int = 100,
                   seed: int = 42, key: str = "hub_id"):
    """G10 (+G9, G12): link-prediction embedding. Returns ``(embeddings, loss)``.

    Propagated features are whitened first; a fit that has not converged after
    ``max_iter`` steps warns with its gradient norm. Pairs carry the whitened
    features of both ends, which are fewer than the propagated ones."""
    h = cut_lineage(propagate(nodes, edges, cols, hops, key))
    p = len(cols) * (hops + 1)
    w = whitening(h, p)
    if not w.shape[1]:                       # all features are 0: one direction of zeros
        w = np.zeros((p, 1))
    pos = edges.select("src", "dst").distinct().withColumn("y", F.lit(1.0))
    neg = negative_edges(nodes, edges, seed, key).withColumn("y", F.lit(0.0))
    pairs = whitened_pairs(h, pos.unionByName(neg), w, key)
    r = range(w.shape[1])
    both = pairs.select("y", *[F.array(*[F.col(f"{c}{i}") for i in r]).alias(f"h{c}") for c in "ij"])
    fit = _checked(fit_bilinear(both, w.shape[1], np.eye(w.shape[1]), weight_decay, max_iter), max_iter)
    drop_tables(pairs)
    m = np.eye(w.shape[1]) if fit is None else fit.matrix
    return _project(h, w, m, dim, key), [] if fit is None else fit.loss


def whitened_pairs(h: DataFrame, pairs: DataFrame, w: np.ndarray, key: str) -> DataFrame:
    """Written (y, i0, i1, .., j0, j1, ..): the whitened features x = h W of both
    ends of ``pairs`` (src, dst, y). Nodes are whitened before they meet their
    pairs, and every feature is a column of its own, in which the values that
    pairs of one node repeat are stored once."""
    p, r = w.shape
    kind = h.schema[key].dataType.simpleString()
    names = [f"x{i}" for i in range(r)]

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("h").flatten(), dtype=float).reshape(-1, p) @ w
            yield pa.record_batch([b.column(key), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=[key, *names])

    x = cut_lineage(h.select(key, "h").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names)))
    end = lambda c, side: x.select(F.col(key).alias(c), *[F.col(f"x{i}").alias(f"{side}{i}") for i in range(r)])
    out = cut_lineage(pairs.join(end("src", "i"), "src").join(end("dst", "j"), "dst").select(
        "y", *[f"{c}{i}" for c in "ij" for i in range(r)]))
    drop_tables(x)
    return out


def _fitted_embedding(h: DataFrame, pairs: DataFrame, p: int, dim: int, reg: float, max_iter: int, key: str):
    w = whitening(h, p)
    pairs = cut_lineage(pairs)
    fit = _checked(fit_bilinear(pairs, p, w, reg, max_iter), max_iter)
    drop_tables(pairs)
    m = np.eye(w.shape[1]) if fit is None else fit.matrix
    return _project(h, w, m, dim, key), [] if fit is None else fit.loss


def contrastive_embedding(nodes: DataFrame, edges: DataFrame, cols: list[str], dim: int = 16,
                          hops: int = 5, weight_decay: float = 5e-4, max_iter: int = 100,
                          seed: int = 42, key: str = "hub_id"):
    """Positives pair each node's propagated features with itself,
    negatives with a seeded permutation of the nodes' raw features
    propagated the same way (true versus corrupted views)."""
    h = cut_lineage(propagate(nodes, edges, cols, hops, key))
    p = len(cols) * (hops + 1)
    idx = _node_index(nodes, key, seed)
    perm = idx.select(F.col(key).alias("orig"), "idx").join(
        _node_index(nodes, key, seed + 7).select(F.col(key).alias("perm"), "idx"), "idx")
    feats = nodes.select(F.col(key).alias("perm"), *cols)
    corrupted = perm.join(feats, "perm").select(F.col("orig").alias(key), *cols)
    hc = cut_lineage(propagate(corrupted, edges, cols, hops, key))
    hp = h.select(key, F.col("h").alias("hi"))
    pos = hp.select(F.lit(1.0).alias("y"), "hi", F.col("hi").alias("hj"))
    neg = hp.join(hc.select(key, F.col("h").alias("hj")), key).select(F.lit(0.0).alias("y"), "hi", "hj")
    return _fitted_embedding(h, pos.unionByName(neg), p, dim, weight_decay, max_iter, key)
