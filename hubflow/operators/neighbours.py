"""Nearest neighbours by cosine over an inverted-file index.

Build: centroids come from Lloyd rounds on a sample of about ``SAMPLE`` unit
vectors (rows whose id hash is below a threshold from the count, a documented
bound); every vector is then assigned to its nearest centroid and the lists are
written as a table partitioned by list, with each list's size and radius.

Search: a target first probes the lists of its ``probes`` nearest centroids.
With ``exact`` the k-th best similarity found becomes a distance bound: by the
triangle inequality a list whose centroid is farther than that distance plus
its radius holds nothing better, and all other lists are searched too, so the
result is that of comparing with every row. Without it the first round is the
result; its recall is measured in tests.

Lists and targets meet in cells of at most about ``CELL`` vectors and as many
targets, however many rows a list or how many targets want it.

Defined results: vectors that are null, zero or hold null or non-finite
components are in no list, have no neighbours and are none; similarities are
rounded to 12 decimals before ranking, so that equal vectors tie; ties go to
the smaller id; unknown targets give no rows; rows that repeat an id are points
of their own, and no row is a neighbour of its own id; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.operators.silhouette import as_matrix
from hubflow.session import cut_lineage, ensure_checkpoint_dir

SAMPLE = 32_768
MAX_LISTS = 4096
ROUNDS = 8
PROBES = 8
CELL = 32_768
STRIPE = 1 << 21
DECIMALS = 12
_RANGE = 1 << 30


def best_rows(sims: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest finite entries of each row, equal
    values by ``order`` of the column, best first."""
    n = sims.shape[1]
    if n > k:
        floor = np.partition(sims, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
    else:
        row, col = np.nonzero(np.isfinite(sims))
    by = np.lexsort((order[col], -sims[row, col], row))
    row, col = row[by], col[by]
    begin = np.searchsorted(row, np.arange(len(sims)))
    keep = np.arange(len(row)) - begin[row] < k
    return row[keep], col[keep]


def _unit(points: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, x): usable vectors at length one."""
    x = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return (points.select(F.col(key).alias("id"), x.alias("x")).withColumn("_n", norm)
            .filter("_n > 0 and _n < double('infinity') and id is not null")
            .select("id", F.transform("x", lambda v: v / F.col("_n")).alias("x")))


def _centroids(x: np.ndarray, n_lists: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n_lists]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(x[s:s + 4096] @ c.T - 0.5 * (c * c).sum(1), axis=1)
                               for s in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    """Written lists (list, part, id, x) with centroids, sizes and radii."""
    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    path: str


def build_index(points: DataFrame, key: str = "vec_id", vec: str = "embedding", n_lists: int | None = None,
                sample: int = SAMPLE, cell: int = CELL, seed: int = 42) -> Index:
    """Index of every usable vector of ``points``; by default sqrt(n) lists, at
    most ``MAX_LISTS``."""
    spark = points.sparkSession
    unit = cut_lineage(_unit(points, key, vec))
    n = unit.count()
    n_lists = max(1, min(n_lists or int(n ** 0.5), MAX_LISTS, n or 1))
    cut = _RANGE if n <= sample else int(_RANGE * sample / n)
    taken = unit.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_RANGE)) < cut).select("id", "x")
    rows = sorted(((repr(r["id"]), r["x"]) for r in taken.toLocalIterator()), key=lambda r: r[0])
    centres = _centroids(np.array([x for _, x in rows]), n_lists, seed) if rows else np.zeros((0, 1))
    kind = points.schema[key].dataType.simpleString()

    def assign(batches):
        half = 0.5 * (centres * centres).sum(1)
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column("x"), centres.shape[1])
                near = np.argmax(x @ centres.T - half, axis=1)
                away = np.linalg.norm(x - centres[near], axis=1)
                yield pa.record_batch([pa.array(near.astype(np.int32)), b.column("id"), b.column("x"),
                                       pa.array(away)], names=["list", "id", "x", "away"])

    placed = cut_lineage(unit.mapInArrow(assign, f"list int, id {kind}, x array<double>, away double"))
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        sizes[r["list"]], radii[r["list"]] = r["n"], r["r"]      # MAX_LISTS rows at most
    parts = F.get(_numbers(-(-sizes // cell)), F.col("list"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(parts, F.lit(1))).cast("int"))
    dealt.select("list", "part", "id", "x").repartition("list", "part").write.partitionBy("list").parquet(path)
    schema = f"part int, id {kind}, x array<double>, list int"
    return Index(spark.read.schema(schema).parquet(path), centres, sizes, radii, path)


def _numbers(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]) if len(values) else F.array().cast("array<int>")


def _search_cells(index: Index, wanted: DataFrame, top_k: int, cell: int) -> DataFrame:
    """Best rows (target, id, sim) of every (target, list) in ``wanted``
    (target, x, list), cell by cell."""
    dim = index.centroids.shape[1]
    asked = np.zeros(len(index.sizes), np.int64)
    for r in wanted.groupBy("list").agg(F.count("*").alias("n")).collect():
        asked[r["list"]] = r["n"]
    of = lambda v: F.greatest(F.get(_numbers(v), F.col("list")), F.lit(1))
    every = lambda v: F.explode(F.sequence(F.lit(0), of(v) - 1))
    parts, groups = -(-index.sizes // cell), -(-asked // cell)
    left = wanted.select("list", "target", F.col("x").alias("tx"),
                         F.pmod(F.xxhash64("target", F.lit(5)), of(groups)).cast("int").alias("g")
                         ).select("*", every(parts).alias("part"))
    used = [int(k) for k in np.flatnonzero(asked)]               # only lists that are wanted are read
    right = index.lists.filter(F.col("list").isin(used)).select("list", "part", "id", "x", every(groups).alias("g"))
    kind = index.lists.schema["id"].dataType.simpleString()

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        tx, px = as_matrix(t["tx"], dim), as_matrix(p["x"], dim)
        tid, pid = t["target"].combine_chunks(), p["id"].combine_chunks()
        codes = np.unique(np.concatenate([tid.to_numpy(zero_copy_only=False), pid.to_numpy(zero_copy_only=False)]),
                          return_inverse=True)[1]
        tc, pc = codes[:len(tid)], codes[len(tid):]
        out, step = [], max(1, STRIPE // max(1, len(px)))
        for lo in range(0, len(tx), step):
            sims = np.round(tx[lo:lo + step] @ px.T, DECIMALS)
            sims[tc[lo:lo + step, None] == pc] = -np.inf
            row, col = best_rows(sims, pc, top_k)
            out.append(pa.table({"target": tid.take(pa.array(lo + row)), "id": pid.take(pa.array(col)),
                                 "sim": sims[row, col]}))
        return pa.concat_tables(out) if out else pa.table({"target": tid[:0], "id": pid[:0], "sim": np.zeros(0)})

    cells = ["list", "part", "g"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(
        run, f"target {kind}, id {kind}, sim double")


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    by = Window.partitionBy("target").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_k)


def search_index(index: Index, targets: DataFrame, top_k: int = 5, probes: int = PROBES, exact: bool = True,
                 key: str = "vec_id", vec: str = "embedding", cell: int = CELL) -> DataFrame:
    """(target_id, similar_id, similarity, rank) for every row of ``targets``
    (key and vector), whether indexed or not."""
    centres, radii = index.centroids, index.radii
    named = lambda df: df.select(F.col("target").alias("target_id"), F.col("id").alias("similar_id"),
                                 F.col("sim").alias("similarity"), "rank")
    kind = targets.schema[key].dataType.simpleString()
    asked = cut_lineage(_unit(targets, key, vec).withColumnRenamed("id", "target"))
    full = np.flatnonzero(index.sizes)
    p = min(probes, len(full))

    def near(batches, bound=False):
        """Lists to search: the nearest ones, or the others within the bound."""
        for b in batches:
            if not b.num_rows or not len(full):
                continue
            x = as_matrix(b.column("x"), centres.shape[1])
            d = np.sqrt(np.maximum(1 + (centres[full] ** 2).sum(1) - 2 * (x @ centres[full].T), 0))
            place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
            if bound:
                kth = np.asarray(b.column("kth").fill_null(-3.0))
                reach = np.sqrt(np.maximum(2 - 2 * kth, 0)) + 1e-6
                row, col = np.nonzero((place >= p) & (d - radii[full] <= reach[:, None]))
            else:
                row, col = np.nonzero(place < p)
            at = pa.array(row)
            yield pa.record_batch([b.column("target").take(at), b.column("x").take(at),
                                   pa.array(full[col].astype(np.int32))], names=["target", "x", "list"])

    schema = f"target {kind}, x array<double>, list int"
    first = cut_lineage(_ranked(_search_cells(index, cut_lineage(asked.mapInArrow(near, schema)), top_k, cell), top_k))
    if not exact:
        return named(first)
    kth = first.filter(F.col("rank") == top_k).select("target", F.col("sim").alias("kth"))
    more = cut_lineage(asked.join(kth, "target", "left").mapInArrow(lambda b: near(b, True), schema))
    again = _search_cells(index, more, top_k, cell)
    return named(_ranked(first.drop("rank").unionByName(again), top_k))
