"""Embedding near-duplicates by int8 tile products with error bounds.

1. Equal vectors become one class, carried by its smallest id and its count.
2. Class vectors are cut into cells along one direction (the first principal
   axis of at most SAMPLE vectors; any direction is right, a good one skips
   more): two unit vectors with cosine t or more differ by at most
   sqrt(2 - 2t) along it, so cells farther apart never meet. Cells are cut
   into blocks of about TILE rows by a hash of the id; every pair of blocks
   whose cells may meet is one tile, computed in one task.
3. In a tile, unit vectors are quantised to int8 with a scale each. With
   u = s q + e the norm of e is known exactly, so
   |u.v - s s' q.q'| <= (1 + |e|) |e'| + |e| (1 + |e'|) + |e| |e'|.
   The integer product plus this bound rules pairs out; only pairs possibly
   at or above the threshold are recomputed in double precision.
4. A tile returns, per row, how many vectors it links to, and a spanning
   forest of its links: never the pairs themselves. Counts add up over tiles,
   forests are joined into components.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different lengths never
link; equal vectors link with each other; rows that repeat an id count as
vectors of their own; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.graph import components, forest
from hubflow.llm.ngram_join import _runs
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage

THRESHOLD = 0.95
TILE = 4096
SAMPLE = 4096
ROWS_AT_ONCE = 512
CELLS_PER_GAP = 4


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col) -> np.ndarray:
    """Unit rows in double precision; all rows of one length."""
    flat = np.asarray(col.flatten(), dtype=np.float64)
    x = flat.reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the error) of each unit row."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1))


def tile_links(u: np.ndarray, v: np.ndarray, threshold: float, same: bool):
    """Yield (i, j) index arrays of the linked pairs, a stripe of rows at a time."""
    qu, su, eu = quantise(u)
    qv, sv, ev = quantise(v)
    kind = np.float32 if u.shape[1] * 127 * 127 < 1 << 24 else np.float64   # exact integers
    right = np.ascontiguousarray(qv.astype(kind).T)
    for lo in range(0, len(u), ROWS_AT_ONCE):
        hi = min(lo + ROWS_AT_ONCE, len(u))
        a = eu[lo:hi]
        worst = (1 + a.max()) * ev.max() + a.max() * (1 + ev.max()) + a.max() * ev.max() + 1e-9
        # s * s' * q.q' >= threshold - worst, with the row's scale moved to the right
        product = qu[lo:hi].astype(kind) @ right
        product *= sv.astype(kind)
        i, j = np.nonzero(product >= ((threshold - worst) / su[lo:hi] * (1 - 1e-5)).astype(kind)[:, None])
        if same:
            i, j = i[j > i + lo], j[j > i + lo]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s:s + (1 << 16)] + lo, j[s:s + (1 << 16)]
            ok = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
            yield p[ok], q[ok]


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["ci", "bi", "cj", "bj"]):
            first = (t["cell"].to_numpy() == t["ci"][0].as_py()) & (t["blk"].to_numpy() == t["bi"][0].as_py())
            same = (t["ci"][0].as_py(), t["bi"][0].as_py()) == (t["cj"][0].as_py(), t["bj"][0].as_py())
            x = _matrix(t["vec"].combine_chunks())
            ids, mult = t["rep"].to_numpy(), t["mult"].to_numpy()
            left = np.flatnonzero(first)
            right = left if same else np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            n = np.zeros(len(ids), np.int64)
            ea, eb = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in tile_links(x[left], x[right], threshold, same):
                i, j = left[i], right[j]
                np.add.at(n, i, mult[j])
                np.add.at(n, j, mult[i])
                ea, eb = forest(np.concatenate([ea, ids[i]]), np.concatenate([eb, ids[j]]))
            hit = np.flatnonzero(n)
            yield pa.record_batch([
                pa.array(np.concatenate([ids[hit], ea])),
                pa.array(np.concatenate([ids[hit], eb])),
                pa.array(np.concatenate([n[hit], np.zeros(len(ea), np.int64)]))], names=["a", "b", "n"])
    return run


def _cells(axis: np.ndarray | None, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("dim"))
            cell = np.zeros(len(size), np.int64)
            rows = np.flatnonzero(size == (len(axis) if axis is not None else -1))
            if len(rows):
                u = _matrix(b.column("vec").take(pa.array(rows)))
                cell[rows] = np.floor((u @ axis + 1.0) / width).astype(np.int64)
            yield pa.record_batch([*b.columns, pa.array(cell)], names=[*b.schema.names, "slot"])
    return run


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                      threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    marked = v.select("id", F.when(_usable(F.col("vec")), F.xxhash64("vec")).alias("h1"),
                      F.when(_usable(F.col("vec")), F.xxhash64(F.lit(1), "vec")).alias("h2"))
    classes = cut_lineage(marked.filter("h1 is not null").groupBy("h1", "h2")
                          .agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    reps = (v.filter(_usable(F.col("vec"))).withColumnRenamed("id", "rep")
            .join(classes.select("rep", "mult"), "rep").dropDuplicates(["rep"])
            .withColumn("dim", F.size("vec")))
    sample = (reps.select("dim", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas())
    axis, gap = None, math.sqrt(max(0.0, 2 - 2 * threshold))
    width = gap / CELLS_PER_GAP if gap > 0 else 0.01
    if len(sample):
        dim = int(sample["dim"].mode().min())
        u = np.stack([np.asarray(x, np.float64) for x in sample.loc[sample["dim"] == dim, "vec"]])
        u = u / np.abs(u).max(axis=1, keepdims=True)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        axis = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)[2][0]
    item = v.schema["vec"].dataType.elementType.simpleString()
    placed = cut_lineage(reps.select("rep", "mult", "dim", "vec").mapInArrow(
        _cells(axis, width), f"rep bigint, mult bigint, dim int, vec array<{item}>, slot bigint"))
    # cells are bounded: 2 / width along the axis, one for each other length
    counts = placed.groupBy("dim", "slot").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    here = counts.select("dim", "slot", "blocks")
    there = counts.select("dim", F.col("slot").alias("slot2"), F.col("blocks").alias("blocks2"))
    meets = (here.join(there, "dim")
             .filter((F.abs(F.col("slot") - F.col("slot2")) - 1) * width <= gap + 1e-9)
             .groupBy("dim", "slot", "blocks")
             .agg(F.collect_list(F.struct("slot2", "blocks2")).alias("near")))
    cell = lambda c: (F.col("dim").cast("long") * 1_000_000 + F.col(c)).alias
    rows = (placed.join(meets, ["dim", "slot"])
            .withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
            .withColumn("o", F.explode("near"))
            .select("rep", "mult", "vec", "dim", "slot", "blk", F.col("o.slot2").alias("slot2"),
                    F.explode(F.sequence(F.lit(0), F.col("o.blocks2") - 1)).alias("blk2"))
            .select("rep", "mult", "vec", cell("slot")("cell"), "blk", cell("slot2")("cell2"), "blk2"))
    me, other = F.struct("cell", "blk"), F.struct(F.col("cell2").alias("cell"), F.col("blk2").alias("blk"))
    tiled = (rows.withColumn("lo", F.least(me, other)).withColumn("hi", F.greatest(me, other))
             .select("rep", "mult", "vec", "cell", "blk", F.col("lo.cell").alias("ci"),
                     F.col("lo.blk").alias("bi"), F.col("hi.cell").alias("cj"), F.col("hi.blk").alias("bj")))
    found = cut_lineage(tiled.repartition("ci", "bi", "cj", "bj")
                        .sortWithinPartitions("ci", "bi", "cj", "bj")
                        .mapInArrow(_tiles(threshold), "a bigint, b bigint, n bigint"))
    links = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comp = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    of_class = (classes.join(links, "rep", "left").join(comp, "rep", "left")
                .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    out = marked.join(of_class, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
