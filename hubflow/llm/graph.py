"""Connected components of a large edge table, without the driver.

Edges are first contracted inside tasks of at most ``block`` edges each
(union-find: every task returns one edge per node, to the smallest id of its
local group). What remains is finished by alternating large-star and
small-star rounds, each written to the shared checkpoint folder, until a
round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.ship import ship
from hubflow.session import cut_lineage, drop_tables

BLOCK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest id of its group) for every node that is not a smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(ids))], dtype=np.int64)
    keep = np.flatnonzero(root != np.arange(len(ids)))
    return ids[keep], ids[root[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += batch.num_rows
        if n > 2 * len(a) + 100_000:                 # the forest is rebuilt as the edges double
            a, b = forest(*(np.concatenate(x) for x in zip((a, b), *held)))
            held, n = [], 0
    a, b = forest(*(np.concatenate(x) for x in zip((a, b), *held)))
    yield pa.record_batch([pa.array(a), pa.array(b)], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(least, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, component) of every node with an edge, except that a component's
    smallest id itself has no row. ``edges``: two long columns; loops and
    repeated edges are allowed, nulls are ignored. The result is a written table."""
    ship(edges.sparkSession)
    a, b = edges.columns
    e = cut_lineage(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
                    .filter("u <> v"))
    parts = -(-e.count() // block) or 1
    # one block of edges is finished by one task, and by one only; edges are dealt by
    # both ends, so a node with very many edges is contracted in many tasks
    dealt = e.coalesce(1) if parts == 1 else e.repartition(parts, "u", "v")
    written, e = e, cut_lineage(dealt.mapInArrow(_contract, "u bigint, v bigint"))
    drop_tables(written)
    before = None
    while parts > 1:
        written, e = e, cut_lineage(_small_star(_large_star(e)))
        drop_tables(written)
        now = _mark(e)
        if now == before:
            break
        before = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out._hubflow_path = e._hubflow_path
    return out
