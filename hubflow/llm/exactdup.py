"""Exact deduplication by a 128-bit content hash, with byte comparison inside groups.

Texts are equal when they are identical after all white space (space, 0x09 to
0x0D) is deleted. Of equal texts one row stays: the one with the most code
points in its original text, then the smallest id.

1. One scan makes a row of numbers per document (128-bit hash, SHA-256 for the
   result, length, row key); texts are left behind. The rows are grouped by
   hash; grouping combines in the map task, so a group that holds a third of
   all rows sends one row per task.
2. Bytes are compared where a hash occurs twice or more: only those texts are
   read again and reduced to the distinct (hash, text) pairs, again first
   inside the map task, so of thousands of copies one text per task moves. The
   comparison is that of the grouping key, byte by byte.
3. A hash with two texts is a collision. Its rows, and only they, are grouped
   by the texts themselves.

The hashes of step 2 are broadcast while their rows, which are counted, fit
``BROADCAST_BYTES``; beyond that they meet the documents in a shuffled join.

Defined results: a null text counts as empty, and all texts without other
characters than white space are equal; rows without id are documents of their
own and stay only in groups where no row has an id (of equal lengths); rows
that repeat an id are told apart by a row key, so exactly one row of a group
is ``kept``; an empty table gives an empty result; further columns are
ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 32 << 20
#: bytes of a broadcast row: hash, kept id, row key, size and overhead
ROW_BYTES = 96


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n * ROW_BYTES <= BROADCAST_BYTES else rows


def _keep() -> Column:
    """The row that stays: longest original, then a row with id, smallest id."""
    return F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")).alias("keep")


def _labelled(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    keep = F.col("keep")
    alone = keep.isNull()
    return rows.join(groups, on, "left").select(
        "id", F.when(alone, F.col("id")).otherwise(keep["id"]).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (keep["row"] == F.col("row"))).alias("kept"), "sha")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("norm", normalised(F.col("t"))).withColumn("h", hash_of(F.col("norm")))
    key = F.monotonically_increasing_id().alias("row")
    slim = cut_lineage(base.select("id", "h", F.sha2("norm", 256).alias("sha"),
                                   F.length("t").cast("long").alias("n"), key))
    groups = cut_lineage(slim.groupBy("h").agg(F.count("*").alias("size"), _keep()).filter("size > 1"))
    n_groups = groups.count()
    # bytes inside groups: the distinct texts behind every hash that occurs twice
    several = base.select("h", "norm").join(_bounded(groups.select("h"), n_groups), "h", "left_semi")
    collided = cut_lineage(several.groupBy("h", "norm").agg(F.count("*").alias("c"))
                           .groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"))
    n_collided = collided.count()
    if not n_collided:
        out = _labelled(slim, _bounded(groups, n_groups), ["h"])
    else:
        apart = _bounded(collided, n_collided)
        odd = cut_lineage(base.join(apart, "h", "left_semi").select(
            "id", "h", "norm", F.sha2("norm", 256).alias("sha"), F.length("t").cast("long").alias("n"), key))
        by_text = cut_lineage(odd.groupBy("h", "norm").agg(F.count("*").alias("size"), _keep()))
        clean = slim.join(apart, "h", "left_anti")
        out = _labelled(clean, _bounded(groups, n_groups), ["h"]).unionByName(
            _labelled(odd, by_text, ["h", "norm"]))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept",
                      F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of every group of equal texts; ids must be unique and set."""
    stay = exact_groups(docs, id_col, text_col, **kw).filter("kept").select(id_col)
    return docs.join(stay, id_col, "left_semi")
