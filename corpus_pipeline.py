"""Corpus pipeline: five stages over ``documents``, each written and reread.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and
decides what goes on. All but the last return the columns of ``documents``:

1. toxicity         documents scored 0.7 or more go
2. line_dedup       lines on too many pages of their source go; the documents
                    of a near-duplicate component are one page, as are equal
                    texts; ``n_chars`` follows the text
3. near_duplicates  of every near-duplicate component the smallest id stays
4. decontamination  documents that contain a benchmark item go
5. packing          every document left gets its length bucket and batch

Null texts pass the filters as empty texts. Copies make no line boilerplate,
and a document whose lines would all go keeps them, so the third stage meets
every group of copies with its text. Lines that stay keep their white space.
Documents
without shingles are no duplicates of each other. Rows that repeat a doc_id
leave the third stage as one row. Rows without doc_id are documents of their
own: stages tell rows apart by a key of their own, and of a component a row with
an id stays before one without. Further columns pass through.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import decontaminate, linededup, ngram_join, packing, toxicity
from hubflow.session import cut_lineage, ensure_checkpoint_dir


def _release(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages whose plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects (labels outside the held-out third)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.filter_clean(docs, model)


def _key_name(docs: DataFrame) -> str:
    key = "row_"
    while any(c.lower().startswith(key) for c in docs.columns):
        key = "_" + key
    return key


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a key that tells its rows apart, and the key's name."""
    key = _key_name(docs)
    return cut_lineage(docs.withColumn(key, F.monotonically_increasing_id())), key


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrite texts without the lines that their source repeats in texts that are no copies.

    The near copies of a source are one page, and so are its equal texts without
    words. Every other document loses its repeated lines, whatever their share."""
    _release(spark)
    rows, key = _with_key(docs)
    copies = ngram_join.link_components(rows.select(key, "text"), key)
    # documents without shingles belong to no component: equal ones are one page
    blank = rows.join(copies.filter("n_shingles = 0").select(key), key, "left_semi")
    groups = (copies.filter("n_shingles > 0").select(key, F.col("component_id").cast("string").alias("page"))
              .unionByName(blank.select(key, F.coalesce(F.md5("text"), F.lit("")).alias("page"))))
    groups = cut_lineage(groups)
    _release(spark)
    out = linededup.drop_boilerplate(rows, key, F.col("source"), F.col("text"), groups=groups,
                                    keep_whole=True, verbatim=True)
    changed = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every doc_id, then the smallest id of every near-duplicate component."""
    _release(spark)
    rows, key = _with_key(docs)
    first = (rows.filter("doc_id is not null").groupBy("doc_id")
             .agg(F.min(key).alias(key), F.count("*").alias("n")))
    if not first.filter("n > 1").isEmpty():
        rows = cut_lineage(rows.join(first.select(key), key, "left_semi").select(*rows.columns)
                           .unionByName(rows.filter("doc_id is null")))
    found = ngram_join.link_components(rows.select(key, "text"), key)
    kept = (rows.select(key, "doc_id").join(found, key).groupBy("component_id")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("least"))
            .select(F.col("least")[key].alias(key)))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    _release(spark)
    # rows of equal id and text share their fate: a digest of both tells enough, and needs no copy
    key = _key_name(docs)
    blank = F.lit("")
    rows = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), blank), F.lit("\n"),
                                               F.coalesce("text", blank))))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(rows, items, key).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    _release(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The toxicity stage is a fitted model; the run is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the ``documents`` of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
