"""Sinks (S4-S7): every table is written by the executors in parallel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet (arrays kept as ``ARRAY<DOUBLE>``) or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def save_patterns(patterns: DataFrame, path: str) -> None:
    """Pattern counts as CSV with the count column titled ``Frequency``."""
    write_table(patterns.select("pattern", F.col("frequency").alias("Frequency")), path, "csv")


def export_results(clustered: DataFrame, embeddings: DataFrame, critical: DataFrame,
                   out_dir: str) -> None:
    """Hub clusters and critical routes as CSV, embeddings as parquet."""
    write_table(clustered, os.path.join(out_dir, "hub_clusters"), "csv")
    write_table(embeddings, os.path.join(out_dir, "hub_embeddings"), "parquet")
    write_table(critical, os.path.join(out_dir, "critical_routes"), "csv")
