"""Raw journey CSV source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hubflow.functions.columns import raw_columns
from hubflow.session import cut_lineage

MALFORMED = "_malformed"


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 98-column raw journey CSV, bound by header name, as text.

    The header is read first; columns may come in any order and further ones
    are ignored, a missing one is an error. All values stay text (no
    inference pass over the data; ``?`` is for the cleaning step to
    interpret). A missing path fails with Spark's ``PATH_NOT_FOUND``."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in raw_columns() if c not in header]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option(
        "enforceSchema", False).csv(path).select(*raw_columns())


def read_raw_csv_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 with malformed rows set apart: (rows as ``read_raw_csv`` gives them,
    one ``_malformed`` text per record that has too few or too many fields).

    The file is parsed once, into a written table, as a record is only known to
    be malformed when all its fields are read; count the second frame for the
    number of rejects. Nothing is dropped silently."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in raw_columns() if c not in header]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, MALFORMED]])
    rows = cut_lineage(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
                       .option("columnNameOfCorruptRecord", MALFORMED).csv(path))
    bad = rows[MALFORMED].isNotNull()
    return rows.filter(~bad).select(*raw_columns()), rows.filter(bad).select(MALFORMED)


def read_raw_csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """Like ``read_raw_csv`` but a missing file gives ``None`` (the
    driver script's "report and return" behaviour) instead of raising."""
    from pyspark.errors import AnalysisException
    try:
        return read_raw_csv(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def read_table_file(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: re-read a cleaned table written by a sink (parquet or CSV)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)
