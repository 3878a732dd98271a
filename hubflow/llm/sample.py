"""Samples of a stated number of rows, however many rows share an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: hexadecimal digits of an MD5 that a threshold is made of
_DIGITS = 12


def smallest(rows: DataFrame, md5: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest ``md5`` (a column of MD5 digests of distinct
    ids). Rows beyond a threshold that leaves about 1.2 n are filtered where
    they are read, so no partition sends n rows of its own to the last task."""
    total = rows.count()
    if total > 2 * n + 2000:
        cut = int((1.2 * n + 1000) / total * 16 ** _DIGITS)
        rows = rows.filter(F.substring(md5, 1, _DIGITS) <= f"{cut:0{_DIGITS}x}")
    return rows.orderBy(md5, *ties).limit(n)


def one_text(text: str) -> Column:
    """Aggregate: one text of an id's rows, the same one in every run."""
    return F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("text")))["text"]
