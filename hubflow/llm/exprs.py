"""Column helpers of the operators that run on built-in expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often and
    wherever (in a lambda, say) ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
