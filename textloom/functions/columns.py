"""Columns that use a costly value more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once for a row however often the body names it.

    Spark shares repeated parts of a projection, but not within branches, lambdas and generators.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
