"""Helpers on whole frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Append columns that are computed once per row.

    A plain projection is inlined into every use of its columns, inside lambdas and into
    filters that move below it as well, and so a costly array can be built again and again.
    A generator of one row stands where it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
