"""Backward as-of fill within a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that is not null up to each row of its sequence, null before the first. A sequence
    (a document, a user) is what one task sorts."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
