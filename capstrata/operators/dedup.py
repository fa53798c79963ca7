"""Merging and de-duplicating event lists. Keys match null-safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what makes two extractions the same event.
KEY = ("event_type", "date", "shares", "ratio", "new_capital")
#: Fixed value: the same for events of the record schema, which tell offers apart as well.
RECORD_KEY = (*KEY, "shares_offered")


def merge_extractions(preferred: DataFrame, other: DataFrame, key: Sequence[str] = KEY, order: str = "pos", scope: Sequence[str] = ()) -> DataFrame:
    """Union of two extractions with one row per key: the last of ``preferred``, else the last of ``other``.

    Adds ``seq``, the place at which the key first appeared (``other`` first), by which the result is ordered.
    """
    both = other.withColumn("__side", F.lit(0)).unionByName(preferred.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__side"]
    at = F.struct("__side", order)
    out = both.groupBy(*scope, *key).agg(F.max_by(F.struct(*columns), at).alias("__row"), F.min(at).alias("seq"))
    return out.select("__row.*", "seq")


def content_hash(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    """SHA-256 of a row: fields in name order, texts trimmed and in lower case, nulls included."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name not in skip:
            c = F.col(f.name)
            parts.append((F.trim(F.lower(c)) if f.dataType.simpleString() == "string" else c).alias(f.name))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def keep_first(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, by an aggregate with map-side combine rather than a window over the key."""
    return df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def drop_repeats(df: DataFrame, order: str = "pos") -> DataFrame:
    """First of the rows equal in content, ``order`` aside."""
    hashed = df.withColumn("__hash", content_hash(df, [order]))
    return keep_first(hashed, ["__hash"], order).drop("__hash")
