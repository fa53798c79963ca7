"""Grouping and lookup that stay safe when one key holds a large part of all rows.

Both helpers salt every key, not only known hot ones, so they need no earlier pass to find the
hot keys and behave alike at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways in which each key is split. A key with a third of N rows gives tasks of N / (3 * SALTS) rows.
SALTS = 16


def _salt(df: DataFrame, by: Column, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by hash for work that is heavy per row: in as many parts as there are cores, which are not
    put together again however few bytes they hold."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def attach_group(
    df: DataFrame, keys: Sequence[str], spread: str, aggs: Sequence[Column], merge: Sequence[Column], salts: int = SALTS, having: str | None = None
) -> DataFrame:
    """Give every row its group's aggregates without holding a group in one task; only rows of groups that meet ``having``.

    ``aggs`` fold rows per (keys, salt); ``merge`` fold those partial results per key. A row joins the
    copy of the result made for its own salt, so a hot group is spread over ``salts`` tasks. Keys match
    null-safely. Columns added: those named by ``merge``.
    """
    salted = _salt(df, F.col(spread), salts)
    part = salted.groupBy(*keys, "__salt").agg(*aggs)
    whole = part.groupBy(*keys).agg(*merge, F.collect_set("__salt").alias("__salts"))
    whole = whole.where(having) if having else whole
    spreaded = whole.select("*", F.explode("__salts").alias("__salt")).drop("__salts")
    right = spreaded.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__salt").alias("__s"), *[c for c in whole.columns if c not in keys and c != "__salts"])
    cond = F.col("__salt") == F.col("__s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return salted.join(right, cond, "inner").drop("__salt", "__s", *[f"__k_{k}" for k in keys])


def join_unique(df: DataFrame, right: DataFrame, key: str, spread_by: str, ways: int = 1024) -> DataFrame:
    """Left join with a table whose ``key`` is unique. Rows without a key match nothing and are dealt out over ``ways``
    values instead of meeting in one task; a key of very many rows is left to the skew join of adaptive execution."""
    name = lambda c, other: F.coalesce(F.concat(F.lit("="), c.cast("string")), other).alias("__j")
    nothing = F.pmod(F.xxhash64(spread_by), F.lit(ways)).cast("string")
    keyed = right.where(F.col(key).isNotNull()).select(name(F.col(key), F.lit("")), *[c for c in right.columns if c != key])
    return df.select("*", name(F.col(key), nothing)).join(keyed, "__j", "left").drop("__j")


def lookup_distinct(
    df: DataFrame, keys: Sequence[str], spread: str, resolve, outputs: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Resolve each distinct key once by ``resolve(distinct_keys) -> keys + outputs`` and hand it back to every row.

    The distinct keys (with their numbers of rows, ``__rows``) are found with map-side combine; the answer is repeated once per salt present, so
    a value held by a third of all rows is joined in ``salts`` tasks.
    """
    salted = _salt(df, F.col(spread), salts)
    n = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    present = n.groupBy(*keys).agg(F.collect_set("__salt").alias("__salts"), F.sum("__n").alias("__rows"))
    answers = resolve(present).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.explode("__salts").alias("__s"), *outputs)
    cond = F.col("__salt") == F.col("__s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return salted.join(answers, cond, "left").drop("__salt", "__s", *[f"__k_{k}" for k in keys])
