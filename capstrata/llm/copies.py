"""Duplicates hidden by formatting differences: Merkle-style hashing of nested records.

Leaves are normalised and hashed, each record once; an unordered node (a record or map, whose field order means nothing) hashes
its children's labelled digests in sorted order, an ordered node (an array) in given order. Rows are
grouped by root digest; where a digest occurs twice, they are grouped again by the canonical form as well, so
membership is confirmed by full structural comparison and a digest collision cannot join different records.

Defined results: null equals only null, an absent field is null; a leaf of punctuation only is present and an empty
text. Rows without filing, event type, date, or any of the other fields belong to no group. Exactly repeated ids
count as copies of the group but give no (keep, copy) pair with themselves. Empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import attach_group
from ..session import cut_lineage

FIELDS = ("event_type", "date", "shares", "ratio")

_RUNS = "[\\p{L}\\p{M}]+|\\p{N}+"


def squeezed(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{M}\\p{N}]+", "")


def in_parts(c: Column) -> Column:
    """Runs of letters and of digits in lower case, kept apart and in order."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(_RUNS), F.lit(0)), "|")


def ratio_sides(c: Column) -> Column:
    """The sides of a ratio kept apart and in order, each squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[:：/∶-]+", "|"), "[^\\p{L}\\p{M}\\p{N}|]+", ""), "^\\|+|\\|+$", "")


NORMALISERS: dict[str, Callable[[Column], Column]] = {"event_type": squeezed, "shares": squeezed, "date": in_parts, "ratio": ratio_sides}


def merkle(value: Column, kind: T.DataType, leaf: Callable[[Column], Column] = squeezed, leaves: dict[str, Callable[[Column], Column]] | None = None) -> tuple[Column, Column]:
    """(digest, canonical form) of a nested value, built bottom-up as one expression without a UDF."""
    leaves = leaves or {}
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            d, c = merkle(value[f.name], f.dataType, leaves.get(f.name, leaf), leaves)
            parts.append(F.struct(F.xxhash64(F.lit(f.name), d).alias("d"), F.concat(F.lit(f.name + "="), F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("null"))).alias("c")))
        kids = F.array_sort(F.array(*parts))
        return F.when(value.isNotNull(), F.xxhash64(F.transform(kids, lambda k: k["d"]))), F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(kids, lambda k: k["c"]), ","), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        digest = F.xxhash64(F.transform(value, lambda x: F.coalesce(merkle(x, kind.elementType, leaf, leaves)[0], F.lit(0))))
        canon = F.transform(value, lambda x: F.coalesce(merkle(x, kind.elementType, leaf, leaves)[1], F.lit("null")))
        return F.when(value.isNotNull(), digest), F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(canon, ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        kids = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(*[x.alias(n) for x, n in zip(merkle(e, entry, leaf, leaves), "dc")])))
        return F.when(value.isNotNull(), F.xxhash64(F.transform(kids, lambda k: k["d"]))), F.when(value.isNotNull(), F.concat(F.lit("<"), F.array_join(F.transform(kids, lambda k: k["c"]), ","), F.lit(">")))
    canon = leaf(value) if isinstance(kind, (T.StringType,)) else value.cast("string")
    return F.when(canon.isNotNull(), F.xxhash64(canon)), canon


def labelled(raw: Column, field: str) -> Column:
    """Value of a labelled field in text such as "Date: 2003 06 04; Shares: 5", "date=.. | shares=.." or JSON."""
    label = lambda f: f.replace("_", "[ _-]*")
    others = "|".join(label(f) for f in FIELDS)
    sep = "\"?\\s*[:=]"
    json = F.get_json_object(F.when(raw.rlike("^\\s*\\{"), raw), f"$.{field}")
    text = F.regexp_extract(raw, f"(?is)(?:^|[^\\p{{L}}]){label(field)}{sep}\\s*(.*?)\\s*(?:$|[\\s|;,\\{{\\}}\"]+(?:{others}){sep})", 1)
    has = raw.rlike(f"(?is)(?:^|[^\\p{{L}}]){label(field)}{sep}")
    return F.coalesce(json, F.when(has & ~text.rlike("(?i)^\"?null\"?[\\s}]*$"), text))


def record_digests(events: DataFrame, key: str = "event_id") -> DataFrame:
    """key, filing_id, digest and canonical form of each row that can have copies."""
    value = lambda f: NORMALISERS[f](F.coalesce(F.col(f), labelled(F.col("raw_text"), f)))
    # Through a generator, so that neither the filter nor the digests below evaluate the leaves again.
    leaves = F.inline(F.array(F.struct(*[value(f).alias(f"__{f}") for f in FIELDS])))
    rows = events.where("filing_id is not null").select(key, "filing_id", leaves)
    kind = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
    digest, canon = merkle(F.struct(*[F.col(f"__{f}").alias(f) for f in FIELDS]), kind, leaf=lambda c: c)
    return rows.where("__event_type is not null and __date is not null and (__shares is not null or __ratio is not null)").select(key, "filing_id", digest.alias("digest"), canon.alias("canonical"))


def copies(events: DataFrame, key: str = "event_id") -> DataFrame:
    """keep_id, copy_id: each later copy beside the smallest id of its group."""
    # Read twice: narrow, to find the digests that occur more than once, and in full for these.
    rows = cut_lineage(record_digests(events, key))
    twice = attach_group(rows, ["filing_id", "digest"], key, [F.count(F.lit(1)).alias("__n")], [F.sum("__n").alias("__n")], having="__n > 1").drop("__n")
    out = attach_group(twice, ["filing_id", "digest", "canonical"], key, [F.min(key).alias("__min")], [F.min("__min").alias("keep_id")])
    return out.where(F.col(key) > F.col("keep_id")).select("keep_id", F.col(key).alias("copy_id"))


def collapsed(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One record per group with its number of copies: keep_id, filing_id, canonical, n_copies."""
    return record_digests(events, key).groupBy("filing_id", "digest", "canonical").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("keep_id", "filing_id", "canonical", "n_copies")
