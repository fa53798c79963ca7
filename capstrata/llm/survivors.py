"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows (group, field, value, vote); votes are summed per normalised value, the
winner of each field is taken by ``max_by``, and winners are pivoted back to one row per group. Every step is
an aggregate with map-side combine, so a group holding a third of all rows reaches the shuffle as one partial
row per task and never gathers in one place.

Two kinds of votes. ``survivors`` sums source trust times recency decay. ``ranked_leads`` needs a strict order
(trust, then confidence, then recency, then id), which no sum of weights can express without rounding, so there
each row votes for its own id with the order itself as the weight; unpivot, ``max_by`` and pivot are the same.

Defined results: rows without date or shares belong to no group; groups of one row give no result; null
methods and confidences rank last; a field that no row of the group supports is null; repeated ``record_id``
rows count as rows of their own; empty input gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique

KEY = ("filing_id", "event_type", "date", "shares")
#: Recency weights are relative to this moment; it cancels out within a group.
EPOCH = "2025-01-01 00:00:00"


def method_name(c: Column) -> Column:
    """Extraction method without letter case and outer blanks; null if blank."""
    name = F.lower(F.regexp_replace(c, "^[\\s\\u00A0\\u2000-\\u200B\\u3000\\uFEFF]+|[\\s\\u00A0\\u2000-\\u200B\\u3000\\uFEFF]+$", ""))
    return F.when(name != "", name)


def unit_confidence(c: Column) -> Column:
    """Confidence on a 0-1 scale: values above 1 and up to 100 are percentages; others outside 0..1 are void."""
    return F.when((c >= 0) & (c <= 1), c).when((c > 1) & (c <= 100), c / 100)


def prepared(rows: DataFrame, filings: DataFrame, trust: DataFrame) -> DataFrame:
    """The named columns with rank, unit confidence and the validity of the page.

    ``trust`` names the few extraction methods there are (four at every scale); its map is built by an
    aggregate that is joined, so nothing is collected and its size is bounded by the number of methods.
    """
    ranks = trust.select(method_name(F.col("extraction_method")).alias("__m"), F.col("trust_rank").alias("__rank")).groupBy("__m").agg(F.min("__rank").alias("__rank"))
    pages = filings.groupBy("filing_id").agg(F.max("total_pages").alias("__pages"))
    base = rows.select(
        *KEY, "record_id", "extracted_at", "page_number", "issue_price", "confidence",
        method_name(F.col("source_provenance.extraction_method")).alias("__m"),
        F.coalesce(unit_confidence(F.col("confidence")), unit_confidence(F.col("source_provenance.confidence"))).alias("__conf"),
    ).where("date is not null and shares is not null")
    # trust has one row per known method, so this broadcast is bounded by the method vocabulary.
    return join_unique(base.join(F.broadcast(ranks), "__m", "left"), pages, "filing_id", "record_id").withColumn("__page_ok", F.coalesce(F.col("page_number").between(1, F.col("__pages")), F.lit(False)))


def _long(df: DataFrame, keep: Sequence[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """field -> (value, whether the row supports it) as long rows (field, value); unsupported ones are left out."""
    items = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value"), ok.alias("ok")) for name, (value, ok) in fields.items()])
    return df.select(*keep, F.explode(items).alias("x")).select(*keep, "x.field", "x.value", "x.ok").where("ok")


def ranked_leads(rows: DataFrame, filings: DataFrame, trust: DataFrame) -> DataFrame:
    """KEY + n_rows, lead_id, page_from_id, price_from_id for groups of two or more rows."""
    df = prepared(rows, filings, trust)
    # Larger is better; a null orders below every value, so missing rank or confidence comes last.
    vote = F.struct((-F.col("__rank")).alias("t"), F.col("__conf").alias("c"), F.col("extracted_at").alias("e"), (-F.col("record_id")).alias("i"))
    df = df.withColumn("vote", vote)
    long = _long(df, [*KEY, "vote"], {
        "lead": (F.col("record_id"), F.lit(True)),
        "page": (F.col("record_id"), F.col("__page_ok")),
        "price": (F.col("record_id"), F.col("issue_price").isNotNull() & ~F.isnan("issue_price")),
    })
    best = long.groupBy(*KEY, "field").agg(F.max_by("value", "vote").alias("id"), F.count(F.lit(1)).alias("n"))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("id")))
    wide = best.groupBy(*KEY).agg(F.max(F.when(F.col("field") == "lead", F.col("n"))).alias("n_rows"), pick("lead").alias("lead_id"), pick("page").alias("page_from_id"), pick("price").alias("price_from_id"))
    return wide.where("n_rows >= 2")


def survivors(rows: DataFrame, filings: DataFrame, trust: DataFrame, half_life_days: float = 365.0) -> DataFrame:
    """One surviving event per group: KEY, n_rows, and confidence, extraction_method, page_number, issue_price with
    the share of the vote each winner got. A vote weighs 2^-(trust_rank - 1) (an unknown method 2^-8) times
    2^(age / half-life); equal totals go to the larger value in text order."""
    df = prepared(rows, filings, trust)
    age_days = (F.unix_micros(F.col("extracted_at").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / 86400e6
    weight = F.pow(F.lit(2.0), -(F.coalesce(F.col("__rank"), F.lit(9)) - 1).cast("double")) * F.pow(F.lit(2.0), F.coalesce(age_days, F.lit(-3650.0)) / half_life_days)
    df = df.withColumn("w", weight)
    long = _long(df, [*KEY, "w"], {
        "rows": (F.lit("-"), F.lit(True)),
        "confidence": (F.round("__conf", 4).cast("string"), F.col("__conf").isNotNull()),
        "extraction_method": (F.col("__m"), F.col("__m").isNotNull()),
        "page_number": (F.col("page_number").cast("string"), F.col("__page_ok")),
        "issue_price": (F.round("issue_price", 2).cast("string"), F.col("issue_price").isNotNull() & ~F.isnan("issue_price")),
    })
    votes = long.groupBy(*KEY, "field", "value").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*KEY, "field").agg(F.max_by("value", F.struct(F.round("w", 9), "value")).alias("value"), (F.max("w") / F.sum("w")).alias("share"), F.sum("n").alias("n"))
    pick = lambda f, c="value": F.max(F.when(F.col("field") == f, F.col(c)))
    wide = best.groupBy(*KEY).agg(
        pick("rows", "n").alias("n_rows"), pick("confidence").cast("double").alias("confidence"), pick("extraction_method").alias("extraction_method"),
        pick("page_number").cast("int").alias("page_number"), pick("issue_price").cast("double").alias("issue_price"),
        *[F.round(pick(f, "share"), 6).alias(f"{f}_share") for f in ("confidence", "extraction_method", "page_number", "issue_price")],
    )
    return wide.where("n_rows >= 2")
