"""Validation and quarantine of raw event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed schemas of four event types; other types pass unchecked.
SCHEMAS = {
    "allotment": {"date": "string", "shares": "bigint", "face_value": "double", "issue_price": "double", "consideration": "string", "allottee_category": "string"},
    "bonus_issue": {"date": "string", "ratio": "string", "shares_issued": "bigint", "pre_issue_capital": "bigint", "post_issue_capital": "bigint"},
    "rights_issue": {"date": "string", "ratio": "string", "price": "double", "shares_offered": "bigint"},
    "authorised_capital_change": {"date": "string", "old_capital": "double", "new_capital": "double", "resolution_type": "string"},
}
#: Fixed value: columns of the flat export, in order.
CSV_FIELDS = [
    "event_type", "date", "shares", "shares_issued", "shares_offered", "face_value", "issue_price", "price", "consideration", "allottee_category", "ratio",
    "pre_issue_capital", "post_issue_capital", "old_capital", "new_capital", "resolution_type",
]
#: Confidence bounds of the high and middle bucket, and below which an event is flagged.
HIGH, MIDDLE = 0.8, 0.5


def validate(raw: DataFrame) -> DataFrame:
    """Adds is_valid and error (names of fields that do not fit the type's schema) to records whose fields are text."""
    kind = F.lower("event_type")
    bad = []
    for event_type, fields in SCHEMAS.items():
        for name, to in fields.items():
            if to != "string" and name in raw.columns:
                # A number with an empty fraction is a whole number.
                c = F.regexp_replace(F.trim(F.col(name).cast("string")), "\\.0+$", "") if to == "bigint" else F.trim(F.col(name).cast("string"))
                bad.append(F.when((kind == event_type) & F.col(name).isNotNull() & c.try_cast(to).isNull(), F.lit(f"{event_type}.{name}")))
    errors = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    error = F.when(F.col("event_type").isNull(), "event_type").when(F.size(errors) > 0, F.array_join(errors, ", "))
    return raw.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())


def confidence_bucket(confidence: str | Column) -> Column:
    """high, middle or low; empty for null."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c.isNull(), "").when(c >= HIGH, "high").when(c >= MIDDLE, "middle").otherwise("low")


def low_confidence(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Rows below the middle bound; missing confidence counts as 1."""
    return df.where(F.coalesce(F.col(confidence), F.lit(1.0)) < MIDDLE)


def listed(df: DataFrame, limit: int, order: str, event_type: str | None = None, kind: str = "event_type") -> DataFrame:
    """Rows of one type in order, the first ``limit`` of them; a negative limit leaves out as many from the end."""
    out = df.where(F.col(kind) == event_type) if event_type else df
    if limit >= 0:
        return out.orderBy(order).limit(limit)
    last = out.orderBy(F.col(order).desc()).limit(-limit).select(F.col(order).alias("__o"))
    return out.join(last, F.col(order) == F.col("__o"), "left_anti").orderBy(order)
