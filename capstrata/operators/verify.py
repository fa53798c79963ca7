"""Consistency of capital events: conflicting figures on a date, breaks in a chain, ratio arithmetic.

Every check works per ``scope`` (a filing or issuer), so windows never span the whole corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio_multiple

#: Relative deviation from which a bonus issue is flagged; confidence lost per issue.
TOLERANCE, STEP = 0.05, 0.2

ISSUE = ["event_ids", "check_type", "severity"]


def event_name(kind: str = "event_type", date: str = "date", event_id: str | None = "event_id", fallback: Column | None = None) -> Column:
    """The event's own id, else "type@date"."""
    own = F.nullif(F.col(event_id).cast("string"), F.lit("")) if event_id else F.lit(None)
    return F.coalesce(own, F.concat(F.coalesce(F.col(kind), F.lit("event")), F.lit("@"), F.coalesce(F.nullif(F.col(date), F.lit("")), (fallback if fallback is not None else F.lit("")).cast("string"))))


def date_conflicts(
    events: DataFrame, scope: Sequence[str], figures: Sequence[str], kind: str = "event_type", date: str = "date", price: str | None = "issue_price",
    ids: str | None = "event_id", order: str = "pos", tranche_kind: str = "allotment",
) -> DataFrame:
    """Groups of two or more events of one kind and date that differ in their figures, nulls told apart.

    Adds n, n_figures, severity and event_ids in order: a warning for allotments that all share one known price.
    """
    groups = [*scope, kind, date]
    aggs = [F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*figures)).alias("n_figures")]
    if price:
        aggs += [F.count_distinct(price).alias("__p"), F.count(price).alias("__np")]
    if ids:
        aggs.append(F.collect_list(F.struct(order, F.col(ids).cast("string").alias("__id"))).alias("__ids"))
    out = events.where(F.col(date).isNotNull() & (F.col(date).cast("string") != "")).groupBy(*groups).agg(*aggs).where("n >= 2 and n_figures > 1")
    tranche = (F.col(kind) == tranche_kind) & (F.col("__p") == 1) & (F.col("__np") == F.col("n")) if price else F.lit(False)
    out = out.withColumn("severity", F.when(tranche, "warning").otherwise("error"))
    if ids:
        out = out.withColumn("event_ids", F.transform(F.array_sort("__ids"), lambda x: x["__id"]))
    return out.drop("__p", "__np", "__ids")


def chain_breaks(events: DataFrame, scope: Sequence[str], old: str, new: str, date: str = "date", order: str = "pos") -> DataFrame:
    """Rows whose ``new`` differs from the ``old`` of the next row by date; pairs with a null side are passed over."""
    w = Window.partitionBy(*scope).orderBy(F.coalesce(F.col(date).cast("string"), F.lit("")), order)
    nxt = events.withColumn("next_old", F.lead(old).over(w)).withColumn("next_pos", F.lead(order).over(w)).withColumn("next_date", F.lead(date).over(w))
    return nxt.where(F.col(new).try_cast("bigint") != F.col("next_old").try_cast("bigint"))


def ratio_breaks(events: DataFrame, ratio: str, before: str, after: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose ``after`` is off ``before * (1 + ratio)`` by more than the tolerance; adds expected and deviation."""
    expected = F.col(before) * (1 + ratio_multiple(F.col(ratio)))
    df = events.where(F.col(before) != 0).withColumn("expected", expected)
    deviation = F.when(F.col("expected") == 0, 1.0).otherwise(F.abs(F.col(after) - F.col("expected")) / F.col("expected"))
    return df.withColumn("deviation", deviation).where(F.col("deviation") > tolerance)


def verify(events: DataFrame, scope: Sequence[str] = ("filing_id",), event_type: str | None = None) -> DataFrame:
    """All issues of capital events: scope, check_type, severity, event_ids, checks in fixed order."""
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    named = events.withColumn("__name", event_name(fallback=F.col("pos")))
    conflicts = date_conflicts(named, scope, ["shares", "ratio", "new_capital"], ids="__name")
    a = conflicts.select(*scope, F.lit(0).alias("check_order"), F.lit("timeline").alias("check_type"), "severity", "event_ids")
    chain = named.where("event_type = 'authorised_capital_change'")
    w = Window.partitionBy(*scope).orderBy(F.coalesce(F.col("date"), F.lit("")), "pos")
    b = chain_breaks(chain.withColumn("__next", F.lead("__name").over(w)), scope, "old_capital", "new_capital")
    b = b.select(*scope, F.lit(1).alias("check_order"), F.lit("capital_continuity").alias("check_type"), F.lit("error").alias("severity"), F.array("__name", "__next").alias("event_ids"))
    c = ratio_breaks(named.where("event_type = 'bonus_issue'"), "ratio", "pre_issue_capital", "post_issue_capital")
    c = c.select(*scope, F.lit(2).alias("check_order"), F.lit("arithmetic").alias("check_type"), F.lit("warning").alias("severity"), F.array("__name").alias("event_ids"))
    return a.unionByName(b).unionByName(c)


def verification_summary(issues: DataFrame, events: DataFrame, scope: Sequence[str] = ("filing_id",)) -> DataFrame:
    """Per scope: events checked, issues by check, consistent, confidence max(0, 1 - 0.2 n)."""
    checked = events.groupBy(*scope).agg(F.count(F.lit(1)).alias("checked"))
    n = issues.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("check_type") == t).alias(t) for t in ("timeline", "capital_continuity", "arithmetic")])
    out = checked.join(n, list(scope), "left").na.fill(0, ["n", "timeline", "capital_continuity", "arithmetic"])
    return out.select(*scope, "checked", F.col("n").alias("n_issues"), "timeline", "capital_continuity", "arithmetic", (F.col("n") == 0).alias("consistent"), F.round(F.greatest(F.lit(0.0), 1 - STEP * F.col("n")), 6).alias("confidence"))
