"""Extraction and retrieval quality: precision, recall, F1 on null-safe keys, nDCG and MRR."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("event_type", "date")
#: The method of events that name none, in evaluation and in the record of an ingest.
DEFAULT_METHOD, INGEST_METHOD = "llm", "table"


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 to 3 places; 0 where a denominator is 0."""
    p = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    return F.round(p, 3), F.round(r, 3), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3)


def sides(predicted: DataFrame, gold: DataFrame, key: Sequence[str] = KEY, scope: Sequence[str] = ()) -> DataFrame:
    """One row per distinct key of either side with flags in_pred and in_gold; nulls are values."""
    cols = [*scope, *key]
    both = predicted.select(*cols, F.lit(1).alias("p"), F.lit(0).alias("g")).union(gold.select(*cols, F.lit(0), F.lit(1)))
    return both.groupBy(*cols).agg(F.max("p").alias("in_pred"), F.max("g").alias("in_gold"))


def scores(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn and their scores, over all keys or per ``by``."""
    counts = flags.groupBy(*by).agg(F.sum(F.col("in_pred") * F.col("in_gold")).alias("tp"), F.sum(F.col("in_pred") * (1 - F.col("in_gold"))).alias("fp"), F.sum((1 - F.col("in_pred")) * F.col("in_gold")).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def evaluate(predicted: DataFrame, gold: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row: scores on distinct keys."""
    none = predicted.sparkSession.createDataFrame([(0, 0, 0)], "in_pred int, in_gold int, one int").select("in_pred", "in_gold")
    return scores(sides(predicted, gold, key).select("in_pred", "in_gold").unionByName(none.where("in_pred = 1")))


def per_type(predicted: DataFrame, gold: DataFrame, kind: str = "event_type", key: Sequence[str] = KEY) -> DataFrame:
    """Scores per event type; events without a type are left out."""
    return scores(sides(predicted, gold, key).where(F.col(kind).isNotNull() & (F.col(kind).cast("string") != "")), [kind])


def per_method(predicted: DataFrame, gold: DataFrame, method: str, key: Sequence[str] = KEY, default: str = DEFAULT_METHOD) -> DataFrame:
    """Per extraction method: rows (not distinct keys), those whose key is in gold, and their precision."""
    hit = gold.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__hit", F.lit(1))
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = predicted.join(hit, cond, "left").groupBy(F.coalesce(F.col(method), F.lit(default)).alias("method"))
    out = rows.agg(F.count(F.lit(1)).alias("predicted"), F.count("__hit").alias("correct"))
    return out.withColumn("precision", F.round(F.col("correct") / F.col("predicted"), 3))


def corpus_scores(predicted: DataFrame, gold: DataFrame, scope: str = "filing_id", key: Sequence[str] = KEY) -> DataFrame:
    """Per filing with gold, and over all of them (scope null) from the summed counts."""
    flags = sides(predicted, gold, key, [scope])
    scored = gold.select(scope).distinct()
    flags = flags.join(scored, scope, "left_semi")
    return scores(flags, [scope]).unionByName(scores(flags).withColumn(scope, F.lit(None).cast(gold.schema[scope].dataType)))


def counts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: predicted and gold rows (not keys)."""
    both = predicted.select(F.lit(1).alias("p")).union(gold.select(F.lit(0)))
    return both.agg(F.count_if(F.col("p") == 1).alias("predicted"), F.count_if(F.col("p") == 0).alias("gold"))


def differences(predicted: DataFrame, gold: DataFrame, key: Sequence[str] = KEY, scope: Sequence[str] = ()) -> DataFrame:
    """scope, key, side: keys only in gold ("missed") or only predicted ("spurious"), in order of side and key."""
    off = sides(predicted, gold, key, scope).where(F.col("in_pred") != F.col("in_gold"))
    return off.select(*scope, *key, F.when(F.col("in_gold") == 1, "missed").otherwise("spurious").alias("side")).orderBy("side", *scope, *key)


def corpus_table(predicted: DataFrame, gold: DataFrame, scope: str = "filing_id", key: Sequence[str] = KEY) -> DataFrame:
    """scope, n_predicted, n_gold, line: one printed line per filing with predictions; without gold it says so."""
    n = predicted.groupBy(scope).agg(F.count(F.lit(1)).alias("n_predicted"))
    g = gold.groupBy(scope).agg(F.count(F.lit(1)).alias("n_gold"))
    s = scores(sides(predicted, gold, key, [scope]), [scope]).select(scope, "precision", "recall", "f1")
    j = n.join(g, scope, "left").join(s, scope, "left")
    figures = F.format_string("P=%.3f R=%.3f F1=%.3f", "precision", "recall", "f1")
    shown = F.format_string("%-40s %5d %5s  %s", F.substring(F.col(scope).cast("string"), 1, 40), "n_predicted", F.coalesce(F.col("n_gold").cast("string"), F.lit("—")), F.when(F.col("n_gold").isNotNull(), figures).otherwise("no gold set"))
    return j.select(scope, "n_predicted", "n_gold", shown.alias("line"))


def rank_quality(ranks: DataFrame, k: int = 5) -> DataFrame:
    """Mean nDCG@k (one relevant item) and MRR over queries given the first relevant ``rank`` (null if none)."""
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return ranks.agg(F.round(F.avg(gain), 4).alias("ndcg"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))
