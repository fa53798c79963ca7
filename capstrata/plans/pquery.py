"""Queries of the general training-data problems (units, timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amounts, timestamps
from ..session import cut_lineage, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cells = amounts.amounts_in_paise(table(spark, d, "sample_events"), table(spark, d, "filings"))
    return cells.where("not is_bare and paise is not null").select("event_id", "field_name", "paise")


def p2_unit_shifts(spark: SparkSession, d: str) -> DataFrame:
    """What levels find by themselves, per field and by what states the unit: cells, segments, cells whose unit by level is
    the stated one, cells in another unit than rupees, those that levels put there, and those they put there rightly.

    Every cell of the four fields with a positive number takes part. A history is an issuer's cells of a field in order of
    arrival; its baseline is the median of the numbers as written, so no statement of a unit enters the search."""
    events = table(spark, d, "sample_events")
    cells = amounts.amounts_in_paise(events, table(spark, d, "filings")).where("written > 0 and paise > 0")
    cells = cells.join(events.select("event_id", "issuer_id"), "event_id").withColumn("history", F.concat_ws(" ", "field_name", F.col("issuer_id").cast("string")))
    slot = F.col("event_id") * len(amounts.FIELDS) + F.array_position(F.array(*[F.lit(f) for f in amounts.FIELDS]), F.col("field_name")) - 1
    cells = cut_lineage(cells.select("history", "field_name", "unit_from", slot.alias("slot"), F.log10("written").alias("log"), F.log10(F.col("paise") / 100).alias("stated")))
    usual = cells.groupBy("history").agg(F.percentile_approx("log", 0.5, 1000).alias("usual"))
    offsets = cells.join(usual, "history").withColumn("offset", F.col("log") - F.col("usual"))
    levels = amounts.unit_levels(offsets, "history", "slot", "offset").select("slot", "level", "segment_start")
    j = levels.join(cells, "slot").withColumn("agrees", F.abs(F.col("level") - (F.col("stated") - F.col("log"))) < 0.5)
    scaled = F.abs(F.col("stated") - F.col("log")) >= 0.5
    return j.groupBy("field_name", "unit_from").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("segment_start").alias("n_segments"), F.count_if("agrees").alias("n_agree"),
        F.count_if(scaled).alias("n_scaled"), F.count_if(F.col("level") != 0).alias("n_claimed"), F.count_if(scaled & F.col("agrees")).alias("n_right"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = timestamps.normalise_moments(table(spark, d, "sample_events"), table(spark, d, "filings"))
    return cells.where("normal_form is not null and cell <> normal_form").select("event_id", "field_name", "normal_form")


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    cells = timestamps.normalise_moments(table(spark, d, "sample_events"), table(spark, d, "filings"))
    return cells.groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("n_cells"))


QUERIES = {f.__name__: f for f in (p2_found, p2_unit_shifts, p5_found, p5_status)}
