"""Extraction files (JSON) as event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event columns read from extraction files; page_number falls back on its alias page.
EVENT = (
    "event_type string, date string, shares bigint, face_value double, issue_price string, consideration string, allottee_category string, ratio string, shares_issued bigint, "
    "pre_issue_capital bigint, post_issue_capital bigint, price double, shares_offered bigint, old_capital bigint, new_capital bigint, resolution_type string, amount_per_share double, "
    "record_date string, payment_date string, total_outflow bigint, shares_bought_back bigint, remaining_buyback_authority bigint, warrants_exercised bigint, exercise_price double, "
    "page_number int, page int, source_snippet string, confidence double, synthetic boolean, bbox array<double>, "
    "source_provenance struct<page: int, section: string, bbox: array<double>, extraction_method: string, confidence: double>"
)


def events_of(files: DataFrame, key: str = "filing_id", text: str = "text") -> DataFrame:
    """key, pos and the event columns of JSON texts: an object with ``capital_events``, or a bare list of events.

    Numbers keep their written form in ``issue_price``. Texts that are no JSON, or hold no events, give no row.
    """
    body = F.trim(F.regexp_replace(F.col(text), "^\\s*```(?:json)?\\s*|\\s*```\\s*$", ""))
    wrapped = F.from_json(F.when(body.startswith("{"), body), f"struct<capital_events: array<struct<{_ddl(EVENT)}>>>")["capital_events"]
    listed = F.from_json(F.when(body.startswith("["), body), f"array<struct<{_ddl(EVENT)}>>")
    rows = files.select(key, F.posexplode(F.coalesce(wrapped, listed)).alias("pos", "e"))
    out = rows.select(key, F.col("pos").cast("bigint").alias("pos"), "e.*")
    return out.withColumn("page_number", F.coalesce("page_number", "page"))


def meta_of(files: DataFrame, key: str = "filing_id", text: str = "text") -> DataFrame:
    """key, meta: the top-level fields of JSON objects besides their events, as texts; an empty map for a bare list."""
    fields = F.from_json(F.when(F.trim(F.col(text)).startswith("{"), F.col(text)), "map<string, string>")
    kept = F.map_filter(fields, lambda k, v: k != "capital_events")
    return files.select(key, F.coalesce(kept, F.create_map().cast("map<string,string>")).alias("meta"))


def _ddl(fields: str) -> str:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            parts.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(parts)


def read_events(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Events of every extraction file under a path, one document per file or per line; filing_id is the document's
    source_file, else the file's own path."""
    files = spark.read.text(path, wholetext=not per_line).select(F.coalesce(F.get_json_object("value", "$.source_file"), F.col("_metadata.file_path")).alias("filing_id"), F.col("value").alias("text"))
    return events_of(files)
