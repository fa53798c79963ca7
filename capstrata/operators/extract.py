"""Capital events from table rows: column families, guards, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cell_date, is_iso
from ..functions.headers import NEEDLES
from ..functions.numbers import cell_amount, cell_count
from ..functions.text import norm
from .dedup import merge_extractions

#: Least authorised capital believed, confidence of table rows, characters of a snippet.
LEAST_CAPITAL, CONFIDENCE, SNIPPET = 100_000, 0.95, 200

EVENT_FIELDS = {
    "event_type": "string", "date": "string", "shares": "bigint", "face_value": "double", "issue_price": "double", "consideration": "string", "ratio": "string",
    "price": "double", "shares_offered": "bigint", "shares_issued": "bigint", "old_capital": "bigint", "new_capital": "bigint", "resolution_type": "string",
}


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def table_events(rows: DataFrame, key: str = "filing_id") -> DataFrame:
    """Events of parsed table rows (sources.markdown.TABLE_ROWS): key, pos, EVENT_FIELDS and provenance.

    Per row the first family that succeeds wins: authorised capital, then bonus or rights, then allotment.
    """
    number = {n: i for i, n in enumerate(NEEDLES)}
    place = lambda n: F.get("places", F.lit(number[n]))
    # Through a generator, so that the filters below do not pick the cells again.
    picked = F.inline(F.array(F.struct(*[F.get("cells", place(n)).alias(f"c_{n}") for n in NEEDLES], *[place(n).isNotNull().alias(f"h_{n}") for n in NEEDLES], F.coalesce(F.get("headers", place("shares")), F.lit("")).alias("share_header"), F.array_join("headers", " ").alias("header_text"))))
    box = F.col("bbox") if "bbox" in rows.columns else F.lit(None).cast("array<double>")
    df = rows.select(key, "page_num", "section", "table_no", "row_no", "raw_text", "row_text", F.when(F.size(box) > 0, box).alias("bbox"), picked)
    c = lambda n: F.col(f"c_{n}")
    has = lambda n: F.col(f"h_{n}")
    resolution = F.nullif(norm(c("resolution")), F.lit(""))

    old, new = cell_count(c("from")), cell_count(c("to"))
    is_capital = has("from") & has("to") & old.isNotNull() & (new >= LEAST_CAPITAL)
    context = norm(F.concat(F.coalesce("section", F.lit("")), F.lit(" "), F.col("header_text")))
    is_ratio = has("ratio") & (has("record") | has("allot_date")) & F.coalesce(c("ratio").rlike("(?U)\\d[\\d,]*\\s*:\\s*\\d[\\d,]*"), F.lit(False))
    share_header = F.col("share_header")
    other_kind = ~share_header.contains("equity") & share_header.rlike("preference|ccps|ccp|warrant|debenture")
    primary = ~has("transaction") | norm(c("transaction")).contains("allotment")
    is_allotment = has("allot_date") & has("shares") & ~other_kind & primary & cell_count(c("shares")).isNotNull()
    family = (
        F.when(is_capital, "authorised_capital_change")
        .when(is_ratio, F.when(context.contains("rights") & ~context.contains("bonus"), "rights_issue").otherwise("bonus_issue"))
        .when(is_allotment, "allotment")
    )
    df = df.withColumn("event_type", family).where("event_type is not null")
    kind = F.col("event_type")
    # One date cell is read per row, whichever family it is.
    text = F.when(kind == "authorised_capital_change", F.coalesce(_filled(c("date")), c("resolution"))).when(kind == "allotment", c("allot_date")).otherwise(F.coalesce(_filled(c("record")), c("date")))
    df = df.withColumn("date", cell_date(text)).where((kind != "allotment") | is_iso(F.col("date")))
    only = lambda t, x: F.when(kind == t, x)
    amount, count = cell_amount(c("price")), cell_count(c("shares"))
    fields = {
        "shares": only("allotment", count), "face_value": only("allotment", cell_amount(c("face"))), "issue_price": only("allotment", amount),
        "consideration": only("allotment", F.nullif(norm(c("consideration")), F.lit(""))), "ratio": F.when(kind.isin("rights_issue", "bonus_issue"), F.regexp_replace(c("ratio"), "(?U)\\s+", "")),
        "price": only("rights_issue", amount), "shares_offered": only("rights_issue", count), "shares_issued": only("bonus_issue", count),
        "old_capital": only("authorised_capital_change", old), "new_capital": only("authorised_capital_change", new), "resolution_type": only("authorised_capital_change", resolution),
    }
    # A row that became an event has text; the raw text of its table, which Markdown tables keep with their first row only, serves rows without.
    row_text = F.col("row_text")
    snippet = F.nullif(F.substring(F.when(row_text != "", row_text).otherwise(F.col("raw_text")), 1, SNIPPET), F.lit(""))
    return df.select(
        key, (F.shiftleft(F.col("table_no").cast("bigint"), 32) + F.col("row_no")).alias("pos"), "event_type", "date", *[fields[n].cast(t).alias(n) for n, t in EVENT_FIELDS.items() if n in fields], F.col("page_num").alias("page_number"), snippet.alias("source_snippet"),
        F.col("page_num").alias("page"), "bbox", F.lit(CONFIDENCE).alias("confidence"),
        F.struct(F.col("page_num").alias("page"), F.nullif("section", F.lit("")).alias("section"), "bbox", F.lit("table").alias("extraction_method"), F.lit(CONFIDENCE).alias("confidence")).alias("source_provenance"),
    )


def extract_events(docs: DataFrame, key: str = "filing_id", text: str = "text") -> DataFrame:
    """Tables of Markdown documents to events, each event once per document (the last statement of it)."""
    from ..sources.markdown import parse_tables

    events = table_events(parse_tables(docs, key, text), key)
    return merge_extractions(events, events.limit(0), scope=[key])
