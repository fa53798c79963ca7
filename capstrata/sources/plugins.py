"""Boundaries to what is not relational: PDF layout, OCR and language models are injected callables.

Each runs in ``mapInPandas`` over its own rows, so one document is one unit of work and of retry. Without a callable
every boundary has a defined offline result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_markdown
from ..session import cut_lineage
from .json_events import events_of

#: A page with less text than this and an image is a scan; pages sent to a model at most.
SCAN_CHARS, MODEL_PAGES = 50, 30
#: Fixed value: attempts at a model call; seconds before the second.
ATTEMPTS, WAIT = 2, 1.0

PAGES = "page_number int, text string, ocr_used boolean, confidence double"


def pdf_pages(files: DataFrame, reader: Callable[[bytes], list[tuple[str, int]]] | None = None, ocr: Callable[[bytes, int], tuple[str, float]] | None = None, key: str = "path") -> DataFrame:
    """key + PAGES of ``binaryFile`` rows. ``reader`` gives (text, images) per page; a page that is a scan goes to
    ``ocr``, or is empty with confidence 0 where there is none. Without a reader there are no pages."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b[key], b["content"]):
                for n, (text, images) in enumerate(reader(bytes(content)) if reader else [], 1):
                    scanned = len((text or "").strip()) < SCAN_CHARS and images > 0
                    text, conf = (ocr(bytes(content), n) if ocr else ("", 0.0)) if scanned else (text or "", 1.0)
                    out.append((path, n, text, scanned, float(conf)))
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in PAGES.split(", ")]])

    return files.select(key, "content").mapInPandas(scan, f"`{key}` string, {PAGES}")


def word_confidence(words: DataFrame, key: str, text: str = "text", conf: str = "conf") -> DataFrame:
    """Mean confidence (0 to 1, 4 places) of the words of each page that are not blank and have one; 0 if none."""
    kept = F.when((F.trim(text) != "") & (F.col(conf) >= 0), F.col(conf))
    return words.groupBy(key).agg(F.round(F.coalesce(F.avg(kept) / 100, F.lit(0.0)), 4).alias("confidence"))


def model_events(pages: DataFrame, model: Callable[[str], str] | None, relevant, key: str = "filing_id", limit: int = MODEL_PAGES) -> DataFrame:
    """key, page_number, text: the model's answer for the first relevant pages of each filing. A failing page is left
    out; without a model there are no rows. The answers are read by ``json_events.events_of``."""
    from pyspark.sql import Window

    kind = pages.schema[key].dataType.simpleString()
    first = pages.where(relevant).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("page_number"))).where(F.col("__n") <= limit)
    tagged = first.select(key, "page_number", F.concat(F.lit("[PAGE "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text")).alias("text"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, text in zip(b[key], b["page_number"], b["text"]):
                try:
                    if model:
                        out.append((k, n, retried(model, text)))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=[key, "page_number", "text"])

    return tagged.mapInPandas(ask, f"`{key}` {kind}, page_number int, text string")


def retried(call: Callable, *args, attempts: int = ATTEMPTS, wait: float = WAIT):
    """The call's answer; a failure is tried again after ``wait`` seconds, doubled each time, and the last one raised."""
    for n in range(attempts):
        try:
            return call(*args)
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(wait * 2**n)


def model_event_rows(pages: DataFrame, model: Callable[[str], str] | None, relevant, key: str = "filing_id", limit: int = MODEL_PAGES) -> DataFrame:
    """Events in the model's answers, with their page and the method "llm"."""
    told = model_events(pages, model, relevant, key, limit)
    rows = events_of(told.select(F.struct(key, "page_number").alias("__k"), "text"), "__k")
    page = F.coalesce("page_number", F.col("__k.page_number"))
    made = F.struct(page.alias("page"), F.col("source_provenance.section").alias("section"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("llm").alias("extraction_method"), F.col("confidence").alias("confidence"))
    return rows.select(F.col(f"__k.{key}").alias(key), "pos", "event_type", "date", "shares", "ratio", "new_capital", "old_capital", page.alias("page_number"), "source_snippet", "confidence", made.alias("source_provenance"))


CHARS = "page_num int, n int, text string, size double, top double"
GRIDS = "page_num int, strategy string, table_no int, bbox array<double>, cells array<array<string>>"


def page_layouts(files: DataFrame, layout: Callable[[bytes], list[dict]], key: str = "filing_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(characters, grids, page texts) of ``binaryFile`` rows. ``layout`` gives per page a dict of text, chars (text, size,
    top) and lines / aligned, the tables (bbox, rows) that ruled lines and alignment show. Files are laid out once."""
    page = "page_num int, text string, chars array<struct<n: int, text: string, size: double, top: double>>, grids array<struct<strategy: string, table_no: int, bbox: array<double>, cells: array<array<string>>>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, content in zip(b[key], b["content"]):
                number = 0
                for p, x in enumerate(layout(bytes(content)), 1):
                    grids = []
                    for strategy, name in (("lines", "lines"), ("text", "aligned")):
                        for box, rows in x.get(name) or []:
                            grids.append({"strategy": strategy, "table_no": number, "bbox": [float(v) for v in box], "cells": rows})
                            number += 1
                    chars = [{"n": i, "text": c[0], "size": float(c[1]), "top": float(c[2])} for i, c in enumerate(x.get("chars") or [])]
                    out.append((k, p, x.get("text") or "", chars, grids))
            yield pd.DataFrame(out, columns=[key, "page_num", "text", "chars", "grids"])

    pages = cut_lineage(files.select(key, "content").mapInPandas(scan, f"`{key}` string, {page}"))
    return pages.select(key, "page_num", F.inline("chars")), pages.select(key, "page_num", F.inline("grids")), pages.select(key, "page_num", "text")


def narrative(report: str, model: Callable[[str], str] | None) -> tuple[str, str]:
    """(text, mode): the model's telling of a brief, or the brief itself where there is no model or it fails."""
    if model:
        try:
            return retried(model, report), "llm"
        except Exception:  # noqa: BLE001
            pass
    return report, "extractive"


def told(briefs: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Adds ``narrative`` and ``mode`` to rows with ``markdown``."""

    @F.pandas_udf("narrative string, mode string")
    def tell(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([narrative(x, model) for x in text], columns=["narrative", "mode"])

    return briefs.withColumn("__n", tell("markdown")).select(*briefs.columns, "__n.narrative", "__n.mode")


def admissible(files: DataFrame, max_bytes: int = 40_000_000, page_count: Callable[[bytes], int] | None = None, max_pages: int = 300) -> DataFrame:
    """Files with a status: 400 for other than PDF and Markdown (by suffix or a ``mime`` column), 413 for too large or, by
    ``page_count``, a PDF of too many pages (one that cannot be counted passes), else 200."""
    name = F.lower("path")
    mime = F.lower("mime") if "mime" in files.columns else F.lit(None).cast("string")
    is_pdf = name.endswith(".pdf") | F.coalesce(mime == "application/pdf", F.lit(False))
    pages = F.lit(0)
    if page_count:

        @F.pandas_udf("int")
        def counted(content: pd.Series) -> pd.Series:
            def one(x: bytes) -> int:
                try:
                    return page_count(bytes(x))
                except Exception:  # noqa: BLE001
                    return 0

            return content.map(one)

        pages = F.when(is_pdf & (F.col("length") <= max_bytes), counted("content")).otherwise(0)
    status = F.when(~(is_pdf | is_markdown(F.col("path"), mime)), 400).when((F.col("length") > max_bytes) | (pages > max_pages), 413).otherwise(200)
    return files.withColumn("status", status)
