"""Command line: ``python -m capstrata extract|postprocess|evaluate|corpus|search ...``. Tables are Parquet or JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .api import Engine
from .operators import evaluate
from .session import get_session
from .sources import json_events, sinks


def _events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else json_events.read_events(spark, path)


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """Runs one command; what it shows is returned as a table."""
    parser = argparse.ArgumentParser("capstrata")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("extract", help="events in the Markdown filings of a folder, one document per filing")
    p.add_argument("folder"), p.add_argument("out"), p.add_argument("--first-page", type=int, default=1), p.add_argument("--pages", type=int, default=0)
    p = commands.add_parser("postprocess", help="validates, sets aside, drops repeats; writes clean, flat and invalid")
    p.add_argument("events"), p.add_argument("out")
    for name in ("evaluate", "corpus"):
        p = commands.add_parser(name, help="predicted events against gold ones" + (", per filing" if name == "corpus" else ""))
        p.add_argument("predicted"), p.add_argument("gold")
    p = commands.add_parser("search", help="the events nearest to a query")
    p.add_argument("events"), p.add_argument("query"), p.add_argument("--k", type=int, default=5), p.add_argument("--vectors-only", action="store_true")
    a = parser.parse_args(argv)
    if a.command == "extract":
        engine = Engine(spark)
        out = engine.ingest(a.folder, "cli")
        sinks.write_extractions(sinks.page_slice(engine.jobs["cli"], a.first_page, a.pages), a.out)
        return out
    if a.command == "postprocess":
        sinks.postprocess(_events(spark, a.events), a.out)
        return None
    if a.command == "search":
        engine = Engine(spark)
        engine.index(_events(spark, a.events))
        return engine.search(a.query, a.k, vectors_only=a.vectors_only).select("rank", "event_id", "score", "strategy", "text")
    predicted, gold = _events(spark, a.predicted), _events(spark, a.gold)
    return evaluate.corpus_table(predicted, gold).select("line") if a.command == "corpus" else evaluate.evaluate(predicted, gold)


def main() -> None:
    import sys

    shown = run(get_session(app="capstrata"), sys.argv[1:])
    if shown is not None:
        shown.show(50, truncate=False)


if __name__ == "__main__":
    main()
