"""The engine behind one object: index, search, ask, verify, report, ingest, events, stats, health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import CAPITAL_SIGNALS, mentions
from .operators import quality, report, retrieval, verify
from .operators.dedup import merge_extractions
from .operators.evaluate import INGEST_METHOD
from .operators.extract import table_events
from .operators.layout import page_table_rows
from .session import cut_lineage, new_job
from .sources import markdown
from .sources.plugins import admissible, model_event_rows, page_layouts, told


class Engine:
    """One live corpus of capital events. Results are DataFrames; every ordered one carries ``rank`` or ``pos``."""

    def __init__(self, spark: SparkSession, embed: Callable[[Column], Column] = retrieval.hash_embedding):
        self.spark, self.embed = spark, embed
        self.corpus: DataFrame | None = None
        self.jobs: dict[str, DataFrame] = {}
        self.last_ingest: str | None = None
        self.ocr_available = False

    def index(self, events: DataFrame) -> int:
        """Makes ``events`` (with pos) the corpus, replacing what was there; returns their number."""
        own = F.nullif(F.col("event_id").cast("string"), F.lit("")) if "event_id" in events.columns else F.lit(None).cast("string")
        named = events.withColumn("event_id", F.coalesce(own, F.concat(F.lit("event-"), F.col("pos").cast("string"))))
        text = retrieval.event_text(named)
        sparse = F.concat_ws(" ", text, F.col("source_snippet")) if "source_snippet" in events.columns else text
        self.corpus = cut_lineage(named.withColumn("text", text).withColumn("sparse_text", sparse))
        return self.corpus.count()

    def _live(self) -> DataFrame:
        if self.corpus is None:
            raise ValueError("nothing is indexed")
        return self.corpus

    def health(self) -> dict:
        n = self.corpus.count() if self.corpus is not None else 0
        return {"status": "ok", "indexed": n, "retrieval": "hybrid" if n else "none", "ocr": self.ocr_available, "last_ingest": self.last_ingest}

    def stats(self) -> DataFrame:
        return self._live().groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))

    def events(self, event_type: str | None = None, limit: int = 100) -> DataFrame:
        return quality.listed(self._live(), limit, "pos", event_type)

    def search(self, query: str, k: int = retrieval.TOP, weight: float | None = None, vectors_only: bool = False) -> DataFrame:
        if not query or not query.strip():
            raise ValueError("the query is blank")
        q = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        hits = retrieval.vector_search(self._live(), q, k, "event_id", "text", embed=self.embed) if vectors_only else retrieval.search(self._live(), q, k, "event_id", "text", embed=self.embed, weight=weight, sparse_text="sparse_text")
        return hits.join(self._live().drop("sparse_text"), "event_id").drop("query_id").orderBy("rank")

    def ask(self, question: str, mode: str = "extractive", model: Callable[[str, list], str] | None = None) -> dict:
        """Answer with the events it rests on; the model, if any, sees only those. A failing model falls back."""
        if mode not in ("extractive", "llm"):
            raise ValueError("mode is extractive or llm")
        hits = self.search(question).withColumn("query_id", F.lit(1))
        kept = retrieval.graded(hits).orderBy("rank").collect()  # at most k rows
        answer = retrieval.NO_MATCH
        if kept:
            answer = "\n".join([retrieval.MATCHES, *[f"  - {h['text']} (match {h['score']})" for h in kept]])
            if mode == "llm" and model:
                try:
                    answer = model(question, [h.asDict() for h in kept])
                except Exception:  # noqa: BLE001
                    pass
        pages = [(h["event_id"], h["page_number"], h["source_snippet"]) for h in kept if h.asDict().get("page_number") is not None and h.asDict().get("source_snippet") is not None]
        return {"question": question, "answer": answer, "mode": mode, "citations": [h.asDict() for h in kept], "page_citations": pages, "strategy": kept[0]["strategy"] if kept else "vector"}

    def verify(self, scope: tuple[str, ...] = ("filing_id",), event_type: str | None = None) -> DataFrame:
        return verify.verify(self._live(), scope, event_type)

    def report(self, title: str = "Capital history", scope: str = "filing_id", model: Callable[[str], str] | None = None) -> DataFrame:
        """scope, part, markdown of each brief. With a model, also ``narrative`` and ``mode``: its telling of each part,
        or the part itself where it fails."""
        out = report.brief(self._live(), verify.verify(self._live(), (scope,)), scope, title)
        return told(out, model) if model else out

    def ingest(self, path: str, job: str | None = None, layout: Callable[[bytes], list[dict]] | None = None, model: Callable[[str], str] | None = None) -> DataFrame:
        """Extracts the files under a path and returns the job's record: job, method, n_events, n_pages.

        Markdown is parsed; PDF pages come from ``layout`` (see plugins.page_layouts), without which they give nothing.
        Pages with capital signals go to ``model``, if any; its events yield to those of tables. A file that is not
        admitted is an error that names its status.
        """
        job = job or new_job()
        files = admissible(self.spark.read.format("binaryFile").load(path))
        refused = files.where("status <> 200").select("path", "status").limit(10).collect()
        if refused:
            raise ValueError(f"not admitted: {[(r.path, r.status) for r in refused]}")
        docs = markdown.read_markdown(self.spark, path)
        tables = table_events(markdown.parse_tables(docs))
        pages = markdown.split_pages(docs)
        if layout:
            pdf = files.where(F.lower("path").endswith(".pdf")).withColumnRenamed("path", "filing_id")
            chars, grids, texts = page_layouts(pdf, layout)
            tables = tables.unionByName(table_events(page_table_rows(chars, grids, texts)))
            pages = pages.unionByName(texts.select("filing_id", F.col("page_num").alias("page_number"), "text"))
        told = model_event_rows(pages, model, mentions(F.col("text"), CAPITAL_SIGNALS))
        self.jobs[job] = cut_lineage(merge_extractions(tables, told, scope=["filing_id"]))
        self.last_ingest = job
        n = self.jobs[job].groupBy(F.coalesce("source_provenance.extraction_method", F.lit(INGEST_METHOD)).alias("method")).agg(F.count(F.lit(1)).alias("n_events"))
        return n.join(F.broadcast(pages.agg(F.count(F.lit(1)).alias("n_pages")))).select(F.lit(job).alias("job"), "method", "n_events", "n_pages")  # one row of pages

    def ingest_index(self, job: str) -> int:
        """Makes a finished ingest the corpus."""
        if job not in self.jobs:
            raise KeyError(job)
        if not self.jobs[job].head(1):
            raise ValueError("the ingest found no events")
        return self.index(self.jobs[job])
