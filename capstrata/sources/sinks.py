"""Writing results: extraction files, the flat CSV, quarantine, the search index, resumable chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import drop_repeats
from ..operators.quality import CSV_FIELDS, validate
from ..operators.retrieval import bm25_index, postings, term_stats
from ..session import cut_lineage


def extraction_documents(events: DataFrame, key: str = "filing_id", order: str = "pos", meta: DataFrame | None = None) -> DataFrame:
    """key, value: one JSON document per filing with its events in order. A filing is a document's worth of rows. ``meta``
    (key and further columns, as total_pages and model) adds its fields before the events."""
    event = F.struct(F.col(order), F.struct(*[c for c in events.columns if c not in (key, order)]).alias("e"))
    lists = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.to_json(event["e"]).alias("j")))), lambda x: x["j"]).alias("j"))
    head = F.lit("")
    if meta is not None:
        lists = lists.join(meta.select(key, F.struct(*[c for c in meta.columns if c != key]).alias("__meta")), key, "left")
        head = F.coalesce(F.concat(F.lit(","), F.nullif(F.regexp_replace(F.to_json("__meta"), "^\\{|\\}$", ""), F.lit(""))), F.lit(""))
    return lists.select(key, F.concat(F.lit('{"source_file":'), F.concat(F.lit('"'), F.regexp_replace(F.col(key).cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"')), head, F.lit(',"capital_events":['), F.array_join("j", ","), F.lit("]}")).alias("value"))


def write_extractions(events: DataFrame, path: str, key: str = "filing_id") -> None:
    extraction_documents(events, key).select("value").write.mode("overwrite").text(path)


def write_csv(events: DataFrame, path: str) -> None:
    """The fixed columns in order; missing ones are empty, others are left out."""
    columns = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in CSV_FIELDS]
    events.select(*columns).write.mode("overwrite").option("header", True).options(emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def postprocess(raw: DataFrame, path: str, order: str = "pos", meta: DataFrame | None = None) -> None:
    """Validates, sets aside what does not fit, drops repeats, and writes clean, flat and quarantined output; with ``meta``
    (filing_id and further columns) also the clean events as documents that carry it."""
    checked = validate(raw)
    checked.where("not is_valid").write.mode("overwrite").json(f"{path}/invalid")
    clean = drop_repeats(checked.where("is_valid").drop("is_valid", "error"), order)
    clean.write.mode("overwrite").json(f"{path}/clean")
    write_csv(clean, f"{path}/flat")
    if meta is not None:
        extraction_documents(clean, order=order, meta=meta).select("value").write.mode("overwrite").text(f"{path}/documents")


def write_index(corpus: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Corpus, postings and term statistics as tables, replaced as a whole; postings are clustered by term, so a lookup
    reads only the files and row groups of its terms (``retrieval.bm25_index``)."""
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    kept = corpus.sparkSession.read.parquet(f"{path}/corpus")
    postings(kept, key, F.col(text)).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    posts = corpus.sparkSession.read.parquet(f"{path}/postings")
    term_stats(posts, kept).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/stats")


def indexed_search(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``bm25`` of the queries over a written index."""
    return bm25_index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), queries, k, key)


def index_is_stale(spark: SparkSession, path: str, corpus: DataFrame) -> bool:
    """Whether the stored corpus has another number of rows."""
    return spark.read.parquet(f"{path}/corpus").count() != corpus.count()


def page_slice(pages: DataFrame, start: int = 1, most: int = 0, page: str = "page_number") -> DataFrame:
    """Pages from ``start`` on, ``most`` of them (0: all)."""
    kept = pages.where(F.col(page) >= start)
    return kept.where(F.col(page) < start + most) if most else kept


def reordered(df: DataFrame, first: list[str]) -> DataFrame:
    """Named columns first, as far as there are any, then the rest."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def resume(chunks: DataFrame, process, path: str, key: str = "chunk_id") -> DataFrame:
    """Results of ``process(chunks)`` (which keeps ``key``) for all chunks: those without a result below ``path`` are
    processed and added, so a run that failed half-way goes on there. A chunk is done once its row in ``done`` is written,
    after its results; results written twice for one chunk are those of the last attempt."""
    spark = chunks.sparkSession
    attempt = uuid.uuid4().hex
    schema = f"`{key}` {chunks.schema[key].dataType.simpleString()}, attempt string"
    done = _stored(spark, f"{path}/done")
    left = cut_lineage(todo(chunks, done, key) if done is not None else chunks)
    process(left).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{path}/results")
    left.select(key, F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{path}/done")
    results, done = spark.read.parquet(f"{path}/results"), spark.read.schema(schema).parquet(f"{path}/done")
    return results.join(done.distinct(), [key, "attempt"], "left_semi").drop("attempt")


def partial(spark: SparkSession, path: str) -> DataFrame | None:
    """What a failed run has written so far; null if nothing."""
    return _stored(spark, f"{path}/results")


def cleanup(spark: SparkSession, path: str) -> None:
    """Removes the chunks' results, once the whole is written elsewhere."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None


def todo(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a result yet."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")
