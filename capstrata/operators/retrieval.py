"""Hybrid retrieval over a query table: BM25, exact vectors, weighted reciprocal-rank fusion, graded answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import alpha, rendered, tokens, truthy
from ..session import cut_lineage
from .evaluate import rank_quality

#: Fixed values of the published Okapi variant and of the fusion.
K1, B, EPSILON, RRF, DECAY, FLOOR, TOP = 1.5, 0.75, 0.25, 60, 0.1, 0.15, 5
#: Queries held by every worker at once, and products computed at once (8 bytes each); larger query sets take several passes.
QUERY_BLOCK, PRODUCTS = 4096, 1 << 23


def event_text(df: DataFrame) -> Column:
    """An event as one searchable sentence; empty and zero figures are left out."""
    kind = lambda c: df.schema[c].dataType.simpleString()
    def bit(c: str, before: str, after: str = "") -> Column:
        return F.when(truthy(F.col(c), kind(c)), F.concat(F.lit(before), rendered(F.col(c), kind(c)), F.lit(after))) if c in df.columns else F.lit(None).cast("string")

    capital = F.lit(None).cast("string")
    if "new_capital" in df.columns:
        old = F.coalesce(rendered(F.col("old_capital"), kind("old_capital")), F.lit("None"))
        capital = F.when(truthy(F.col("new_capital"), kind("new_capital")), F.concat(F.lit("authorised capital "), old, F.lit(" to "), rendered(F.col("new_capital"), kind("new_capital"))))
    return F.concat_ws(
        ", ", F.translate(F.coalesce("event_type", F.lit("event")), "_", " "), bit("date", "on "), bit("allottee_category", "to "), bit("shares", "", " shares"), bit("ratio", "ratio "),
        bit("issue_price", "at price "), bit("consideration", "for "), capital, bit("resolution_type", "via "), bit("amount_per_share", "dividend ", " per share"),
        bit("shares_bought_back", "bought back ", " shares"), bit("warrants_exercised", "", " warrants exercised"), bit("exercise_price", "exercise price "),
    )


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, dl, term, tf of every text."""
    t = docs.select(key, tokens(F.coalesce(text, F.lit(""))).alias("__t")).withColumn("dl", F.size("__t"))
    return t.select(key, "dl", F.explode("__t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf, avgdl: negative idf is replaced by EPSILON times the mean idf of all terms. Texts without a token
    count as documents of length 0."""
    sizes = docs.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))))  # one row each
    return _statistics(posts, sizes)


def top_k(scored: DataFrame, query: str, key: str, k: int, by: Sequence[Column] | None = None) -> DataFrame:
    """The k best rows per query with ``rank`` from 1; ties by the key as text. The row-number filter is pushed below
    the shuffle as a group limit, so each task sends at most k rows per query."""
    order = list(by or [F.col("score").desc()]) + [F.col(key).cast("string")]
    w = Window.partitionBy(query).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """query, key, score, rank: Okapi BM25 with repeated query terms counted each time; scores of 0 or less do not
    rank. Scores are rounded to 6 places before ranking. Postings are made and dropped; where they are kept
    (``sinks.write_index``), ``bm25_index`` reads only what the queries name."""
    t = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    wanted = queries.select(query, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qn"))
    # Written once: of each text its length and how often it holds each term, without the text.
    posts = cut_lineage(t.select(key, F.size("__t").alias("dl"), F.explode_outer("__t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    sizes = posts.groupBy(key, "dl").agg(F.count(F.lit(1))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    return _ranked(posts.where("term is not null"), sizes, wanted, k, key, query)


def bm25_index(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """``bm25`` over stored postings (term, key, dl, tf; clustered by term) and their ``term_stats`` table. Terms of the
    queries reach both scans as a run-time filter through the join, so other terms are not read from clustered files."""
    wanted = queries.select(query, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qn"))
    return _scored(postings, wanted.join(stats, "term"), k, key, query)


def _ranked(posts: DataFrame, sizes: DataFrame, wanted: DataFrame, k: int, key: str, query: str) -> DataFrame:
    return _scored(posts, wanted.join(_statistics(posts, sizes), "term"), k, key, query)


def _statistics(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    n = F.broadcast(sizes.select("n", (F.col("total") / F.col("n")).alias("avgdl")))  # one row
    raw = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(n).withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", "avgdl", F.when(F.col("idf0") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf0")).alias("idf"))


def _scored(posts: DataFrame, terms: DataFrame, k: int, key: str, query: str) -> DataFrame:
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = posts.join(terms, "term").groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scored, query, key, k).where("score > 0")


def hash_embedding(text: Column) -> Column:
    """Deterministic stand-in for a model: the 32 bytes of the lower-cased text's SHA-256, each divided by 255."""
    digest = F.sha2(F.lower(F.coalesce(text, F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", block: int = QUERY_BLOCK, cells: str | None = None) -> DataFrame:
    """query, key, distance, rank: exact squared-L2 nearest rows of a stated query set, block by block.

    Each task multiplies its rows with a block of queries, a slice at a time, and keeps its k best per query, so it holds
    and sends on at most queries x k rows however many it reads. Distances are rounded to 9 places; ties go by the key
    as text. Null vectors match nothing. With ``cells``, both sides have this array column and a query only meets
    rows that share an element with it (see ``nearest_cells``).
    """
    spark = vectors.sparkSession
    kind, key_kind = queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    arrow, key_arrow = to_arrow_type(queries.schema[query].dataType), to_arrow_type(vectors.schema[key].dataType)
    held = queries.select(query, vector, *([cells] if cells else [])).where(F.col(vector).isNotNull())
    total = held.count()
    # Blocks by hash; about even, and none is numbered through one task.
    parts = -(-total // block)
    passes = []
    for i in range(parts):
        rows = (held.where(F.pmod(F.xxhash64(query), F.lit(parts)) == i) if parts > 1 else held).collect()  # about one block
        if not rows:
            continue
        rows.sort(key=lambda r: r[0])
        q = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), [set(r[2] or ()) for r in rows] if cells else None))

        def scan(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            ids, m, own = q.value
            best, mine_of = _Best(len(ids), k), {}
            for j, o in enumerate(own or []):
                for c in o:
                    mine_of.setdefault(c, []).append(j)
            for b in batches:
                lists = b.column(1)
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, m.shape[1]))
                keys = np.array(b.column(0).to_pylist(), dtype=object)
                if own is None:
                    best.add(m, np.arange(len(ids)), x, keys)
                else:
                    rows_of: dict = {}
                    for j, cs in enumerate(b.column(2).to_pylist()):
                        for c in cs or ():
                            rows_of.setdefault(c, []).append(j)
                    for c, at in rows_of.items():
                        if c in mine_of:
                            best.add(m, np.array(mine_of[c]), x[at], keys[at])
            n, d, names = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in n], arrow), pa.array(names, key_arrow), pa.array(d)], names=[query, key, "distance"])

        columns = vectors.select(key, vector, *([cells] if cells else [])).where(F.col(vector).isNotNull())
        passes.append(columns.mapInArrow(scan, f"`{query}` {kind}, `{key}` {key_kind}, distance double"))
    if not passes:
        return spark.createDataFrame([], f"`{query}` {kind}, `{key}` {key_kind}, distance double, rank int")
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return top_k(out.distinct() if cells else out, query, key, k, [F.col("distance").asc()])


class _Best:
    """The k nearest keys seen so far of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.keys = k, np.full((n, k), np.inf), np.full((n, k), None, dtype=object)

    def add(self, m: np.ndarray, mine: np.ndarray, x: np.ndarray, keys: np.ndarray) -> None:
        """Rows ``x`` against the queries numbered ``mine``."""
        norms = (m[mine] ** 2).sum(axis=1)
        step = max(1, PRODUCTS // max(1, len(mine)))
        for i in range(0, len(x), step):
            part, names = x[i : i + step], keys[i : i + step]
            order = np.argsort(np.array([str(v) for v in names]), kind="stable")
            part, names = part[order], names[order]
            d = np.round(np.maximum(norms[:, None] + (part * part).sum(axis=1)[None] - 2 * m[mine] @ part.T, 0), 9)
            # What is farther than the k-th so far cannot come in.
            rows = np.flatnonzero((d <= self.d[mine, -1:]).any(axis=1))
            for j in rows:
                near = np.flatnonzero(d[j] <= self.d[mine[j], -1])
                if len(near) > self.k:
                    near = near[np.argsort(d[j][near], kind="stable")[: self.k]]
                old = self.d[mine[j]] < np.inf
                pairs = {(v, str(n)): n for v, n in zip(self.d[mine[j]][old], self.keys[mine[j]][old])} | {(d[j][c], str(names[c])): names[c] for c in near}
                top = sorted(pairs)[: self.k]
                self.d[mine[j], : len(top)] = [p[0] for p in top]
                self.keys[mine[j], : len(top)] = [pairs[p] for p in top]

    def rows(self) -> tuple[list[int], np.ndarray, list]:
        q, c = np.nonzero(self.d < np.inf)
        return q.tolist(), self.d[q, c], self.keys[q, c].tolist()


def cell_centres(vectors: DataFrame, n_cells: int = 64, sample: int = 20_000, vector: str = "embedding", key: str = "vec_id", rounds: int = 8, k: int = 10, target: float = 0.97) -> tuple[np.ndarray, int]:
    """(centres of ``n_cells`` cells, how many cells to look into), fitted on a sample of at most ``sample`` vectors, those
    least by hash of the key: k-means, then the least number of nearest cells that hold the share ``target`` of the k
    nearest of 500 of them."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(sample).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)] if len(x) else np.zeros((0, 1))
    for _ in range(rounds if len(x) else 0):
        own = (((x**2).sum(axis=1))[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    if not len(x):
        return centres, 0
    far = lambda a, b: (b * b).sum(axis=1)[None] - 2 * a @ b.T
    some = x[:500]
    own, order = far(x, centres).argmin(axis=1), far(some, centres).argsort(axis=1, kind="stable")
    near = far(some, x).argsort(axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(order, axis=1)[np.arange(len(some))[:, None], own[near]]
    return centres, int(np.quantile(place, target, method="higher")) + 1 if place.size else 1


def in_cells(vectors: DataFrame, centres: np.ndarray, near: int, vector: str = "embedding", name: str = "cells") -> DataFrame:
    """Adds the numbers of the ``near`` cells whose centres are nearest to each vector."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # n_cells vectors

    @F.pandas_udf("array<int>")
    def place(v: pd.Series) -> pd.Series:
        c = held.value
        x = np.array(v.tolist(), dtype=np.float64)
        d = (c**2).sum(axis=1)[None] - 2 * x @ c.T
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :near].astype(np.int32)))

    return vectors.where(F.col(vector).isNotNull()).withColumn(name, place(F.col(vector)))


def nearest_cells(vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", n_cells: int = 64) -> DataFrame:
    """``nearest`` by an index of cells: every vector lies in its nearest cell, and a query meets those of its ``probes``
    nearest cells (by default as many as the sample asks for). Centres are fitted on a bounded sample, all rows are indexed; recall is measured by ``recall``, and
    ``nearest`` is the exact way."""
    centres, enough = cell_centres(vectors, n_cells, vector=vector, key=key, k=k)
    if not len(centres):
        return nearest(vectors, queries, k, key, vector, query)
    return nearest(in_cells(vectors, centres, 1, vector), in_cells(queries, centres, probes or enough, vector), k, key, vector, query, cells="cells")


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """One row: exact pairs, those of them found, and their share."""
    hit = exact.select(query, key).join(found.select(query, key).withColumn("hit", F.lit(1)), [query, key], "left")
    n = hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return n.withColumn("recall", F.round(F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(1.0)), 4))


def similarity(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def fuse(vec: DataFrame, sparse: DataFrame, weights: DataFrame, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """query, key, score, strategy, rank from two ranked legs (query, key, rank; vec also distance).

    Weighted reciprocal ranks over the larger of the legs, scaled to 1 for a first place in both. A query without
    sparse hits keeps its vector similarities; one without vector hits gets 1 / (1 + 0.1 rank). ``weights``: query, alpha.
    """
    v = vec.select(query, key, F.col("rank").alias("rv"), similarity(F.col("distance")).alias("sim"), F.lit(None).cast("int").alias("rb"))
    s = sparse.select(query, key, F.lit(None).cast("int").alias("rv"), F.lit(None).cast("double").alias("sim"), F.col("rank").alias("rb"))
    both = v.unionByName(s).groupBy(query, key).agg(F.max("rv").alias("rv"), F.max("sim").alias("sim"), F.max("rb").alias("rb"))
    legs = both.groupBy(query).agg(F.count("rv").alias("nv"), F.count("rb").alias("nb")).join(weights.select(query, "alpha"), query)
    j = both.join(legs, query)
    fused = F.round((F.coalesce(F.col("alpha") / (RRF + F.col("rv")), F.lit(0.0)) + F.coalesce((1 - F.col("alpha")) / (RRF + F.col("rb")), F.lit(0.0))) * (RRF + 1), 4)
    score = F.when(F.col("nb") == 0, F.col("sim")).when(F.col("nv") == 0, F.round(1 / (1 + DECAY * F.col("rb")), 4)).otherwise(fused)
    strategy = F.when(F.col("nb") == 0, "vector").when(F.col("nv") == 0, "bm25").otherwise("hybrid")
    return top_k(j.select(query, key, score.alias("score"), strategy.alias("strategy")), query, key, k)


def vector_search(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """query, key, score, strategy, rank by vectors alone, for a corpus without a sparse side."""
    near = nearest(docs.select(key, embed(F.col(text)).alias("embedding")), queries.select(query, embed(F.col(query_text)).alias("embedding")), k or TOP, key, "embedding", query)
    return near.select(query, key, similarity(F.col("distance")).alias("score"), F.lit("vector").alias("strategy"), "rank")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", embed: Callable[[Column], Column] = hash_embedding, weight: float | None = None, sparse_text: str | None = None) -> DataFrame:
    """Hybrid search of every query: twice k candidates per leg, fused to k."""
    k = k or TOP
    vec = nearest(docs.select(key, embed(F.col(text)).alias("embedding")), queries.select(query, embed(F.col(query_text)).alias("embedding")), 2 * k, key, "embedding", query)
    sparse = bm25(docs, queries, 2 * k, key, sparse_text or text, query, query_text)
    weights = queries.select(query, (F.lit(float(weight)) if weight is not None else alpha(F.col(query_text))).alias("alpha"))
    return fuse(vec, sparse, weights, k, query, key)


def graded(hits: DataFrame, query: str = "query_id", floor: float = FLOOR) -> DataFrame:
    """Hits at or above the floor, or the first one where none is."""
    any_kept = F.max(F.when(F.col("score") >= floor, 1).otherwise(0)).over(Window.partitionBy(query))
    return hits.withColumn("__any", any_kept).where((F.col("score") >= floor) | ((F.col("__any") == 0) & (F.col("rank") == 1))).drop("__any")


#: The answer where nothing matches, and the line before what does.
NO_MATCH, MATCHES = "No matching capital events were found in this filing.", "Relevant capital events:"


def answers(queries: DataFrame, hits: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, answer: an extractive answer from graded hits that carry their text; a fixed line where there are none."""
    line = F.concat(F.lit("  - "), F.col(text), F.lit(" (match "), F.col("score").cast("string"), F.lit(")"))
    made = hits.select(query, F.struct("rank", line.alias("line")).alias("x")).groupBy(query).agg(F.concat(F.lit(MATCHES + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("answer"))
    return queries.select(query).join(made, query, "left").select(query, F.coalesce("answer", F.lit(NO_MATCH)).alias("answer"))


def scalar_columns(df: DataFrame) -> DataFrame:
    """The columns that hold single values; lists, maps and nested rows are left out."""
    return df.select(*[f.name for f in df.schema if f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct")])


def compare_weights(docs: DataFrame, queries: DataFrame, relevant: DataFrame, weights: dict[str, float | None], k: int = TOP, **names) -> DataFrame:
    """strategy, ndcg, mrr, n_queries: ranks of the first relevant hit under each weight of the vector leg (None: by query)."""
    out = None
    for name, weight in weights.items():
        ranks = first_relevant(search(docs, queries, k, weight=weight, **names), relevant)
        row = rank_quality(ranks, k).select(F.lit(name).alias("strategy"), "ndcg", "mrr", "n_queries")
        out = row if out is None else out.unionByName(row)
    return out


def first_relevant(hits: DataFrame, relevant: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """query, rank of the first hit that is relevant; null if none."""
    found = hits.join(relevant.select(query, key), [query, key]).groupBy(query).agg(F.min("rank").alias("rank"))
    return relevant.select(query).distinct().join(found, query, "left")
