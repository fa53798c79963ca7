"""Queries that run the domain operators over the whole test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import asof, dedup, evaluate, extract, layout, provenance, quality, report, retrieval, verify
from ..session import cut_lineage, scratch_dir, spread_table, table
from ..sources import json_events, markdown, plugins, sinks
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def typed_events(spark: SparkSession, d: str) -> DataFrame:
    """sample_events with plain numbers as numbers; what is no plain number is null."""
    e = table(spark, d, "sample_events")
    whole = {c: F.col(c).try_cast("bigint") for c in ("shares", "old_capital", "new_capital", "total_outflow")}
    return e.withColumns({**whole, "issue_price": F.col("issue_price").try_cast("double")})


_TYPED = """typed AS (
  SELECT * REPLACE (
    CASE WHEN regexp_matches(trim(shares), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(shares) AS BIGINT) END AS shares,
    CASE WHEN regexp_matches(trim(old_capital), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(old_capital) AS BIGINT) END AS old_capital,
    CASE WHEN regexp_matches(trim(new_capital), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(new_capital) AS BIGINT) END AS new_capital,
    CASE WHEN regexp_matches(trim(total_outflow), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(total_outflow) AS BIGINT) END AS total_outflow,
    TRY_CAST(issue_price AS DOUBLE) AS issue_price)
  FROM sample_events)"""


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM sample_events GROUP BY 1")
def event_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50")
def events_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return quality.listed(table(spark, d, "events"), 50, "event_id", "click").select("event_id", "user_id", "value")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'click') t WHERE n > 20")
def events_negative_limit(spark: SparkSession, d: str) -> DataFrame:
    return quality.listed(table(spark, d, "events"), -20, "event_id", "click").select("event_id")


@query("""
WITH g AS (SELECT filing_id, event_type, date, count(*) AS n, count(issue_price) AS np, count(DISTINCT issue_price) AS p
           FROM ola_drhp_extracted WHERE date IS NOT NULL AND date <> '' GROUP BY 1, 2, 3),
f AS (SELECT filing_id, event_type, date, count(*) AS n_figures FROM
        (SELECT DISTINCT filing_id, event_type, date, shares, issue_price FROM ola_drhp_extracted WHERE date IS NOT NULL AND date <> '') t GROUP BY 1, 2, 3)
SELECT g.filing_id, g.event_type, g.date, g.n, f.n_figures,
  CASE WHEN g.event_type = 'allotment' AND g.p = 1 AND g.np = g.n THEN 'warning' ELSE 'error' END AS severity
FROM g JOIN f ON g.filing_id = f.filing_id AND g.event_type = f.event_type AND g.date = f.date WHERE g.n >= 2 AND f.n_figures > 1
""")
def timeline_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return verify.date_conflicts(table(spark, d, "ola_drhp_extracted"), ["filing_id"], ["shares", "issue_price"], ids=None).select("filing_id", "event_type", "date", "n", "n_figures", "severity")


@query(f"""
WITH {_TYPED}, n AS (SELECT filing_id, event_id, new_capital, lead(old_capital) OVER (PARTITION BY filing_id ORDER BY coalesce(date, ''), event_id) AS next_old
  FROM typed WHERE event_type = 'authorised_capital_change')
SELECT filing_id, event_id, new_capital, next_old FROM n WHERE new_capital <> next_old
""")
def capital_continuity(spark: SparkSession, d: str) -> DataFrame:
    chain = typed_events(spark, d).where("event_type = 'authorised_capital_change'")
    return verify.chain_breaks(chain, ["filing_id"], "old_capital", "new_capital", order="event_id").select("filing_id", "event_id", "new_capital", "next_old")


_RATIO = "CASE WHEN regexp_matches(ratio, '^\\s*\\d+(\\.\\d+)?\\s*:\\s*\\d+(\\.\\d+)?\\s*$') AND CAST(trim(split_part(ratio, ':', 2)) AS DOUBLE) <> 0 THEN CAST(trim(split_part(ratio, ':', 1)) AS DOUBLE) / CAST(trim(split_part(ratio, ':', 2)) AS DOUBLE) END"


@query(f"""
WITH r AS (SELECT event_id, pre_issue_capital AS pre, post_issue_capital AS post, {_RATIO} AS m FROM sample_events WHERE event_type = 'bonus_issue'),
x AS (SELECT event_id, pre * (1 + m) AS expected, abs(post - pre * (1 + m)) / (pre * (1 + m)) AS deviation FROM r WHERE pre <> 0)
SELECT event_id, round(expected, 3) AS expected, round(deviation, 6) AS deviation FROM x WHERE deviation > 0.05
""")
def bonus_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    bonus = table(spark, d, "sample_events").where("event_type = 'bonus_issue'")
    out = verify.ratio_breaks(bonus, "ratio", "pre_issue_capital", "post_issue_capital")
    return out.select("event_id", F.round("expected", 3).alias("expected"), F.round("deviation", 6).alias("deviation"))


_SUMMARY = f"""
WITH {_TYPED},
g AS (SELECT filing_id, event_type, date, count(*) AS n FROM typed WHERE date IS NOT NULL AND date <> '' GROUP BY 1, 2, 3),
f AS (SELECT filing_id, event_type, date, count(*) AS k FROM (SELECT DISTINCT filing_id, event_type, date, shares, ratio, new_capital FROM typed WHERE date IS NOT NULL AND date <> '') t GROUP BY 1, 2, 3),
a AS (SELECT g.filing_id, count(*) AS timeline FROM g JOIN f ON g.filing_id = f.filing_id AND g.event_type IS NOT DISTINCT FROM f.event_type AND g.date = f.date WHERE g.n >= 2 AND f.k > 1 GROUP BY 1),
l AS (SELECT filing_id, new_capital, lead(old_capital) OVER (PARTITION BY filing_id ORDER BY coalesce(date, ''), event_id) AS next_old FROM typed WHERE event_type = 'authorised_capital_change'),
b AS (SELECT filing_id, count(*) AS capital_continuity FROM l WHERE new_capital <> next_old GROUP BY 1),
r AS (SELECT filing_id, pre_issue_capital AS pre, post_issue_capital AS post, {_RATIO} AS m FROM typed WHERE event_type = 'bonus_issue'),
c AS (SELECT filing_id, count(*) AS arithmetic FROM r WHERE pre <> 0 AND abs(post - pre * (1 + m)) / (pre * (1 + m)) > 0.05 GROUP BY 1),
n AS (SELECT filing_id, count(*) AS checked FROM typed GROUP BY 1)
SELECT n.filing_id, n.checked, coalesce(timeline, 0) + coalesce(capital_continuity, 0) + coalesce(arithmetic, 0) AS n_issues,
  coalesce(timeline, 0) AS timeline, coalesce(capital_continuity, 0) AS capital_continuity, coalesce(arithmetic, 0) AS arithmetic,
  coalesce(timeline, 0) + coalesce(capital_continuity, 0) + coalesce(arithmetic, 0) = 0 AS consistent,
  round(greatest(0.0, 1 - 0.2 * (coalesce(timeline, 0) + coalesce(capital_continuity, 0) + coalesce(arithmetic, 0))), 6)::DOUBLE AS confidence
FROM n LEFT JOIN a ON n.filing_id = a.filing_id LEFT JOIN b ON n.filing_id = b.filing_id LEFT JOIN c ON n.filing_id = c.filing_id
WHERE n.filing_id IS NOT NULL
"""


@query(_SUMMARY)
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    events = typed_events(spark, d).where("filing_id is not null").withColumn("pos", F.col("event_id"))
    return verify.verification_summary(verify.verify(events), events)


@query(f"""
WITH {_TYPED}
SELECT issuer_id, count(*) AS n_events,
  CAST(coalesce(sum(CASE WHEN event_type = 'allotment' THEN shares END), 0) AS BIGINT) AS total_shares_allotted,
  sum(CASE WHEN event_type = 'allotment' THEN 1 ELSE 0 END)::BIGINT AS allotment_events,
  sum(CASE WHEN event_type = 'bonus_issue' THEN 1 ELSE 0 END)::BIGINT AS bonus_issues,
  sum(CASE WHEN event_type = 'rights_issue' THEN 1 ELSE 0 END)::BIGINT AS rights_issues,
  CAST(coalesce(sum(CASE WHEN event_type = 'dividend_declaration' THEN total_outflow END), 0) AS BIGINT) AS total_dividend_outflow,
  CAST(coalesce(sum(CASE WHEN event_type = 'share_repurchase' THEN shares_bought_back END), 0) AS BIGINT) AS total_shares_bought_back,
  CAST(coalesce(sum(CASE WHEN event_type = 'warrant_exercise' THEN warrants_exercised END), 0) AS BIGINT) AS total_warrants_exercised,
  min(nullif(date, '')) AS first_date, max(nullif(date, '')) AS last_date
FROM typed GROUP BY 1
""")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    events = typed_events(spark, d).withColumn("pos", F.col("event_id"))
    return report.metrics(events, ["issuer_id"]).select(
        "issuer_id", "n_events", "total_shares_allotted", "allotment_events", "bonus_issues", "rights_issues", "total_dividend_outflow", "total_shares_bought_back", "total_warrants_exercised", "first_date", "last_date"
    )


@query(f"""
WITH {_TYPED}, c AS (SELECT issuer_id, new_capital, row_number() OVER (PARTITION BY issuer_id ORDER BY coalesce(date, '') DESC, event_id DESC) AS n FROM typed WHERE event_type = 'authorised_capital_change')
SELECT issuer_id, new_capital AS latest FROM c WHERE n = 1
""")
def latest_capital(spark: SparkSession, d: str) -> DataFrame:
    events = typed_events(spark, d).where("event_type = 'authorised_capital_change'").withColumn("pos", F.col("event_id"))
    return report.metrics(events, ["issuer_id"]).select("issuer_id", F.col("latest_authorised_capital").alias("latest"))


def _grouped(c: str) -> str:
    return f"format('{{:,}}', {c})"


def _rupees(c: str) -> str:
    two = lambda size: f"printf('%.2f', (({c} + {size // 200}) // {size // 100}) / 100.0)"
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} >= 10000000 THEN 'Rs. ' || {two(10**7)} || ' Cr' WHEN {c} >= 100000 THEN 'Rs. ' || {two(10**5)} || ' L' ELSE 'Rs. ' || {_grouped(c)} END"


_HEADLINE = f"""CASE coalesce(event_type, 'event')
  WHEN 'allotment' THEN 'Allotted ' || coalesce({_grouped('shares')}, '?') || ' shares' || CASE WHEN allottee_category <> '' THEN ' to ' || allottee_category ELSE '' END || CASE WHEN issue_price <> 0 THEN ' at Rs. ' || CAST(issue_price AS VARCHAR) ELSE '' END
  WHEN 'bonus_issue' THEN 'Bonus issue ' || coalesce(ratio, '?')
  WHEN 'rights_issue' THEN 'Rights issue ' || coalesce(ratio, '?') || ' at Rs. ' || coalesce(CAST(price AS VARCHAR), '?')
  WHEN 'authorised_capital_change' THEN 'Authorised capital raised ' || {_rupees('old_capital')} || ' → ' || {_rupees('new_capital')}
  WHEN 'dividend_declaration' THEN 'Dividend Rs. ' || coalesce(CAST(amount_per_share AS VARCHAR), '?') || '/share'
  WHEN 'share_repurchase' THEN coalesce('Buyback of ' || {_grouped('shares_bought_back')} || ' shares', 'Share repurchase')
  WHEN 'warrant_exercise' THEN coalesce({_grouped('warrants_exercised')} || ' warrants exercised', 'Warrant exercise')
  ELSE replace(coalesce(event_type, 'event'), '_', ' ') END"""


@query(f"WITH {_TYPED} SELECT event_id, coalesce(nullif(date, ''), '9999-99-99') AS sort_date, {_HEADLINE} AS headline FROM typed")
def timeline_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The timeline of the events with all their figures."""
    e = typed_events(spark, d).withColumn("pos", F.col("event_id"))
    return report.timeline(e, ["event_id"]).select("event_id", "sort_date", "headline")


@query("""
SELECT event_id, concat_ws(', ', replace(coalesce(event_type, 'event'), '_', ' '),
  CASE WHEN date <> '' THEN 'on ' || date END, CASE WHEN allottee_category <> '' THEN 'to ' || allottee_category END,
  CASE WHEN shares <> '' THEN shares || ' shares' END, CASE WHEN ratio <> '' THEN 'ratio ' || ratio END,
  CASE WHEN issue_price <> '' THEN 'at price ' || issue_price END, CASE WHEN consideration <> '' THEN 'for ' || consideration END,
  CASE WHEN new_capital <> '' THEN 'authorised capital ' || coalesce(old_capital, 'None') || ' to ' || new_capital END,
  CASE WHEN resolution_type <> '' THEN 'via ' || resolution_type END,
  CASE WHEN amount_per_share <> 0 THEN 'dividend ' || CAST(amount_per_share AS VARCHAR) || ' per share' END,
  CASE WHEN shares_bought_back <> 0 THEN 'bought back ' || CAST(shares_bought_back AS VARCHAR) || ' shares' END,
  CASE WHEN warrants_exercised <> 0 THEN CAST(warrants_exercised AS VARCHAR) || ' warrants exercised' END,
  CASE WHEN exercise_price <> 0 THEN 'exercise price ' || CAST(exercise_price AS VARCHAR) END) AS sentence
FROM sample_events
""")
def event_to_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_events")
    return e.select("event_id", retrieval.event_text(e).alias("sentence"))


_TOKENS = "[a-z0-9]+(?:[.,:][a-z0-9]+)*"


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKENS}')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY 1
""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    posts = retrieval.postings(spread_table(spark, d, "documents"), "doc_id", F.col("text"))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every evaluation item whose id is divisible by 20."""
    return table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("query"))


_BM25 = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKENS}')) AS term FROM documents),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{_TOKENS}')) AS dl FROM documents),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
raw AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM tf, n GROUP BY term, n.n),
idf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM raw) ELSE idf0 END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(item_text), '{_TOKENS}')) AS term FROM eval_items WHERE item_id % 20 = 0),
qn AS (SELECT query_id, term, count(*) AS qn FROM q GROUP BY 1, 2),
s AS (SELECT qn.query_id, tf.doc_id, round(sum(qn.qn * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / n.avgdl))), 6) AS score
  FROM qn JOIN tf ON qn.term = tf.term JOIN idf ON qn.term = idf.term JOIN dl ON tf.doc_id = dl.doc_id, n GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM s)"""


@query(_BM25 + " SELECT query_id, doc_id, round(score, 3) AS score FROM bm WHERE rank <= 10 AND score > 0")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(spread_table(spark, d, "documents"), _queries(spark, d), 10).select("query_id", "doc_id", F.round("score", 3).alias("score"))


_NEAR = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS query_label, round(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(vec_id AS VARCHAR)) AS rank FROM p)"""


@query(_NEAR + " SELECT query_id, vec_id, round(1 / (1 + distance), 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    out = retrieval.nearest(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return out.select("query_id", "vec_id", retrieval.similarity(F.col("distance")).alias("score"), "rank")


@query(_NEAR + """, f AS (SELECT query_id, min(rank) AS rank FROM r WHERE rank <= 11 AND vec_id <> query_id AND label = query_label GROUP BY 1),
a AS (SELECT q.vec_id AS query_id, f.rank - 1 AS rank FROM embeddings q LEFT JOIN f ON q.vec_id = f.query_id WHERE q.vec_id % 20 = 0)
SELECT round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0) ELSE 0 END), 4) AS ndcg, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, count(*) AS n_queries FROM a""")
def ndcg_mrr(spark: SparkSession, d: str) -> DataFrame:
    """First neighbour (itself aside) with the query's label."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    hits = retrieval.nearest(v, q, 11).join(v.select("vec_id", "label"), "vec_id").join(q.select("query_id", "wanted"), "query_id")
    first = hits.where("vec_id <> query_id and label = wanted").groupBy("query_id").agg((F.min("rank") - 1).alias("rank"))
    return evaluate.rank_quality(q.select("query_id").join(first, "query_id", "left"))


_ALPHA = "CASE WHEN regexp_matches(item_text, '(\\d+\\.?\\d*\\s*(cr|crore|l|lakh|m|mn|b|bn|%))|(\\d[\\d,.]*)|(\\b\\d+:\\d+\\b)|(\\bin[a-z0-9]{10}\\b)', 'i') THEN 0.3 ELSE 0.6 END"


@query(f"SELECT item_id, ({_ALPHA})::DOUBLE AS alpha FROM eval_items")
def alpha_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", text.alpha(F.col("item_text")).cast("double").alias("alpha"))


_HYBRID = f"""{_BM25},
qe AS (SELECT item_id AS query_id, sha256(lower(coalesce(item_text, ''))) AS h, {_ALPHA} AS alpha FROM eval_items WHERE item_id % 20 = 0),
de AS (SELECT doc_id, sha256(lower(coalesce(text, ''))) AS h FROM documents),
dist AS (SELECT query_id, doc_id, round(list_sum(list_transform(range(0, 32), lambda i: pow((('0x' || substr(qe.h, 2 * i + 1, 2))::INT - ('0x' || substr(de.h, 2 * i + 1, 2))::INT) / 255.0, 2))), 9) AS d FROM qe, de),
vec AS (SELECT query_id, doc_id, round(1 / (1 + d), 4) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY d, CAST(doc_id AS VARCHAR)) AS rv FROM dist QUALIFY rv <= 10),
sp AS (SELECT query_id, doc_id, rank AS rb FROM bm WHERE rank <= 10 AND score > 0),
j AS (SELECT coalesce(v.query_id, s.query_id) AS query_id, coalesce(v.doc_id, s.doc_id) AS doc_id, sim, rv, rb FROM vec v FULL JOIN sp s ON v.query_id = s.query_id AND v.doc_id = s.doc_id),
legs AS (SELECT query_id, count(rv) AS nv, count(rb) AS nb FROM j GROUP BY 1),
f AS (SELECT j.query_id, doc_id, CASE WHEN nb = 0 THEN sim WHEN nv = 0 THEN round(1 / (1 + 0.1 * rb), 4) ELSE round((coalesce(alpha::DOUBLE / (60 + rv), 0) + coalesce((1 - alpha::DOUBLE) / (60 + rb), 0)) * 61, 4) END AS score,
  CASE WHEN nb = 0 THEN 'vector' WHEN nv = 0 THEN 'bm25' ELSE 'hybrid' END AS strategy FROM j JOIN legs ON j.query_id = legs.query_id JOIN qe ON j.query_id = qe.query_id),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM f QUALIFY rank <= 5)"""


@query(_HYBRID + " SELECT query_id, doc_id, score::DOUBLE AS score, strategy, rank FROM hits")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(spread_table(spark, d, "documents"), _queries(spark, d), 5).select("query_id", "doc_id", "score", "strategy", "rank")


@query(_HYBRID + """, kept AS (SELECT *, bool_or(score >= 0.15) OVER (PARTITION BY query_id) AS any_kept FROM hits),
a AS (SELECT k.query_id, 'Relevant capital events:\n' || string_agg('  - ' || coalesce(heading, 'document') || ' (match ' || CAST(score::DOUBLE AS VARCHAR) || ')', '\n' ORDER BY rank) AS answer
  FROM kept k JOIN documents d ON k.doc_id = d.doc_id WHERE score >= 0.15 OR (NOT any_kept AND rank = 1) GROUP BY 1)
SELECT qe.query_id, coalesce(answer, 'No matching capital events were found in this filing.') AS answer FROM qe LEFT JOIN a ON qe.query_id = a.query_id""")
def ask_extractive(spark: SparkSession, d: str) -> DataFrame:
    docs, q = spread_table(spark, d, "documents"), _queries(spark, d)
    hits = retrieval.graded(retrieval.search(docs, q, 5)).join(docs.select("doc_id", F.coalesce("heading", F.lit("document")).alias("text")), "doc_id")
    return retrieval.answers(q, hits)


_METHOD = "lower(trim(source_provenance.extraction_method))"


@query(f"""
WITH s AS (SELECT record_id, filing_id, event_type, date, shares, CASE WHEN {_METHOD} = 'table' THEN 1 ELSE 0 END AS side FROM ola_drhp_extracted)
SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY filing_id, event_type, date, shares ORDER BY side DESC, record_id DESC) AS n FROM s) t WHERE n = 1
""")
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ola_drhp_extracted").select("record_id", "filing_id", "event_type", "date", "shares", F.lower(F.trim("source_provenance.extraction_method")).alias("m"))
    is_table = F.coalesce(F.col("m") == "table", F.lit(False))
    merged = dedup.merge_extractions(o.where(is_table), o.where(~is_table), ["event_type", "date", "shares"], "record_id", ["filing_id"])
    return merged.select("record_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), lang ORDER BY doc_id) AS n FROM documents) t WHERE n = 1")
def dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return dedup.drop_repeats(docs, "doc_id").select("doc_id")


_EVAL = """
WITH p AS (SELECT DISTINCT filing_id, event_type, date FROM ola_drhp_extracted), g AS (SELECT DISTINCT filing_id, event_type, date FROM gold_events),
k AS (SELECT filing_id, event_type, date, max(p) AS p, max(g) AS g FROM (SELECT *, 1 AS p, 0 AS g FROM p UNION ALL SELECT *, 0, 1 FROM g) t GROUP BY 1, 2, 3)"""
_SCORES = """sum(p * g)::BIGINT AS tp, sum(p * (1 - g))::BIGINT AS fp, sum((1 - p) * g)::BIGINT AS fn"""
_PRF = """tp, fp, fn, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 3)::DOUBLE AS precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 3)::DOUBLE AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3)::DOUBLE AS f1"""


@query(f"{_EVAL}, c AS (SELECT {_SCORES} FROM k) SELECT {_PRF} FROM c")
def eval_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"), ["filing_id", "event_type", "date"])


@query(f"{_EVAL}, c AS (SELECT event_type, {_SCORES} FROM k WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY 1) SELECT event_type, {_PRF} FROM c")
def eval_per_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_type(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"), key=["filing_id", "event_type", "date"])


@query(f"""
WITH g AS (SELECT DISTINCT filing_id, event_type, date FROM gold_events),
m AS (SELECT coalesce({_METHOD}, 'llm') AS method, count(*) AS predicted, count(g.filing_id) AS correct FROM ola_drhp_extracted o
  LEFT JOIN g ON o.filing_id IS NOT DISTINCT FROM g.filing_id AND o.event_type IS NOT DISTINCT FROM g.event_type AND o.date IS NOT DISTINCT FROM g.date GROUP BY 1)
SELECT method, predicted, correct, round(correct * 1.0 / predicted, 3)::DOUBLE AS precision FROM m
""")
def eval_per_method(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ola_drhp_extracted").withColumn("method", F.lower(F.trim("source_provenance.extraction_method")))
    return evaluate.per_method(o, table(spark, d, "gold_events"), "method", ["filing_id", "event_type", "date"])


@query(f"""{_EVAL}, s AS (SELECT k.* FROM k WHERE filing_id IN (SELECT filing_id FROM g)),
c AS (SELECT filing_id, {_SCORES} FROM s GROUP BY 1 UNION ALL SELECT NULL, {_SCORES} FROM s) SELECT filing_id, {_PRF} FROM c""")
def eval_corpus(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.corpus_scores(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"), key=["event_type", "date"])


def _rendered(rows: DataFrame, header: list[str], cells: list, key: str, order: str, heading: str) -> DataFrame:
    """One Markdown document per key with the rows as one table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(c.cast("string"), "\\|", "\\\\\\\\|"), F.lit("")) for c in cells]), F.lit(" |"))
    top = f"# {heading}\n\n[PAGE 7]\n| " + " | ".join(header) + " |\n" + "|---" * len(header) + "|\n"
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return body.select(F.col(key).alias("filing_id"), F.concat(F.lit(top), "body", F.lit("\n\nEnd of table.\n")).alias("text"))


@query("SELECT DISTINCT filing_id, date, shares, issue_price, 7 AS page_number FROM ola_drhp_extracted WHERE event_type = 'allotment' AND regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') AND shares IS NOT NULL")
def md_roundtrip_allotment(spark: SparkSession, d: str) -> DataFrame:
    """Allotments rendered as Markdown tables, parsed back; the cells of unknown prices are empty."""
    o = table(spark, d, "ola_drhp_extracted").where("event_type = 'allotment' and shares is not null and date is not null")
    doc = _rendered(o, ["Date of Allotment", "No. of Equity Shares", "Face value", "Issue Price (Rs.)", "Nature of consideration"], [F.col("date"), F.col("shares"), F.lit(10), F.col("issue_price"), F.lit("Cash")], "filing_id", "record_id", "Equity share capital")
    return extract.table_events(markdown.parse_tables(doc)).where("event_type = 'allotment'").select("filing_id", "date", "shares", "issue_price", "page_number").distinct()


@query("SELECT filing_id, ratio, count(*) AS n FROM (SELECT filing_id, regexp_replace(ratio, '\\s+', '', 'g') AS ratio FROM sample_events WHERE event_type = 'bonus_issue' AND regexp_matches(ratio, '\\d\\s*:\\s*\\d')) t GROUP BY 1, 2")
def md_roundtrip_bonus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_events").where("event_type = 'bonus_issue' and ratio is not null")
    doc = _rendered(e, ["Record date", "Ratio"], [F.lit("31-01-2019"), F.col("ratio")], "filing_id", "event_id", "Bonus issue")
    return extract.table_events(markdown.parse_tables(doc)).where("event_type = 'bonus_issue'").groupBy("filing_id", "ratio").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT filing_id, ratio, count(*) AS n, sum(price) AS price FROM (SELECT filing_id, regexp_replace(ratio, '\\s+', '', 'g') AS ratio, 25.5 AS price FROM sample_events WHERE event_type = 'rights_issue' AND regexp_matches(ratio, '\\d\\s*:\\s*\\d')) t GROUP BY 1, 2".replace("sum(price) AS price", "sum(price)::DOUBLE AS price"))
def md_roundtrip_rights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_events").where("event_type = 'rights_issue' and ratio is not null")
    doc = _rendered(e, ["Record date", "Ratio", "Issue price"], [F.lit("January 31, 2019"), F.col("ratio"), F.lit("Rs. 25.50")], "filing_id", "event_id", "Rights Issue")
    return extract.table_events(markdown.parse_tables(doc)).where("event_type = 'rights_issue'").groupBy("filing_id", "ratio").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@query("""SELECT issuer_id AS filing_id, count(*) AS n, CAST(sum(post_issue_capital) AS BIGINT) AS new_total FROM sample_events
WHERE pre_issue_capital IS NOT NULL AND post_issue_capital >= 100000 GROUP BY 1""")
def md_roundtrip_authorised(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_events").where("pre_issue_capital is not null and post_issue_capital is not null")
    doc = _rendered(e, ["Date of resolution", "Increased from", "Increased to", "Type of resolution"], [F.lit("2019-01-31"), F.col("pre_issue_capital"), F.col("post_issue_capital"), F.lit("Ordinary")], "issuer_id", "event_id", "Authorised capital")
    return extract.table_events(markdown.parse_tables(doc)).where("event_type = 'authorised_capital_change'").groupBy("filing_id").agg(F.count(F.lit(1)).alias("n"), F.sum("new_capital").alias("new_total"))


@query()
def md_document_events(spark: SparkSession, d: str) -> DataFrame:
    """Events in the Markdown tables of the documents themselves, each once per document."""
    docs = spread_table(spark, d, "documents").select(F.col("doc_id").alias("filing_id"), "text")
    return extract.extract_events(docs).select("filing_id", "event_type", "date", "shares", "ratio", "new_capital", "page_number", "source_snippet")


@query("""
WITH c AS (SELECT event_id, issue_price AS x, translate(issue_price, '०१२३४५६७८९', '0123456789') AS y FROM sample_events WHERE issue_price IS NOT NULL),
v AS (SELECT event_id, x, TRY_CAST(replace(regexp_extract(y, '(-?\\d[\\d,]*(\\.\\d+)?)', 1), ',', '') AS DOUBLE) AS v FROM c)
SELECT event_id, CASE WHEN v < 100000 THEN v * CASE WHEN regexp_matches(lower(x), '\\bcrore\\b|\\bcr\\b') THEN 1e7 WHEN regexp_matches(lower(x), '\\blakh\\b|\\blac\\b') THEN 1e5
  WHEN regexp_matches(lower(x), '\\bbillion\\b|\\bbn\\b') THEN 1e9 WHEN regexp_matches(lower(x), '\\bmillion\\b|\\bmn\\b') THEN 1e6 ELSE 1 END ELSE v END AS amount FROM v
""")
def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_events").where("issue_price is not null")
    return e.select("event_id", numbers.cell_amount(F.col("issue_price")).alias("amount"))


_FORMS = [
    ("\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"), ("\\d{1,2}-\\d{1,2}-\\d{4}", "%d-%m-%Y"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "%d.%m.%Y"), ("\\d{1,2}/\\d{1,2}/\\d{2}", "%d/%m/%y"),
    ("[A-Za-z]+ \\d{1,2}, \\d{4}", "%B %d, %Y"), ("[A-Za-z]+ \\d{1,2} \\d{4}", "%B %d %Y"), ("\\d{1,2} [A-Za-z]+ \\d{4}", "%d %B %Y"), ("\\d{1,2} [A-Za-z]+, \\d{4}", "%d %B, %Y"), ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "%b %d, %Y"),
    ("[A-Za-z]{3} \\d{1,2} \\d{4}", "%b %d %Y"), ("\\d{1,2} [A-Za-z]{3} \\d{4}", "%d %b %Y"), ("\\d{1,2}-[A-Za-z]{3}-\\d{4}", "%d-%b-%Y"), ("\\d{1,2}-[A-Za-z]{3}-\\d{2}", "%d-%b-%y"),
]


@query(f"""
WITH c AS (SELECT event_id, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(date, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '[*#^~†‡]+|\\(\\d+\\)|\\[\\d+\\]', '', 'g')), ',+$', '')) AS t FROM sample_events WHERE date IS NOT NULL)
SELECT event_id, CASE WHEN t <> '' THEN coalesce({', '.join(f"CASE WHEN regexp_full_match(t, '{r}') THEN strftime(try_strptime(t, '{f}'), '%Y-%m-%d') END" for r, f in _FORMS)}, t) END AS iso FROM c
""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_events").where("date is not null").select("event_id", dates.cell_date(F.col("date")).alias("iso"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
n AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT p.o_custkey, p.page AS start_page, n.n FROM p JOIN n ON p.o_custkey = n.o_custkey WHERE (p.page - 1) % 2 = 0 AND (p.page = 1 OR p.page - 1 + 1 < n.n))
SELECT s.o_custkey AS filing_id, s.start_page, max(p.page) AS end_page, CAST(sum(p.o_orderkey) AS BIGINT) AS key_sum
FROM s JOIN p ON p.o_custkey = s.o_custkey AND p.page BETWEEN s.start_page AND s.start_page + 2 GROUP BY 1, 2
""")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three pages that overlap by one, over each customer's orders as pages."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.row_number().over(w).cast("bigint").alias("page_number"), F.col("o_orderkey").cast("string").alias("text"))
    out = provenance.page_windows(pages, 3, 1)
    keys = F.filter(F.split("text", "\n"), lambda x: ~x.startswith("["))
    return out.select("filing_id", "start_page", "end_page", F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("key_sum"))


#: Fixed value: most quotes from which one part of a page is put together.
PART_QUOTES = 256


def _altered(record: Column, snippet: Column) -> Column:
    """A snippet misread in every 16th character, in every 4th, or with its words in reverse order, by record."""
    misread = lambda n: F.regexp_replace(snippet, f"(?s).(.{{0,{n - 1}}})", "~$1")
    return F.when(record % 3 == 0, misread(16)).when(record % 3 == 1, misread(4)).otherwise(F.array_join(F.reverse(F.split(snippet, " ")), " "))


@query()
def snippet_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Extracted rows with altered snippets checked against pages put together from what all extractions quote of them, so
    that the comparison decides. Pages with many quotes are put together, and compared, in parts."""
    return checked_snippets(table(spark, d, "ola_drhp_extracted"))


def checked_snippets(o: DataFrame, part_quotes: int = PART_QUOTES) -> DataFrame:
    rows = o.select("record_id", "filing_id", "page_number", _altered(F.col("record_id"), F.col("source_snippet")).alias("source_snippet"), "confidence")
    quotes = o.where("page_number > 0 and source_snippet is not null").select("filing_id", "page_number", "source_snippet")
    page = ["filing_id", "page_number"]
    text = F.array_join(F.sort_array(F.collect_set("source_snippet")), "\n").alias("text")
    hot = cut_lineage(quotes.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_quotes))
    if hot.isEmpty():
        out = provenance.attach_provenance(rows, quotes.groupBy(*page).agg(text))
    else:
        hot = F.broadcast(hot)
        out = provenance.attach_provenance(rows.join(hot, page, "left_anti"), quotes.join(hot, page, "left_anti").groupBy(*page).agg(text))
        part = F.pmod(F.xxhash64("source_snippet"), F.ceil(F.col("n") / part_quotes)).alias("part")
        parts = quotes.join(hot, page).groupBy(*page, part).agg(text)
        out = out.unionByName(provenance.attach_provenance(rows.join(hot, page, "left_semi"), parts, part="part"))
    return out.select("record_id", "page_number", "confidence", F.length("source_snippet").alias("n_chars"))


@query("""
WITH s AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events)
SELECT event_id, signup FROM s
""")
def asof_section(spark: SparkSession, d: str) -> DataFrame:
    """The last sign-up of the same user up to each event: a backward as-of fill, as for sections of a document."""
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return asof.carried(table(spark, d, "events"), "user_id", ["ts", "event_id"], signup, "signup").select("event_id", "signup")


@query("""
SELECT event_id, CASE WHEN event_type IS NULL THEN 'event_type'
  WHEN lower(event_type) = 'allotment' THEN nullif(concat_ws(', ', CASE WHEN shares IS NOT NULL AND NOT regexp_matches(trim(shares), '^[+-]?[0-9]+(\\.0+)?$') THEN 'allotment.shares' END,
    CASE WHEN issue_price IS NOT NULL AND NOT regexp_matches(trim(issue_price), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN 'allotment.issue_price' END), '')
  WHEN lower(event_type) = 'authorised_capital_change' THEN nullif(concat_ws(', ', CASE WHEN old_capital IS NOT NULL AND NOT regexp_matches(trim(old_capital), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN 'authorised_capital_change.old_capital' END,
    CASE WHEN new_capital IS NOT NULL AND NOT regexp_matches(trim(new_capital), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN 'authorised_capital_change.new_capital' END), '') END AS error
FROM sample_events
""")
def validate_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate(table(spark, d, "sample_events")).select("event_id", "error")


@query("""SELECT record_id, CASE WHEN confidence IS NULL THEN '' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'middle' ELSE 'low' END AS bucket,
  coalesce(confidence, 1) < 0.5 AS is_low FROM ola_drhp_extracted""")
def conf_buckets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ola_drhp_extracted")
    return o.select("record_id", quality.confidence_bucket("confidence").alias("bucket"), (F.coalesce(F.col("confidence"), F.lit(1.0)) < quality.MIDDLE).alias("is_low"))


_PAGES = """
WITH l AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '(\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line,
  generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '(\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), 1) AS n FROM documents),
m AS (SELECT doc_id, n, line, TRY_CAST(coalesce(nullif(regexp_extract(line, '(?i)\\[\\s*page\\s*(\\d+)\\s*\\]', 1), ''), nullif(regexp_extract(line, '(?i)<!--\\s*page\\D*(\\d+)\\s*-->', 1), ''),
  nullif(regexp_extract(line, '^\\s*\\{(\\d+)\\}\\s*-*\\s*$', 1), ''), nullif(regexp_extract(line, '(?i)^\\s*-*\\s*page\\s+(\\d+)\\s*-*\\s*$', 1), '')) AS INTEGER) AS mark FROM l),
p AS (SELECT doc_id, line, mark, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page_number FROM m)"""


@query(_PAGES + " SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(sum(length(line)) + count(*) - 1 AS INTEGER) AS n_chars FROM p WHERE mark IS NULL GROUP BY 1, 2")
def split_pages(spark: SparkSession, d: str) -> DataFrame:
    return markdown.split_pages(table(spark, d, "documents"), "doc_id").select("doc_id", "page_number", F.length("text").alias("n_chars"))


@query(_PAGES + """, q AS (SELECT doc_id, page_number, sum(length(line)) + count(*) - 1 AS chars FROM p WHERE mark IS NULL GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_pages, 0::BIGINT AS n_ocr, 1.0::DOUBLE AS confidence, CAST(sum(chars) AS BIGINT) AS chars FROM q GROUP BY 1""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return markdown.document_summary(markdown.page_summary(markdown.split_pages(table(spark, d, "documents"), "doc_id"), "doc_id"), "doc_id")


@query("SELECT doc_id, contains(lower(text), 'date of allotment') OR contains(lower(text), 'equity share capital') OR contains(lower(text), 'bonus') OR contains(lower(text), 'rights issue') OR contains(lower(text), 'authorised capital') OR contains(lower(text), 'authorized capital') OR contains(lower(text), 'allotment') OR contains(lower(text), 'face value') AS relevant FROM documents")
def capital_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.mentions(F.col("text"), text.CAPITAL_SIGNALS).alias("relevant"))


@query("""SELECT record_id, page_number, nullif(source_provenance.section, '') AS section_heading FROM ola_drhp_extracted WHERE page_number IS NOT NULL AND source_snippet IS NOT NULL""".replace("nullif(source_provenance.section, '')", "source_provenance.section"))
def cited_events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ola_drhp_extracted").withColumn("event_id", F.col("record_id"))
    return report.citations(o).select(F.col("event_id").cast("bigint").alias("record_id"), "page_number", "section_heading")


_BRIEF = f"""
WITH {_TYPED}, ev AS (SELECT *, {_HEADLINE} AS headline, coalesce(nullif(CAST(event_id AS VARCHAR), ''), 'x') AS name FROM typed WHERE filing_id IS NOT NULL),
cap AS (SELECT filing_id, new_capital FROM ev WHERE event_type = 'authorised_capital_change' QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY coalesce(date, '') DESC, event_id DESC) = 1),
m AS (SELECT filing_id, count(*) AS n, coalesce(sum(CASE WHEN event_type = 'allotment' THEN shares END), 0)::BIGINT AS allotted, count(*) FILTER (WHERE event_type = 'allotment') AS na, count(*) FILTER (WHERE event_type = 'bonus_issue') AS nb,
  count(*) FILTER (WHERE event_type = 'rights_issue') AS nr, nullif(coalesce(sum(CASE WHEN event_type = 'dividend_declaration' THEN total_outflow END), 0), 0)::BIGINT AS outflow,
  coalesce(sum(CASE WHEN event_type = 'share_repurchase' THEN shares_bought_back END), 0)::BIGINT AS bought, coalesce(sum(CASE WHEN event_type = 'warrant_exercise' THEN warrants_exercised END), 0)::BIGINT AS warrants,
  min(nullif(date, '')) AS lo, max(nullif(date, '')) AS hi, count(*) FILTER (WHERE page_number IS NOT NULL AND source_snippet IS NOT NULL) AS cited FROM ev GROUP BY 1),
told AS (SELECT filing_id, string_agg('- **' || coalesce(nullif(date, ''), 'undated') || '** — ' || headline || coalesce(' (p. ' || page_number || ')', ''), chr(10) ORDER BY coalesce(nullif(date, ''), '9999-99-99'), event_id) AS lines FROM ev GROUP BY 1),
g AS (SELECT filing_id, list(name ORDER BY event_id) AS ids FROM ev WHERE date <> '' GROUP BY filing_id, event_type, date HAVING count(*) >= 2 AND count(DISTINCT {{'s': shares, 'r': ratio, 'c': new_capital}}) > 1),
c AS (SELECT filing_id, name, new_capital, lead(old_capital) OVER w AS nxt, lead(name) OVER w AS nn FROM ev WHERE event_type = 'authorised_capital_change' WINDOW w AS (PARTITION BY filing_id ORDER BY coalesce(date, ''), event_id)),
b AS (SELECT filing_id, name, pre_issue_capital AS pre, post_issue_capital AS post, {_RATIO} AS r FROM ev WHERE event_type = 'bonus_issue'),
i AS (SELECT filing_id, 0 AS o, '    - [timeline] ' || array_to_string(ids, ', ') AS line FROM g UNION ALL SELECT filing_id, 1, '    - [capital_continuity] ' || name || ', ' || nn FROM c WHERE new_capital <> nxt
  UNION ALL SELECT filing_id, 2, '    - [arithmetic] ' || name FROM b WHERE pre <> 0 AND abs(post - pre * (1 + r)) / (pre * (1 + r)) > 0.05),
iss AS (SELECT filing_id, count(*) AS k, string_agg(line, chr(10) ORDER BY o, encode(line)) AS lines FROM i GROUP BY 1)
SELECT m.filing_id, 1::BIGINT AS part, array_to_string(['# Capital history', '', '*' || n || ' capital events' || coalesce(' spanning ' || lo || ' → ' || hi, '') || '*', '', '## Snapshot', '',
  '- Latest authorised capital: **' || {_rupees('new_capital')} || '**', '- Total shares allotted: **' || {_grouped('allotted')} || '** across ' || na || ' allotments', '- Bonus issues: **' || nb || '**  ·  Rights issues: **' || nr || '**',
  '- Total dividend outflow: **' || {_rupees('outflow')} || '**', '- Shares bought back: **' || {_grouped('bought')} || '**  ·  Warrants exercised: **' || {_grouped('warrants')} || '**', '', '## Capital timeline', '', told.lines, '', '## Verification', '',
  CASE WHEN k IS NULL THEN '- ✅ No contradictions across ' || n || ' events (timeline / capital-continuity / bonus-arithmetic).' ELSE '- ⚠️ **' || k || ' contradiction(s)** found across ' || n || ' events:' || chr(10) || iss.lines END,
  '', '*' || cited || ' of ' || n || ' events are page-cited back to the source filing.*'], chr(10)) AS markdown
FROM m JOIN told ON m.filing_id = told.filing_id LEFT JOIN cap ON m.filing_id = cap.filing_id LEFT JOIN iss ON m.filing_id = iss.filing_id"""


@query(_BRIEF)
def report_brief(spark: SparkSession, d: str) -> DataFrame:
    events = typed_events(spark, d).where("filing_id is not null").withColumn("pos", F.col("event_id"))
    return report.brief(events, verify.verify(events))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream into a keyed count, all that is there and then stop."""
    return ingest.counted_stream(spark, d)


# ---- Laid-out pages


def _laid_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(characters, grids, page texts) of one page per filing with its allotments as a table under a heading, its header
    wrapped over two rows. By the last digit of the filing the table has lines (0-3), none on a page that speaks of
    dates of allotment (4-6), or none on a page that does not (7-9) and is then no table."""
    o = table(spark, d, "ola_drhp_extracted").where("event_type = 'allotment' and shares is not null and date is not null").withColumn("digit", F.right("filing_id", F.lit(1)).cast("int"))
    row = F.array("date", F.col("shares").cast("string"), F.coalesce(F.col("issue_price").cast("string"), F.lit("")))
    head = F.array(F.array(F.lit("Date of"), F.lit("No. of Equity"), F.lit("Issue")), F.array(F.lit("Allotment"), F.lit("Shares"), F.lit("Price")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("record_id", row.alias("r")))), lambda x: x["r"])
    per = o.groupBy("filing_id", "digit").agg(F.concat(head, body).alias("cells"))
    grids = per.select("filing_id", F.lit(1).alias("page_num"), F.when(F.col("digit") <= 3, "lines").otherwise("text").alias("strategy"), F.lit(0).alias("table_no"), F.array(*[F.lit(float(v)) for v in (10, 120.004, 500, 700)]).alias("bbox"), "cells")
    pages = per.select("filing_id", F.lit(1).alias("page_num"), F.when(F.col("digit").between(4, 6), "DATE OF ALLOTMENT and more").otherwise("a page").alias("text"))
    lines = [("Capital Structure", 14.0, 40.0), ("Equity  Share Capital", 14.0, 80.0), ("Notes", 14.0, 400.0), ("what stands on this page is set in small letters, as most of it", 9.0, 100.0)]
    signs = F.array(*[F.struct(F.lit(c).alias("text"), F.lit(s).alias("size"), F.lit(y).alias("top")) for text_, s, y in lines for c in text_])
    chars = per.select("filing_id", F.lit(1).alias("page_num"), F.posexplode(signs).alias("n", "x")).select("filing_id", "page_num", "n", "x.*")
    return chars, grids, pages


@query("""SELECT DISTINCT filing_id, date, shares, issue_price, 'Equity Share Capital' AS section, 120.0::DOUBLE AS top FROM ola_drhp_extracted
WHERE event_type = 'allotment' AND shares IS NOT NULL AND regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') AND CAST(right(filing_id, 1) AS INTEGER) <= 6""")
def pdf_tables(spark: SparkSession, d: str) -> DataFrame:
    """Allotments laid out as grids on pages, read back: choice of grids, headings, wrapped headers, box and section."""
    rows = layout.page_table_rows(*_laid_out(spark, d))
    e = extract.table_events(rows).where("event_type = 'allotment'")
    return e.select("filing_id", "date", "shares", "issue_price", F.col("source_provenance.section").alias("section"), F.element_at("bbox", 2).alias("top")).distinct()


@query("""
WITH c AS (SELECT l_orderkey AS filing_id, l_linenumber AS n, l_returnflag || l_linestatus || ' ' AS text, l_quantity AS size, (l_partkey % 4) + 0.25 AS top FROM lineitem),
m AS (SELECT *, median(size) OVER (PARTITION BY filing_id) AS median FROM c),
l AS (SELECT filing_id, floor(top) AS line, arg_min(top, n) AS top, trim(string_agg(text, '' ORDER BY n, text)) AS text, avg(size) AS mean, max(median) AS median FROM m GROUP BY 1, 2)
SELECT filing_id, top::DOUBLE AS top, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM l WHERE mean > 1.1 * median AND text <> ''
""")
def pdf_headings(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines of pages whose characters are order lines: mean size of a line against the median of its page."""
    i = table(spark, d, "lineitem")
    chars = i.select(F.col("l_orderkey").alias("filing_id"), F.lit(1).alias("page_num"), F.col("l_linenumber").alias("n"), F.concat("l_returnflag", "l_linestatus", F.lit(" ")).alias("text"), F.col("l_quantity").cast("double").alias("size"), (F.col("l_partkey") % 4 + 0.25).cast("double").alias("top"))
    return layout.headings(chars).select("filing_id", "top", "text")


@query("SELECT doc_id, 'allotment' AS event_type, CAST(length('[PAGE ' || coalesce(page_from, 1) || ']\n' || text) AS BIGINT) AS shares, coalesce(page_from, 1) AS page_number, 'llm' AS method FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{p}')" for p in text.CAPITAL_SIGNALS))
def model_pass(spark: SparkSession, d: str) -> DataFrame:
    """Pages with capital signals sent to a model - here one that tells how long its page is - and its answers read."""
    pages = table(spark, d, "documents").select("doc_id", F.coalesce("page_from", F.lit(1)).alias("page_number"), "text")
    told = plugins.model_event_rows(pages, _length_as_event, text.mentions(F.col("text"), text.CAPITAL_SIGNALS), "doc_id")
    return told.select("doc_id", "event_type", "shares", "page_number", F.col("source_provenance.extraction_method").alias("method"))


def _length_as_event(page: str) -> str:
    return '```json\n{"capital_events": [{"event_type": "allotment", "shares": %d}]}\n```' % len(page)


@query("SELECT l_orderkey AS page, round(coalesce(avg(CASE WHEN l_returnflag <> 'A' AND l_quantity >= 10 THEN l_quantity END) / 100, 0), 4)::DOUBLE AS confidence FROM lineitem GROUP BY 1")
def word_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of pages whose words are order lines; quantities below ten stand for words without one."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")).alias("text"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("double")).otherwise(-1.0).alias("conf"))
    return plugins.word_confidence(i, "page")


@query("""SELECT doc_id, CASE WHEN source NOT IN (SELECT source FROM (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 6)) OR source IS NULL THEN 400 WHEN n_chars > 2000 THEN 413 ELSE 200 END AS status FROM documents""")
def admitted_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: those of the first six sources are Markdown, others something else; over 2,000 bytes is too large."""
    docs = table(spark, d, "documents")
    six = docs.select("source").where("source is not null").distinct().orderBy("source").limit(6).withColumn("md", F.lit(True))  # six rows
    files = docs.join(F.broadcast(six), "source", "left").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.when(F.col("md"), ".MD").otherwise(".txt")).alias("path"), F.col("n_chars").alias("length"))
    return plugins.admissible(files, 2000).select("doc_id", "status")


# ---- Evaluation outputs, sinks and small projections


@query(f"{_EVAL} SELECT filing_id, event_type, date, CASE WHEN g = 1 THEN 'missed' ELSE 'spurious' END AS side FROM k WHERE p <> g")
def eval_differences(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.differences(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"), scope=["filing_id"])


@query("SELECT (SELECT count(*) FROM ola_drhp_extracted) AS predicted, (SELECT count(*) FROM gold_events) AS gold")
def eval_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.counts(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"))


@query(f"""{_EVAL}, c AS (SELECT filing_id, {_SCORES} FROM k GROUP BY 1), s AS (SELECT filing_id, {_PRF} FROM c),
n AS (SELECT filing_id, count(*) AS n_predicted FROM ola_drhp_extracted GROUP BY 1), m AS (SELECT filing_id, count(*) AS n_gold FROM gold_events GROUP BY 1)
SELECT n.filing_id, n_predicted, n_gold, printf('%-40s %5d %5s  %s', left(n.filing_id, 40), n_predicted, coalesce(CAST(n_gold AS VARCHAR), '—'),
  CASE WHEN n_gold IS NULL THEN 'no gold set' ELSE printf('P=%.3f R=%.3f F1=%.3f', precision, recall, f1) END) AS line
FROM n LEFT JOIN m ON n.filing_id = m.filing_id LEFT JOIN s ON n.filing_id = s.filing_id""")
def eval_corpus_table(spark: SparkSession, d: str) -> DataFrame:
    """Every filing with predictions as a printed line, those without gold as such."""
    return evaluate.corpus_table(table(spark, d, "ola_drhp_extracted"), table(spark, d, "gold_events"))


@query("SELECT coalesce(event_type, 'none') AS chunk_id, count(*) AS n FROM sample_events GROUP BY 1")
def chunk_resume(spark: SparkSession, d: str) -> DataFrame:
    """A chunked run that stopped after a third of its chunks, resumed: each chunk's result once, whatever was done before."""
    e = table(spark, d, "sample_events").select(F.coalesce("event_type", F.lit("none")).alias("chunk_id"))
    chunks, path = e.distinct(), f"{scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"
    work = lambda some: e.join(some.select("chunk_id"), "chunk_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    sinks.resume(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0), work, path)
    return sinks.resume(chunks, work, path)


@query("""SELECT record_id, filing_id, event_type, date, shares, coalesce(page_number, page) AS page_number, source_provenance.extraction_method AS method FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY record_id) AS n FROM ola_drhp_extracted WHERE filing_id IS NOT NULL) t""")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Extractions written as one JSON document per filing, with its pages and model, and read again."""
    o = table(spark, d, "ola_drhp_extracted").where("filing_id is not null")
    kept = o.select("filing_id", "record_id", F.col("record_id").cast("string").alias("consideration"), "event_type", "date", "shares", "page_number", "page", "source_provenance")
    meta = table(spark, d, "filings").select("filing_id", "total_pages", "model")
    path = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    sinks.extraction_documents(kept, order="record_id", meta=meta).select("value").write.text(path)
    back = json_events.read_events(spark, path, per_line=True)
    return back.select(F.col("consideration").cast("bigint").alias("record_id"), "filing_id", "event_type", "date", "shares", "page_number", F.col("source_provenance.extraction_method").alias("method"))


@query("SELECT coalesce(event_type, '') AS event_type, coalesce(date, '') AS date, count(*) AS n FROM sample_events GROUP BY 1, 2")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The flat export written and read again; missing values are empty."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(table(spark, d, "sample_events"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.groupBy(F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("date", F.lit("")).alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(_BM25 + " SELECT query_id, doc_id, round(score, 3) AS score FROM bm WHERE rank <= 10 AND score > 0")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """``bm25_topk`` over written tables of postings and term statistics, of which only the queries' terms are read."""
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    sinks.write_index(spread_table(spark, d, "documents").select("doc_id", "text"), path)
    return sinks.indexed_search(spark, path, _queries(spark, d), 10).select("query_id", "doc_id", F.round("score", 3).alias("score"))


@query()
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the cell index against the exact search, ten nearest of every vector whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.recall(retrieval.nearest_cells(v, q, 10), retrieval.nearest(v, q, 10))


@query()
def dense_against_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """nDCG and MRR of vectors alone and of both legs; what is relevant to a passage holds seven words of it in a row, from
    its first, eighth or a later seventh one on."""
    docs, q = spread_table(spark, d, "documents").select("doc_id", "text"), _queries(spark, d)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    w = q.select("query_id", words(F.col("query")).alias("w")).where(F.size("w") >= 7)
    part = w.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 6, F.lit(7)), lambda i: F.array_join(F.slice("w", i, 7), " "))).alias("part"))
    # The stated query set against all rows.
    relevant = docs.withColumn("flat", F.array_join(words(F.col("text")), " ")).join(F.broadcast(part), F.contains("flat", "part")).select("query_id", "doc_id").distinct()
    return retrieval.compare_weights(docs, q, relevant, {"dense": 1.0, "hybrid": None})


@query("SELECT record_id, confidence, date, event_type, extracted_at, face_value, filing_id, issue_price, issuer_id, page, page_number, shares, source_snippet, source_system, consideration FROM ola_drhp_extracted WHERE coalesce(confidence, 1) < 0.5")
def low_confidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows below the middle bound, single-valued columns only, the important ones first."""
    o = retrieval.scalar_columns(quality.low_confidence(table(spark, d, "ola_drhp_extracted")))
    return sinks.reordered(o, ["event_type", "date", "shares", "confidence", "not there"])


@query("SELECT p_partkey, printf('%g', p_retailprice) AS general, printf('%.0f', p_size / 100.0 * 100) || '%' AS percent FROM part")
def displayed_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.general(F.col("p_retailprice").cast("double")).alias("general"), text.percent(F.col("p_size") / 100).alias("percent"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) t WHERE n BETWEEN 2 AND 4")
def page_range(spark: SparkSession, d: str) -> DataFrame:
    """Three pages from the second on, of each customer's orders as pages."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return sinks.page_slice(table(spark, d, "orders").withColumn("page_number", F.row_number().over(w)), 2, 3).select("o_orderkey", "o_custkey")
