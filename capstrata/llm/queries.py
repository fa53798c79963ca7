"""Queries over the filing tables for the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canon, copies, leakage, packing, subjects, survivors, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = survivors.ranked_leads(table(spark, d, "ola_drhp_extracted"), table(spark, d, "filings"), table(spark, d, "method_trust"))
    return out.select("lead_id", "page_from_id", "price_from_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "ola_drhp_extracted"), table(spark, d, "filings"), table(spark, d, "method_trust"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "sample_events"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "sample_events")).select("keep_id", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(table(spark, d, "ola_drhp_extracted"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(table(spark, d, "ola_drhp_extracted"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_to_terms(table(spark, d, "sample_events"), table(spark, d, "canon_terms")).select("event_id", "field_name", "term_id")


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canon.unmatched(table(spark, d, "sample_events"), table(spark, d, "canon_terms"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.leak_report(leakage.leaks(table(spark, d, "documents"), items), items)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    shares = subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))
    return subjects.subjects_of(shares)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p9_found(spark, d), table(spark, d, "subject_areas").withColumn("subject_id", F.col("subject_id").cast("bigint")))


def queries() -> dict[str, Query]:
    named = [p1_found, p1_survivors, p3_found, p3_collapsed, p4_found, p4_shares, p6_found, p6_unmatched, p7_packing, p7_fill, p8_found, p8_items, p9_found, p9_composition]
    return {f.__name__: f for f in named}


_P1 = """
WITH trust AS (SELECT lower(trim(extraction_method)) AS m, min(trust_rank) AS r FROM method_trust GROUP BY 1),
pages AS (SELECT filing_id, max(total_pages) AS total_pages FROM filings GROUP BY 1),
base AS (
  SELECT o.filing_id, o.event_type, o.date, o.shares, o.record_id, o.extracted_at, o.page_number, o.issue_price, p.total_pages,
    coalesce(t.r, 1000000) AS rnk,
    coalesce(CASE WHEN o.confidence BETWEEN 0 AND 1 THEN o.confidence WHEN o.confidence > 1 AND o.confidence <= 100 THEN o.confidence / 100 END,
             CASE WHEN o.source_provenance.confidence BETWEEN 0 AND 1 THEN o.source_provenance.confidence
                  WHEN o.source_provenance.confidence > 1 AND o.source_provenance.confidence <= 100 THEN o.source_provenance.confidence / 100 END, -1) AS conf
  FROM ola_drhp_extracted o
  LEFT JOIN trust t ON lower(trim(o.source_provenance.extraction_method)) = t.m
  LEFT JOIN pages p ON o.filing_id = p.filing_id
  WHERE o.date IS NOT NULL AND o.shares IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY filing_id, event_type, date, shares ORDER BY rnk, conf DESC, extracted_at DESC, record_id) AS pos FROM base),
firsts AS (
  SELECT filing_id, event_type, date, shares, count(*) AS n,
    min(CASE WHEN page_number BETWEEN 1 AND total_pages THEN pos END) AS page_pos,
    min(CASE WHEN issue_price IS NOT NULL THEN pos END) AS price_pos
  FROM ranked GROUP BY 1, 2, 3, 4)
SELECT max(CASE WHEN r.pos = 1 THEN r.record_id END) AS lead_id,
  max(CASE WHEN r.pos = f.page_pos THEN r.record_id END) AS page_from_id,
  max(CASE WHEN r.pos = f.price_pos THEN r.record_id END) AS price_from_id
FROM ranked r JOIN firsts f ON r.filing_id = f.filing_id AND r.event_type = f.event_type AND r.date = f.date AND r.shares = f.shares
WHERE f.n >= 2
GROUP BY r.filing_id, r.event_type, r.date, r.shares
"""


def _p3(tail: str) -> str:
    """Labelled texts are cut at ";", "|" and line ends and each part at its first ":" or "="; JSON is read as such."""
    name = {"event_type": "eventtype", "date": "date", "shares": "shares", "ratio": "ratio"}
    field = lambda f: f"coalesce({f}, CASE WHEN is_json THEN json_extract_string(j, '$.{f}') ELSE list_extract(list_filter(pairs, lambda q: q.k = '{name[f]}'), 1).v END) AS {f}"
    flat = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
    return f"""
WITH r AS (SELECT *, coalesce(raw_text LIKE '{{%', false) AS is_json, CASE WHEN raw_text LIKE '{{%' THEN raw_text END AS j,
  list_transform(string_split_regex(coalesce(raw_text, ''), '[;|\\n]'), lambda s: {{'k': regexp_replace(lower(regexp_extract(s, '^([^:=]*)[:=]', 1)), '[^a-z]', '', 'g'), 'v': trim(regexp_extract(s, '^[^:=]*[:=](.*)$', 1))}}) AS pairs
  FROM sample_events WHERE filing_id IS NOT NULL),
f AS (SELECT event_id, filing_id, {', '.join(field(f) for f in copies.FIELDS)} FROM r),
norm AS (SELECT event_id, filing_id, {flat('event_type')} AS e,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(date), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g')) AS d,
  {flat('shares')} AS s, array_to_string(list_filter(list_transform(string_split_regex(ratio, '[:/∶：-]'), lambda x: {flat('x')}), lambda x: x <> ''), ':') AS r FROM f),
kept AS (SELECT * FROM norm WHERE e IS NOT NULL AND d IS NOT NULL AND (s IS NOT NULL OR r IS NOT NULL)),
grouped AS (SELECT filing_id, e, d, coalesce(s, '~') AS s, coalesce(r, '~') AS r, min(event_id) AS keep_id, count(*) AS n FROM kept GROUP BY 1, 2, 3, 4, 5)
{tail}"""


_P1_VOTES = """
WITH trust AS (SELECT lower(trim(extraction_method)) AS m, min(trust_rank) AS r FROM method_trust GROUP BY 1),
pages AS (SELECT filing_id, max(total_pages) AS total_pages FROM filings GROUP BY 1),
unit AS (SELECT *, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence WHEN confidence > 1 AND confidence <= 100 THEN confidence / 100 END AS c1,
  CASE WHEN source_provenance.confidence BETWEEN 0 AND 1 THEN source_provenance.confidence WHEN source_provenance.confidence > 1 AND source_provenance.confidence <= 100 THEN source_provenance.confidence / 100 END AS c2,
  nullif(lower(trim(source_provenance.extraction_method)), '') AS m FROM ola_drhp_extracted WHERE date IS NOT NULL AND shares IS NOT NULL),
b AS (SELECT u.filing_id, event_type, date, shares, coalesce(c1, c2) AS conf, u.m, issue_price, CASE WHEN page_number BETWEEN 1 AND total_pages THEN page_number END AS page,
  pow(2, -(coalesce(t.r, 9) - 1)) * pow(2, coalesce(epoch_us(extracted_at) - epoch_us(TIMESTAMP '2025-01-01'), -3650 * 86400000000) / 86400e6 / 365.0) AS w
  FROM unit u LEFT JOIN trust t ON u.m = t.m LEFT JOIN pages p ON u.filing_id = p.filing_id),
l AS (SELECT filing_id, event_type, date, shares, w, unnest(['rows', 'confidence', 'extraction_method', 'page_number', 'issue_price']) AS field,
  unnest(['-', CAST(round(conf, 4) AS VARCHAR), m, CAST(page AS VARCHAR), CASE WHEN NOT isnan(issue_price) THEN CAST(round(issue_price, 2) AS VARCHAR) END]) AS value FROM b),
v AS (SELECT filing_id, event_type, date, shares, field, value, sum(w) AS w, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY filing_id, event_type, date, shares, field ORDER BY round(w, 9) DESC, value DESC) AS pos,
  max(w) OVER g / sum(w) OVER g AS share FROM v WINDOW g AS (PARTITION BY filing_id, event_type, date, shares, field))
SELECT filing_id, event_type, date, shares, max(CASE WHEN field = 'rows' THEN n END) AS n_rows, CAST(max(CASE WHEN field = 'confidence' THEN value END) AS DOUBLE) AS confidence,
  max(CASE WHEN field = 'extraction_method' THEN value END) AS extraction_method, CAST(max(CASE WHEN field = 'page_number' THEN value END) AS INTEGER) AS page_number, CAST(max(CASE WHEN field = 'issue_price' THEN value END) AS DOUBLE) AS issue_price,
  """ + ", ".join(f"round(max(CASE WHEN field = '{f}' THEN share END), 6) AS {f}_share" for f in ("confidence", "extraction_method", "page_number", "issue_price")) + """
FROM r WHERE pos = 1 GROUP BY 1, 2, 3, 4 HAVING max(CASE WHEN field = 'rows' THEN n END) >= 2"""

_P8 = """
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 14], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM fold) t),
ifold AS (SELECT item_id, regexp_extract_all(translate(item_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
e AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 14], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM ifold) t),
hits AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e ON d.run = e.run)"""


def _p6(tail: str) -> str:
    """Every distinct value against every entry, and every word against every word of the entries."""
    blank = "[_\\s\\x{A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]+"
    quoted = lambda s: s.replace("'", "''")

    def clean(x: str) -> str:
        x = f"regexp_replace(regexp_replace(lower(trim(regexp_replace({x}, '{blank}', ' ', 'g'))), '{quoted(canon._TAIL)}', ''), '{quoted(canon._HEAD)}', '')"
        for digit, letter in (("[1|]", "l"), ("0", "o")):
            one = "1" if letter == "l" else "0"
            for _ in range(2):
                x = f"regexp_replace(regexp_replace({x}, '([a-z]){digit}([^0-9]|$)', '\\1{letter}\\2', 'g'), '(^|[^0-9]){one}([a-z])', '\\1{letter}\\2', 'g')"
        x = f"regexp_replace(regexp_replace(regexp_replace({x}, '&', ' and ', 'g'), '\\(s\\)|[''’`.]', '', 'g'), '\\b([a-z])/([a-z]{{2}})', '\\1\\2', 'g')"
        x = f"regexp_replace(trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')), '{quoted(canon._HEAD)}', '')"
        return f"list_transform([{x}], lambda y: CASE WHEN regexp_full_match(y, '([a-z] ){{2,}}[a-z]') THEN replace(y, ' ', '') ELSE y END)[1]"

    def close(v: str, r: str) -> str:
        n, d = f"length({r})", f"levenshtein({v}, {r})"
        limit = f"(CASE WHEN {n} <= 3 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 9 THEN 2 WHEN {n} <= 19 THEN 3 ELSE 4 END)"
        swaps = f"(CASE WHEN {d} % 2 = 0 AND length({v}) = {n} AND list_sort(string_split({v}, '')) = list_sort(string_split({r}, '')) THEN {d} // 2 ELSE {d} END)"
        return f"(CASE WHEN {d} <= {limit} THEN least({d}, {swaps}) WHEN {swaps} < {d} AND {swaps} <= least(2, {limit}) THEN {swaps} END)"

    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    words = lambda x: f"list_transform([list_filter(string_split({x}, ' '), lambda w: w <> '')], lambda a: CASE WHEN len(list_filter(a, lambda w: w NOT IN ({listed(canon.STOP)}))) > 0 THEN list_filter(a, lambda w: w NOT IN ({listed(canon.STOP)})) ELSE a END)[1]"
    same = lambda w: f"(CASE WHEN {w} IN ({listed(canon.NOT)}) THEN '{canon.NOT[0]}' ELSE {w} END)"
    single = lambda w: f"(CASE WHEN length({w}) > 2 THEN regexp_replace({w}, 's$', '') ELSE {w} END)"
    letters = lambda v, w: f"regexp_matches({w}, '^' || regexp_replace({v}, '(.)', '\\1.*', 'g'))"
    initials = lambda v, r: f"({v} = {r} OR (whole AND ((length({r}) >= 3 AND length({v}) >= 3 AND levenshtein({v}, {r}) <= 1 AND left({v}, 2) = left({r}, 2)) OR (length({r}) = 2 AND length({v}) = 3 AND starts_with({v}, {r})))))"
    v, w = single("word"), single("ref")
    return f"""
WITH cells AS (SELECT event_id, field_name, entry FROM (SELECT event_id, unnest([{listed(canon.FIELDS)}]) AS field_name, unnest([{', '.join(canon.FIELDS)}]) AS entry FROM sample_events) t
  WHERE entry IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canon_terms c WHERE c.field_name = t.field_name AND c.term = t.entry)),
named AS (SELECT field_name, entry, {clean('entry')} AS value, n FROM (SELECT field_name, entry, count(*) AS n FROM cells GROUP BY 1, 2) t),
vals AS (SELECT field_name, value, sum(n) AS n FROM named GROUP BY 1, 2),
refs AS (SELECT field_name, ref, min(term_id) AS term_id FROM (SELECT field_name, term_id, {clean('term')} AS ref FROM canon_terms) t WHERE ref <> '' GROUP BY 1, 2),
near AS (SELECT v.field_name, value, term_id, length(ref) AS len, {close('value', 'ref')} AS d FROM vals v JOIN refs r ON v.field_name = r.field_name WHERE value <> ''),
whole AS (SELECT * FROM near WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_name, value ORDER BY d, len DESC, term_id) = 1),
open AS (SELECT v.field_name, v.value FROM vals v LEFT JOIN whole w ON v.field_name = w.field_name AND v.value = w.value WHERE v.value <> '' AND (w.d IS NULL OR w.d > 1)),
split AS (SELECT field_name, value, list_transform({words("regexp_replace(regexp_replace(value, '" + canon._PART_OF + "', ''), '^non([a-z]{3})', 'non \\1')")}, lambda w: {same('w')}) AS ws FROM open),
each AS (SELECT field_name, value, len(ws) AS nv, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM split),
own AS (SELECT field_name, term_id, ws, len(ws) AS nt, unnest(ws) AS ref, unnest(range(len(ws))) AS place FROM (SELECT field_name, term_id, {words('ref')} AS ws FROM refs) t),
runs AS (SELECT DISTINCT a.field_name, a.term_id, array_to_string(list_transform(a.ws[a.place + 1:b.place + 1], lambda x: left(x, 1)), '') AS ref, a.place, b.place AS upto, (b.place - a.place + 1 = a.nt) AS whole
  FROM own a JOIN own b ON a.field_name = b.field_name AND a.term_id = b.term_id AND b.place > a.place),
lone AS (SELECT DISTINCT field_name, word FROM each),
pairs AS (
  SELECT l.field_name, word, term_id, place, place AS upto, least({close('word', 'form')}, 1) AS cost FROM lone l JOIN (SELECT *, unnest([ref, {single('ref')}, {same('ref')}]) AS form FROM own) o ON l.field_name = o.field_name WHERE {close('word', 'form')} IS NOT NULL
  UNION ALL
  SELECT l.field_name, word, term_id, place, place, CASE WHEN {v} = {w} THEN 0 WHEN starts_with({w}, {v}) OR (length(word) >= {canon.STEM} AND length(ref) >= {canon.STEM} AND left(word, {canon.STEM}) = left(ref, {canon.STEM})) OR (length(ref) >= {canon.ROOT} AND starts_with(word, ref)) THEN 1
    WHEN length({v}) < length({w}) AND {letters(v, w)} AND length({v}) >= 3 AND right({v}, 1) = right({w}, 1) THEN 3 END AS cost
  FROM lone l JOIN own o ON l.field_name = o.field_name AND left(word, 1) = left(ref, 1)
  UNION ALL
  SELECT l.field_name, word, term_id, place, upto, CASE WHEN {initials('word', 'ref')} OR {initials(v, 'ref')} THEN 1 END FROM lone l JOIN runs r ON l.field_name = r.field_name AND left(word, 1) = left(ref, 1)),
best AS (SELECT field_name, word, term_id, place, upto, min(cost) AS cost FROM pairs WHERE cost IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
one AS (SELECT e.field_name, e.value, nv, term_id, e.pos, cost, place, upto FROM each e JOIN best b ON e.field_name = b.field_name AND e.word = b.word QUALIFY row_number() OVER (PARTITION BY e.field_name, e.value, term_id, e.pos ORDER BY cost, place, upto) = 1),
per AS (SELECT field_name, value, nv, term_id, count(*) AS mv, sum(cost) AS cost, max(cost) AS worst, list_distinct(flatten(list(range(place, upto + 1)))) AS places FROM one GROUP BY 1, 2, 3, 4),
rare AS (SELECT field_name, {single('ref')} AS w, count(DISTINCT term_id) AS n FROM own GROUP BY 1, 2),
sizes AS (SELECT o.field_name, o.term_id, count(DISTINCT place) AS nt, coalesce(list(DISTINCT place) FILTER (WHERE r.n = 1), []) AS alone FROM own o JOIN rare r ON o.field_name = r.field_name AND {single('o.ref')} = r.w GROUP BY 1, 2),
kinds AS (SELECT p.*, nt, len(places) AS mt, CASE WHEN len(places) = nt AND mv = nv THEN 0 WHEN len(places) = nt AND worst < 3 THEN 1 WHEN mv = nv AND worst < 3 AND list_has_any(places, alone) THEN 2 END AS kind FROM per p JOIN sizes s ON p.field_name = s.field_name AND p.term_id = s.term_id),
worded AS (SELECT * FROM kinds WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_name, value ORDER BY kind, CASE WHEN kind = 1 THEN -nt ELSE 0 END, nv - mv + nt - mt, cost, term_id) = 1),
pick AS (SELECT v.field_name, v.value, v.n, w.term_id AS whole_id, w.d, x.term_id AS word_id, x.term_id IS NOT NULL AND (w.d IS NULL OR (x.kind = 0 AND x.cost < w.d)) AS derived
  FROM vals v LEFT JOIN whole w ON v.field_name = w.field_name AND v.value = w.value LEFT JOIN worded x ON v.field_name = x.field_name AND v.value = x.value),
usual AS (SELECT field_name, sum(n) * {canon.USUAL}::DOUBLE AS least FROM pick GROUP BY 1),
forms AS (SELECT p.field_name, value AS ref, word_id AS term_id FROM pick p JOIN usual u ON p.field_name = u.field_name WHERE derived AND n >= least AND n >= 3),
late AS (SELECT * FROM (SELECT p.field_name, p.value, p.d AS before, f.term_id, length(f.ref) AS len, {close('p.value', 'f.ref')} AS d FROM pick p JOIN forms f ON p.field_name = f.field_name WHERE p.value <> '' AND NOT derived AND (p.d IS NULL OR p.d > 1)) t
  WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_name, value ORDER BY d, len DESC, term_id) = 1),
answer AS (SELECT p.field_name, p.value, coalesce(CASE WHEN l.before IS NULL OR l.d < l.before THEN l.term_id END, CASE WHEN derived THEN word_id ELSE whole_id END, 0) AS term_id FROM pick p LEFT JOIN late l ON p.field_name = l.field_name AND p.value = l.value),
mapped AS (SELECT c.event_id, c.field_name, c.entry, CAST(a.term_id AS BIGINT) AS term_id FROM cells c JOIN named n ON c.field_name = n.field_name AND c.entry = n.entry JOIN answer a ON a.field_name = n.field_name AND a.value = n.value)
{tail}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_survivors": _P1_VOTES,
        "p3_found": _p3("SELECT g.keep_id, k.event_id AS copy_id FROM kept k JOIN grouped g ON k.filing_id = g.filing_id AND k.e = g.e AND k.d = g.d AND coalesce(k.s, '~') = g.s AND coalesce(k.r, '~') = g.r WHERE k.event_id > g.keep_id"),
        "p3_collapsed": _p3("SELECT keep_id, n AS n_copies FROM grouped"),
        "p6_found": _p6("SELECT event_id, field_name, term_id FROM mapped"),
        "p6_unmatched": _p6("SELECT field_name, entry, count(*) AS n FROM mapped WHERE term_id = 0 GROUP BY 1, 2"),
        "p8_found": _P8 + " SELECT doc_id, item_id FROM hits",
        "p8_items": _P8 + " SELECT i.item_id, suite, count(h.doc_id) AS n_documents FROM eval_items i LEFT JOIN hits h ON i.item_id = h.item_id GROUP BY 1, 2",
    }
