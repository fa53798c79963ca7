"""Domain operators on small fixtures written for these tests."""

from datetime import datetime
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capstrata.functions.headers import NEEDLES
from capstrata.functions import dates, headers, numbers, text
from capstrata.operators import dedup, evaluate, extract, provenance, quality, report, retrieval, verify
from capstrata.operators.skew import attach_group
from capstrata.plans import catalogue
from capstrata.sources import json_events, markdown, plugins, sinks

EVENT = (
    "filing_id string, pos bigint, event_id string, event_type string, date string, shares bigint, issue_price double, allottee_category string, ratio string, price double, pre_issue_capital bigint, "
    "post_issue_capital bigint, old_capital bigint, new_capital bigint, consideration string, resolution_type string, amount_per_share double, total_outflow bigint, shares_bought_back bigint, warrants_exercised bigint, page_number int, source_snippet string"
)
NAMES = [f.split()[0] for f in EVENT.split(", ")]


def events(spark, *rows):
    return spark.createDataFrame([tuple({"filing_id": "f", "pos": i, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], EVENT)


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_amounts(spark):
    cells = ["2,50,000", "Rs. 154.20", "₹1,50,00,00,000", "Rs. 150 crore", "10 lakh", "5 mn", "Nil", "N/A", "—", None, "2,75,00,00,000 (Rupees two hundred seventy-five crore)", "150 crores", "10Cr", "2019-20", "A-1"]
    assert column(spark, cells, numbers.cell_amount) == [250000, 154.2, 1.5e9, 1.5e9, 1e6, 5e6, None, None, None, None, 2.75e9, 150, 10, 2019, -1]
    assert column(spark, ["5:1", " 1 : 4 ", "2.5:1", "1:0", "194,998:1", "garbage", None], numbers.ratio_multiple) == [5, 0.25, 2.5, None, None, None, None]
    assert column(spark, [None, 5.0, 250000.0, 1.5e9], numbers.rupees, "double") == ["—", "Rs. 5", "Rs. 2.50 L", "Rs. 150.00 Cr"]


FORMS = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%d/%m/%y", "%B %d, %Y", "%B %d %Y", "%d %B %Y", "%d %B, %Y", "%b %d, %Y", "%b %d %Y", "%d %b %Y", "%d-%b-%Y", "%d-%b-%y"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.dates(datetime(1970, 1, 1).date(), datetime(2068, 12, 31).date()), st.sampled_from(FORMS), st.booleans()), min_size=40, max_size=40))
def test_dates_agree_with_strptime(spark, drawn):
    cells = [d.strftime(f).upper() if up else d.strftime(f) for d, f, up in drawn]
    def plain(c):
        for f in FORMS:
            try:
                return datetime.strptime(c, f).strftime("%Y-%m-%d")
            except ValueError:
                pass
        return c
    assert column(spark, cells, dates.cell_date) == [plain(c) for c in cells]


def test_dates_of_odd_cells(spark):
    cells = ["January 31,\n2019", "2019-01-31#", "31 Jan 2019 (1)", "", "not a date", None, "31-Jan-69", "December 23", "31-02-2019"]
    assert column(spark, cells, dates.cell_date) == ["2019-01-31", "2019-01-31", "2019-01-31", None, "not a date", None, "1969-01-31", "December 23", "31-02-2019"]


def test_text_functions(spark):
    assert column(spark, ["Price 154.20 at 5:1 on 2,50,000!", None], text.tokens) == [["price", "154.20", "at", "5:1", "on", "2,50,000"], None]
    assert column(spark, ["4.5 Cr", "what is it", "introduction here", "5:1"], text.alpha) == [0.3, 0.6, 0.3, 0.3]
    assert column(spark, ["[PAGE 42]", "<!-- Page: 5 -->", "{7}-----", "--- Page 9 ---", "see page 3 of", None], text.page_marker) == [42, 5, 7, 9, None, None]
    assert column(spark, ["a.MD", "b.pdf", None], text.is_markdown) == [True, False, False]
    assert column(spark, [10000000.0, 154.2, 10.0], lambda c: text.rendered(c, "double"), "double") == ["10000000.0", "154.2", "10.0"]


def test_headers(spark):
    h = [["Date of allotment of equity shares", "consideration", "Cumulative shares", "No. of Equity Shares"], ["consolidated", "operations"], []]
    at = lambda name, *a: column(spark, h, lambda c: headers.column_at(c, headers.NEEDLES[name], *a), "array<string>")
    assert at("ratio") == [1, 1, None] and at("date") == [0, 0, None] and at("shares") == [0, None, None]
    assert column(spark, h[:1], lambda c: headers.column_at(c, headers.NEEDLES["shares"], F.array(F.lit(0), F.lit(2))), "array<string>") == [3]
    assert dict(zip(NEEDLES, markdown.places_of(tuple(x.lower() for x in h[0]), 99)))["shares"] == 3
    grid = [["Date of", "No. of"], ["Allotment", "Equity  Shares"], ["31-Jan-2019", "10,000"]]
    got = spark.createDataFrame([(grid,)], "g array<array<string>>").select(*[c.alias(n) for c, n in zip(headers.fold_headers(F.col("g")), "hb")]).first()
    assert got.h == ["date of allotment", "no. of equity shares"] and got.b == [grid[2]]


def test_checks(spark):
    e = events(
        spark,
        {"event_type": "allotment", "date": "2020-01-01", "shares": 5, "issue_price": 10.0}, {"event_type": "allotment", "date": "2020-01-01", "shares": 6, "issue_price": 10.0},
        {"event_type": "allotment", "date": "2020-02-01", "shares": 5}, {"event_type": "allotment", "date": "2020-02-01", "shares": None},
        {"event_type": "allotment", "date": None, "shares": 1}, {"event_type": "allotment", "date": None, "shares": 2},
        {"event_type": "authorised_capital_change", "date": "2019-01-01", "old_capital": 1, "new_capital": 5, "event_id": "A"}, {"event_type": "authorised_capital_change", "date": "2020-01-01", "old_capital": 6, "new_capital": None},
        {"event_type": "authorised_capital_change", "date": "2021-01-01", "old_capital": 9, "new_capital": 10},
        {"event_type": "bonus_issue", "date": "2020-05-05", "ratio": "1:1", "pre_issue_capital": 100, "post_issue_capital": 250}, {"event_type": "bonus_issue", "ratio": "1:1", "pre_issue_capital": 100, "post_issue_capital": 205},
        {"event_type": "bonus_issue", "ratio": "1:1", "pre_issue_capital": 0, "post_issue_capital": 205},
    )
    issues = verify.verify(e)
    got = sorted((r.check_order, r.severity, tuple(r.event_ids)) for r in issues.collect())
    assert got == [
        (0, "error", ("allotment@2020-02-01", "allotment@2020-02-01")), (0, "warning", ("allotment@2020-01-01", "allotment@2020-01-01")),
        (1, "error", ("A", "authorised_capital_change@2020-01-01")), (2, "warning", ("bonus_issue@2020-05-05",)),
    ]
    s = verify.verification_summary(issues, e).first()
    assert (s.checked, s.n_issues, s.consistent, s.confidence) == (12, 4, False, 0.2)
    clean = verify.verification_summary(verify.verify(e.limit(0)), e.limit(1)).first()
    assert clean.consistent and clean.confidence == 1.0


def test_report(spark):
    e = events(
        spark,
        {"event_type": "allotment", "date": "2017-02-03", "shares": 10000, "issue_price": 154.2, "allottee_category": "promoters", "page_number": 3, "source_snippet": "x"},
        {"event_type": "allotment", "date": "2018-02-03", "shares": None, "page_number": None, "source_snippet": "y"}, {"event_type": "bonus_issue", "date": "2019-01-01", "ratio": "5:1", "page_number": 9, "source_snippet": None},
        {"event_type": "authorised_capital_change", "date": "2020-01-01", "old_capital": 600000000, "new_capital": 1500000000}, {"event_type": "authorised_capital_change", "date": "", "old_capital": 1, "new_capital": 2},
        {"event_type": "dividend_declaration", "date": "2023-01-10", "amount_per_share": 2.5, "total_outflow": 150000000}, {"event_type": "share_repurchase", "shares_bought_back": 1500}, {"event_type": None},
    )
    m = report.metrics(e).first()
    assert (m.total_shares_allotted, m.allotment_events, m.bonus_issues, m.latest_authorised_capital, m.latest_authorised_capital_fmt, m.total_dividend_outflow) == (10000, 2, 1, 1500000000, "Rs. 150.00 Cr", 150000000)
    assert (m.first_date, m.last_date, m.n_cited) == ("2017-02-03", "2023-01-10", 1)
    t = [r.headline for r in report.timeline(e).orderBy("sort_date", "pos").collect()]
    assert t == ["Allotted 10,000 shares to promoters at Rs. 154.2", "Allotted ? shares", "Bonus issue 5:1", "Authorised capital raised Rs. 60.00 Cr → Rs. 150.00 Cr", "Dividend Rs. 2.5/share", "Authorised capital raised Rs. 1 → Rs. 2", "Buyback of 1,500 shares", "event"]
    assert [r.event_id for r in report.citations(e).collect()] == ["allotment@p3"]
    b = report.brief(e, verify.verify(e)).first().markdown
    assert "- Latest authorised capital: **Rs. 150.00 Cr**" in b and "- **2017-02-03** — Allotted 10,000 shares to promoters at Rs. 154.2 (p. 3)" in b and "No contradictions" not in b
    assert report.metrics(e.limit(0)).count() == 0


def test_brief_of_a_large_scope(spark):
    """A scope above the size of a part gets its whole timeline, in ordered parts; so does a null scope."""
    n = 10_050
    kind = F.when(F.col("id") % 7 == 0, "authorised_capital_change").otherwise("allotment")
    cols = {"filing_id": F.when(F.col("id") < n, "hot").when(F.col("id") < n + 3, "cold"), "pos": F.col("id") % 5000, "event_type": kind, "date": F.when(F.col("id") % 3 > 0, F.format_string("20%02d-01-01", F.col("id") * 7 % 20)), "shares": F.col("id"), "old_capital": F.col("id"), "new_capital": F.col("id") + 5, "page_number": F.lit(2)}
    e = spark.range(n + 5).select(*[cols.get(f.split()[0], F.lit(None)).cast(f.split()[1]).alias(f.split()[0]) for f in EVENT.split(", ")])
    issues = verify.verify(e)
    got = {}
    for r in report.brief(e, issues).orderBy("filing_id", "part").collect():
        got.setdefault(r.filing_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"hot": 6, "cold": 1, None: 1} and [r.part for r in got["hot"]] == [1, 2, 3, 4, 5, 6]
    assert max(r.markdown.count("\n") for r in got["hot"]) < report.PART_LINES
    plain = lambda f: [f"- **{r.date or 'undated'}** — {r.headline} (p. 2)" for r in sorted(f.collect(), key=lambda r: (r.sort_date, r.pos, r.headline))]
    for scope in ("hot", "cold", None):
        text = "\n".join(r.markdown for r in got[scope])
        shown = text.split("## Capital timeline\n\n")[1].split("\n\n## Verification\n\n")
        assert shown[0].split("\n") == plain(report.timeline(e.where(F.col("filing_id").eqNullSafe(scope))))
        found = issues.where(F.col("filing_id").eqNullSafe(scope)).count()
        assert sum(x.startswith("    - [") for x in shown[1].split("\n")) == found
        assert shown[1].endswith(f"0 of {len(shown[0].splitlines())} events are page-cited back to the source filing.*")
    # Cut small or left whole, the brief reads the same.
    small = report.brief(e, issues, part_lines=100).orderBy("filing_id", "part").collect()
    whole = report.brief(e, issues, part_lines=20_000).where("filing_id = 'hot'").collect()
    assert "\n".join(r.markdown for r in small if r.filing_id == "hot") == whole[0].markdown == "\n".join(r.markdown for r in got["hot"]) and len(whole) == 1


def test_merging_and_repeats(spark):
    e = events(spark, {"event_type": "a", "date": "d", "shares": 1, "event_id": "t1"}, {"event_type": "a", "date": "d", "shares": 1, "event_id": "t2"}, {"event_type": "b", "event_id": "t3"})
    o = events(spark, {"event_type": "a", "date": "d", "shares": 1, "event_id": "m1"}, {"event_type": "c", "date": None, "event_id": "m2"}, {"event_type": "c", "date": None, "event_id": "m3"})
    got = [r.event_id for r in dedup.merge_extractions(e, o).orderBy("seq").collect()]
    assert got == ["t2", "m3", "t3"]
    r = events(spark, {"event_type": " A "}, {"event_type": "a"}, {"event_type": None}, {"event_type": "a", "shares": 0})
    assert sorted(x.pos for x in dedup.drop_repeats(r).collect()) == [0, 2, 3]


def test_scores(spark):
    kind = "event_type string, date string, m string"
    pred = spark.createDataFrame([("a", "1", "table"), ("a", "1", None), ("a", None, "llm"), ("b", "9", "llm")], kind)
    gold = spark.createDataFrame([("a", "1", None), ("a", None, None), ("c", "7", None)], kind)
    r = evaluate.evaluate(pred, gold).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (2, 1, 1, 0.667, 0.667, 0.667)
    assert {x.event_type: (x.tp, x.fp, x.fn) for x in evaluate.per_type(pred, gold).collect()} == {"a": (2, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1)}
    assert {x.method: (x.predicted, x.correct) for x in evaluate.per_method(pred, gold, "m").collect()} == {"table": (1, 1), "llm": (3, 2)}
    ranks = spark.createDataFrame([(1,), (3,), (None,), (8,)], "rank int")
    q = evaluate.rank_quality(ranks).first()
    assert (q.ndcg, q.mrr) == (0.375, round((1 + 1 / 3 + 1 / 8) / 4, 4))


@pytest.mark.parametrize("tp,fp,fn,want", [(6, 0, 1, (1.0, 0.857, 0.923)), (15, 0, 1, (1.0, 0.938, 0.968)), (0, 0, 0, (0.0, 0.0, 0.0))])
def test_published_scores(spark, tp, fp, fn, want):
    row = spark.createDataFrame([(tp, fp, fn)], "tp bigint, fp bigint, fn bigint").select(*[c.alias(n) for c, n in zip(evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn")), "prf")]).first()
    assert tuple(row) == want


def test_hybrid_search(spark):
    rows = [(f"event-{i}", f"allotment on 20{10 + i}-01-15, {i + 1}0000 shares, at price {100 + i}.5") for i in range(12)] + [("event-20", "bonus issue on 2020-01-01, ratio 5:1"), ("event-21", "bonus issue, ratio 1:4")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    q = spark.createDataFrame([(1, "price 104.5"), (2, "ratio 5:1"), (3, "zzz nothing"), (4, rows[3][1])], "query_id int, query string")
    hits = retrieval.search(docs, q, 3).collect()
    top = {}
    for h in hits:
        top.setdefault(h.query_id, []).append((h["rank"], h.doc_id, h.strategy, h.score))
    assert {len(v) for v in top.values()} == {3}
    assert "event-4" in [d for _, d, _, _ in top[1]] and "event-20" in [d for _, d, _, _ in top[2]]
    assert {s for _, _, s, _ in top[3]} == {"vector"} and min(top[4])[1] == "event-3"
    kept = retrieval.graded(retrieval.search(docs, q, 3)).join(docs, "doc_id")
    assert retrieval.answers(q, kept).where("answer like 'Relevant capital events:%'").count() == 4
    near = retrieval.nearest(spark.createDataFrame([(2, [0.0, 1.0]), (10, [0.0, 1.0]), (3, [5.0, 0.0]), (4, None)], "vec_id bigint, embedding array<double>"), spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 0.0])], "query_id int, embedding array<double>"), 2, block=1)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in near.collect()) == [(1, 1, 10, 0.0), (1, 2, 2, 0.0), (2, 1, 3, 0.0), (2, 2, 10, 26.0)]


MD = """intro
[PAGE 42]
# Equity share capital
| Date of Allotment | No. of Equity Shares | Face value | Issue Price (Rs.) | Nature of consideration |
|:---|---:|:-:|---|---|
| January 31, 2019 | 10,000 | 10 | 154.20 | Cash \\| kind |
| 31-01-2019 | 10,000 | 10 | 154.20 | Cash |
| December 23 | 5,000 | 10 | 1 | Cash |
| 2020-02-02 | 7 |

# Rights Issue
| Record date | Ratio | Issue price |
|---|---|---|
| 5 March 2020 | 1 : 4 (rights) | Rs. 220.50 |
--- Page 43 ---
| Particulars | Ratio |
|---|---|
| Debt | 2:1 |
# Capital
| Date of resolution | Increased from | Increased to | Type of resolution |
|---|---|---|---|
| 2018-05-05 | Rs. 60 crore | Rs. 150 crore | Ordinary  Resolution |
| 2018-05-05 | 5 | 6 | Ordinary |
| Date of allotment | Number of preference shares |
|---|---|
| 2020-01-01 | 500 |
"""


def test_markdown_tables_to_events(spark):
    docs = spark.createDataFrame([("x", MD, 1), ("y", "no table", 1), ("z", None, 1), ("e", "", 1)], "filing_id string, text string, section int")
    e = {(r.event_type, r.date): r for r in extract.table_events(markdown.parse_tables(docs)).collect()}
    a = e["allotment", "2019-01-31"]
    assert (a.shares, a.issue_price, a.face_value, a.page_number, a.source_provenance.section, a.confidence) == (10000, 154.2, 10.0, 42, "Equity share capital", 0.95)
    assert e["allotment", "2020-02-02"].shares == 7 and e["allotment", "2020-02-02"].issue_price is None
    r = e["rights_issue", "2020-03-05"]
    assert (r.ratio, r.price, r.page_number) == ("1:4(rights)", 220.5, 42)
    c = e["authorised_capital_change", "2018-05-05"]
    assert (c.old_capital, c.new_capital, c.resolution_type, c.page_number) == (600000000, 1500000000, "ordinary resolution", 43)
    assert len(e) == 4
    assert extract.extract_events(docs).where("event_type = 'allotment'").count() == 2
    pages = {(r.filing_id, r.page_number) for r in markdown.split_pages(docs).collect()}
    assert {("x", 1), ("x", 42), ("x", 43), ("y", 1)} <= pages


def test_duplicate_headers_and_guards():
    rows = list(markdown.table_rows("|a|a|\n|-|-|\n|1|2|\n|---|\n| b | c |\n|--|--|\n|x|y|"))
    assert rows[0][4:6] == (["a", "a"], ["1", "2"]) and rows[0][2] == 0
    assert dict(zip(NEEDLES, markdown.places_of(("date", "nature of allotment", "consideration"), 3)))["consideration"] == 1


def test_rows_of_a_long_table_grow_as_the_table(spark):
    head = "| Date of resolution | Increased from | Increased to |\n|---|---|---|\n"
    table = lambda n: head + "\n".join(f"| 2019-01-31 | {i} | {100_000 + i} |" for i in range(n))
    rows = list(markdown.table_rows(f"{table(300)}\n\n{table(2)}\n"))
    assert [(r[2], r[3], r[6]) for r in rows if r[6]] == [(0, 0, table(300)), (1, 0, table(2))] and len(rows) == 302
    n = 2 * markdown.BATCH + 5
    docs = spark.createDataFrame([(1, table(n)), (2, table(3))], "filing_id bigint, text string")
    events = extract.table_events(markdown.parse_tables(docs)).groupBy("filing_id").agg(F.count("new_capital").alias("n"), F.sum("new_capital").alias("total"), F.min("source_snippet").alias("first")).orderBy("filing_id")
    assert [tuple(r) for r in events.collect()] == [(k, m, m * 100_000 + m * (m - 1) // 2, "2019-01-31 | 0 | 100000") for k, m in ((1, n), (2, 3))]


def test_page_windows(spark):
    pages = spark.createDataFrame([("f", n, f"t{n}") for n in range(3, 9)] + [("g", 1, "only")], "filing_id string, page_number int, text string")
    got = sorted((r.filing_id, r.start_page, r.end_page) for r in provenance.page_windows(pages, 3, 1).collect())
    assert got == [("f", 3, 5), ("f", 5, 7), ("f", 7, 8), ("g", 1, 1)]
    first = provenance.page_windows(pages).where("filing_id = 'f'").orderBy("start_page").first()
    assert first.text == "[PAGE 3]\nt3\n[PAGE 4]\nt4"
    with pytest.raises(ValueError):
        provenance.page_windows(pages, 2, 2)


def test_provenance(spark):
    page = "The Board allotted ten thousand equity shares to promoters at a price of Rs. 154.20 each on the given date."
    pages = spark.createDataFrame([("f", 5, page), ("f", 6, "")], "filing_id string, page_number int, text string")
    rows = [("f", 5, "allotted  TEN thousand", 0.9), ("f", 5, "alloted ten thousand equity shares to promoter", None), ("f", 5, "something else entirely", 0.95), ("f", 99, "x", 0.5), ("f", None, "kept", 0.5), ("f", 5, None, None)]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, filing_id string, page_number int, source_snippet string, confidence double")
    got = {r.i: (r.page_number, r.source_snippet, r.confidence) for r in provenance.attach_provenance(e, pages).collect()}
    ratio = provenance.match_ratio("alloted ten thousand equity shares to promoter", page.lower())
    assert got[0] == (5, rows[0][2], 0.9) and got[2] == (5, page, 0.7) and got[3] == (None, None, 0.5) and got[4] == (None, "kept", 0.5) and got[5] == (5, page, 0.7)
    assert got[1] == ((5, rows[1][2], 1.0) if ratio >= 0.85 else (5, page, 0.7))
    assert provenance.match_ratio("abcd", "abcx") == SequenceMatcher(None, "abcd", "abcx").ratio()


@settings(max_examples=300, deadline=None)
@given(st.text("abc ~", max_size=40), st.text("abc ", max_size=120), st.integers(0, 60), st.integers(1, 9))
def test_snippet_decision_is_that_of_the_full_comparison(snippet, page, start, every):
    for x in (snippet, "".join("~" if i % every == 0 else c for i, c in enumerate(page[start : start + 60]))):
        assert provenance.stands(x, page) == (provenance.match_ratio(x, page) >= provenance.MATCH)


def test_altered_snippets_are_compared(spark):
    """Light misreads stand, heavy ones and reversed words do not; in page parts as on whole pages."""
    said = [f"Our Board approved the allotment of {n},000 Equity Shares to the promoters named below on March {n}, 2019." for n in range(10, 16)]
    rows = [(i, f"F{i}", 3, t, 0.9) for i, t in enumerate(said)] + [(6, "F6", None, "x", 0.9), (7, "F7", -1, "y", 0.9), (8, "F8", 4, None, 0.9)]
    # A page of many quotes, each long and unlike the others.
    many = [" ".join(chr(97 + (k * k + j * (k + 3)) % 26) * 3 + str(k * j) for j in range(8)) for k in range(40)]
    rows += [(100 + k, "hot", 9, t, None) for k, t in enumerate(many)]
    o = spark.createDataFrame(rows, "record_id bigint, filing_id string, page_number int, source_snippet string, confidence double")
    got = {r.record_id: r for r in catalogue.checked_snippets(o, 5).collect()}
    assert len(got) == len(rows)
    assert [got[i].confidence for i in range(6)] == [0.9, 0.7, 0.7, 0.9, 0.7, 0.7]
    assert [(got[i].page_number, got[i].n_chars) for i in (6, 7, 8)] == [(None, 1), (None, None), (None, None)]
    e = o.where("filing_id = 'hot'").select("record_id", "filing_id", "page_number", catalogue._altered(F.col("record_id"), F.col("source_snippet")).alias("s")).collect()
    part = {r.source_snippet: r.p for r in o.where("filing_id = 'hot'").select("source_snippet", F.pmod(F.xxhash64("source_snippet"), F.lit(8)).alias("p")).collect()}
    texts = [" ".join(sorted(t for t in many if part[t] == p)).lower() for p in set(part.values())]
    want = {r.record_id: 1.0 if any(provenance.match_ratio(" ".join(r.s.split()).lower(), t) >= provenance.MATCH for t in texts) else 0.7 for r in e}
    assert {k: got[k].confidence for k in want} == want and set(want.values()) == {0.7, 1.0}


def test_allotments_without_a_price_come_back(spark, sf):
    got = catalogue.QUERIES["md_roundtrip_allotment"](spark, sf)
    o = spark.read.parquet(f"{sf}/ola_drhp_extracted.parquet").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("event_type") == "allotment") & F.col("shares").isNotNull())
    want = o.select("filing_id", "date", "shares", "issue_price", F.lit(7).alias("page_number")).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == rows(want) and got.where("issue_price is null").count() > 0


def test_texts_and_timeline_show_every_figure(spark, sf):
    e = {r.event_id: r for r in catalogue.typed_events(spark, sf).collect()}
    texts = {r.event_id: r.sentence for r in catalogue.QUERIES["event_to_text"](spark, sf).collect()}
    lines = {r.event_id: r.headline for r in catalogue.QUERIES["timeline_sorted"](spark, sf).collect()}
    assert set(texts) == set(lines) == set(e)
    for i, r in e.items():
        assert (f"dividend {r.amount_per_share} per share" in texts[i]) == bool(r.amount_per_share)
        assert (f"exercise price {r.exercise_price}" in texts[i]) == bool(r.exercise_price)
        if r.event_type == "allotment":
            assert lines[i].endswith(f" at Rs. {r.issue_price}") == bool(r.issue_price)
        if r.event_type == "dividend_declaration":
            assert lines[i] == f"Dividend Rs. {'?' if r.amount_per_share is None else r.amount_per_share}/share"
        if r.event_type == "bonus_issue":
            assert lines[i] == f"Bonus issue {'?' if r.ratio is None else r.ratio}"
        if r.event_type == "share_repurchase":
            assert lines[i] == ("Share repurchase" if r.shares_bought_back is None else f"Buyback of {r.shares_bought_back:,} shares")
    assert any(r.amount_per_share for r in e.values()) and any(r.exercise_price for r in e.values())


def test_amounts_in_devanagari_digits_are_kept(spark, tmp_path):
    cells = [(1, "१,२५०.५०"), (2, "Rs. २ crore"), (3, "12.5"), (4, None), (5, "—")]
    spark.createDataFrame(cells, "event_id bigint, issue_price string").write.parquet(str(tmp_path / "sample_events.parquet"))
    got = {r.event_id: r.amount for r in catalogue.QUERIES["parse_amounts"](spark, str(tmp_path)).collect()}
    assert got == {1: 1250.5, 2: 2e7, 3: 12.5, 5: None}


def test_validation_and_listing(spark):
    raw = spark.createDataFrame([(1, "allotment", "10", "5.5"), (2, "allotment", "ten", None), (3, "allotment", "10.0", "x"), (4, "other", "ten", None), (5, None, "1", None)], "pos bigint, event_type string, shares string, issue_price string")
    got = {r.pos: r.error for r in quality.validate(raw).collect()}
    assert got == {1: None, 2: "allotment.shares", 3: "allotment.issue_price", 4: None, 5: "event_type"}
    assert [r.pos for r in quality.listed(raw, 2, "pos", "allotment").collect()] == [1, 2]
    assert [r.pos for r in quality.listed(raw, -2, "pos").collect()] == [1, 2, 3]
    assert column(spark, [0.9, 0.5, 0.2, None], quality.confidence_bucket, "double") == ["high", "middle", "low", ""]


def test_json_sources_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a", '{"source_file": "x", "capital_events": [{"event_type": "allotment", "shares": 10, "page": 4, "issue_price": 10.0}]}'), ("b", '```json\n[{"event_type": "b"}, {"event_type": "c"}]\n```'), ("c", "oops"), ("d", None)], "filing_id string, text string")
    e = json_events.events_of(files)
    assert sorted((r.filing_id, r.pos, r.event_type, r.page_number) for r in e.collect()) == [("a", 0, "allotment", 4), ("b", 0, "b", None), ("b", 1, "c", None)]
    sinks.write_extractions(e.select("filing_id", "pos", "event_type", "shares"), str(tmp_path / "out"))
    back = json_events.read_events(spark, str(tmp_path / "out"), per_line=True)
    assert sorted((r.filing_id, r.event_type) for r in back.collect()) == [("a", "allotment"), ("b", "b"), ("b", "c")]
    sinks.postprocess(spark.createDataFrame([(0, "allotment", "5"), (1, "Allotment", "5"), (2, "allotment", "x")], "pos bigint, event_type string, shares string"), str(tmp_path / "pp"))
    assert spark.read.json(str(tmp_path / "pp/clean")).count() == 1 and spark.read.json(str(tmp_path / "pp/invalid")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "pp/flat")).columns[:3] == ["event_type", "date", "shares"]
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    sinks.write_index(docs, str(tmp_path / "ix"))
    assert not sinks.index_is_stale(spark, str(tmp_path / "ix"), docs) and sinks.index_is_stale(spark, str(tmp_path / "ix"), docs.limit(1))


def test_plugins(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    pages = plugins.pdf_pages(files, lambda b: [("t" * 60, 0), ("", 1)]).collect()
    assert [(p.page_number, p.ocr_used, p.confidence) for p in pages] == [(1, False, 1.0), (2, True, 0.0)]
    assert plugins.pdf_pages(files).count() == 0
    words = spark.createDataFrame([(1, "a", 90.0), (1, " ", 10.0), (1, "b", -1.0), (2, "", 5.0)], "page int, text string, conf double")
    assert {r.page: r.confidence for r in plugins.word_confidence(words, "page").collect()} == {1: 0.9, 2: 0.0}
    src = spark.createDataFrame([("f", n, "bonus" if n != 2 else "bonus bad") for n in range(1, 5)] + [("f", 9, "other")], "filing_id string, page_number int, text string")
    def model(t):
        if "bad" in t:
            raise RuntimeError
        return '[{"event_type": "x"}]'
    answers = plugins.model_events(src, model, text.mentions(F.col("text"), text.CAPITAL_SIGNALS), limit=3)
    assert sorted(r.page_number for r in answers.collect()) == [1, 3]
    assert json_events.events_of(answers).count() == 2


def test_engine(spark, tmp_path):
    from capstrata.api import Engine

    (tmp_path / "f.md").write_text(MD)
    engine = Engine(spark)
    with pytest.raises(ValueError):
        engine.stats()
    assert engine.ingest(str(tmp_path), "j1").first().n_events == 4
    assert engine.ingest_index("j1") == 4
    assert {r.event_type: r.n for r in engine.stats().collect()} == {"allotment": 2, "rights_issue": 1, "authorised_capital_change": 1}
    assert engine.search("rights ratio 1:4").first().event_type == "rights_issue"
    assert engine.ask("shares at 154.2")["answer"].startswith("Relevant capital events:")
    with pytest.raises(ValueError):
        engine.search(" ")
    assert engine.health()["indexed"] == 4


def test_streams(spark, tmp_path, sf):
    from capstrata.session import table
    from capstrata.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(MD)
    run = lambda: ingest.stream_filings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    (tmp_path / "in" / "b.md").write_text(MD.replace("10,000", "11,000"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    e = table(spark, sf, "events")
    assert ingest.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_attach_group_matches_a_window(spark):
    df = spark.range(400).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("id") % 5).alias("k"))
    out = attach_group(df, ["k"], "i", [F.min("i").alias("__m"), F.count(F.lit(1)).alias("__n")], [F.min("__m").alias("m"), F.sum("__n").alias("n")], 4)
    want = {r.i: (r.m, r.n) for r in df.selectExpr("i", "min(i) over (partition by k) m", "count(*) over (partition by k) n").collect()}
    assert {r.i: (r.m, r.n) for r in out.collect()} == want


# ---- laid-out pages, boundaries and small operators


def test_markdown_lines():
    assert markdown.cells_of(r"| a \| b | c |") == ["a | b", "c"] and markdown.cells_of("x|y") == ["x", "y"] and markdown.cells_of("||z|") == ["", "z"] and markdown.cells_of("|") == [""]
    assert all(markdown.is_rule(x) for x in ("|---|:--:|", "--- | ---", "-", "| --: ||")) and not any(markdown.is_rule(x) for x in ("", "| a - |", "|:|", "- - x"))
    pages = {"[PAGE 12]": 12, "see [ page 3 ] here": 3, "<!-- page no. 7 -->": 7, "{9}----": 9, "--- Page 4 ---": 4, "page 5": 5, "Page five": None, "[page x]": None, "on page 6 of": None, "{a}": None}
    assert {k: markdown.page_of(k) for k in pages} == pages
    heads = {"# A": "A", "   ###### B c ": "B c", "    # code": None, "#no": None, "####### seven": None, "## ": None}
    assert {k: markdown.heading_of(k) for k in heads} == heads


def test_laid_out_pages(spark):
    from capstrata.operators import layout

    chars = spark.createDataFrame([("f", 1, i, c, 14.0 if i < 4 else 9.0, 10.2 if i < 4 else 50.0) for i, c in enumerate("Hea ") ] + [("f", 1, 10 + i, c, 9.0, 50.0) for i, c in enumerate("small text")], "filing_id string, page_num int, n int, text string, size double, top double")
    head, body = [["Date of", "No. of"], ["allotment", "shares"]], [["2019-01-31", "5,000"], [None, " 7 "]]
    grid = lambda p, s, box, cells, n=0: ("f", p, s, n, box, cells)
    grids = spark.createDataFrame([grid(1, "lines", [0.0, 20.0, 1.0, 2.0], head + body), grid(1, "lines", [0.0, 5.0, 1.0, 2.0], head + body, 1), grid(1, "text", [0.0, 30.0, 1.0, 2.0], head + body, 2), grid(2, "text", [0.0, 1.0, 2.0, 3.0], head + body), grid(3, "text", [0.0, 1.0, 2.0, 3.0], head + body), grid(4, "lines", [0.0, 1.0, 2.0, 3.0], [["one"]])], "filing_id string, page_num int, strategy string, table_no int, bbox array<double>, cells array<array<string>>")
    pages = spark.createDataFrame([("f", 1, "x"), ("f", 2, "Date of Allotment"), ("f", 3, "nothing")], "filing_id string, page_num int, text string")
    rows = layout.page_table_rows(chars, grids, pages).collect()
    assert {(r.page_num, r.table_no, r.section) for r in rows} == {(1, 0, "Hea"), (1, 1, ""), (2, 0, "")}
    assert {tuple(r.headers) for r in rows} == {("date of allotment", "no. of shares")} and all(r.cells[1] in ("5,000", "7") for r in rows)
    events = extract.table_events(layout.page_table_rows(chars, grids, pages)).collect()
    assert [(e.date, e.shares) for e in events] == [("2019-01-31", 5000)] * 3 and events[0].bbox == [0.0, 20.0, 1.0, 2.0] or len(events) == 3
    assert layout.page_table_rows(chars.limit(0), grids.limit(0), pages.limit(0)).count() == 0


def test_index_and_exact_search_agree(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, [float(x) for x in v[0]])], "vec_id bigint, embedding array<double>").repartition(3)
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    exact = retrieval.nearest(df, q, 5, block=7)
    all_ = {i: v[i] for i in range(400)} | {900: v[0]}
    for query in (0, 900, 60):
        d = sorted((round(float(((all_[query] - x) ** 2).sum()), 9), str(i)) for i, x in all_.items())[:5]
        assert [str(r.vec_id) for r in exact.where(f"query_id = {query}").orderBy("rank").collect()] == [i for _, i in d]
    r = retrieval.recall(retrieval.nearest_cells(df, q, 5, n_cells=16), exact).first()
    assert r.n_exact == 105 and r.recall >= 0.9
    assert retrieval.recall(retrieval.nearest_cells(df, q, 5, probes=16, n_cells=16), exact).first().recall == 1.0
    assert retrieval.nearest_cells(df.limit(0), q, 5).count() == 0


def test_boundaries(spark, tmp_path):
    from capstrata.session import Settings, new_job
    from capstrata.sources import plugins

    tried = []

    def flaky(x):
        tried.append(x)
        if len(tried) < 2:
            raise RuntimeError
        return x + "!"

    assert plugins.retried(flaky, "a", wait=0.0) == "a!" and plugins.narrative("brief", None) == ("brief", "extractive") and plugins.narrative("brief", lambda x: "told")[1] == "llm"
    assert plugins.narrative("brief", lambda x: 1 / 0) == ("brief", "extractive")
    files = spark.createDataFrame([("a.pdf", 10, bytearray(b"x" * 301), None), ("b.PDF", 10, bytearray(b"x"), None), ("c.doc", 1, bytearray(b""), None), ("d", 1, bytearray(b""), "text/markdown"), ("e.md", 99, bytearray(b""), None), ("f.pdf", 5, bytearray(b"?"), None)], "path string, length bigint, content binary, mime string")
    got = {r.path: r.status for r in plugins.admissible(files, 50, lambda x: 1 // (x != b"?") and len(x)).collect()}
    assert got == {"a.pdf": 413, "b.PDF": 200, "c.doc": 400, "d": 200, "e.md": 413, "f.pdf": 200}
    env = tmp_path / ".env"
    env.write_text("# c\nCAPSTRATA_TOP_K=9\n")
    assert Settings.read(str(env)).top_k == 9 and Settings.read(None).model_pages == 30 and len(new_job()) == 12


def test_chunks_go_on_where_they_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([(i,) for i in range(6)], "chunk_id int")
    path, seen = str(tmp_path / "run"), []

    def work(part):
        seen.append(part.count())
        return part.withColumn("r", F.col("chunk_id") * 10)

    assert sinks.partial(spark, path) is None
    assert sinks.resume(chunks.where("chunk_id < 2"), work, path).count() == 2
    assert sorted(r.r for r in sinks.resume(chunks, work, path).collect()) == [0, 10, 20, 30, 40, 50] and seen == [2, 4]
    assert sinks.partial(spark, path).count() == 6
    sinks.cleanup(spark, path)
    assert sinks.partial(spark, path) is None


def test_scores_of_a_small_gold_set(spark):
    """7 gold events of which 6 are found, nothing else; 16 of which 15 are found."""
    for n in (7, 16):
        gold = spark.createDataFrame([("allotment", f"2019-01-{i:02d}") for i in range(1, n + 1)], "event_type string, date string")
        pred = gold.where("date <> '2019-01-01'")
        s = evaluate.evaluate(pred, gold).first()
        assert (s.precision, s.recall, s.f1) == ((1.0, 0.857, 0.923) if n == 7 else (1.0, 0.938, 0.968))
        assert [(r.date, r.side) for r in evaluate.differences(pred, gold).collect()] == [("2019-01-01", "missed")]


def test_command_line(spark, tmp_path):
    from capstrata.__main__ import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.md").write_text(MD)
    out = run(spark, ["extract", str(tmp_path / "in"), str(tmp_path / "out")])
    assert out.first().n_events == 4
    assert run(spark, ["evaluate", str(tmp_path / "out"), str(tmp_path / "out")]).first().f1 == 1.0
    assert "F1=1.000" in run(spark, ["corpus", str(tmp_path / "out"), str(tmp_path / "out")]).first().line
    assert markdown.filings_in(spark, str(tmp_path / "none")).count() == 0 and [r.path[-4:] for r in markdown.filings_in(spark, str(tmp_path / "in")).collect()] == ["f.md"]
    briefs = spark.createDataFrame([("a",), ("b",)], "markdown string")
    assert {(r.markdown, r.narrative, r.mode) for r in plugins.told(briefs, lambda x: {"a": "A"}[x]).collect()} == {("a", "A", "llm"), ("b", "b", "extractive")}


def test_meta_of_extraction_files(spark, tmp_path):
    files = spark.createDataFrame([("a", '{"source_file": "x.pdf", "total_pages": 7, "capital_events": [{"event_type": "allotment"}]}'), ("b", '[{"event_type": "allotment"}]'), ("c", "no json"), ("d", None)], "filing_id string, text string")
    got = {r.filing_id: r.meta for r in json_events.meta_of(files).collect()}
    assert got == {"a": {"source_file": "x.pdf", "total_pages": "7"}, "b": {}, "c": {}, "d": {}}
    raw = spark.createDataFrame([("f", 0, "allotment", "5"), ("f", 1, "allotment", "5"), ("f", 2, "allotment", "x")], "filing_id string, pos int, event_type string, shares string")
    sinks.postprocess(raw, str(tmp_path / "o"), meta=spark.createDataFrame([("f", 7, "m")], "filing_id string, total_pages int, model string"))
    text_ = spark.read.text(str(tmp_path / "o" / "documents")).first().value
    assert '"total_pages":7' in text_ and text_.count('"allotment"') == 1


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from capstrata.session import checkpoint_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError):
            checkpoint_dir(bare)
