"""Capital-history report: metrics, timeline, citations and the rendered brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import grouped, rupees
from ..functions.text import rendered, truthy
from ..session import cut_lineage

#: Fixed value: most events of a brief in one part, and most lines of a part.
PART_LINES = 10_000


def metrics(events: DataFrame, scope: Sequence[str] = ("filing_id",)) -> DataFrame:
    """Headline measures in one aggregate per scope. The latest authorised capital is that of the last change by
    (date, pos), null if that row has none; sums cut each value to a whole number."""
    kind = F.col("event_type")
    total = lambda t, c: F.coalesce(F.sum(F.when(kind == t, F.col(c).try_cast("bigint"))), F.lit(0))
    changed = kind == "authorised_capital_change"
    out = events.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_events"),
        total("allotment", "shares").alias("total_shares_allotted"),
        F.count_if(kind == "allotment").alias("allotment_events"),
        F.count_if(kind == "bonus_issue").alias("bonus_issues"),
        F.count_if(kind == "rights_issue").alias("rights_issues"),
        F.max_by("new_capital", F.when(changed, F.struct(F.coalesce("date", F.lit("")), "pos"))).alias("latest_authorised_capital"),
        total("dividend_declaration", "total_outflow").alias("total_dividend_outflow"),
        total("share_repurchase", "shares_bought_back").alias("total_shares_bought_back"),
        total("warrant_exercise", "warrants_exercised").alias("total_warrants_exercised"),
        F.min(F.nullif("date", F.lit(""))).alias("first_date"),
        F.max(F.nullif("date", F.lit(""))).alias("last_date"),
        F.count_if(F.col("page_number").isNotNull() & F.col("source_snippet").isNotNull()).alias("n_cited"),
    )
    return out.withColumn("latest_authorised_capital_fmt", rupees(F.col("latest_authorised_capital")))


def headline(df: DataFrame) -> Column:
    """One line per event by its type; unknown figures show as "?"."""
    def shown(c: str) -> Column:
        return F.coalesce(rendered(F.col(c), df.schema[c].dataType.simpleString()), F.lit("?"))

    has = lambda c: truthy(F.col(c), df.schema[c].dataType.simpleString())
    kind = F.coalesce("event_type", F.lit("event"))
    to = F.when(has("allottee_category"), F.concat(F.lit(" to "), F.col("allottee_category"))).otherwise("")
    at = F.when(has("issue_price"), F.concat(F.lit(" at Rs. "), shown("issue_price"))).otherwise("")
    return (
        F.when(kind == "allotment", F.concat(F.lit("Allotted "), F.coalesce(grouped(F.col("shares")), F.lit("?")), F.lit(" shares"), to, at))
        .when(kind == "bonus_issue", F.concat(F.lit("Bonus issue "), shown("ratio")))
        .when(kind == "rights_issue", F.concat(F.lit("Rights issue "), shown("ratio"), F.lit(" at Rs. "), shown("price")))
        .when(kind == "authorised_capital_change", F.concat(F.lit("Authorised capital raised "), rupees(F.col("old_capital")), F.lit(" → "), rupees(F.col("new_capital"))))
        .when(kind == "dividend_declaration", F.concat(F.lit("Dividend Rs. "), shown("amount_per_share"), F.lit("/share")))
        .when(kind == "share_repurchase", F.coalesce(F.concat(F.lit("Buyback of "), grouped(F.col("shares_bought_back")), F.lit(" shares")), F.lit("Share repurchase")))
        .when(kind == "warrant_exercise", F.coalesce(F.concat(grouped(F.col("warrants_exercised")), F.lit(" warrants exercised")), F.lit("Warrant exercise")))
        .otherwise(F.translate(kind, "_", " "))
    )


def timeline_key(date: Column) -> Column:
    """Undated events come last."""
    return F.coalesce(F.nullif(date, F.lit("")), F.lit("9999-99-99"))


def timeline(events: DataFrame, scope: Sequence[str] = ("filing_id",)) -> DataFrame:
    """scope, sort key, pos, date, event_type, headline, page_number, source_snippet."""
    return events.select(*scope, timeline_key(F.col("date")).alias("sort_date"), "pos", "date", F.coalesce("event_type", F.lit("event")).alias("event_type"), headline(events).alias("headline"), "page_number", "source_snippet")


def citations(events: DataFrame, scope: Sequence[str] = ("filing_id",)) -> DataFrame:
    """Events with both a page and a snippet; an event without id is named by type and page."""
    own = F.nullif(F.col("event_id").cast("string"), F.lit(""))
    name = F.coalesce(own, F.concat(F.coalesce("event_type", F.lit("event")), F.lit("@p"), F.col("page_number").cast("string")))
    section = F.col("source_provenance.section") if "source_provenance" in events.columns else F.lit(None).cast("string")
    return events.where("page_number is not null and source_snippet is not null").select(*scope, name.alias("event_id"), "page_number", "source_snippet", section.alias("section_heading"))


def brief(events: DataFrame, issues: DataFrame, scope: str = "filing_id", title: str = "Capital history", part_lines: int = PART_LINES) -> DataFrame:
    """scope, part, markdown: the brief of each scope; its parts in order, joined by newlines, are the whole brief.

    A scope of at most ``part_lines`` events is one part. A larger one has parts for its snapshot, for each
    ``part_lines`` lines of its timeline by (sort_date, pos), for the verdict, for the issues in the same way and for the
    closing line. Its lines are dealt out by range, so neither a task nor a string holds all of a hot scope.
    """
    key = F.struct(scope).alias("__k")  # joins a null scope as well
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- **"), F.coalesce(F.nullif("date", F.lit("")), F.lit("undated")), F.lit("** — "), "headline", page)
    told = timeline(events, [scope]).select(key, F.lit(0).alias("section"), "sort_date", "pos", line.alias("line"))
    issue = F.concat(F.lit("    - ["), F.col("check_type"), F.lit("] "), F.array_join("event_ids", ", "))
    lines = told.unionByName(issues.select(key, F.lit(1).alias("section"), F.col("check_order").cast("string").alias("sort_date"), F.lit(None).cast(events.schema["pos"].dataType).alias("pos"), issue.alias("line")))
    big = cut_lineage(events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_lines).select("__k"))
    m = metrics(events.withColumn("__k", key), ["__k"])
    if big.isEmpty():
        out = _whole(m, lines, title)
    else:
        few = F.broadcast(big)
        out = _whole(m.where(F.col("n_events") <= part_lines), lines.join(few, "__k", "left_anti"), title)
        out = out.unionByName(_parted(m.join(few, "__k", "left_semi"), lines.join(few, "__k", "left_semi"), title, part_lines))
    return out.select(F.col("__k")[scope].alias(scope), "part", "markdown")


def _whole(m: DataFrame, lines: DataFrame, title: str) -> DataFrame:
    """__k, part, markdown: each scope's brief as one part."""
    x = lines.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("section", "sort_date", "pos", "line"))).alias("x"))
    of = lambda s: F.filter("x", lambda y: y["section"] == s)
    text = lambda s: F.array_join(F.transform(of(s), lambda y: y["line"]), "\n")
    j = m.join(x, "__k").withColumn("n_issues", F.size(of(1)))
    return j.select("__k", F.lit(1).cast("bigint").alias("part"), F.concat_ws("\n", _head(title), text(0), _verdict(), F.when(F.col("n_issues") > 0, text(1)), _foot()).alias("markdown"))


def _parted(m: DataFrame, lines: DataFrame, title: str, part_lines: int) -> DataFrame:
    """__k, part, markdown of scopes too large for one part. The ranges are kept by a checkpoint, so that every line has one
    number: those in the ranges before its own, and its rank there."""
    at = cut_lineage(lines.repartitionByRange("__k", "section", "sort_date", "pos", "line").withColumn("__p", F.spark_partition_id()))
    ranges = at.groupBy("__k", "section", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__k", "section").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__k", "section", "__p").orderBy("sort_date", "pos", "line"))
    i = F.col("__before") + rank - 1
    chunks = lambda s: F.ceil(F.sum(F.when(F.col("section") == s, F.col("__n")).otherwise(0)) / part_lines)
    sizes = ranges.groupBy("__k").agg(chunks(0).alias("__told"), chunks(1).alias("__issues"), F.sum(F.when(F.col("section") == 1, F.col("__n")).otherwise(0)).alias("n_issues"))
    numbered = at.join(ranges.withColumn("__before", before).drop("__n"), ["__k", "section", "__p"]).withColumn("__i", i).withColumn("__c", F.floor(F.col("__i") / part_lines))
    texts = numbered.groupBy("__k", "section", "__c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    part = F.when(F.col("section") == 0, F.col("__c") + 2).otherwise(F.col("__told") + F.col("__c") + 3)
    inner = texts.join(sizes, "__k").select("__k", part.alias("part"), "markdown")
    edge = lambda n, c: F.struct(n.cast("bigint").alias("part"), c.alias("markdown"))
    edges = F.array(edge(F.lit(1), _head(title)), edge(F.col("__told") + 2, _verdict()), edge(F.col("__told") + F.col("__issues") + 3, _foot()))
    return m.join(sizes, "__k").select("__k", F.inline(edges)).unionByName(inner)


def _head(title: str) -> Column:
    """The brief up to the heading of the timeline, from the measures."""
    num = lambda c: grouped(F.col(c))
    return F.concat_ws(
        "\n",
        F.lit(f"# {title}"), F.lit(""),
        F.concat(F.lit("*"), F.col("n_events").cast("string"), F.lit(" capital events"), F.coalesce(F.concat(F.lit(" spanning "), "first_date", F.lit(" → "), "last_date"), F.lit("")), F.lit("*")),
        F.lit(""), F.lit("## Snapshot"), F.lit(""),
        F.concat(F.lit("- Latest authorised capital: **"), "latest_authorised_capital_fmt", F.lit("**")),
        F.concat(F.lit("- Total shares allotted: **"), num("total_shares_allotted"), F.lit("** across "), F.col("allotment_events").cast("string"), F.lit(" allotments")),
        F.concat(F.lit("- Bonus issues: **"), F.col("bonus_issues").cast("string"), F.lit("**  ·  Rights issues: **"), F.col("rights_issues").cast("string"), F.lit("**")),
        F.concat(F.lit("- Total dividend outflow: **"), rupees(F.nullif("total_dividend_outflow", F.lit(0))), F.lit("**")),
        F.concat(F.lit("- Shares bought back: **"), num("total_shares_bought_back"), F.lit("**  ·  Warrants exercised: **"), num("total_warrants_exercised"), F.lit("**")),
        F.lit(""), F.lit("## Capital timeline"), F.lit(""),
    )


def _verdict() -> Column:
    """Heading and verdict of the verification; the issues, if any, follow."""
    clean = F.concat(F.lit("- ✅ No contradictions across "), F.col("n_events").cast("string"), F.lit(" events (timeline / capital-continuity / bonus-arithmetic)."))
    found = F.concat(F.lit("- ⚠️ **"), F.col("n_issues").cast("string"), F.lit(" contradiction(s)** found across "), F.col("n_events").cast("string"), F.lit(" events:"))
    return F.concat(F.lit("\n## Verification\n\n"), F.when(F.col("n_issues") == 0, clean).otherwise(found))


def _foot() -> Column:
    return F.concat(F.lit("\n*"), F.col("n_cited").cast("string"), F.lit(" of "), F.col("n_events").cast("string"), F.lit(" events are page-cited back to the source filing.*"))
