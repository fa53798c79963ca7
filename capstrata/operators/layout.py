"""Tables of laid-out pages: which grids count, the heading each stands under, and their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import NEEDLES, column_at, fold_headers, more_header_rows
from ..functions.text import TABLE_SIGNALS, blanks, mentions

#: How much larger than the page's median a heading's letters are on average; least rows of a table.
HEADING, LEAST_ROWS = 1.1, 2
LINES, TEXT = "lines", "text"


def headings(chars: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, page_num, top, text of the heading lines, from characters (key, page_num, n, text, size, top) in order ``n``.

    Characters are on one line if their rounded tops agree; a line is a heading if its mean size is above HEADING times
    the median size of its page's characters. A page is the most that one task holds of a document.
    """
    page = [key, "page_num"]
    c = chars.withColumn("__line", F.bround("top", 0))
    c = c.withColumn("__median", F.median("size").over(Window.partitionBy(*page)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "")
    lines = c.groupBy(*page, "__line").agg(F.min_by("top", "n").alias("top"), blanks(text).alias("text"), F.avg("size").alias("mean"), F.max("__median").alias("median"))
    return lines.where((F.col("mean") > HEADING * F.col("median")) & (F.col("text") != "")).select(*page, "top", "text")


def chosen_grids(grids: DataFrame, pages: DataFrame, key: str = "filing_id") -> DataFrame:
    """The ruled grids (strategy "lines") of each page; where there are none and the page's text has a table signal, those
    found by alignment ("text"). Grids of fewer than two rows are left out after that choice."""
    page = [key, "page_num"]
    ruled = grids.where(F.col("strategy") == LINES)
    signalled = pages.where(mentions(F.col("text"), TABLE_SIGNALS)).select(*page).distinct()
    aligned = grids.where(F.col("strategy") == TEXT).join(ruled.select(*page).distinct(), page, "left_anti").join(signalled, page, "left_semi")
    return ruled.unionByName(aligned).where(F.size("cells") >= LEAST_ROWS)


def under_headings(grids: DataFrame, heads: DataFrame, key: str = "filing_id") -> DataFrame:
    """Adds ``section``: the last heading (by top, then text) of the page that stands no lower than the grid's top, a
    backward as-of join; empty where there is none."""
    at = grids.withColumn("__g", F.struct("table_no", "strategy"))
    h = heads.select(F.col(key).alias("__k"), F.col("page_num").alias("__p"), F.struct("top", "text").alias("__h"))
    near = at.select(key, "page_num", "__g", F.element_at("bbox", 2).alias("__top")).join(h, (F.col(key) == F.col("__k")) & (F.col("page_num") == F.col("__p")) & (F.col("__h.top") <= F.col("__top")))
    best = near.groupBy(key, "page_num", "__g").agg(F.max("__h").alias("__h"))
    return at.join(best, [key, "page_num", "__g"], "left").withColumn("section", F.coalesce("__h.text", F.lit(""))).drop("__h", "__g")


def grid_rows(grids: DataFrame, key: str = "filing_id") -> DataFrame:
    """Rows of grids in the columns of the table parser (markdown.TABLE_ROWS) with their ``bbox``: wrapped headers folded,
    cells trimmed, those beyond the headers left out."""
    full = F.transform("cells", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    raw = F.array_join(F.transform("__c", lambda r: F.array_join(r, " | ")), "\n")
    # What is costly is made a column of the grid once, before its rows are taken apart.
    g = grids.withColumn("__c", full).withColumn("__more", more_header_rows(F.col("__c")))
    names, body = fold_headers(F.col("__c"), F.col("__more"))
    g = g.withColumns({"headers": names, "__body": body, "raw_text": raw}).withColumn("places", places(F.col("headers")))
    box = F.transform("bbox", lambda v: F.round(v, 2))
    rows = g.select(key, "page_num", "section", "table_no", "headers", "raw_text", "places", box.alias("bbox"), F.posexplode("__body").alias("row_no", "__r"))
    rows = rows.withColumn("cells", F.transform(F.slice("__r", F.lit(1), F.size("headers")), lambda c: F.trim(c))).drop("__r")
    return rows.withColumn("row_text", F.array_join(F.filter("cells", lambda c: c != ""), " | "))


def places(headers: Column) -> Column:
    """0-based column of each wanted name, in the order of NEEDLES, null if none. Share counts come neither from the
    allotment date's column nor from cumulative ones."""
    date = column_at(headers, NEEDLES["allot_date"])
    barred = F.filter(F.transform(headers, lambda x, i: F.when(x.contains("cumulative") | (i == F.coalesce(date, F.lit(-1))), i)), lambda i: i.isNotNull())
    return F.array(*[column_at(headers, needles, barred if name == "shares" else None) for name, needles in NEEDLES.items()])


def page_table_rows(chars: DataFrame, grids: DataFrame, pages: DataFrame, key: str = "filing_id") -> DataFrame:
    """Table rows of laid-out pages, ready for ``extract.table_events``."""
    return grid_rows(under_headings(chosen_grids(grids, pages, key), headings(chars, key), key), key)
