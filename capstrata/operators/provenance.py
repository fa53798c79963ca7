"""Page windows and validation of what events claim to quote."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blanks

#: Least match of a snippet with its page, confidence of a replaced one, its length, end of the search.
MATCH, FALLBACK, CHARS, ENOUGH = 0.85, 0.7, 200, 0.99


def page_windows(pages: DataFrame, size: int = 2, overlap: int = 1, key: str = "filing_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """key, start_page, end_page, text of overlapping windows of ``size`` pages; pages are marked "[PAGE n]".

    Pages are numbered without gaps from their least number. Each page is sent to the windows that hold it by a range
    of starts, so no window function over a document is needed.
    """
    if overlap >= size or size < 1 or overlap < 0:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    bounds = pages.groupBy(key).agg(F.min(page).alias("__lo"), F.max(page).alias("__hi"))
    p = pages.join(bounds, key).withColumn("__i", F.col(page) - F.col("__lo")).withColumn("__n", F.col("__hi") - F.col("__lo") + 1)
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("int"), F.floor(F.col("__i") / step).cast("int"))
    w = p.withColumn("__s", F.explode(starts)).withColumn("__s", F.col("__s") * step).where((F.col("__s") == 0) | (F.col("__s") + overlap < F.col("__n")))
    part = F.struct(F.col("__i"), F.concat(F.lit("[PAGE "), F.col(page).cast("string"), F.lit("]\n"), F.col(text)).alias("t"))
    out = w.groupBy(key, "__s").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("text"))
    return out.drop("__s")


def match_ratio(snippet: str, page: str) -> float:
    """Best likeness of a snippet to any window of its length on a page, both with single blanks in lower case."""
    n = len(snippet)
    if not n or not page:
        return 0.0
    if snippet in page:
        return 1.0
    if n >= len(page):
        return SequenceMatcher(None, snippet, page).ratio()
    best = 0.0
    for i in range(0, len(page) - n + 1, max(1, n // 2)):
        best = max(best, SequenceMatcher(None, snippet, page[i : i + n]).ratio())
        if best >= ENOUGH:
            break
    return best


def stands(snippet: str, page: str) -> bool:
    """Whether ``match_ratio`` reaches MATCH, by the same windows. What a comparison can match is at most the characters
    that the page has at all, and at most a longest common subsequence; only windows that pass both are compared in full."""
    n = len(snippet)
    if not n or not page:
        return False
    if snippet in page:
        return True
    if 2.0 * sum(map(set(page).__contains__, snippet)) / (n + min(n, len(page))) < MATCH:
        return False
    at: dict[str, int] = {}
    for k, c in enumerate(snippet):
        at[c] = at.get(c, 0) | 1 << k
    bits = [at.get(c, 0) for c in page]
    starts = range(0, len(page) - n + 1, max(1, n // 2)) if n < len(page) else (0,)
    return any(_in_order(bits[i : i + n] if n < len(page) else bits, n) and _alike(snippet, page[i : i + n] if n < len(page) else page) for i in starts)


def _in_order(bits: list[int], n: int) -> bool:
    """Whether a longest common subsequence suffices for MATCH; each character of the window comes as the bits of its places
    among the snippet's n."""
    m, full = len(bits), (1 << n) - 1
    v = full  # a bit at 0 for each character of the subsequence
    for i in range(0, m, 16):
        for x in bits[i : i + 16]:
            u = v & x
            v = v + u | v - u
        v &= full
        if 2.0 * (n - v.bit_count() + max(0, m - i - 16)) / (n + m) < MATCH:
            return False
    return True


def _alike(a: str, b: str) -> bool:
    """SequenceMatcher(None, a, b).ratio() >= MATCH: its longest blocks, earliest first, by substring search. From 200
    characters on it leaves out frequent ones; there it is called itself."""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio() >= MATCH
    length, total, rest, todo = len(a) + len(b), 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        part, best, at, i = b[b0:b1], 0, 0, a0
        while i + best < a1:
            if a[i : i + best + 1] in part:
                best, at = best + 1, i
                while at + best < a1 and a[at : at + best + 1] in part:
                    best += 1
            i += 1
        rest -= min(a1 - a0, b1 - b0)
        if best:
            total += best
            j = b.index(a[at : at + best], b0, b1)
            for x in ((a0, at, b0, j), (at + best, a1, j + best, b1)):
                if x[0] < x[1] and x[2] < x[3]:
                    todo.append(x)
                    rest += min(x[1] - x[0], x[3] - x[2])
        if 2.0 * total / length >= MATCH:
            return True
        if 2.0 * (total + rest) / length < MATCH:
            return False
    return False


@F.pandas_udf(T.BooleanType())
def _stand(snippet: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([stands(s or "", p or "") for s, p in zip(snippet, page)], dtype="bool")


def _found(snippet: Column, text: Column) -> Column:
    """Whether a snippet stands on a text. Literal matches are settled in the JVM; only the rest is sent on to be compared."""
    snip, body = F.lower(blanks(snippet)), F.lower(text)
    literal = F.coalesce((snip != "") & F.contains(body, snip), F.lit(False))
    return literal | _stand(F.when(~literal, snip), F.when(~literal & (snip != ""), body))


def attach_provenance(events: DataFrame, pages: DataFrame, key: str = "filing_id", part: str | None = None) -> DataFrame:
    """Events checked against their pages: an unknown page is removed with its snippet; a snippet that does not stand
    on its page is replaced by the page's beginning at lower confidence; events without a page stay as they are.

    With ``part``, pages come as numbered parts that no passage crosses, and a snippet stands on its page if it stands on
    any of them. Then each distinct (page, snippet) meets each part in a task of that part, so no row holds a whole page.
    """
    known = pages.select(F.col(key).alias("__k"), F.col("page_number").alias("__p"), blanks(F.col("text")).alias("__text"), *([F.col(part).alias("__part")] if part else []))
    df = events.withColumn("__page", F.col("page_number").try_cast("int"))
    same = (F.col(key) == F.col("__k")) & (F.col("__page") == F.col("__p"))
    begins = F.substring("__text", 1, CHARS)
    if part:
        parts = known.groupBy("__k", "__p").agg(F.collect_set("__part").alias("__parts"))
        claims = df.select(key, "__page", "source_snippet").distinct().join(F.broadcast(parts), same).select("__k", "__p", F.col("source_snippet").alias("__s"), F.explode("__parts").alias("__part"))
        each = claims.join(known, ["__k", "__p", "__part"]).select("__k", "__p", "__s", "__part", begins.alias("__begin"), _found(F.col("__s"), F.col("__text")).alias("__good"))
        each = each.groupBy("__k", "__p", "__s").agg(F.bool_or(F.coalesce("__good", F.lit(False))).alias("__good"), F.min_by("__begin", "__part").alias("__begin"))
        j = df.join(each, same & F.col("source_snippet").eqNullSafe(F.col("__s")), "left")
    else:
        j = df.join(known, same, "left").withColumn("__begin", begins).withColumn("__good", F.coalesce(_found(F.col("source_snippet"), F.col("__text")), F.lit(False)))
    claimed, found, good = F.col("page_number").isNotNull(), F.col("__begin").isNotNull(), F.col("__good")
    snippet = F.when(~claimed | (found & good), F.col("source_snippet")).when(found, F.col("__begin"))
    confidence = F.when(~claimed | ~found, F.col("confidence")).when(good, F.coalesce("confidence", F.lit(1.0))).otherwise(F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(FALLBACK)))
    page = F.when(found, F.col("__page"))
    return j.withColumns({"source_snippet": snippet, "confidence": confidence, "page_number": page}).select(*events.columns)
