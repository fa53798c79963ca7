"""Markdown filings: tables with page and section, page texts, and file sources."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import NEEDLES
from ..functions.text import is_markdown, page_marker
from ..operators.asof import carried

_ASIDE = re.compile(r"\[([^][]*)\]|<!--(.*?)-->")
_RULE = re.compile(r"[\s|]*:?-+:?(?:\s*\|[\s|]*:?-+:?)*[\s|]*")

#: Fixed value: rows handed from Python to Spark at once.
BATCH = 10_000

TABLE_ROWS = "page_num int, section string, table_no int, row_no int, headers array<string>, cells array<string>, raw_text string, places array<int>, row_text string"


def page_of(line: str) -> int | None:
    """The page a line declares: "page N" in brackets or in a comment, a line that is "{N}" or "page N" but for dashes."""
    for inside in _ASIDE.finditer(line):
        bracket, comment = inside.groups()
        said = (bracket if bracket is not None else comment).strip()
        if said[:4].lower() == "page":
            number = said[4:].strip() if bracket is not None else re.sub("^\\D*", "", said[4:])
            if number.isdecimal():
                return int(number)
    bare = line.strip().rstrip("-").rstrip()
    if bare[:1] == "{" and bare[-1:] == "}" and bare[1:-1].isdecimal():
        return int(bare[1:-1])
    words = bare.lstrip("-").split()
    return int(words[1]) if len(words) == 2 and words[0].lower() == "page" and words[1].isdecimal() else None


def heading_of(line: str) -> str | None:
    """The title of a heading line: up to three blanks, one to six signs, a blank, and text."""
    body = line.lstrip()
    title = body.lstrip("#")
    if len(line) - len(body) > 3 or not 1 <= len(body) - len(title) <= 6 or not title[:1].isspace():
        return None
    return title.strip() or None


def cells_of(line: str) -> list[str]:
    """Trimmed cells of a table line; an escaped pipe belongs to its cell, an outer pipe is a border."""
    cells: list[list[str]] = [[]]
    for sign in line.strip():
        if sign != "|":
            cells[-1].append(sign)
        elif cells[-1][-1:] == ["\\"]:
            cells[-1][-1] = "|"
        else:
            cells.append([])
    first = len(cells) > 1 and not cells[0]
    last = len(cells) - first > 1 and not cells[-1]
    return ["".join(c).strip() for c in cells[first : len(cells) - last]]


def is_rule(line: str) -> bool:
    """A line of dashes, pipes and colons that divides a table's head from its body."""
    return _RULE.fullmatch(line) is not None


@functools.lru_cache(maxsize=4096)
def places_of(headers: tuple[str, ...], width: int) -> tuple[int | None, ...]:
    """Place of each wanted column (in the order of NEEDLES) in rows of ``width`` cells: the first header that holds any of
    its needles, punctuation aside; under equal headers the last cell that the row has. Share counts come neither from
    the allotment date's column nor from cumulative ones."""
    flat = [re.sub("[^a-z0-9]", "", x.lower()) for x in headers]

    def first(name: str, barred: set[int] = frozenset()) -> int | None:
        wanted = [re.sub("[^a-z0-9]", "", n) for n in NEEDLES[name]]
        return next((i for i, x in enumerate(flat) if i not in barred and any(n in x for n in wanted)), None)

    at = {name: first(name) for name in NEEDLES}
    at["shares"] = first("shares", {i for i, x in enumerate(headers) if i == at["allot_date"] or "cumulative" in x})
    last = {h: i for i, h in enumerate(headers[:width])}
    return tuple(None if i is None else last.get(headers[i], i) for i in at.values())


def table_rows(text: str) -> Iterator[tuple]:
    """(page, section, table number, row number, headers, cells, raw table text, places, row text) of every body row.

    The raw text, whole, stands with a table's first row only: with every row, it would grow as the square of the table.
    One pass with a small state: the open table, if any, and the page and section last seen. Page marks come before
    headings, headings before tables; a pipe line heads a table only if a rule follows; a line without a pipe, a blank
    line or another rule ends it.
    """
    page, section, number = 1, "", 0
    lines = text.splitlines()
    open_at, head = -1, []

    def close(end: int) -> Iterator[tuple]:
        for r, line in enumerate(lines[open_at + 2 : end]):
            row = cells_of(line)
            kept = dict(zip(head, row))
            yield page, section, number - 1, r, head, row, None if r else "\n".join(lines[open_at:end]), places_of(tuple(head), len(row)), " | ".join(v for v in kept.values() if v)

    i = 0
    while i <= len(lines):
        line = lines[i] if i < len(lines) else ""
        if open_at >= 0:
            if i < len(lines) and line.strip() and "|" in line and not is_rule(line):
                i += 1
                continue
            yield from close(i)
            open_at = -1
        if i == len(lines):
            return
        mark = page_of(line)
        title = heading_of(line) if mark is None else None
        if mark is not None:
            page = mark
        elif title:
            section = title
        elif "|" in line and i + 1 < len(lines) and is_rule(lines[i + 1]):
            head, open_at, number = [" ".join(c.split()).lower() for c in cells_of(line)], i, number + 1
            i += 1
        i += 1


def parse_tables(docs: DataFrame, key: str = "filing_id", text: str = "text") -> DataFrame:
    """One row per table body row of every document; whole documents, in parallel over documents. A table's ``raw_text``
    stands with its row 0."""
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, *[c.split()[0] for c in TABLE_ROWS.split(", ")]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ((k, *row) for k, t in zip(b[key], b[text]) for row in table_rows(t))
            while out := list(itertools.islice(rows, BATCH)):
                yield pd.DataFrame(out, columns=columns)

    # Only documents with a pipe reach Python.
    return docs.select(key, text).where(F.col(text).contains("|")).mapInPandas(scan, f"`{key}` {kind}, {TABLE_ROWS}")


def split_pages(docs: DataFrame, key: str = "filing_id", text: str = "text") -> DataFrame:
    """key, page_number, text: lines by the page mark last seen; what precedes any mark is page 1; marks are dropped."""
    line_ends = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({line_ends})$", ""), line_ends)).alias("n", "line"))
    marked = lines.withColumn("mark", page_marker(F.col("line")))
    paged = carried(marked, key, ["n"], F.col("mark"), "page_number").where("mark is null").withColumn("page_number", F.coalesce("page_number", F.lit(1)))
    return paged.groupBy(key, "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def page_summary(pages: DataFrame, key: str = "filing_id", method: str = "markdown") -> DataFrame:
    """key, page_number, method, confidence, chars."""
    return pages.select(key, "page_number", F.lit(method).alias("method"), F.lit(1.0).alias("confidence"), F.char_length("text").alias("chars"))


def filings_in(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF and Markdown files of a folder (``binaryFile`` rows) in order of path; a missing folder has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike("\\.(pdf|md|markdown|mdown|mkd)$")).orderBy("path")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """filing_id (the path) and text of the Markdown files of a folder; undecodable bytes are replaced."""
    files = filings_in(spark, path).where(is_markdown(F.col("path")))
    return files.select(F.col("path").alias("filing_id"), F.expr("decode(content, 'UTF-8')").alias("text"))


def document_summary(pages: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, n_pages, n_ocr, mean confidence (4 places) and characters of each document, from ``page_summary`` rows."""
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("method") == "ocr").alias("n_ocr"), F.round(F.avg("confidence"), 4).alias("confidence"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
