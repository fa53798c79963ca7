"""Resolving table columns by their headers, and folding wrapped headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import cell_date, is_iso
from .text import blanks, norm, squash

#: What each column's header may hold.
NEEDLES = {
    "allot_date": ["date of allotment", "allotment date"],
    "date": ["date of allotment", "allotment date", "date of resolution", "record date", "date"],
    "shares": ["no. of shares", "number of shares", "no of shares", "no. of equity", "number of equity", "shares allotted", "shares issued", "shares offered", "shares"],
    "transaction": ["nature of transaction"],
    "face": ["face value"],
    "price": ["issue price", "price per", "offer price"],
    "consideration": ["consideration", "nature of", "nature"],
    "ratio": ["ratio"],
    "record": ["record date"],
    "from": ["increased from"],
    "to": ["increased to"],
    "resolution": ["type of", "resolution type", "nature of resolution"],
}


def column_at(headers: Column, needles: list[str], barred: Column | None = None) -> Column:
    """0-based place of the first header that holds any needle, punctuation aside; null if none.

    ``barred``: places (array of int) that do not count.
    """
    pattern = "|".join(sorted({re.sub("[^a-z0-9]", "", n.lower()) for n in needles}))
    fits = F.transform(headers, lambda h, i: squash(h).rlike(pattern) & (F.lit(True) if barred is None else ~F.array_contains(barred, i)))
    at = F.array_position(fits, True)
    return F.when(at > 0, (at - 1).cast("int"))


def is_data_row(cells: Column) -> Column:
    """Whether any cell holds an ISO-readable date or a grouped or long number."""
    return F.exists(cells, lambda c: is_iso(cell_date(c)) | F.coalesce(blanks(c).rlike("(?U)\\d{1,3}(?:,\\d{2,3})+|\\d{4,}"), F.lit(False)))


def more_header_rows(grid: Column) -> Column:
    """How many rows after the first, at most three, hold no data and so continue the header."""
    def more(i: int) -> Column:
        row = F.get(grid, F.lit(i))
        return row.isNotNull() & ~is_data_row(row)

    return F.when(~more(1) | (F.size(grid) <= 1), 0).when(~more(2) | (F.size(grid) <= 2), 1).when(~more(3) | (F.size(grid) <= 3), 2).otherwise(3)


def fold_headers(grid: Column, extra: Column | None = None) -> tuple[Column, Column]:
    """(headers, body) of a grid whose header may run over the first rows: the rows that continue it are joined to it,
    column by column. ``extra`` is their number, where it is known as a column already."""
    extra = more_header_rows(grid) if extra is None else extra
    top = F.slice(grid, F.lit(1), extra + 1)
    width = F.array_max(F.transform(top, lambda r: F.size(r)))
    names = F.transform(F.sequence(F.lit(0), width - 1), lambda c: norm(F.array_join(F.filter(F.transform(top, lambda r: F.get(r, c)), lambda x: x.isNotNull() & (x != "")), " ")))
    return names, F.slice(grid, extra + 2, F.greatest(F.size(grid), F.lit(1)))
