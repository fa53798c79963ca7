"""Number column builders for filing cells and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitude words in the order they are looked for, and the ceiling above which none applies.
MAGNITUDES = [("crore", 10**7), ("cr", 10**7), ("lakh", 10**5), ("lac", 10**5), ("billion", 10**9), ("bn", 10**9), ("million", 10**6), ("mn", 10**6)]
CEILING = 100_000


def cell_amount(cell: Column) -> Column:
    """First number of a cell; shorthand below the ceiling is multiplied by a whole magnitude word; else null."""
    found = F.regexp_extract(cell, "(?U)(-?\\d[\\d,]*(?:\\.\\d+)?)", 1)
    value = F.regexp_replace(F.translate(found, "०१२३४५६७८९", "0123456789"), ",", "").try_cast("double")
    low, factor = F.lower(cell), F.lit(1.0)
    for word, size in reversed(MAGNITUDES):
        factor = F.when(low.rlike(f"(?U)\\b{word}\\b"), F.lit(float(size))).otherwise(factor)
    return F.when(value < CEILING, value * factor).otherwise(value)


def cell_count(cell: Column) -> Column:
    """``cell_amount`` cut to a whole number."""
    return cell_amount(cell).try_cast("bigint")


def ratio_multiple(ratio: Column) -> Column:
    """ "a:b" as a / b; null for other forms and for b = 0."""
    form = "(?U)^\\s*(\\d+(?:\\.\\d+)?)\\s*:\\s*(\\d+(?:\\.\\d+)?)\\s*$"
    a, b = (F.regexp_extract(ratio, form, i).try_cast("double") for i in (1, 2))
    return F.try_divide(a, b)


def rupees(amount: Column) -> Column:
    """An amount with crore or lakh scale ("Rs. 1.50 Cr"), a dash for null."""
    a = amount.cast("double")
    return (
        F.when(a.isNull(), "—")
        .when(a >= 1e7, F.format_string("Rs. %.2f Cr", a / 1e7))
        .when(a >= 1e5, F.format_string("Rs. %.2f L", a / 1e5))
        .otherwise(F.concat(F.lit("Rs. "), F.format_number(a, 0)))
    )


def grouped(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)
