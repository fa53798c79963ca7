"""Dates of filing cells as ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blanks

#: The forms tried, in this order; the flag marks those with a two-digit year.
FORMS = [
    ("yyyy-M-d", False), ("d-M-yyyy", False), ("d/M/yyyy", False), ("d.M.yyyy", False), ("d/M/yy", True), ("MMMM d, yyyy", False), ("MMMM d yyyy", False),
    ("d MMMM yyyy", False), ("d MMMM, yyyy", False), ("MMM d, yyyy", False), ("MMM d yyyy", False), ("d MMM yyyy", False), ("d-MMM-yyyy", False), ("d-MMM-yy", True),
]


def _try(text: Column, form: str, short: bool) -> Column:
    # initcap because month names are matched by letter case.
    day = F.try_to_date(F.initcap(F.regexp_replace(text, "-", " - ")) if "MMM" in form and "-" in form else F.initcap(text), form.replace("-", "' - '") if "MMM" in form and "-" in form else form)
    # Two-digit years from 69 on belong to the last century.
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day) if short else day


def cell_date(cell: Column) -> Column:
    """ISO date of a cell; the cleaned text where no form fits; null where nothing is left after cleaning."""
    text = F.regexp_replace(blanks(cell), "(?U)[*#^~†‡]+|\\(\\d+\\)|\\[\\d+\\]", "")
    text = F.trim(F.regexp_replace(F.trim(text), ",+$", ""))
    # The lambda binds the cleaned text once; written out, each of the forms would clean it anew.
    read = F.transform(F.array(text), lambda t: F.when(t != "", F.coalesce(*[F.date_format(_try(t, f, s), "yyyy-MM-dd") for f, s in FORMS], t)))
    return F.get(read, F.lit(0))


def is_iso(c: Column) -> Column:
    return F.coalesce(c.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.lit(False))
