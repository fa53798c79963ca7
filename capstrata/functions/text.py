"""Text column builders. Python's Unicode notion of blanks and digits is kept by (?U) patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: tokens keep inner full stops, commas and colons, so financial literals survive.
TOKEN = "[a-z0-9]+(?:[.,:][a-z0-9]+)*"
#: Fixed value: queries that look numeric (amounts with units, numbers, ratios, security identifiers).
NUMERIC_QUERY = "(?i)(\\d+\\.?\\d*\\s*(cr|crore|l|lakh|m|mn|b|bn|%))|(\\d[\\d,.]*)|(\\b\\d+:\\d+\\b)|(\\bin[a-z0-9]{10}\\b)"
#: Fusion weight of the vector leg for numeric and other queries.
ALPHA_NUMERIC, ALPHA_DEFAULT = 0.3, 0.6
#: Phrases that mark pages of interest, and tighter ones that justify a second look for tables.
CAPITAL_SIGNALS = ["date of allotment", "equity share capital", "bonus", "rights issue", "authorised capital", "authorized capital", "allotment", "face value"]
TABLE_SIGNALS = [
    "date of allotment", "build-up of", "build up of", "history of equity share capital", "history of the equity share capital",
    "history of share capital", "history of the share capital", "increased from",
]


def blanks(c: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", " "))


def norm(c: Column) -> Column:
    """``blanks`` in lower case; null becomes empty."""
    return F.lower(blanks(F.coalesce(c, F.lit(""))))


def squash(c: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Array of tokens, repeated ones included."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def alpha(query: Column) -> Column:
    """Weight of the vector leg for a query."""
    return F.when(query.rlike(NUMERIC_QUERY), ALPHA_NUMERIC).otherwise(ALPHA_DEFAULT)


def mentions(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds any of the phrases, letter case aside."""
    low = F.lower(text)
    found = F.lit(False)
    for p in phrases:
        found = found | low.contains(p)
    return found


def page_marker(line: Column) -> Column:
    """Page number that a line declares ("[PAGE 5]", "<!-- page 5 -->", "{5}---", "--- Page 5 ---"), else null."""
    forms = ["(?iU)\\[\\s*page\\s*(\\d+)\\s*\\]", "(?iU)<!--\\s*page\\D*(\\d+)\\s*-->", "(?U)^\\s*\\{(\\d+)\\}\\s*-*\\s*$", "(?iU)^\\s*-*\\s*page\\s+(\\d+)\\s*-*\\s*$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(line, f, 1), F.lit("")).try_cast("int") for f in forms])


def is_markdown(name: Column, mime: Column | None = None) -> Column:
    """Whether a file name or MIME type is Markdown's."""
    by_name = F.coalesce(F.lower(name).rlike("\\.(md|markdown|mdown|mkd)$"), F.lit(False))
    return by_name if mime is None else by_name | F.coalesce(F.lower(mime).isin("text/markdown", "text/x-markdown"), F.lit(False))


def rendered(c: Column, kind: str) -> Column:
    """A value as Python prints it: whole doubles keep ".0", no exponent below 1e16."""
    if kind not in ("double", "float"):
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
    return F.when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def truthy(c: Column, kind: str) -> Column:
    """Python's truth of a value: not null, not empty, not zero."""
    return c.isNotNull() & ((c != "") if kind == "string" else (c != 0))


def general(c: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros, as "%g" prints it between 1e-4 and 1e6."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(c)))).cast("int")
    rounded = F.regexp_replace(F.call_function("format_number", F.round(F.abs(c) * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits), F.lit("0.##########")), ",", "")
    return F.when(c == 0, "0").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), rounded))


def percent(c: Column) -> Column:
    """A share as a whole percentage ("7%")."""
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))
