"""Mixed timestamp formats and time zones: every cell as one unambiguous day or UTC instant.

Parsing stays in JVM expressions. A clock time without an explicit offset is resolved by an as-of join of
the local time to the zone's offset intervals, which are exploded into (zone, year) buckets: a local time
covered by two intervals occurs twice (the first is meant), by none never occurs, by one gives its offset.

Defined results: null, blank, partial ("Q3", "December 23"), impossible (31-02-2020) and nonexistent
(spring gap) cells give a null ``normal_form``; a clock time whose zone is unknown likewise. Empty input
gives an empty result. Extra columns are ignored; their names cannot clash as only the named ones are read.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_unique

FIELDS = ("date", "record_date", "payment_date")

#: Month names in English, German and French with their usual abbreviations.
MONTHS = [
    ["jan", "january", "januar", "jänner", "janvier", "janv"],
    ["feb", "february", "februar", "février", "fevrier", "févr", "fév"],
    ["mar", "march", "märz", "maerz", "mrz", "mär", "mars"],
    ["apr", "april", "avril", "avr"],
    ["may", "mai"],
    ["jun", "june", "juni", "juin"],
    ["jul", "july", "juli", "juillet", "juil"],
    ["aug", "august", "août", "aout"],
    ["sep", "sept", "september", "septembre"],
    ["oct", "october", "okt", "oktober", "octobre"],
    ["nov", "november", "novembre"],
    ["dec", "december", "dez", "dezember", "décembre", "decembre", "déc"],
]
#: Minutes east of UTC of the zone abbreviations that are read as fixed offsets.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "sgt": 480, "hkt": 480, "myt": 480, "jst": 540, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Words after a clock time that say nothing on its zone.
LOCAL_WORDS = ("", "hrs", "hrs.", "hours", "uhr", "h", "local time")
#: Years for which intervals are listed; those at the ends are open, so the first offset holds for all time before (a
#: zone's local mean time) and the last one for all time after.
YEARS = (1840, 2100)

_BLANKS = "[\\s\\u00A0\\u1680\\u2000-\\u200B\\u202F\\u205F\\u3000\\uFEFF]+"
_NOTES = "(?:\\s*(?:[*#^~†‡§,;.]|\\([0-9a-z]{1,2}\\)|\\[[0-9a-z]{1,2}\\]))+$"
_TIME = "^(.*?)(?:t|[ ,]+)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)? ?([ap]\\.?m\\.?(?![a-z]))? ?([^|]*)$"
_BASIC = "^([0-9]{8})t([0-9]{2})([0-9]{2})([0-9]{2})?(?:[.,][0-9]+)?()([^|]*)$"
_ZONE_NAME = "([A-Za-z_]+/[A-Za-z_/+\\-0-9]+)\\)?\\s*$"


def ascii_digits(c: Column) -> Column:
    """Devanagari and full-width digits as 0-9."""
    return F.translate(c, "०१२३४५६७८९０１２３４５６７８９", "01234567890123456789")


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _iso(y: Column, m: Column, d: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(y, 4), pad(m, 2), pad(d, 2)).try_cast("date")


def offset_intervals(zones: Sequence[str]) -> pd.DataFrame:
    """Local-time segments of each zone, cut at year ends: zone, year, lo, hi (local seconds; null: open), offset, twice.

    Built from the UTC offset intervals; where two of them cover one local time, ``twice`` is set and
    ``offset`` is that of the earlier instant. Local times in a gap lie in no segment.
    """
    rows = []
    known = {z.lower(): z for z in zoneinfo.available_timezones()}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first = int((datetime(YEARS[0], 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    last = int((datetime(YEARS[1] + 1, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    for zone in zones:
        if zone not in known:
            continue
        info = zoneinfo.ZoneInfo(known[zone])
        off = lambda s, info=info: int((epoch + timedelta(seconds=s)).astimezone(info).utcoffset().total_seconds())
        spans, at, now = [], first, off(first)
        start = first
        while at < last:
            to = min(at + 86400, last)
            if off(to) != now:
                lo, hi = at, to
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if off(mid) == now else (lo, mid)
                spans.append((start, hi, now))
                start, now, at = hi, off(hi), hi
            else:
                at = to
        spans.append((start, last, now))
        marks = sorted({u + o for a, b, o in spans for u in (a, b)})
        local = [(a + o, b + o, o) for a, b, o in spans]
        k = 0
        for lo, hi in zip(marks, marks[1:]):
            while k < len(local) and local[k][1] <= lo:
                k += 1
            over = [o for a, b, o in local[k : k + 3] if a <= lo and hi <= b]
            if not over:
                continue
            y0, y1 = ((epoch + timedelta(seconds=s)).year for s in (lo, hi - 1))
            for y in range(max(YEARS[0], y0), min(YEARS[1], y1) + 1):
                s, e = (int((datetime(v, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for v in (y, y + 1))
                rows.append((zone, y, None if lo == marks[0] and y == YEARS[0] else max(lo, s), None if hi == marks[-1] and y == YEARS[1] else min(hi, e), max(over), len(over) > 1))
    return pd.DataFrame(rows, columns=["zone", "year", "lo", "hi", "offset", "twice"]).astype({"lo": "Int64", "hi": "Int64"})


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield offset_intervals([z for z in b["zone"] if z])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """offset_intervals for a DataFrame of lower-case zone names; unknown names yield nothing."""
    return zones.where("zone is not null").distinct().mapInPandas(_intervals, "zone string, year int, lo bigint, hi bigint, offset int, twice boolean")


def parse_moment(df: DataFrame, cell: str, order: str, office: str) -> DataFrame:
    """Adds ``day`` (date), ``clock`` (seconds of the day, null if none), ``shift`` (known seconds east of UTC),
    ``zone`` (lower-case name whose clock is meant) and ``epoch`` (instants given as a number)."""
    text = F.lower(F.trim(F.regexp_replace(ascii_digits(F.col(cell)), _BLANKS, " ")))
    text = F.trim(F.regexp_replace(text, _NOTES, ""))
    df = df.withColumn("__t", text)
    df = df.withColumn("__p", F.split(F.regexp_replace(F.regexp_replace("__t", _BASIC, "$1|$2|$3|$4|$5|$6"), _TIME, "$1|$2|$3|$4|$5|$6"), "\\|"))
    part = lambda i: F.coalesce(F.get("__p", F.lit(i)), F.lit(""))
    timed = F.size("__p") == 6
    date = F.regexp_replace(part(0), "\\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\\b\\.?,?|(?<=[0-9])(?:st|nd|rd|th)\\b", " ")
    date = F.regexp_replace(date, "(?<=[0-9])(?=\\p{L})|(?<=\\p{L})(?=[0-9])|[ ,/.\\-]+", " ")
    df = df.withColumn("__d", F.split(F.trim(date), " +"))
    a, b, c = (F.coalesce(F.get("__d", F.lit(i)), F.lit("")) for i in range(3))
    months = _literal_map({name: i + 1 for i, names in enumerate(MONTHS) for name in names})
    digits = lambda x, n: x.rlike(f"^[0-9]{{{n}}}$")
    short, year = "1,2", lambda x: F.when(digits(x, 2), F.when(_int(x) >= 69, _int(x) + 1900).otherwise(_int(x) + 2000)).when(digits(x, 4), _int(x))
    mdy = F.col(order) == "MDY"
    known_order = F.col(order).isin("DMY", "MDY")
    triple = (
        F.when(digits(a, 4) & digits(b, short) & digits(c, short), _iso(_int(a), _int(b), _int(c)))
        .when(digits(a, short) & digits(b, short), F.when(known_order | (a == b), _iso(year(c), F.when(mdy, _int(a)).otherwise(_int(b)), F.when(mdy, _int(b)).otherwise(_int(a)))))
        .when(digits(a, short), _iso(year(c), F.try_element_at(months, b), _int(a)))
        .when(digits(a, 4) & digits(c, short), _iso(_int(a), F.try_element_at(months, b), _int(c)))
        .when(digits(b, short), _iso(year(c), F.try_element_at(months, a), _int(b)))
    )
    count = F.size("__d")
    cut = lambda i, n: _int(F.substring(a, i, n))
    stamp = digits(a, "12") | digits(a, "14")
    single = (
        F.when(digits(a, 8) | stamp, _iso(cut(1, 4), cut(5, 2), cut(7, 2)))
        .when(digits(a, 5), F.date_add(F.lit("1899-12-30").cast("date"), F.coalesce(_int(a), F.lit(0))))
    )
    hour, minute, second = _int(part(1)), _int(part(2)), F.coalesce(_int(part(3)), F.lit(0))
    half = F.substring(part(4), 1, 1)
    hour = F.when(half == "", hour).when((hour > 12) | ((hour == 0) & (half == "p")), F.lit(None)).when(half == "a", hour % 12).otherwise(hour % 12 + 12)
    of_time = F.when((hour <= 23) & (minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second)
    of_stamp = F.when((cut(9, 2) <= 23) & (cut(11, 2) <= 59) & (F.coalesce(cut(13, 2), F.lit(0)) <= 59), cut(9, 2) * 3600 + cut(11, 2) * 60 + F.coalesce(cut(13, 2), F.lit(0)))
    long = F.regexp_extract("__t", "^([0-9]+)$", 1)
    number = long.try_cast("decimal(20,0)")
    epoch = F.when(digits(long, 10), number).when(digits(long, 13), F.floor(number / 1000)).when(digits(long, 16), F.floor(number / 1000000)).when(digits(long, 19), F.floor(number / 1000000000)).cast("bigint")
    tail = F.regexp_replace(F.trim(part(5)), "^\\(|\\)$", "")
    sign = F.regexp_extract(tail, "^(?:utc|gmt)? ?([+-])([0-9]{1,2}):?([0-9]{2})?$", 1)
    hh, mm = (_int(F.regexp_extract(tail, "^(?:utc|gmt)? ?([+-])([0-9]{1,2}):?([0-9]{2})?$", i)) for i in (2, 3))
    shift = F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (hh * 3600 + F.coalesce(mm, F.lit(0)) * 60)).otherwise(
        F.try_element_at(_literal_map({k: v * 60 for k, v in ABBREVIATIONS.items()}), tail)
    )
    is_stamp = (count == 1) & stamp & ~timed
    zone = F.when(is_stamp | tail.isin(*LOCAL_WORDS), F.lower(F.col(office))).when(tail.contains("/"), tail)
    return df.select(
        *[x for x in df.columns if x not in ("__t", "__p", "__d")],
        F.when(count == 3, triple).when((count == 1) & (~timed | digits(a, 8)), single).alias("day"),
        F.when(timed, of_time).when(is_stamp, of_stamp).alias("clock"),
        (timed | is_stamp).alias("has_clock"),
        F.when(timed, shift).alias("shift"),
        F.when(timed | is_stamp, zone).alias("zone"),
        epoch.alias("epoch"),
    )


def instant_text(seconds: Column) -> Column:
    """UTC seconds as YYYY-MM-DDTHH:MM:SSZ, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    pad = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), pad(F.floor(rest / 3600)), F.lit(":"), pad(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), pad(F.pmod(rest, F.lit(60))), F.lit("Z"))


def normalise_moments(events: DataFrame, filings: DataFrame, fields: Sequence[str] = FIELDS, key: str = "event_id") -> DataFrame:
    """One row per non-null cell: key, field_name, cell, normal_form, status.

    ``status``: day, instant, first_of_two (ambiguous clock time), nonexistent, or unreadable.
    ``filings`` gives date_order and office_tz by filing_id (unique).
    """
    offices = filings.select("filing_id", F.col("date_order").alias("__order"), F.col("office_tz").alias("__office"))
    stacked = events.select(key, "filing_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])).alias("x"))
    cells = stacked.select(key, "filing_id", "x.field_name", "x.cell").where("cell is not null")
    named = cells.select(F.lower(F.regexp_extract("cell", _ZONE_NAME, 1)).alias("zone")).where("zone <> ''")
    intervals = zone_intervals(named.union(offices.select(F.lower("__office").alias("zone"))))
    parsed = parse_moment(join_unique(cells, offices, "filing_id", key), "cell", "__order", "__office")
    local = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.col("clock")
    parsed = parsed.withColumn("__local", local).withColumn("__year", F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1]), F.year("day"))))
    # Bounded: at most some 600 zones of the time zone database with a few segments a year.
    z = F.broadcast(intervals.select(F.col("zone").alias("__zone"), F.col("year").alias("__y"), "lo", "hi", "offset", "twice"))
    on = F.col("shift").isNull() & (F.col("zone") == F.col("__zone")) & (F.col("__year") == F.col("__y")) & (F.col("lo").isNull() | (F.col("__local") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("__local") < F.col("hi")))
    joined = parsed.join(z, on, "left")
    utc = F.coalesce(F.col("epoch"), F.col("__local") - F.coalesce(F.col("shift"), F.col("offset")))
    form = F.when(F.col("epoch").isNotNull() | F.col("has_clock"), instant_text(utc)).otherwise(F.col("day").cast("string"))
    status = (
        F.when(form.isNotNull(), F.when(~F.col("has_clock") & F.col("epoch").isNull(), "day").when(F.coalesce("twice", F.lit(False)), "first_of_two").otherwise("instant"))
        .when(F.col("__local").isNotNull() & F.col("zone").isNotNull(), "nonexistent")
        .otherwise("unreadable")
    )
    return joined.select(key, "field_name", "cell", form.alias("normal_form"), status.alias("status"))
