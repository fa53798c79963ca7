"""Quantities recorded in different units: every stated amount in paise.

Two parts.

``amounts_in_paise`` reads the units that are *stated* - in the cell, in the row's snippet, in the filing -
and is exact. ``unit_levels`` works without statements: it segments each source's history of log values by
exact penalised changepoint search over the known unit factors, so a shift of level by a known factor marks
a change of unit that can be reversed. The levels alone cannot give exact paise for a history whose real
amounts also jump, so the results of record come from the statements (see README for measured figures).

Defined results: null, blank, dash, "Nil", "N/A" and other cells without a number state no amount and give
no row; nor do dotted dates ("1.5.2020") and exponents ("1e6"). Negative or bracketed numbers keep their digits. Amounts are rounded half-up to whole paise. Empty
input gives an empty result; only the named columns are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import join_unique
from .timestamps import ascii_digits

FIELDS = ("old_capital", "new_capital", "issue_price", "total_outflow")
#: Fields that are amounts per share, which a filing's or table's unit of totals does not scale.
PER_SHARE = ("issue_price",)
#: Unit words and their size in rupees.
UNITS = [
    (10**7, "crores?|crs?"),
    (10**5, "lakhs?|lacs?|lkhs?"),
    (10**9, "billions?|bns?"),
    (10**6, "millions?|mns?|mio"),
    (10**3, "thousands?|ths?|k"),
    (1, "rupees?"),
]
#: English number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "thousand": 1000, "lakh": 100000, "lakhs": 100000, "lac": 100000, "lacs": 100000, "million": 1000000, "crore": 10000000, "crores": 10000000,
    "billion": 1000000000,
}
#: log10 of the factors that a level shift may mark: rupees, paise, thousands, lakhs, millions, crores, billions.
LEVELS = (0.0, -2.0, 3.0, 5.0, 6.0, 7.0, 9.0)
#: Padded values handled at once, which bounds the memory of a Python worker.
PADDED = 1 << 18


def _dec(c: Column) -> Column:
    return c.try_cast("decimal(30,6)")


def unit_factor(text: Column, pattern: str) -> Column:
    """Rupees in one unit by the unit word captured by ``pattern`` (group 1 of its first match); null if none."""
    word = F.regexp_extract(text, pattern, 1)
    out = F.when(word == "", F.lit(None).cast("bigint"))
    for size, names in UNITS:
        out = out.when(word.rlike(f"^(?:{names})$"), F.lit(size).cast("bigint"))
    return out.when(word == "m", F.lit(10**6).cast("bigint"))


def stated_scale(text: Column) -> Column:
    """Rupees in the unit that a heading-like statement declares ("₹ in lakhs", "Amount in crores of rupees",
    "(₹ '000)", "Rs. Cr.", "Absolute INR"); null where it declares none, as a currency mark alone."""
    t = F.lower(F.trim(text))
    known = F.when(t.rlike("['’`]\\s*000\\b|\\b000s?\\b"), F.lit(1000).cast("bigint"))
    for size, names in UNITS[:-1]:
        known = known.when(t.rlike(f"(?<![a-z])(?:{names})(?![a-z])"), F.lit(size).cast("bigint"))
    return known.when(t.rlike("\\b(?:rupees?|absolute)\\b"), F.lit(1).cast("bigint"))


def snippet_statement(snippet: Column) -> tuple[Column, Column]:
    """(rupees in the unit of the row's totals, whether its prices are in paise) as the snippet declares them.

    A statement is about the figures themselves: it stands in brackets or speaks of amounts, figures, columns,
    tables or rows, and carries no number of its own ("borrowings of 45 lakh" states no unit).
    """
    s = F.lower(snippet)
    unit = "(?:crores?|crs?|lakhs?|lacs?|billions?|bns?|millions?|mns?|thousands?|rupees?|'000|’000)"
    about = (
        s.rlike("\\b(?:amounts?|figures?|sums?|values?|presented|expressed|stated|shown|given|reported)\\b[^0-9]{0,60}(?:\\b|')" + unit)
        | s.rlike("\\([^()0-9]*(?:₹|rs\\.?|inr|rupees?|amounts?)[^()0-9]*" + unit)
        | s.rlike("\\((?:₹|rs\\.?|inr)?\\s*(?:in)?\\s*['’]\\s*000\\)")
    )
    paise = s.rlike("\\b(?:prices?|columns?|amounts?|figures?|stated|expressed|given)\\b[^0-9]{0,40}\\bpaise\\b")
    return F.when(about & ~s.rlike("\\bpaise\\b"), stated_scale(snippet)), paise


def words_value(text: Column) -> Column:
    """Value of English number words in rupees with an optional paise part; null if there are none."""
    words = F.filter(F.split(text, "[^a-z]+"), lambda w: w.isin(*NUMBER_WORDS, "paise", "and", "rupees"))
    table = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("part"), zero.alias("whole"), zero.alias("paise"), zero.alias("n"))

    def step(acc: Column, w: Column) -> Column:
        v = F.coalesce(F.try_element_at(table, w), F.lit(0)).cast("bigint")
        unit = acc["part"]
        part = F.when(w.isin("and"), acc["part"]).when(w == "paise", zero).when(v >= 1000, zero).when(v == 100, F.greatest(unit, F.lit(1)) * 100).otherwise(unit + v)
        total = F.when(w == "paise", zero).when(v >= 1000, acc["total"] + F.greatest(unit, F.lit(1)) * v).otherwise(acc["total"])
        # "X and Y paise": what stands before the last "and" is whole rupees.
        whole = F.when(w == "and", acc["total"] + acc["part"]).otherwise(acc["whole"])
        paise = F.when(w == "paise", acc["total"] + acc["part"] - acc["whole"]).otherwise(acc["paise"])
        return F.struct(total.alias("total"), part.alias("part"), whole.alias("whole"), paise.alias("paise"), (acc["n"] + F.when(v > 0, 1).otherwise(0)).cast("bigint").alias("n"))

    def finish(acc: Column) -> Column:
        has_paise = F.array_contains(words, "paise")
        return F.when(acc["n"] > 0, F.when(has_paise, acc["whole"] * 100 + acc["paise"]).otherwise((acc["total"] + acc["part"]) * 100))

    return F.aggregate(words, start, step, finish)


def read_cell(cell: Column) -> tuple[Column, Column, Column, Column]:
    """(number, its own unit in paise or null, whole amount in paise if the cell settles it, is bare number).

    The third is set for compounds ("3 crore 20 lakh", "12 rupees 50 paise", "Rs. 9 and 50 paise") and for
    amounts spelled out in words; the first two otherwise.
    """
    text = F.lower(F.trim(F.regexp_replace(ascii_digits(cell), "[\\s\\u00A0\\u2000-\\u200B\\u202F\\u3000\\uFEFF]+", " ")))
    plain = F.regexp_replace(text, "(?<=[0-9]) (?=[0-9]{2,3}(?![0-9]))|(?<=[0-9])['’,](?=[0-9])", "")
    number = F.regexp_extract(plain, "([0-9]+(?:\\.[0-9]+)?|(?<![a-z0-9])\\.[0-9]+)", 1)
    odd = plain.rlike("[0-9]\\.[0-9]+\\.[0-9]|[0-9]e[+-]?[0-9]")
    value = _dec(F.when((number != "") & ~odd, number))
    after = unit_factor(plain, "[0-9]\\)?\\s*(?:/-\\s*)?(crores?|crs?|lakhs?|lacs?|lkhs?|billions?|bns?|millions?|mns?|mio|thousands?|ths?|k|m|rupees?)(?![a-z])")
    is_paise = plain.rlike("[0-9]\\s*(?:p|paise|paisa)(?![a-z])|\\b(?:paise|paisa)\\s*[0-9]")
    own = F.when(is_paise, F.lit(1).cast("bigint")).otherwise(after * 100)
    pairs = F.regexp_extract_all(plain, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*(?:crores?|crs?\\b|lakhs?|lacs?|thousands?|rupees?|paise)"), F.lit(0))
    sizes = lambda x: F.when(x.rlike("cr"), 10**9).when(x.rlike("la[ck]"), 10**7).when(x.rlike("thou"), 10**5).when(x.rlike("rupee"), 100).otherwise(1)
    summed = F.aggregate(pairs, F.lit(0).cast("decimal(38,6)"), lambda acc, x: (acc + _dec(F.regexp_extract(x, "^([0-9.]+)", 1)) * sizes(x)).cast("decimal(38,6)"))
    rupees_and = F.regexp_extract(plain, "^[^0-9]*([0-9]+)\\s*(?:rupees?)?\\s*(?:and|,)\\s*[0-9]+\\s*paise", 1)
    paise_part = F.regexp_extract(plain, "and\\s*([0-9]+)\\s*paise", 1)
    spelled = words_value(text)
    settled = (
        F.when(rupees_and != "", _dec(rupees_and) * 100 + _dec(paise_part))
        .when(F.size(pairs) >= 2, summed)
        .when(text.rlike("\\b(?:rupees|paise|only|hundred|one|two|three|four|five|six|seven|eight|nine|ten|[a-z]+teen|[a-z]+ty)\\b") & (number == ""), spelled.cast("decimal(38,6)"))
        .when(text.rlike("\\(\\s*(?:rupees\\s+)?[a-z -]*(?:hundred|thousand|lakh|crore|one|two|three|four|five|six|seven|eight|nine|ten|[a-z]+teen|[a-z]+ty)[a-z -]*\\)"), spelled.cast("decimal(38,6)"))
    )
    return value, own, settled, cell.rlike("^[0-9]+(?:\\.[0-9]*)?$|^\\.[0-9]+$")


def amounts_in_paise(events: DataFrame, filings: DataFrame, fields: Sequence[str] = FIELDS, key: str = "event_id") -> DataFrame:
    """One row per cell that states an amount: key, field_name, cell, paise, unit_from, is_bare.

    ``unit_from`` says what settled the unit: cell, snippet, filing or none (rupees). ``is_bare`` is true for
    a plain number of rupees that equals the amount, which needs no conversion.
    """
    declared = filings.select("filing_id", stated_scale(F.col("amount_unit")).alias("__filing"))
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields]))
    cells = events.select(key, "filing_id", "source_snippet", stack.alias("x")).select(key, "filing_id", "source_snippet", "x.field_name", "x.cell").where("cell is not null")
    totals, in_paise = snippet_statement(F.col("source_snippet"))
    value, own, settled, bare = read_cell(F.col("cell"))
    per_share = F.col("field_name").isin(*PER_SHARE)
    snippet = F.when(per_share, F.when(in_paise, F.lit(1).cast("bigint"))).otherwise(totals * 100)
    read = cells.select(key, "filing_id", "field_name", "cell", value.alias("__v"), own.alias("__own"), settled.alias("__all"), bare.alias("__bare"), snippet.alias("__snip"))
    read = join_unique(read.where("__v is not null or __all is not null"), declared, "filing_id", key)
    filing = F.when(~per_share, F.col("__filing") * 100)
    unit = F.coalesce("__own", "__snip", filing, F.lit(100).cast("bigint"))
    paise = F.round(F.coalesce(F.col("__all"), F.col("__v") * unit), 0).try_cast("bigint")
    origin = F.when(F.col("__all").isNotNull() | F.col("__own").isNotNull(), "cell").when(F.col("__snip").isNotNull(), "snippet").when(filing.isNotNull(), "filing").otherwise("none")
    same = F.col("__bare") & (F.round(F.col("cell").try_cast("decimal(30,6)") * 100, 0).try_cast("bigint") == paise)
    return read.select(key, "filing_id", "field_name", "cell", F.col("__v").cast("double").alias("written"), paise.alias("paise"), origin.alias("unit_from"), F.coalesce(same, F.lit(False)).alias("is_bare"))


# ---- Changepoints -----------------------------------------------------------------------------------


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in groups of like length, each of at most PADDED padded values (or one row)."""
    order = np.argsort(lengths, kind="stable")[::-1]
    i = 0
    while i < len(order):
        n = max(1, PADDED // max(1, int(lengths[order[i]])))
        yield order[i : i + n]
        i += n


def _padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[row, step, level]: cost of each value at each level; unusable values cost nothing anywhere."""
    t = np.arange(max(1, int(lengths.max())))
    inside = t[None] < lengths[:, None]
    x = np.where(inside, values[np.where(inside, starts[:, None] + t[None], 0)], np.nan)
    return np.nan_to_num(np.abs(x[:, :, None] + np.asarray(LEVELS)), nan=0.0)


def transfers(costs: np.ndarray, penalty: float, lengths: np.ndarray) -> np.ndarray:
    """[row, entry level, exit level] -> least cost of each row; these matrices compose by (min, +)."""
    k = costs.shape[2]
    m = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, np.inf), (len(costs), k, k))
    for t in range(costs.shape[1]):
        step = np.minimum(m, m.min(axis=2, keepdims=True) + penalty) + costs[:, t, None, :]
        # Past its end a row keeps what it has.
        m = np.where((t < lengths)[:, None, None], step, m)
    return m


def stitched(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry level, exit level) of each block on the cheapest path through [block, entry, exit] matrices; the first
    entry is -1."""
    v, backs = m[0].min(axis=0), []
    for x in m[1:]:
        step = v[:, None] + x
        backs.append(step.argmin(axis=0))
        v = step.min(axis=0)
    ends = [int(np.argmin(v))]
    for b in reversed(backs):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return np.array([-1, *ends[:-1]]), np.array(ends)


def paths(costs: np.ndarray, penalty: float, entry: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[row, step] -> level number on the cheapest path of each row from its entry (-1: a start) to its end."""
    rows, steps, k = costs.shape
    back = np.empty((steps, rows, k), dtype=np.int8)
    v = costs[:, 0] + np.where((entry[:, None] < 0) | (entry[:, None] == np.arange(k)), 0.0, penalty)
    for t in range(1, steps):
        best = v.min(axis=1) + penalty
        stays = v <= best[:, None]
        back[t] = np.where(stays, np.arange(k), v.argmin(axis=1)[:, None])
        step = np.where(stays, v, best[:, None]) + costs[:, t]
        v = np.where((t < lengths)[:, None], step, v)
    path = np.empty((rows, steps), dtype=np.int64)
    at = end.astype(np.int64)
    for t in range(steps - 1, -1, -1):
        path[:, t] = at
        if t:
            at = np.where(t < lengths, back[t, np.arange(rows), at], at)
    return path


def unit_levels(cells: DataFrame, source: str, order: str, log_value: str, penalty: float = 2.0, block: int = 32768) -> DataFrame:
    """Exact penalised segmentation of each source's history on the known unit levels.

    ``log_value`` is log10 of the written number minus that of the source's usual one, so a history kept in lakhs lies
    near -5. ``order`` is a unique non-negative integer in order of arrival. A history is cut into blocks of ``block``
    consecutive orders, so no task holds more rows of one source at once; blocks are summed up as (min, +) transfer
    matrices, stitched per source, and then traced back block by block, which gives the same optimum as one pass. All
    three steps run on many blocks at a time. Gives source, order, ``level`` (log10 of the factor to multiply by) and
    ``segment_start`` (a change of level begins at this row). Rows with a null ``log_value`` follow their segment; a null
    source is a source of its own.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("s")
    item = F.struct(F.col(order).cast("bigint").alias("o"), F.col(log_value).cast("double").alias("x"))
    blocks = cells.select(named, F.floor(F.col(order) / block).alias("b"), item.alias("i")).groupBy("s", "b").agg(F.array_sort(F.collect_list("i")).alias("i"))
    blocks = cut_lineage(blocks.select("s", "b", F.transform("i", lambda i: i["o"]).alias("o"), F.transform("i", lambda i: i["x"]).alias("x")))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((len(b), len(LEVELS), len(LEVELS)))
            values, starts, lengths = _lists(b.column("x"))
            for at in _batches(lengths):
                out[at] = transfers(_padded(values, starts[at], lengths[at]), penalty, lengths[at])
            yield pa.RecordBatch.from_arrays([b.column("s"), b.column("b"), _list_array(out.ravel(), len(b))], names=["s", "b", "m"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(LEVELS)
        for b in batches:
            entry, end = [], []
            for bs in b.column("bs"):
                m = bs.values.field("m").flatten().to_numpy().reshape(-1, k, k)
                e, x = stitched(m)
                entry.append(e), end.append(x)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int32)) if x else pa.array([], pa.int32())
            n = np.array([len(e) for e in entry], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            numbers = pa.chunked_array([bs.values.field("b") for bs in b.column("bs")] or [pa.array([], pa.int64())]).combine_chunks()
            yield pa.RecordBatch.from_arrays([b.column("s").take(of), numbers, cat(entry), cat(end)], names=["s", "b", "entry", "end"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, starts, lengths = _lists(b.column("x"))
            orders, _, _ = _lists(b.column("o"))
            entry, end = (b.column(c).to_numpy() for c in ("entry", "end"))
            level, starts_here = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
            for at in _batches(lengths):
                path = paths(_padded(values, starts[at], lengths[at]), penalty, entry[at], end[at], lengths[at])
                inside = np.arange(path.shape[1])[None] < lengths[at][:, None]
                where = (starts[at][:, None] + np.arange(path.shape[1])[None])[inside]
                level[where] = path[inside]
                starts_here[where] = (path != np.concatenate([entry[at][:, None], path[:, :-1]], axis=1))[inside]
            of = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            yield pa.RecordBatch.from_arrays([b.column("s").take(of), pa.array(orders), pa.array(np.asarray(LEVELS)[level]), pa.array(starts_here)], names=["s", order, "level", "segment_start"])

    sums = blocks.select("s", "b", "x").mapInArrow(sum_up, "s string, b bigint, m array<double>")
    # A row per source: of one small matrix for each ``block`` orders.
    per = sums.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("bs"))
    ends = per.mapInArrow(stitch, "s string, b bigint, entry int, end int")
    traced = blocks.join(ends, ["s", "b"]).mapInArrow(trace, f"s string, `{order}` bigint, level double, segment_start boolean")
    kind = cells.schema[source].dataType
    return traced.select(F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).cast(kind).alias(source), order, "level", "segment_start")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of an array of lists; null values are NaN."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets[:-1] - offsets[0], np.diff(offsets)


def _list_array(values: np.ndarray, rows: int) -> pa.ListArray:
    size = len(values) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array((np.arange(rows + 1) * size).astype(np.int32)), pa.array(values))
