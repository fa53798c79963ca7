"""Text cut off by field limits or mid-transfer, and how often each source cuts.

Per source the histograms of lengths, in characters and in bytes, are tested for spikes: a length that holds
several times as many values as its neighbours is a limit. Values at a limit without terminal punctuation are
suspects. A limit alone cannot tell a whole value of that length from a cut one, nor find cuts below a limit, so
the ending decides: the shape of the last sentence (or last table cell) with names, numbers and dates masked must
be one in which finished texts of the corpus end, and a closing name must end in a word that closes texts. At a
limit, a finished-looking shape with which a longer one begins still counts as cut if it is itself piled up there.

Endings are learned from all rows: sentences that end in a stop, and table rows of lengths that are no limit.
Shapes and words are kept from a minimum share of all on, so their number is bounded whatever the corpus.

Defined results: null and blank values are not cut; a missing full stop alone is no cut; footnote marks, page
markers and trailing blanks are left aside; equal values are judged alike; with too few rows to see a spike only
endings count; empty input gives empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A limit holds at least LEAST values and TIMES as many as a neighbouring length (mean of REACH to either side).
LEAST, TIMES, REACH = 8, 4.0, 10
#: Least share of finished sentences (table rows) that a shape or closing word must have.
PROSE_SHARE, TABLE_SHARE, WORD_SHARE = 0.0005, 0.01, 0.001
#: Rows up to which the learned endings and limits are broadcast; they are bounded by 1 / share, and this is checked.
SMALL = 100_000

#: The months' names and usual short forms, by their first letters.
_MONTH = "(?:J(?:an(?:uary)?|une?|uly?)|Feb(?:ruary)?|Ma(?:r(?:ch)?|y)|A(?:pr(?:il)?|ug(?:ust)?)|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DATE = _MONTH + " [0-9]{1,2}, [0-9]{4}(?![0-9])"
_OTHER_BLANKS = "\t\n\x0b\f\r\u00a0\u202f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200C))
_MARKS = "(?: ?(?:\\[PAGE ?[0-9]*\\]|\\[[0-9]{1,3}\\]|\\([0-9]{1,2}\\)|[*†‡#;]))+ ?$"


def bare(text: Column) -> Column:
    """Single blanks, no footnote marks, page markers or blanks at the end."""
    # Substring tests are far cheaper than regular expressions, and few values need either replacement.
    odd = text.contains("  ")
    for c in _OTHER_BLANKS:
        odd = odd | text.contains(c)
    flat = F.when(odd, F.regexp_replace(text, "[\\s\\u00A0\\u2000-\\u200B\\u202F\\u3000\\uFEFF]+", " ")).otherwise(text)
    return F.trim(_unmarked(flat))


def _unmarked(flat: Column) -> Column:
    # Every mark ends in one of these.
    marked = F.right(flat, F.lit(1)).isin(*"])*†‡#; ")
    return F.when(marked, F.regexp_replace(flat, _MARKS, "")).otherwise(flat)


def shape(unit: Column) -> Column:
    """A sentence or cell with full dates, numbers and capitalised names masked."""
    out = F.regexp_replace(unit, _DATE, "\u0002")
    out = F.regexp_replace(out, "\\p{Lu}[\\p{L}\\p{N}'’-]*(?: (?:\\p{Lu}[\\p{L}\\p{N}'’-]*))*", "N")
    out = F.regexp_replace(out, "[0-9][0-9,.]*(?<![,.])", "#")
    return F.translate(out, "\u0002", "D")


def features(rows: DataFrame) -> DataFrame:
    """record_id, source_system, chars, bytes, is_table, ending (stop, open or none), shape, word of each non-blank snippet."""
    text = bare(F.col("source_snippet"))
    df = rows.select("record_id", "source_system", F.col("source_snippet").alias("__x"), text.alias("__t")).where(F.col("__x").rlike("\\S"))
    df = df.withColumn("__table", F.col("__t").contains(" | "))
    # The last sentence; "Rs." and "No." end none.
    unit = F.when(F.col("__table"), F.substring_index("__t", "|", -1)).otherwise(F.element_at(F.split(F.regexp_replace("__t", "([.!?][\"'”)]?)(?<!\\b(?:Rs|No|Nos|Mr|Ms)\\.) (?=[\\p{Lu}\\p{N}])", "$1\u0001"), "\u0001"), -1))
    df = df.withColumn("__u", F.trim(unit))
    # Closing quotes and brackets taken away, the last sign tells a stop; what is compared with "Nos." has five signs at most.
    end = F.expr("rtrim('\"”'')]', __t)")
    short = F.right(end, F.lit(5)).rlike("\\b(?:Rs|Nos?|Mr|Ms)\\.$") | end.endswith("..")
    stop = F.right(end, F.lit(1)).isin(*".!?") & ~(short & (end == F.col("__t")))
    last = F.right("__t", F.lit(1))
    page = F.expr("rtrim(rtrim('0123456789', __t))").endswith("[PAGE")
    cut = last.isin(*"…\uFFFD,:|(/₹&-") | F.col("__t").endswith("..") | page | F.right("__t", F.lit(5)).rlike("\\b(?:Rs|Nos?)\\.$")
    body = F.regexp_replace("__u", "[.!?\"'”)\\]]+$", "")
    word = F.translate(F.lower(F.try_element_at(F.filter(F.split(body, "[^\\p{L}\\p{N}]+"), lambda w: w != ""), F.lit(-1))), "0158", "olsb")
    return df.select(
        "record_id", "source_system", F.char_length("__x").alias("chars"), F.octet_length("__x").alias("bytes"), F.col("__table").alias("is_table"),
        F.when(cut, "open").when(stop | (F.col("__t") == ""), "stop").otherwise("none").alias("ending"),
        F.when(F.col("__table"), F.concat(F.size(F.split("__t", " \\| ")).cast("string"), F.lit("|"), shape(body))).otherwise(shape(body)).alias("shape"), word.alias("word"),
    )


def limits(feats: DataFrame) -> DataFrame:
    """source_system, unit (chars or bytes), length, n, usual: the lengths at which values pile up."""
    stacked = feats.select("source_system", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    hist = stacked.groupBy("source_system", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source_system", "unit").orderBy("length").rangeBetween(-REACH, REACH)
    # Past the longest value there is nothing to compare with, so only lengths up to it count.
    last = Window.partitionBy("source_system", "unit")
    around = hist.withColumn("usual", (F.sum("n").over(near) - F.col("n")) / F.greatest(F.lit(1), REACH + F.least(F.lit(REACH), F.max("length").over(last) - F.col("length"))))
    return around.where((F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.greatest("usual", F.lit(1.0))))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its checked size allows; otherwise left to the planner."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def judged(rows: DataFrame) -> DataFrame:
    """record_id, source_system, at_limit, is_cut for every row with a non-blank snippet."""
    feats = cut_lineage(features(rows))
    caps = limits(feats)
    caps = _small(caps.select("source_system", F.col("length").alias("__length"), F.col("unit").alias("__unit")))
    at = lambda unit: caps.where(F.col("__unit") == unit).select(F.col("source_system").alias(f"__s_{unit}"), F.col("__length").alias(f"__l_{unit}"))
    df = feats
    for unit in ("chars", "bytes"):
        df = df.join(at(unit), F.col("source_system").eqNullSafe(F.col(f"__s_{unit}")) & (F.col(unit) == F.col(f"__l_{unit}")), "left")
    df = df.withColumns({"__at_chars": F.col("__l_chars").isNotNull(), "__at_bytes": F.col("__l_bytes").isNotNull()}).drop("__s_chars", "__l_chars", "__s_bytes", "__l_bytes")
    df = df.withColumn("at_limit", F.col("__at_chars") | F.col("__at_bytes"))
    whole = df.where(F.when(F.col("is_table"), ~F.col("at_limit") & (F.col("ending") != "open")).otherwise(F.col("ending") == "stop"))
    totals = whole.groupBy("is_table").agg(F.count(F.lit(1)).alias("__all"))
    least = lambda share: F.greatest(F.lit(2), F.ceil(F.col("__all") * share))

    def frequent(column: str, share: Column) -> DataFrame:
        n = whole.groupBy("is_table", column).agg(F.count(F.lit(1)).alias("__n")).join(F.broadcast(totals), "is_table")  # totals: two rows
        return n.where(F.col("__n") >= least(share)).select("is_table", column, F.lit(True).alias(f"__ok_{column}"))

    shapes = frequent("shape", F.when(F.col("is_table"), TABLE_SHARE).otherwise(PROSE_SHARE))
    # In text order, what begins with a shape follows it directly, so one look ahead finds shapes that could go on.
    goes_on = F.lead("shape").over(Window.partitionBy("is_table").orderBy("shape")).startswith(F.concat("shape", F.lit(" ")))
    shapes = _small(shapes.withColumn("__open_ended", F.coalesce(goes_on, F.lit(False))))
    df = df.join(shapes, ["is_table", "shape"], "left")
    df = df.join(_small(frequent("word", F.lit(WORD_SHARE))), ["is_table", "word"], "left")
    ends_in_name = F.col("shape").rlike("N$")
    finished = F.coalesce("__ok_shape", F.lit(False)) & (~ends_in_name | F.coalesce("__ok_word", F.lit(False)))
    df = df.withColumn("__done", F.when(F.col("ending") == "open", F.lit(False)).when(F.col("ending") == "stop", F.lit(True)).otherwise(finished))
    piled = _piled(df)
    for unit in ("chars", "bytes"):
        own = piled.where(F.col("unit") == unit).select(F.col("source_system").alias("__s"), F.col("length").alias("__n"), F.col("shape").alias(f"__piled_{unit}"))
        df = df.join(own, F.col("source_system").eqNullSafe(F.col("__s")) & (F.col(unit) == F.col("__n")) & (F.col("shape") == F.col(f"__piled_{unit}")), "left").drop("__s", "__n")
    is_cut = ~F.col("__done") | ((F.col("ending") == "none") & (F.col("__piled_chars").isNotNull() | F.col("__piled_bytes").isNotNull()))
    return df.select("record_id", "source_system", "at_limit", is_cut.alias("is_cut"))


def _piled(df: DataFrame) -> DataFrame:
    """source_system, unit, length, shape: finished-looking shapes with which longer ones begin and that are several times
    as frequent at a limit as near it, counted in the unit of the limit."""
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length"), F.col(f"__at_{u}").alias("at")) for u in ("chars", "bytes")]))
    stacked = df.where("__done and ending = 'none' and __open_ended").select("source_system", "shape", "at_limit", each.alias("x"))
    n = stacked.groupBy("source_system", "x.unit", "x.length", "shape").agg(F.count(F.lit(1)).alias("n"), F.max("x.at").alias("at"), F.max("at_limit").alias("any"))
    near = Window.partitionBy("source_system", "unit", "shape").orderBy("length").rangeBetween(-REACH, REACH)
    rate = n.withColumn("usual", (F.sum(F.when(~F.col("any"), F.col("n"))).over(near)) / (2 * REACH))
    found = rate.where(F.col("at") & (F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1.0))))
    return _small(found.select("source_system", "unit", "length", "shape"))


def cut_records(rows: DataFrame) -> DataFrame:
    """record_id of every row whose snippet is cut."""
    return judged(rows).where("is_cut").select("record_id")


def cut_shares(rows: DataFrame) -> DataFrame:
    """Per source: rows with a snippet, cut ones, those of them at a limit, share cut."""
    n = judged(rows).groupBy("source_system").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_cut_at_limit"))
    return n.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6))
