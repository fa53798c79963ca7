"""Mapping free-entered values to a canonical list by a partition-based pigeonhole join, in built-in expressions only.

A reference string that may differ by up to k edits is cut into k + 1 segments; a value within k edits holds at
least one of them unchanged, shifted by no more than the edits before and after it. So values are joined to references by equality
on (length, segment number, substring) alone, verified by ``levenshtein``, and what joins nothing is found by an
anti-join and reported with term 0. Values are first cleaned of decoration, and each distinct value is resolved
once, however often it occurs.

What is no misspelling of a whole entry is looked up word by word, each distinct word once, through the same
pigeonhole index over the entries' words and through an index on the first letter. A word stands for an entry's word
if it is a misspelling, an abbreviation (its start, or letters of it in order down to its last: "inst", "bldg") or
another form of its stem, and for several words if it is made of their initials. A value means an entry if it holds
all of the entry's words in any order, or only words of the entry among which is one that no other entry has. Short forms
found so and in use are references for what is left, as the entries themselves. No synonyms are kept: what no rule
derives from the entries is reported as unmatched.

Defined results: null values give no row; values equal to a term give none either (nothing to map); values without
a letter map to 0; equal matches go to the smaller term_id; a repeated row gives its answer again; an empty
reference list maps everything to 0; empty input gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_distinct, spread
from ..session import cut_lineage

FIELDS = ("allottee_category", "consideration", "resolution_type")

#: Words that carry no meaning of their own, and words that all say "not".
STOP = ("as", "per", "of", "and", "the", "in", "by", "to", "than", "for", "with", "on", "a", "an", "or", "their", "its", "all")
NOT = ("non", "not", "no", "other", "otherwise")
#: First letters that two forms of one stem share at least; least length of a word that others may go on from.
STEM, ROOT = 5, 4
#: Share of a field's rows from which on a short form is in use; so there are at most 1 / USUAL of them.
USUAL = 0.0005

_TAIL = "(?:\\s*(?:\\((?:note\\s*)?[0-9]+\\)|\\[[0-9]+\\]|/\\s*[0-9]+|[,;]?\\s*see (?:page|note|annexure) [0-9a-z]+|-\\s*as certified|[*†‡#^.,;:])|\\s)+$"
_HEAD = "^(?:(?:to|by way of|viz\\.?|being|by|for|in|the|namely|i\\.e\\.?)\\s+)+"
_PART_OF = "^(?:members?|persons?|categor(?:y|ies)|class(?:es)?) of (?:the )?"


def cleaned(c: Column) -> Column:
    """Lower case, one blank between words, no decoration or punctuation, digits that stand for letters restored. A single
    letter before a slash belongs to the next word ("s/holders")."""
    out = F.lower(F.trim(F.regexp_replace(c, "[_\\s\\u00A0\\u2000-\\u200B\\u202F\\u3000\\uFEFF]+", " ")))
    out = F.regexp_replace(F.regexp_replace(out, _TAIL, ""), _HEAD, "")
    out = F.regexp_replace(out, "(?<=[a-z])[1|](?![0-9])|(?<![0-9])1(?=[a-z])", "l")
    out = F.regexp_replace(out, "(?<=[a-z])0(?![0-9])|(?<![0-9])0(?=[a-z])", "o")
    out = F.regexp_replace(F.regexp_replace(out, "&", " and "), "\\(s\\)|['’`.]|(?<=\\b[a-z])/(?=[a-z]{2})", "")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), _HEAD, "")
    return F.when(out.rlike("^(?:[a-z] ){2,}[a-z]$"), F.regexp_replace(out, " ", "")).otherwise(out)


def edits(length: Column) -> Column:
    """Edits within which a reference of that many letters is searched for, at least all that ``close`` accepts: two
    swaps are four edits."""
    return F.when(length <= 3, 0).when(length <= 5, 2).otherwise(4)


def close(value: Column, ref: Column) -> Column:
    """Edit distance if the value may be a misspelling of the reference, else null: one slip in 4-5 letters, two in
    6-9, three in 10-19, four beyond, where two adjacent letters changing places are one slip."""
    n, d = F.length(ref), F.levenshtein(value, ref)
    limit = F.when(n <= 3, 0).when(n <= 5, 1).when(n <= 9, 2).when(n <= 19, 3).otherwise(4)
    same_letters = F.array_sort(F.split(value, "")) == F.array_sort(F.split(ref, ""))
    swaps = F.when((d % 2 == 0) & (F.length(value) == n) & same_letters, F.floor(d / 2)).otherwise(d)
    return F.when(d <= limit, F.least(d, swaps)).when((swaps < d) & (swaps <= F.least(F.lit(2), limit)), swaps)


def content_words(text: Column) -> Column:
    """The words of a cleaned text that mean something; all of them where none does ("or")."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.isin(*STOP))
    return F.when(F.size(own) > 0, own).otherwise(words)


def references(terms: DataFrame) -> DataFrame:
    """field_name, ref (cleaned term), term_id, n (length), k (edits) of the canonical list."""
    ref = terms.where("term is not null and field_name is not null").select("field_name", "term_id", cleaned(F.col("term")).alias("ref")).where("ref <> ''")
    return ref.groupBy("field_name", "ref").agg(F.min("term_id").alias("term_id")).withColumn("n", F.length("ref")).withColumn("k", edits(F.col("n")))


def _segments(n: Column, k: Column) -> Column:
    """Array of (number, start from 1, length) of the k + 1 segments of a string of length n."""
    cut = lambda i: F.floor(i * n / (k + 1))
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), (cut(i) + 1).cast("int").alias("at"), (cut(i + 1) - cut(i)).cast("int").alias("len")))


def near_matches(values: DataFrame, refs: DataFrame) -> DataFrame:
    """field_name, value, ref, distance for every value within the allowed edits of a reference, equal ones at 0.

    ``values``: distinct (field_name, value); ``refs``: distinct (field_name, ref, n, k). Two adjacent letters changing
    places count as one edit.
    """
    # One row per (field, length): at most the greatest length of a reference, whatever the number of values.
    shapes = refs.select("field_name", "n", "k").distinct()
    near = values.withColumn("__m", F.length("value")).join(F.broadcast(shapes), "field_name").where(F.abs(F.col("__m") - F.col("n")) <= F.col("k"))
    # The i-th segment is shifted by at most the i slips before it and, seen from the end, by the k - i after it; of the
    # segments left whole there is always one that meets both bounds.
    shift = F.col("__m") - F.col("n")
    first = lambda s: F.greatest(F.lit(1), s["at"] - s["i"], s["at"] + shift - F.col("k") + s["i"])
    last = lambda s: F.least(F.col("__m") - s["len"] + 1, s["at"] + s["i"], s["at"] + shift + F.col("k") - s["i"])
    places = lambda s: F.when(first(s) <= last(s), F.sequence(first(s), last(s))).otherwise(F.array().cast("array<int>"))
    spot = F.explode(F.flatten(F.transform(_segments(F.col("n"), F.col("k")), lambda s: F.transform(places(s), lambda p: F.struct(s["i"].alias("i"), F.substring(F.col("value"), p, s["len"]).alias("part"))))))
    parts = near.select("field_name", "value", "n", spot.alias("s")).select("field_name", "value", "n", "s.i", "s.part")
    index = refs.select("field_name", "ref", "n", F.explode(_segments(F.col("n"), F.col("k"))).alias("s")).select("field_name", "n", "ref", "s.i", F.expr("substring(ref, s.at, s.len)").alias("part"))
    hit = parts.join(index, ["field_name", "n", "i", "part"]).select("field_name", "value", "ref").distinct()
    return hit.withColumn("distance", close(F.col("value"), F.col("ref"))).where("distance is not null")


def word_references(refs: DataFrame) -> DataFrame:
    """field_name, term_id, ref, at and to (places of the words it stands for), is_word, whole (it stands for all of the
    entry): the words of the entries and the initials of runs of them."""
    at = refs.select("field_name", "term_id", content_words(F.col("ref")).alias("w")).withColumn("nt", F.size("w"))
    word = F.transform("w", lambda w, i: F.struct(w.alias("ref"), i.alias("at"), i.alias("to"), F.lit(True).alias("is_word")))
    first = F.transform("w", lambda w: F.substring(w, 1, 1))
    spell = lambda i, j: F.struct(F.array_join(F.slice(first, i + 1, j - i + 1), "").alias("ref"), i.alias("at"), j.alias("to"), F.lit(False).alias("is_word"))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda i: F.transform(F.sequence(i, F.col("nt") - 1), lambda j: spell(i, j))))
    long = F.filter(runs, lambda r: r["to"] > r["at"])
    return at.select("field_name", "term_id", "nt", F.inline(F.concat(word, long))).withColumn("whole", F.col("to") - F.col("at") + 1 == F.col("nt")).drop("nt")


def _same_not(w: Column) -> Column:
    return F.when(w.isin(*NOT), F.lit(NOT[0])).otherwise(w)


def _singular(w: Column) -> Column:
    return F.when(F.length(w) > 2, F.regexp_replace(w, "s$", "")).otherwise(w)


def _is_short_for(v: Column, w: Column) -> Column:
    """v abbreviates w: its start, or at least three of its letters in order, the first and the last among them."""
    in_order = F.regexp_like(w, F.concat(F.lit("^"), F.regexp_replace(v, "(.)", "$1.*")))
    return (F.length(v) < F.length(w)) & in_order & (F.startswith(w, v) | ((F.length(v) >= 3) & (F.right(v, F.lit(1)) == F.right(w, F.lit(1)))))


def _same_stem(v: Column, w: Column) -> Column:
    long = (F.length(v) >= STEM) & (F.length(w) >= STEM) & (F.substring(v, 1, STEM) == F.substring(w, 1, STEM))
    return long | ((F.length(w) >= ROOT) & F.startswith(v, w))


def _is_initials(v: Column, ref: Column, whole: Column) -> Column:
    """v is made of the initials: exactly, or, for a whole entry, with one letter more or other than the rest ("hni")."""
    one_off = ((F.length(ref) >= 3) & (F.length(v) >= 3) & (F.levenshtein(v, ref) <= 1) & (F.substring(v, 1, 2) == F.substring(ref, 1, 2))) | ((F.length(ref) == 2) & (F.length(v) == 3) & F.startswith(v, ref))
    return (v == ref) | (whole & one_off)


def word_matches(words: DataFrame, names: DataFrame) -> DataFrame:
    """field_name, word, term_id, at, to, cost: the places in entries that each distinct word may stand for, given their
    ``word_references``. Costs: 0 the word itself or its plural, 1 a misspelling, start, stem or initials, 3 letters of it."""
    own = names.where("is_word").select("field_name", "term_id", F.explode(F.array_distinct(F.array("ref", _singular(F.col("ref")), _same_not(F.col("ref"))))).alias("ref"), "at", "to")
    forms = own.select("field_name", "ref").distinct().withColumn("n", F.length("ref")).withColumn("k", edits(F.col("n")))
    typed = near_matches(words.select("field_name", F.col("word").alias("value")), forms).select("field_name", F.col("value").alias("word"), "ref", F.least("distance", F.lit(1)).cast("int").alias("cost")).join(own, ["field_name", "ref"])
    v, w, ref = _singular(F.col("word")), _singular(F.col("ref")), F.col("ref")
    short = F.when(v == w, 0).when(F.startswith(w, v) | _same_stem(F.col("word"), ref), 1).when(_is_short_for(v, w), 3)
    spelled = F.when(_is_initials(F.col("word"), ref, F.col("whole")) | _is_initials(v, ref, F.col("whole")), 1)
    lettered = words.withColumn("__l", F.substring("word", 1, 1)).join(names.withColumn("__l", F.substring("ref", 1, 1)), ["field_name", "__l"])
    lettered = lettered.withColumn("cost", F.when(F.col("is_word"), short).otherwise(spelled)).where("cost is not null")
    cols = ["field_name", "word", "term_id", "at", "to", "cost"]
    return typed.select(*cols).unionByName(lettered.select(*cols)).groupBy("field_name", "word", "term_id", "at", "to").agg(F.min("cost").alias("cost"))


def by_words(values: DataFrame, refs: DataFrame) -> DataFrame:
    """field_name, value, term_id, cost, exact (nothing is left over on either side) of the values whose words name an entry."""
    split = F.transform(content_words(F.regexp_replace(F.regexp_replace("value", _PART_OF, ""), "^non(?=[a-z]{3})", "non ")), _same_not)
    each = values.select("field_name", "value", split.alias("w")).withColumn("nv", F.size("w")).select("field_name", "value", "nv", F.posexplode("w").alias("pos", "word"))
    names = cut_lineage(word_references(refs))
    found = word_matches(spread(each.select("field_name", "word").distinct(), "field_name", "word"), names)
    # A word of the value counts for one place of an entry: the nearest, then the first.
    one = each.join(found, ["field_name", "word"]).groupBy("field_name", "value", "nv", "term_id", "pos").agg(F.min(F.struct("cost", "at", "to")).alias("m"))
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence("m.at", "m.to"))))  # at most the words of an entry
    per = one.groupBy("field_name", "value", "nv", "term_id").agg(F.count(F.lit(1)).alias("mv"), F.sum("m.cost").alias("cost"), F.max("m.cost").alias("worst"), places.alias("places"))
    own = names.where("is_word").select("field_name", "term_id", "at", _singular(F.col("ref")).alias("w"))
    rare = own.groupBy("field_name", "w").agg(F.count_distinct("term_id").alias("n"))
    sizes = own.join(rare, ["field_name", "w"]).groupBy("field_name", "term_id").agg(F.count_distinct("at").alias("nt"), F.collect_set(F.when(F.col("n") == 1, F.col("at"))).alias("own_places"))
    per = per.join(sizes, ["field_name", "term_id"]).withColumn("mt", F.size("places"))
    all_of_entry, all_of_value = F.col("mt") == F.col("nt"), F.col("mv") == F.col("nv")
    # Letters of a word are too little where something is left over.
    some = F.col("worst") < 3
    kind = F.when(all_of_entry & all_of_value, 0).when(all_of_entry & some, 1).when(all_of_value & some & F.arrays_overlap("places", "own_places"), 2)
    # The more of an entry is held, the better; what is left over on either side, and changed words, count against it.
    rank = F.struct(kind.alias("kind"), F.when(kind == 1, -F.col("nt")).otherwise(0).alias("size"), (F.col("nv") - F.col("mv") + F.col("nt") - F.col("mt")).alias("left"), "cost", "term_id")
    best = per.where(kind.isNotNull()).groupBy("field_name", "value").agg(F.min(rank).alias("b"))
    return best.select("field_name", "value", F.col("b.term_id").alias("term_id"), F.col("b.cost").alias("cost"), (F.col("b.kind") == 0).alias("exact"))


def resolve_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """field_name, value, term_id (0 if none) of (field_name, value, n): cleaned distinct values and their numbers of rows."""
    refs, pair = cut_lineage(references(terms)), ["field_name", "value"]
    nearest = lambda near: near.groupBy(*pair).agg(F.min(F.struct("distance", (-F.col("n")).alias("l"), "term_id")).alias("b")).select(*pair, F.col("b.term_id").alias("term_id"), F.col("b.distance").alias("distance"))
    values = cut_lineage(spread(values.groupBy(*pair).agg(F.sum("n").alias("rows")), *pair))
    # A longer reference explains more of the value at the same distance.
    whole = nearest(near_matches(values.where("value <> ''").select(*pair), refs).join(refs, ["field_name", "ref"]))
    seen = cut_lineage(values.join(whole, pair, "left"))
    worded = by_words(spread(seen.where("value <> '' and (distance is null or distance > 1)").select(*pair), *pair), refs)
    # "ord resolution" is two slips from "board resolution" but, word by word, one from "ordinary resolution".
    better = F.col("w.term_id").isNotNull() & (F.col("s.distance").isNull() | (F.col("w.exact") & (F.col("w.cost") < F.col("s.distance"))))
    both = seen.alias("s").join(worded.alias("w"), pair, "left").select(*pair, "rows", F.when(better, F.col("w.term_id")).otherwise(F.col("s.term_id")).alias("term_id"), F.when(~better, F.col("s.distance")).alias("distance"), better.alias("derived"))
    both = cut_lineage(both)
    # Short forms in use are references in turn, so their misspellings are found as those of the entries are.
    usual = both.groupBy("field_name").agg((F.sum("rows") * USUAL).alias("__least"))  # a row per field
    forms = both.where("derived").join(F.broadcast(usual), "field_name").where((F.col("rows") >= F.col("__least")) & (F.col("rows") >= 3))
    forms = forms.select("field_name", F.col("value").alias("ref"), "term_id", F.length("value").alias("n")).withColumn("k", edits(F.col("n")))
    doubtful = both.where("value <> '' and not derived and (distance is null or distance > 1)").select(*pair, F.col("distance").alias("before"))
    late = nearest(near_matches(doubtful.select(*pair), forms).join(forms, ["field_name", "ref"])).join(doubtful, pair)
    late = late.where("before is null or distance < before").select(*pair, F.col("term_id").alias("__late"))
    found = cut_lineage(both.join(late, pair, "left").select(*pair, F.coalesce("__late", "term_id").alias("term_id")).where("term_id is not null"))
    none = both.select(*pair).join(found, pair, "left_anti").withColumn("term_id", F.lit(0))
    return found.unionByName(none)


def map_to_terms(events: DataFrame, terms: DataFrame, fields: Sequence[str] = FIELDS, key: str = "event_id") -> DataFrame:
    """key, field_name, entry, term_id (bigint) of every non-null entry that is not letter for letter a term."""
    cells = events.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("entry")) for f in fields])).alias("x")).select(key, "x.field_name", "x.entry").where("entry is not null")
    exact = terms.select("field_name", F.col("term").alias("entry")).distinct()
    cells = cells.join(exact, ["field_name", "entry"], "left_anti")

    def resolve(present: DataFrame) -> DataFrame:
        # Read by several branches; the distinct entries are written once instead of being found anew for each.
        clean = cut_lineage(spread(present, "field_name", "entry").withColumn("value", cleaned(F.col("entry"))))
        answers = resolve_values(clean.select("field_name", "value", F.col("__rows").alias("n")), terms)
        return clean.join(answers, ["field_name", "value"])

    out = lookup_distinct(cells, ["field_name", "entry"], key, resolve, ["term_id"])
    return out.select(key, "field_name", "entry", F.col("term_id").cast("bigint").alias("term_id"))


def unmatched(events: DataFrame, terms: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field_name, entry, n of the entries the list has no term for."""
    return map_to_terms(events, terms, fields).where("term_id = 0").groupBy("field_name", "entry").agg(F.count(F.lit(1)).alias("n"))
