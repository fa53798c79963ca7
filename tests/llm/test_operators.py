"""Each operator on small fixtures: against brute force, and on nulls, ties, repeats, empty and clashing input."""

import random
import re
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capstrata.llm import canon, copies, leakage, packing, subjects, survivors, truncation

EXTRACTED = (
    "record_id bigint, filing_id string, event_type string, date string, shares bigint, issue_price double, page_number int, confidence double, "
    "extracted_at timestamp_ntz, source_provenance struct<extraction_method string, confidence double>, value string, vote string"
)


# ---- survivors


def extracted(spark, rows):
    full = [(i, f, e, d, n, p, pg, c, datetime(2024, 1, day), (m, pc), "x", "y") for i, f, e, d, n, p, pg, c, day, m, pc in rows]
    return spark.createDataFrame(full, EXTRACTED)


def side_tables(spark):
    filings = spark.createDataFrame([("f", 10, 1)], "filing_id string, total_pages int, field int")
    trust = spark.createDataFrame([("table", 1), ("text", 2), ("llm", 3), ("ocr", 4)], "extraction_method string, trust_rank int")
    return filings, trust


def test_leads_follow_the_stated_order(spark):
    rows = extracted(spark, [
        (1, "f", "a", "d", 5, None, 99, 0.9, 1, " Table ", None),
        (2, "f", "a", "d", 5, 7.0, 3, 95.0, 1, "TABLE", None),
        (3, "f", "a", "d", 5, 8.0, 0, None, 5, "table", 0.99),
        (4, "f", "a", "d", 5, 9.0, 1, 1.0, 9, "llm", None),
        (5, "f", "a", "d", 6, 9.0, 1, 1.0, 9, "llm", None),
        (6, "f", "a", None, 5, 9.0, 1, 1.0, 9, "llm", None),
        (7, "g", "a", "d", 5, None, 1, None, 9, None, None),
        (8, "g", "a", "d", 5, None, 1, None, 9, "unknown", None),
    ])
    got = {tuple(r) for r in survivors.ranked_leads(rows, *side_tables(spark)).select("lead_id", "page_from_id", "price_from_id").collect()}
    assert got == {(3, 2, 3), (7, None, None)}
    assert survivors.ranked_leads(rows.limit(0), *side_tables(spark)).count() == 0


def test_leads_match_brute_force(spark):
    rng = random.Random(5)
    data = [
        (i, rng.choice("fg"), "a", rng.choice(["d", None]), rng.choice([1, 2]), rng.choice([None, 1.0]), rng.choice([None, -1, 0, 5, 10, 11]), rng.choice([None, 0.5, 50.0, 0.9]), rng.choice([1, 2]), rng.choice([None, "table", "Text", "x"]), rng.choice([None, 0.7]))
        for i in range(60)
    ]
    rank = {"table": 1, "text": 2, "llm": 3, "ocr": 4}
    groups = defaultdict(list)
    for r in data:
        if r[3] is not None:
            groups[r[1], r[2], r[3], r[4]].append(r)
    want = set()
    for key, rows in groups.items():
        if len(rows) < 2:
            continue
        conf = lambda r: (r[7] / 100 if r[7] and r[7] > 1 else r[7]) if r[7] is not None else (r[10] if r[10] is not None else -1)
        rows.sort(key=lambda r: (rank.get((r[9] or "").lower(), 9), -conf(r), -r[8], r[0]))
        first = lambda ok: next((r[0] for r in rows if ok(r)), None)
        pages = {"f": 10}.get(key[0])
        want.add((rows[0][0], first(lambda r: pages and r[6] is not None and 1 <= r[6] <= pages), first(lambda r: r[5] is not None)))
    got = {tuple(r) for r in survivors.ranked_leads(extracted(spark, data), *side_tables(spark)).select("lead_id", "page_from_id", "price_from_id").collect()}
    assert got == want


def test_survivors_sum_votes(spark):
    rows = extracted(spark, [(1, "f", "a", "d", 5, 7.0, 3, 0.9, 1, "text", None), (2, "f", "a", "d", 5, 8.0, 3, 0.8, 1, "text", None), (3, "f", "a", "d", 5, 8.0, 99, 80.0, 1, "ocr", None)])
    r = survivors.survivors(rows, *side_tables(spark)).collect()[0]
    assert (r.n_rows, r.confidence, r.extraction_method, r.page_number, r.issue_price) == (3, 0.8, "text", 3, 8.0)
    assert r.issue_price_share == pytest.approx(0.625 / 1.125, abs=1e-5)


# ---- copies

EVENT = "event_id bigint, filing_id string, event_type string, date string, shares string, ratio string, raw_text string, digest int, canonical int"


def test_copies_of_every_layout(spark):
    rows = [
        (5, "f", "bonus_issue", "26-May-2012", None, "5:1", None), (3, "f", "Bonus Issue", "26 MAY 2012", None, "[5 : 1]", None),
        (9, "f", None, None, None, None, "DATE : 26.May.2012 \nEVENT-TYPE : BonusIssue\nRATIO : 5：1"), (7, "f", None, None, None, None, '{"ratio": "5/1", "date": "26 May 2012", "event_type": "bonus-issue"}'),
        (8, "f", "bonus_issue", "26-May-2012", None, "1:5", None), (10, "f", "bonus_issue", "26-May-2012", "5", "5:1", None), (11, "g", "bonus_issue", "26-May-2012", None, "5:1", None),
        (12, "f", "bonus_issue", "2-6-May-2012", None, "5:1", None), (13, "f", "a", None, "5", None, None), (14, "f", "a", None, "5", None, None), (15, None, "a", "d", "5", None, None), (16, None, "a", "d", "5", None, None),
        (20, "f", "allotment", "2001-01-01", "1,000", None, None), (21, "f", "Allotment.", "2001/01/01", "(1 000)", None, None), (21, "f", "Allotment.", "2001/01/01", "1000", None, None), (22, "f", "a", "d", None, None, None), (23, "f", "a", "d", None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], EVENT)
    assert sorted(tuple(r) for r in copies.copies(df).collect()) == [(3, 5), (3, 7), (3, 9), (20, 21), (20, 21)]
    assert {r.keep_id: r.n_copies for r in copies.collapsed(df).collect()} == {3: 4, 8: 1, 10: 1, 11: 1, 12: 1, 20: 3}
    assert copies.copies(df.limit(0)).count() == 0


def test_merkle_ignores_field_order_but_not_array_order(spark):
    kind = T.StructType().add("a", T.StringType()).add("b", T.ArrayType(T.StringType())).add("m", T.MapType(T.StringType(), T.StringType()))
    flipped = T.StructType([kind["m"], kind["b"], kind["a"]])
    one = spark.createDataFrame([(("X y", ["p", "q"], {"k": "v", "l": None}),)], T.StructType().add("r", kind))
    two = spark.createDataFrame([(({"L": None, "K": "V."}, ["P", "q "], "xY"),)], T.StructType().add("r", flipped))
    three = spark.createDataFrame([(("X y", ["q", "p"], {"k": "v"}),)], T.StructType().add("r", kind))
    d = [df.select(*copies.merkle(F.col("r"), df.schema["r"].dataType)).first() for df in (one, two, three)]
    assert d[0] == d[1] != d[2]


def test_a_hot_group_of_copies_stays_whole(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("event_id"), F.lit("f").alias("filing_id"), F.lit("a").alias("event_type"), F.lit("d1").alias("date"), F.lit("5").alias("shares"), F.lit(None).cast("string").alias("ratio"), F.lit(None).cast("string").alias("raw_text"))
    out = copies.copies(df)
    assert out.count() == 2999 and out.agg(F.countDistinct("keep_id"), F.min("keep_id")).first() == (1, 1)


# ---- truncation


def test_cut_snippets_are_told_from_whole_ones(spark):
    names = [f"{a}{b} Trust" for a in ("Alpha", "Beta", "Gamma", "Delta", "Omega") for b in ("ro", "vi", "lex", "mor")]
    whole = [f"{n} Equity Shares were allotted to {w} on June {n % 27 + 1}, 2011." for n, w in zip(range(100, 400), names * 15)]
    notes = [f"The allottees included {a} and {b}." for a, b in zip(names, names[1:])] * 4
    texts = whole + notes + [w[:-1] for w in whole[:10]] + [w + " (1)" for w in whole[:5]] + ["(1)", "* ;"] + [w[:-1] + " [PAGE 4]" for w in whole[:3]]
    good = len(texts)
    cut = [w[:45] for w in whole[:30]] + [whole[0][:30] + "…", whole[1][:33] + "�", whole[2][:40] + "-", notes[0][:-4], whole[3][:38] + " [PAGE"]
    texts += cut + [None, "", "  \n"]
    df = spark.createDataFrame([(i, f"s{i % 2}" if i < good else "lim", t, "x") for i, t in enumerate(texts)], "record_id bigint, source_system string, source_snippet string, shape string")
    got = {r[0] for r in truncation.cut_records(df).collect()}
    assert got == set(range(good, good + len(cut)))
    shares = {r.source_system: (r.n_rows, r.n_cut) for r in truncation.cut_shares(df).collect()}
    assert shares["lim"] == (len(cut), len(cut)) and shares["s0"][1] == 0
    caps = {(r.source_system, r.unit, r.length) for r in truncation.limits(truncation.features(df)).collect()}
    assert ("lim", "chars", 45) in caps
    assert truncation.cut_records(df.limit(0)).count() == 0


def test_cuts_at_a_byte_limit_are_counted_in_bytes(spark):
    """Multi-byte letters spread one byte limit over many lengths in characters; the finished-looking cuts still pile up."""
    tail = "The allottees included the promoters"
    cut = ["é" * k + "e" * (60 - 2 * k) + ". " + tail for k in range(1, 13)] * 2
    assert {len(t.encode()) for t in cut} == {62 + len(tail)} and len({len(t) for t in cut}) == 12
    whole = [f"{'e' * n}. {tail}{end}." for n in range(1, 40) for end in ("", " and others")]
    texts = [("lim", t) for t in cut] + [("s", t) for t in whole] + [("s", whole[0][:-1])]
    df = spark.createDataFrame([(i, src, t) for i, (src, t) in enumerate(texts)], "record_id bigint, source_system string, source_snippet string")
    caps = {(r.unit, r.length) for r in truncation.limits(truncation.features(df)).collect() if r.source_system == "lim"}
    assert caps == {("bytes", 62 + len(tail))}
    assert {r[0] for r in truncation.cut_records(df).collect()} == set(range(len(cut)))


# ---- canon


def test_entries_map_to_the_term_they_mean(spark):
    terms = spark.createDataFrame([(1, "c", "cash"), (2, "c", "other than cash"), (3, "c", "conversion of debentures"), (4, "c", "conversion of warrants"), (5, "d", "cash")], "term_id int, field_name string, term string")
    entries = {
        "cash": None, "Cash": 1, "c a s h": 1, "cahs": 1, "in cash": 1, "by way of cash (note 3)": 1, "cash, see page 80": 1, "other_than_cash": 2, "otehr than cahs": 2, "0ther than cash.": 2,
        "conversion of drbentures": 3, "converion 0f debentures": 3, "warrants converted": 4, "conversion of warraants": 4, "weather index": 0, "": 0, "(28)": 0, "700": 0, "cost": 0, None: None,
    }
    keys = list(entries)
    ev = spark.createDataFrame([(i, k, "z") for i, k in enumerate(keys)] * 2, "event_id bigint, c string, term_id string")
    got = sorted((r.event_id, r.term_id) for r in canon.map_to_terms(ev, terms, ["c"]).collect())
    want = sorted([(i, entries[k]) for i, k in enumerate(keys) if entries[k] is not None] * 2)
    assert got == want
    assert all(r.term_id == 0 for r in canon.map_to_terms(ev, terms.limit(0), ["c"]).collect())
    assert canon.map_to_terms(ev.limit(0), terms, ["c"]).count() == 0


def test_short_forms_follow_from_the_entries(spark):
    names = ["promoters", "promoter group", "qualified institutional buyers", "banks and financial institutions", "high net worth individuals", "general public", "other than cash", "cash", "land and buildings", "board resolution", "ordinary resolution", "plant and machinery", "existing shareholders", "conversion of loan"]
    terms = spark.createDataFrame([(i, "c", n) for i, n in enumerate(names, 1)], "term_id int, field_name string, term string")
    entries = {
        "Promoter": 1, "founding promoters": 1, "prom. group": 2, "QIBs": 3, "institutional buyers (qualified)": 3, "Banks & FIs": 4, "financial institutions and banks": 4, "HNI": 5, "public": 6, "members of the public": 6,
        "non-cash": 7, "otherwise than in cash": 7, "paid in cash": 8, "land and bldgs": 9, "ord. resolution": 11, "resolution of the board": 10, "P and M": 12, "existing s/holders": 13, "loan converted": 14, "conv. of loan": 14,
        "resolution": 0, "as per list 5": 0, "lottery winners": 0,
    }
    keys = list(entries)
    ev = spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(100 + i, "founding promoters") for i in range(5)] + [(200, "foundign promotesr")], "event_id bigint, c string")
    got = {r.event_id: r.term_id for r in canon.map_to_terms(ev, terms, ["c"]).collect()}
    assert {keys[i]: t for i, t in got.items() if i < 100 and t != entries[keys[i]]} == {}
    assert got[200] == 1


def test_pigeonhole_join_loses_nothing(spark):
    rng = random.Random(7)
    refs = ["conversion of loan", "share swap", "land and buildings", "scheme of amalgamation", "holding company"]
    values = set()
    for r in refs:
        for _ in range(60):
            t = list(r)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(t))
                op = rng.randrange(3)
                if op == 0:
                    t[i] = rng.choice("abcxyz")
                elif op == 1 and len(t) > 4:
                    del t[i]
                else:
                    t.insert(i, rng.choice("abcxyz"))
            values.add("".join(t).strip())
    vals = spark.createDataFrame([("c", v) for v in sorted(values)], "field_name string, value string")
    terms = spark.createDataFrame([(i, "c", r) for i, r in enumerate(refs)], "term_id int, field_name string, term string")
    ref = canon.references(terms)
    got = {(r.value, r.ref, r.distance) for r in canon.near_matches(vals, ref).collect()}
    pairs = vals.crossJoin(F.broadcast(ref.drop("field_name"))).withColumn("distance", canon.close(F.col("value"), F.col("ref"))).where("distance is not null")
    assert got == {(r.value, r.ref, r.distance) for r in pairs.collect()} and len(got) > 100


# ---- packing


def test_two_swaps_in_a_short_reference_are_found(spark):
    """Two swaps are four edits; a candidate search of fewer segments than five misses some of them."""
    terms = spark.createDataFrame([("c", 7, "promoters"), ("c", 8, "public")], "field_name string, term_id int, term string")
    vals = spark.createDataFrame([("c", "pormoetrs"), ("c", "upblci"), ("c", "opmroters")], "field_name string, value string")
    ref = canon.references(terms)
    pairs = vals.crossJoin(F.broadcast(ref.drop("field_name"))).withColumn("distance", canon.close(F.col("value"), F.col("ref"))).where("distance is not null")
    want = {(r.value, r.ref, r.distance) for r in pairs.collect()}
    assert {("pormoetrs", "promoters", 2), ("upblci", "public", 2)} <= want
    assert {(r.value, r.ref, r.distance) for r in canon.near_matches(vals, ref).collect()} == want


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(4)}
        room = rng.randint(1, 50)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        chosen = packing.best_fill(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums) and all(n <= counts[x] for x, n in chosen.items())


def test_packing_places_every_piece_once(spark):
    rng = random.Random(1)
    sizes = [rng.choice([7, 7, 7, rng.randint(1, 100), 0]) for _ in range(900)] + [250, 100, 101]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "doc_id bigint, tokens bigint, piece int")
    rows = packing.pack_counts(df, 100, 4).collect()
    loads = defaultdict(int)
    for r in rows:
        loads[r.container_id] += r.tokens
    assert max(loads.values()) <= 100
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.token_from, r.tokens))
    assert len(pieces) == len(sizes)
    for i, n in enumerate(sizes):
        got = sorted(pieces[i])
        assert sum(t for _, _, t in got) == n and len(got) == max(1, -(-n // 100)) and [f for _, f, _ in got] == [100 * k for k in range(len(got))]
    used = sum(1 for v in loads.values() if v)
    assert set(c for c, v in loads.items() if v) == set(range(used)) and used <= -(-sum(sizes) // 100) * 1.03 + 1
    again = {(r.doc_id, r.piece): r.container_id for r in packing.pack_counts(df.repartition(7), 100, 4).collect()}
    assert again == {(r.doc_id, r.piece): r.container_id for r in rows}
    assert packing.pack_counts(df.limit(0), 100).count() == 0


def test_whole_texts_are_counted(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 5000), (1, "hello world")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.tokens) for r in packing.pack(docs, 4000).groupBy("doc_id").agg(F.sum("tokens").alias("tokens")).collect())
    assert got[0] == (1, 4) and got[1:3] == [(2, 0), (3, 0)] and got[3][1] >= 10000


# ---- leakage


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)] + ["Ltd", "ü", "no5"]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(25)]
    texts = []
    for _ in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            src = re.findall("[A-Za-z0-9ü]+", rng.choice(items))
            a = rng.randrange(len(src))
            words[rng.randint(0, len(words)) : 0] = src[a : a + rng.randint(10, 25)]
        texts.append(rng.choice([" ", "\n", ", ", " - "]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += [None, "", items[0], items[0], "x " * 200_000 + items[1]]
    split = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
    own = [grams(split(t)) for t in items]
    want = {(d, i) for d, t in enumerate(texts) for i, g in enumerate(own) if g & grams(split(t))}
    docs = spark.createDataFrame([(d, t, 1) for d, t in enumerate(texts)], "doc_id bigint, text string, item_id int").repartition(3)
    ev = spark.createDataFrame([(i, "s", t) for i, t in enumerate(items)], "item_id bigint, suite string, item_text string")
    assert {tuple(r) for r in leakage.leaks(docs, ev).collect()} == want
    assert leakage.leaks(docs.limit(0), ev).count() == 0
    assert leakage.leaks(docs, ev.limit(0)).count() == 0
    assert {tuple(r) for r in leakage.leaks(docs.withColumn("doc_id", F.col("doc_id").cast("int")), ev).collect()} == want
    assert len(want) > 20
    assert sum(r.n_documents for r in leakage.leak_report(leakage.leaks(docs, ev), ev).collect()) == len(want)


def test_one_id_for_two_texts_leaks_what_either_holds(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " * 40), (1, "y " * 7 + item), (2, item), (2, "short")], "doc_id bigint, text string")
    ev = spark.createDataFrame([(5, "s", item), (5, "s", "other " * 3), (6, "s", None)], "item_id bigint, suite string, item_text string")
    assert sorted(tuple(r) for r in leakage.leaks(docs, ev).collect()) == [(1, 5), (2, 5)]


# ---- subjects


def test_subjects_are_learned_and_measured(spark):
    rng = random.Random(4)
    nouns = {1: ["dividend", "payout", "buyback", "yield"], 2: ["court", "lawsuit", "tribunal", "judge"], 3: ["factory", "assembly", "gearbox", "furnace"]}
    def sentence(s):
        a, b = rng.sample(nouns[s], 2)
        return f"The {a} and the {b} were reviewed in {rng.randint(1990, 2020)} by the committee."
    docs, labels, truth = [], [], []
    for i in range(160):
        s = rng.randint(1, 3)
        t = rng.choice([x for x in nouns if x != s])
        other = rng.random() < 0.4
        parts = [sentence(s) for _ in range(8)] + ([sentence(t) for _ in range(3)] if other else [])
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), rng.choice(["en", None]), "src", 5, None))
        truth.append({s, t} if other else {s})
        if i < 90:
            labels += [(i, x, "a") for x in truth[-1]]
    docs += [(900, None, "en", "src", 5, None), (901, "", "en", "src", None, "x"), (902, "Q", "fr", None, 5, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, issuer_id bigint, heading string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject_id int, labeller string")
    areas = spark.createDataFrame([(i, f"a{i}", "") for i in range(1, 4)], "subject_id int, subject_name string, description string")
    found = subjects.subjects_of(subjects.subject_shares(d, lab, areas))
    got = defaultdict(set)
    for r in found.collect():
        got[r.doc_id].add(r.subject_id)
    hits = sum(got[i] == truth[i] for i in range(90, 160))
    assert hits >= 66 and not (set(got) & {900, 901, 902})
    assert sum(r.n_documents for r in subjects.composition(found, areas).collect()) == sum(len(v) for v in got.values())
    assert subjects.subjects_of(subjects.subject_shares(d.limit(0), lab, areas)).count() == 0
    assert subjects.subjects_of(subjects.subject_shares(d, lab.limit(0), areas)).count() == 0


def test_accuracies_are_recovered():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.integers(0, 4, 4000)
    votes = np.stack([np.where(rng.random(4000) < a, truth, rng.integers(0, 4, 4000)) for a in (0.9, 0.6, 0.6)], axis=1)
    votes[rng.random((4000, 3)) < 0.2] = -1
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    acc, share, _ = subjects.learn_accuracies(pats, counts.astype(float), 4)
    assert abs(acc[0] - 0.925) < 0.05 and abs(acc[1] - 0.7) < 0.06 and abs(share - 0.25).max() < 0.05
