import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.operators import amounts as A

EVENT = "event_id bigint, filing_id string, source_snippet string, old_capital string, new_capital string, issue_price string, total_outflow string, unit string"


def run(spark, cells, unit=None, snippet=None, field="old_capital"):
    rows = [(i, "f", snippet, *[c if f == field else None for f in ("old_capital", "new_capital", "issue_price", "total_outflow")], "extra") for i, c in enumerate(cells)]
    ev = spark.createDataFrame(rows, EVENT)
    fl = spark.createDataFrame([("f", unit)], "filing_id string, amount_unit string")
    out = {r.event_id: (r.paise, r.is_bare) for r in A.amounts_in_paise(ev, fl).collect()}
    return [out.get(i) for i in range(len(cells))]


def test_units_in_the_cell(spark):
    cells = ["₹ 12.5 crore", "Rs.188.7 mn", "1,20,000", "3 crore 20 lakh", "1 055 900", "995.3M INR", "१,०३१.८ million", "0.5k", "Rs. 4,00,600 thousand", "10 bn"]
    got = [x[0] for x in run(spark, cells)]
    assert got == [12500000000, 18870000000, 12000000, 3200000000, 105590000, 99530000000, 103180000000, 50000, 40060000000, 1000000000000]


def test_words_and_compounds(spark):
    cells = [
        "Rupees Twenty-Five Crore Twenty-Five Lakh only", "Rupees Four Hundred Ten and Ninety-Nine Paise", "Rs. 1004 and 12 paise", "98 rupees 18 paise",
        "₹2,61,00,000 (Rupees Two Crore Sixty-One Lakh Only)", "Rupees Two Thousand Three Hundred", "9951 paise", "Paise 100", "1000p", "₹986.55 each", "₹ 99/-",
    ]
    got = [x[0] for x in run(spark, cells, unit="INR lakh", field="issue_price")]
    assert got == [25250000000, 41099, 100412, 9818, 2610000000, 230000, 9951, 100, 1000, 98655, 9900]


def test_order_of_statements(spark):
    assert run(spark, ["5"], unit="Rs. in Lacs")[0] == (50000000, False)
    assert run(spark, ["5"], unit="Rs. in Lacs", snippet="Amounts on this page are in absolute rupees.")[0] == (500, True)
    assert run(spark, ["5"], unit="Rs. in Lacs", snippet="(₹ '000) extract")[0] == (500000, False)
    assert run(spark, ["5 crore"], unit="Rs. in Lacs", snippet="(₹ '000) extract")[0] == (5000000000, False)
    assert run(spark, ["5"], unit=None, snippet="A subsidiary had borrowings of 51 lakh at that date.")[0] == (500, True)
    assert run(spark, ["5"], unit="₹ in crores", field="issue_price")[0] == (500, True)
    assert run(spark, ["5"], snippet="(issue price in paise) list", field="issue_price")[0] == (5, False)
    assert run(spark, ["₹ 5"])[0] == (500, False)


@pytest.mark.parametrize("cell", [None, "", " ", "-", "—", "Nil", "NA", "not applicable", "to be announced", "1.5.2020", "1e6"])
def test_no_amount(spark, cell):
    assert run(spark, [cell]) == [None]


def test_missing_filing_ties_and_empty(spark):
    ev = spark.createDataFrame([(1, None, None, "5", None, None, None, "x"), (1, None, None, "5", None, None, None, "x")], EVENT)
    fl = spark.createDataFrame([], "filing_id string, amount_unit string")
    assert [r.paise for r in A.amounts_in_paise(ev, fl).collect()] == [500, 500]
    assert A.amounts_in_paise(ev.limit(0), fl).count() == 0


def brute(x, penalty):
    best = None
    for path in itertools.product(range(len(A.LEVELS)), repeat=len(x)):
        cost = sum(abs(v + A.LEVELS[p]) for v, p in zip(x, path) if not np.isnan(v)) + penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = cost if best is None else min(best, cost)
    return best


def test_changepoints_match_brute_force_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        x = [float(v) for v in rng.choice([0, -3, -5, -7], 6) + rng.normal(0, 0.4, 6)]
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "src string, k bigint, lv double")
        for block in (2, 3, 100):
            got = [int(A.LEVELS.index(r.level)) for r in A.unit_levels(df, "src", "k", "lv", 1.0, block).orderBy("k").collect()]
            cost = sum(abs(v + A.LEVELS[p]) for v, p in zip(x, got)) + 1.0 * sum(a != b for a, b in zip(got, got[1:]))
            assert cost == pytest.approx(brute(x, 1.0))


def test_changepoints_find_a_unit_change(spark):
    x = [0.1, -0.2, 0.0, 0.1] * 3 + [-5.1, None, -4.9, -5.0] * 3 + [0.0] * 5
    df = spark.createDataFrame([("s", i, v, 1) for i, v in enumerate(x)], "src string, k bigint, lv double, level int")
    out = A.unit_levels(df, "src", "k", "lv", 2.0, 7).orderBy("k").collect()
    assert [r.level for r in out] == [0.0] * 12 + [5.0] * 12 + [0.0] * 5
    assert [i for i, r in enumerate(out) if r.segment_start] == [0, 12, 24]
    assert A.unit_levels(df.where("k < 0"), "src", "k", "lv").count() == 0


def test_many_histories_at_once_match_one_by_one(spark):
    """Histories of unlike lengths share padded arrays; a null source is a source of its own."""
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for s in [None, *range(12)]:
        for _ in range(int(rng.integers(1, 60))):
            rows.append((s, k, float(rng.choice([0, -5]) + rng.normal(0, 1))))
            k += int(rng.integers(1, 3))
    df = spark.createDataFrame(rows, "src bigint, k bigint, lv double")
    one = {r.k: r.level for s in range(12) for r in A.unit_levels(df.where(f"src = {s}"), "src", "k", "lv", 1.5, 1000).collect()}
    for block in (5, 1000):
        got = A.unit_levels(df, "src", "k", "lv", 1.5, block).collect()
        assert len(got) == len(rows) and {r.k for r in got if r.src is None} == {x[1] for x in rows if x[0] is None}
        for s in range(12):
            mine = [x for x in rows if x[0] == s]
            cost = lambda level: sum(abs(x[2] + level[x[1]]) for x in mine) + 1.5 * sum(level[a[1]] != level[b[1]] for a, b in zip(mine, mine[1:]))
            assert cost({r.k: r.level for r in got}) == pytest.approx(cost(one))
