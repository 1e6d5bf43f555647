from __future__ import annotations

import pytest

from casemill.operators.timestamps import estimate_zones, normal_form, parse_columns

CASES = [
    ("15/03/2025", None, "dmy", "2025-03-15"), ("03/15/2025", None, "dmy", "2025-03-15"), ("04/05/2010", "Europe/London", "mdy", "2010-04-05"), ("04/05/2010", None, None, None), ("05/05/2010", None, None, "2010-05-05"),
    ("30 February 2011", None, "dmy", None), ("Aug 2009", None, None, "2009-08"), ("2011-09", None, None, "2011-09"), ("this the 1st day of June, 2021", None, None, "2021-06-01"), ("25.12.49", None, "dmy", "2049-12-25"), ("25.12.50", None, "dmy", "1950-12-25"),
    ("1378454787", None, None, "2013-09-06T08:06:27.000000Z"), ("1284302648000", None, None, "2010-09-12T14:44:08.000000Z"), ("2015-10-05T11:29:34.5Z", None, None, "2015-10-05T11:29:34.500000Z"), ("30-Mar-2014 04:17 GMT+02:00", None, None, "2014-03-30T02:17:00.000000Z"),
    ("28.10.2012 01:30", "Europe/London", "dmy", "2012-10-28T00:30:00.000000Z"),  # occurs twice: the earlier
    ("31.03.2013 01:30", "Europe/London", "dmy", "2013-03-31T01:30:00.000000Z"),  # skipped: the offset before
    ("06 November 2016 01:30:00 EST", "America/New_York", "mdy", "2016-11-06T06:30:00.000000Z"), ("06 November 2016 01:30:00 EDT", "America/New_York", "mdy", "2016-11-06T05:30:00.000000Z"), ("19 June 2017 15:27:14 IST", None, None, None),
    ("24/12/2008, 12.13 am", "UTC", "dmy", "2008-12-24T00:13:00.000000Z"), ("24/12/2008 25:13", "UTC", "dmy", None), ("n.d.", "UTC", "dmy", None), ("", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("9" * 50_000, "UTC", "dmy", None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v, z, o, "clash") for i, (v, z, o, _) in enumerate(CASES)], "i int, value string, zone string, ord string, kind string")
    got = {r.i: r.normal_form for r in normal_form(df, "value", "ord", "zone").collect()}
    for i, (v, _, _, want) in enumerate(CASES):
        assert got[i] == want, (v, got[i], want)
    assert normal_form(df.limit(0), "value", "ord", "zone").count() == 0


def zones(spark, rows, candidates, declared=None):
    df = spark.createDataFrame(rows, "place string, value string, ord string, keyed string, declared string").selectExpr("place", "value", "ord", "CAST(keyed AS TIMESTAMP) AS keyed", "declared")
    return [(r.place, r.zone_name, r.violations, r.is_declared, r.estimated_zone) for r in estimate_zones(parse_columns(df, "value", "ord"), "place", ["keyed"], candidates, declared).collect()]


@pytest.mark.parametrize("declared", [None, "Europe/London"])
def test_zone_is_the_one_with_fewest_violations(spark, declared):
    # judgments at 18:00 in Kolkata are keyed at 12:45 UTC; read as London time they would lie in the future
    rows = [("R1", f"{d:02d}.06.2012 18:00", "dmy", f"2012-06-{d:02d} 12:45:00", declared) for d in range(1, 20)] + [(None, "01.06.2012 18:00", "dmy", "2012-06-01 12:45:00", None)]
    assert zones(spark, rows, ["Europe/London", "Asia/Kolkata"], "declared") == [("R1", "Asia/Kolkata", 0, False, "Asia/Kolkata")]
    # two rows that speak against a declared zone are too few
    rows = [("R1", f"{d:02d}.06.2012 18:00", "dmy", "2012-06-%02d %s" % (d, "12:45:00" if d < 3 else "20:00:00"), "Europe/London") for d in range(1, 20)]
    assert zones(spark, rows, ["Europe/London", "Asia/Kolkata"], "declared") == [("R1", "Europe/London", 2, True, "Asia/Kolkata")]


def test_zone_east_of_the_true_one_is_not_taken(spark):
    rows = [("R1", f"{d:02d}.06.2012 18:00", "dmy", f"2012-06-{d:02d} 12:45:00", None) for d in range(1, 20)]
    assert zones(spark, rows, ["Asia/Hong_Kong", "Asia/Dhaka", "Asia/Kolkata", "Europe/London"]) == [("R1", "Asia/Kolkata", 0, False, "Asia/Kolkata")]


def test_zone_from_known_moments(spark):
    # clocks without zone run from 9 to 18; moments known in UTC do so only on the clock of the true zone, on both sides of the change of summer time
    local = [("R1", f"{d:02d}.0{m}.2012 {h:02d}:30", "dmy", "2013-01-01 00:00:00", None) for m in (1, 7) for d, h in enumerate(range(9, 19), 1)]
    known = [("R1", f"2012-0{m}-{d:02d}T{h + (5 if m == 1 else 4):02d}:30:00Z", "dmy", "2013-01-01 00:00:00", None) for m in (1, 7) for d, h in enumerate(range(9, 19), 1)]
    candidates = ["America/Chicago", "America/New_York", "Asia/Singapore", "Europe/London"]
    assert zones(spark, local + known, candidates)[0][1] == "America/New_York"
    # an explicit offset speaks for the zones that observe it then
    offsets = [("R2", "2012-07-01T12:30:00-0500", "dmy", "2013-01-01 00:00:00", None)] * 3
    assert ("R2", "America/Chicago", 0) in [z[:3] for z in zones(spark, local + offsets, candidates)]
    assert zones(spark, [], candidates) == []
