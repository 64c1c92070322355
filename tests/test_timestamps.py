from __future__ import annotations

from datetime import datetime, timezone

import pytest

from palimpsest.operators import timestamps as T


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2025-01-02T03:45:36.160Z", None, us(2025, 1, 2, 3, 45, 36) + 160_000),
        ("2025-01-02t04:33:04z", None, us(2025, 1, 2, 4, 33, 4)),
        ("20250102T152719Z", None, us(2025, 1, 2, 15, 27, 19)),
        (" 2025-01-02T03:04:05.123456789Z\n", None, us(2025, 1, 2, 3, 4, 5) + 123_456),
        ("2025-01-02 00:20:56,769+01:00", None, us(2025, 1, 1, 23, 20, 56) + 769_000),
        ("1735786898", None, 1_735_786_898_000_000),
        ("1735794544833", None, 1_735_794_544_833_000),
        ("1735777155.303915", None, 1_735_777_155_303_915),
        ("1735777155303915", None, 1_735_777_155_303_915),
        ("1735777155303915999", None, 1_735_777_155_303_915),
        ("Jan 10, 2025 12:33 AM", "America/Denver", us(2025, 1, 10, 7, 33)),
        ("2025-01-01 21:14:44 MST", "Europe/Berlin", us(2025, 1, 2, 4, 14, 44)),
        ("02.01.2025 01:27", "Asia/Kolkata", us(2025, 1, 1, 19, 57)),
        ("2025-01-02 05:43:26 Asia/Kolkata", None, us(2025, 1, 2, 0, 13, 26)),
        ("2025-03-12 02:53:22 America/Denver", None, us(2025, 3, 12, 8, 53, 22)),
        ("10 January 2025, 17:48:55 EST", None, us(2025, 1, 10, 22, 48, 55)),
        ("Thu, 02 Jan 2025 01:29:31 +0100", None, us(2025, 1, 2, 0, 29, 31)),
        ("Wed Jan 01 2025 19:39:54 GMT-0500 (Eastern Standard Time)", None, us(2025, 1, 2, 0, 39, 54)),
        ("1/12/2025 7:16:24 PM", "UTC", us(2025, 1, 12, 19, 16, 24)),
        ("2025-01-02T23:41:18+01:00[Europe/Berlin]", None, us(2025, 1, 2, 22, 41, 18)),
        ("1/12/2025 7:16:24 PM", None, us(2025, 1, 12, 19, 16, 24)),
        ("2025-11-02 01:30:00 EST", None, us(2025, 11, 2, 6, 30)),
        ("2025-03-09 02:30:00", "America/New_York", None),  # skipped
        ("2025-11-02 01:30:00", "America/New_York", None),  # twice
        ("2025-11-02 01:30:00", "America/Phoenix", us(2025, 11, 2, 8, 30)),
        ("13/01/2025 10:00:00", None, None),  # month first
        ("2025-01-02", None, None),
        ("2025-02-30 10:00:00", None, None),
        ("0000-00-00 00:00:00", None, None),
        ("25:61:00", None, None),
        ("yesterday 14:05", None, None),
        ("2025-01-02 10:00:00 XQZ", None, None),
        ("2025-01-02 10:00:00", "Nowhere/None", None),
        ("", None, None),
        (None, None, None),
        ("9" * 100_000, None, None),
        ("٢٠٢٥-٠١-٠٢ 10:00", None, None),
        ("0001-01-01 00:00:00+14:00", None, -62_135_647_200_000_000),
        ("2024-01-02 03:04:05.1234567890123", None, us(2024, 1, 2, 3, 4, 5) + 123_456),
        ("2024-01-02T03:04:05.123456789012345Z", None, us(2024, 1, 2, 3, 4, 5) + 123_456),
        ("2024-01-02T03:04:05." + "1" * 5000 + "Z", None, us(2024, 1, 2, 3, 4, 5) + 111_111),
        ("1735777155." + "3" * 400, None, 1_735_777_155_333_333),
        ("Tue Jan 02 2024 03:04:05 GMT+0100 (Mitteleurop\u00e4ische Zeit)", None, us(2024, 1, 2, 2, 4, 5)),
        ("Tue Jan 02 2024 03:04:05 GMT+0100 (" + "a zone of many words " * 20 + ")", None, us(2024, 1, 2, 2, 4, 5)),
        ("2025-01-02 \u00a0 " + " " * 500 + "10:00:00", None, us(2025, 1, 2, 10)),
        ("599999999", None, None),  # before the plausible instants in every unit
    ],
)
def test_readings(value, zone, want):
    got = [(f, u) for f, u in T.readings(value, zone) if T.US_SLASH_EU_DOT.get(f, 1)]
    assert [u for _, u in got] == ([] if want is None else [want])


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, row_key string, value string, local_tz string")


def test_mixture_decides_day_and_month(spark):
    rows = [("eu", f"a{i}", f"{i}/1/2025 10:00:00", None) for i in range(13, 29)] + [("eu", "q", "3/4/2025 10:00:00", None)]
    rows += [("us", f"b{i}", f"1/{i}/2025 10:00:00", None) for i in range(13, 29)] + [("us", "q", "3/4/2025 10:00:00", None)]
    rows += [("even", "q", "3/4/2025 10:00:00", None)]
    got = {(r.source, r.row_key): r for r in T.normalise(frame(spark, rows)).collect()}
    assert (got["eu", "q"].format, got["eu", "q"].status, got["eu", "q"].utc_us) == ("slash_dmy", "ok", us(2025, 4, 3, 10))
    assert (got["us", "q"].format, got["us", "q"].status, got["us", "q"].utc_us) == ("slash_mdy", "ok", us(2025, 3, 4, 10))
    assert got["even", "q"].status == "ambiguous" and abs(got["even", "q"].posterior - 0.5) < 1e-6


def test_a_convention_decides_through_the_posterior(spark):
    rows = [("x", f"a{i}", f"{i}/1/2025 10:00:00", None) for i in range(13, 29)] + [("x", "q", "3/4/2025 10:00:00", None), ("x", "d", "03.04.2025 10:00", None)]
    got = {r.row_key: r for r in T.normalise(frame(spark, rows), T.US_SLASH_EU_DOT).collect()}
    assert (got["q"].format, got["q"].status, got["q"].utc_us, got["q"].posterior) == ("slash_mdy", "ok", us(2025, 3, 4, 10), 1.0)
    assert (got["d"].format, got["d"].utc_us) == ("dot_dmy", us(2025, 4, 3, 10))
    assert {(got[f"a{i}"].status, got[f"a{i}"].utc_us, got[f"a{i}"].format) for i in range(13, 29)} == {("none", None, None)}


def test_priors_short_of_nothing_are_outweighed(spark):
    rows = [("x", f"a{i}", f"{i}/1/2025 10:00:00", None) for i in range(13, 29)] + [("x", "q", "3/4/2025 10:00:00", None)]
    got = {r.row_key: r for r in T.normalise(frame(spark, rows), {"slash_dmy": 0.1}).collect()}
    assert got["q"].format == "slash_dmy" and got["q"].status == "ok"


def test_no_rows_and_no_readings(spark):
    assert T.normalise(frame(spark, [])).collect() == []
    r = T.normalise(frame(spark, [("s", "1", "x", None), ("s", None, None, None)])).collect()
    assert {x.status for x in r} == {"none"} and all(x.utc_us is None for x in r)


def test_p4_on_the_tables(spark, sf):
    from palimpsest.plans import timestamp_queries as q

    got = q.p4_found(spark, sf).collect()
    assert got and len(got) == len({tuple(r) for r in got})
    n = {r["status"]: r["n"] for r in q.p4_status(spark, sf).groupBy("status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert n["ok"] > 0 and n["none"] > 0
    unsure = q.p4_ambiguous(spark, sf)
    assert unsure.count() == unsure.select("src_table", "src_field", "row_key").distinct().count() and {r.format for r in unsure.collect()} <= {f for f, _ in T._DATES}
