"""Value rules on hand-written cells."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from floorledger.functions.amounts import amount_parts, parse_amount, sum_amount
from floorledger.functions.dates import month_key, operating_day, parse_day_first
from floorledger.functions.text import month_label, payment_class, timestamp_text


def apply(spark, values, expression, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


D = dt.datetime
DATES = {
    "13/01/2024 10:05": D(2024, 1, 13, 10, 5),
    "02/01/2024": D(2024, 1, 2),
    "02-01-2024": D(2024, 1, 2),
    "02.01.2024 3:04": D(2024, 1, 2, 3, 4),
    "02/01/24": D(2024, 1, 2),
    "02/01/99": D(1999, 1, 2),
    "1/2/3": D(2003, 2, 1),
    "01/13/2024": D(2024, 1, 13),
    "2024-01-02": D(2024, 1, 2),
    "2024/01/02": D(2024, 1, 2),
    "2024-13-01": D(2024, 1, 13),
    "2024-1-2": D(2024, 1, 2),
    "2024-01-02T10:05:06": D(2024, 1, 2, 10, 5, 6),
    "2024-01-02 10:05:06.123456": D(2024, 1, 2, 10, 5, 6, 123456),
    "2024-01-02 10": D(2024, 1, 2, 10),
    "20240102": D(2024, 1, 2),
    "20240102 1005": D(2024, 1, 2, 10, 5),
    "2 Jan 2024": D(2024, 1, 2),
    "2 January 2024 10:05": D(2024, 1, 2, 10, 5),
    "2-Jan-2024": D(2024, 1, 2),
    "Jan 2, 2024": D(2024, 1, 2),
    "2 ene 2024": None,
    "02-01-2024 10:05:06 PM": D(2024, 1, 2, 22, 5, 6),
    "02/01/2024 10:05 p. m.": D(2024, 1, 2, 22, 5),
    "02/01/2024 12:05 am": D(2024, 1, 2, 0, 5),
    "02/01/2024 13:05 pm": None,
    "2024-01-02 10:05 PM": D(2024, 2, 1, 22, 5),
    "02/01/2024, 10:05": D(2024, 1, 2, 10, 5),
    " 02/01/2024 ": D(2024, 1, 2),
    "02 01 2024": D(2024, 1, 2),
    "2024-01": D(2024, 1, 1),
    "01/2024": D(2024, 1, 1),
    "2024": D(2024, 1, 1),
    "31/02/2024": None,
    "13/13/2024": None,
    "2024-01-02 24:00:00": None,
    "1500-01-01": None,
    "2300-01-01": None,
    "02/01/024": None,
    "45000": None,
    "10": None,
    "x": None,
    "": None,
    "N/A": None,
    None: None,
}


def test_dates_match_hand_written_values(spark):
    assert dict(zip(DATES, apply(spark, DATES, parse_day_first))) == DATES


def test_dates_match_public_day_first_parser(spark):
    """Every day of a year in many spellings, against pandas' day-first mixed parser."""
    days = pd.date_range("2023-12-25", "2025-01-05", freq="37h7min11s")
    formats = [
        "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M", "%d.%m.%Y", "%m/%d/%Y %H:%M:%S",
        "%Y/%m/%d %H:%M", "%d/%m/%y %H:%M", "%d %b %Y %H:%M", "%d %B %Y", "%b %d, %Y", "%Y%m%d", "%d/%m/%Y %I:%M:%S %p",
        "%d-%m-%Y %I:%M %p", "%Y-%m-%dT%H:%M:%S", "%d-%b-%Y", "%d/%m/%Y, %H:%M",
    ]
    texts = [day.strftime(f) for f in formats for day in days]
    expected = pd.to_datetime(pd.Series(texts, dtype=object), errors="coerce", dayfirst=True, format="mixed")
    got = apply(spark, texts, parse_day_first)
    wrong = [(t, g, e) for t, g, e in zip(texts, got, expected) if g != (None if pd.isna(e) else e.to_pydatetime())]
    assert wrong == []


AMOUNTS = {
    "12": 12.0, " 12 ": 12.0, "\t12\n": 12.0, "1e3": 1000.0, "1E+3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0,
    "1,000": 0.0, "$5": 0.0, "nan": 0.0, "1d": 0.0, "1f": 0.0, "0x10": 0.0, "1_000": 0.0, "1 2": 0.0, "": 0.0,
    "12\xa0": 0.0, "1e400": 0.0, "inf": float("inf"), "-inf": float("-inf"), "Infinity": float("inf"), None: 0.0,
}


def test_amounts(spark):
    assert dict(zip(AMOUNTS, apply(spark, AMOUNTS, parse_amount))) == AMOUNTS


@pytest.mark.parametrize(
    "values, total",
    [
        ([0.1] * 10, 1.0),
        ([10.07, -10.07, 1e12 + 0.01], 1e12 + 0.01),
        ([0.005, 0.005], 0.01),
        ([1e20, 1.0], 1e20),
        ([float("inf"), 1.0], float("inf")),
        ([-0.01, -0.99], -1.0),
        ([], 0.0),
    ],
)
def test_sum_is_exact_for_cents_and_whole_for_the_rest(spark, values, total):
    rows = spark.createDataFrame([(v,) for v in values], "m double")
    assert rows.select(*amount_parts(F.col("m"))).agg(sum_amount().alias("t")).first()["t"] == total


def test_month_labels(spark):
    given = ["2024-01", "2024-12", "2024-13", "2024-0", "abc", "2024-x", "2024-01-02", "", None]
    want = ["Enero 2024", "Diciembre 2024", "13 2024", "0 2024", "abc", "2024-x", "2024-01-02", "", None]
    assert apply(spark, given, month_label) == want


def test_payment_classes(spark):
    given = ["Jackpot HP", " progresive jackpot hp ", "\xa0PROGRESSIVE JACKPOT HP\t", "MDC Purse Clear", "cancel credit",
             "Chip Cash HandPay", "other", "", None]
    want = ["Premios"] * 3 + ["MDC purse clear", "Cancel Credit", "Chip Cash HandPay", None, None, None]
    assert apply(spark, given, payment_class) == want


def test_operating_day_borders(spark):
    given = [D(2024, 2, 1, 9, 59, 59), D(2024, 2, 1, 10), D(2024, 2, 1, 1), D(2024, 3, 1, 8, 59, 59)]
    day = apply(spark, given, operating_day, "timestamp_ntz")
    assert day == [dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    months = apply(spark, given, lambda t: month_key(operating_day(t)), "timestamp_ntz")
    assert months == ["2024-01", "2024-02", "2024-01", "2024-02"]


def test_moments_do_not_depend_on_the_session_zone(spark):
    texts = ["2024-03-10 02:30:00", "10/03/2024 02:30", "2024-03-10 12:30:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        shown = apply(spark, texts, lambda t: timestamp_text(parse_day_first(t)))
        days = apply(spark, texts, lambda t: month_key(operating_day(parse_day_first(t))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert shown == ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "2024-03-10 12:30:00"]
    assert days == ["2024-03"] * 3


def test_timestamp_text(spark):
    given = [D(2024, 1, 2, 3, 4, 5), D(2024, 1, 2, 3, 4, 5, 120000), None]
    want = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.120000", "NaT"]
    assert apply(spark, given, timestamp_text, "timestamp_ntz") == want
