from __future__ import annotations

import datetime as dt
import warnings

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.missing import drop_blank_rows, read_missing
from tidewater.functions.temporal import hours_between, iso8601, iso_column, to_utc, utc_column
from tidewater.functions.text import currency, squeeze, squeeze_columns, title_case, title_columns


def values(spark, items, change):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r["y"] for r in rows.select("i", change(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space_is_trimmed_and_collapsed(spark):
    df = spark.createDataFrame([("  Blue   Harbor  ",), (None,)], "name string")
    assert [r[0] for r in squeeze_columns(df, ["name"]).collect()] == ["Blue Harbor", None]
    assert values(spark, ["a 　b\t"], squeeze) == ["a b"]


def test_unknown_columns_raise(spark):
    with pytest.raises(Exception):
        squeeze_columns(spark.createDataFrame([("a",)], "name string"), ["other"]).collect()


#: Texts and the amounts that they have to give.
CURRENCY = {
    "$1,200.50": 1200.5, "1200,50 €": 1200.5, "1,050.75 USD": 1050.75, "-$20.00": -20.0, "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89,
    "1,200": 1200.0, "1200,5": 12005.0, "1,200,50": None, "1.200": 1.2, "--5": -5.0, "$-20": -20.0, "-$-20": 20.0, "(20.00)": None, "1 200,50 €": None,
    "usd 5": None, "inf": float("inf"), "$nan": None, "N/A": None, "": None, "-": None, "?": None, "null": None, "1_000": 1000.0, "1d": None, "US$ 7": 7.0,
}


def test_currency(spark):
    assert values(spark, [*CURRENCY, None], currency) == [*CURRENCY.values(), None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=20, max_size=40))
def test_currency_round_trip(spark, cents):
    shown = []
    for k, c in enumerate(cents):
        english = f"{c / 100:,.2f}"
        european = english.translate(str.maketrans(",.", ".,"))
        shown.append([f"${english}", f"{european} €", f"€{english}", f"{english} USD", f"US$ {english}", f"-{european} EUR"][k % 6])
    assert values(spark, shown, currency) == [(-c if k % 6 == 5 else c) / 100 for k, c in enumerate(cents)]


def test_title_case(spark):
    df = spark.createDataFrame([("LOW",), ("high",), (None,)], "p string")
    assert [r[0] for r in title_columns(df, ["p"]).collect()] == ["Low", "High", None]
    items = ["o'neil's", "bug-report", "a1b c", "ÉCOLE", " feature REQUEST "]
    assert values(spark, items, title_case) == [x.strip().title() for x in items]


#: Texts and the moments that they have to give.
DATES = {
    "27/06/2025 09:10 EST": "2025-06-27T14:10:00+00:00", "2025-03-11T19:27:00+02:00": "2025-03-11T17:27:00+00:00", "2024-01-01 12:00:00": "2024-01-01T12:00:00+00:00",
    "07/09/2024 05:06 PM": "2024-07-09T17:06:00+00:00", "March 05, 2024 13:20 Z": "2024-03-05T13:20:00+00:00", "05-Mar-2024 13:20:11 CET": "2024-03-05T12:20:11+00:00",
    "2031-13-04": "2031-04-13T00:00:00+00:00", "2024-05-01 09:10:11.5": "2024-05-01T09:10:11.500000+00:00", "2024-05-01T09:10:11Z": "2024-05-01T09:10:11+00:00",
    "13/01/2024 10:00 PST": "2024-01-13T18:00:00+00:00", "not a date": None, "N/A": None, "": None, "-": None, "31/02/2024 10:00": None,
}


def test_dates(spark):
    assert values(spark, DATES, lambda c: iso8601(to_utc(c))) == list(DATES.values())


def test_date_columns(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00",), ("not a date",)], "created_at string")
    assert [r[0] for r in iso_column(utc_column(df, "created_at"), "created_at").collect()] == ["2024-01-01T12:00:00+00:00", None]
    assert utc_column(df, "created_at", "at").columns == ["created_at", "at"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2060, 1, 1)), min_size=10, max_size=30))
def test_dates_round_trip(spark, moments):
    forms = ["%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M %p", "%B %d, %Y %H:%M", "%d-%b-%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]
    zones = {"": 0, " UTC": 0, " EST": -5, " +02:00": 2, " PST": -8, " CET": 1}
    shown, expected = [], []
    for k, m in enumerate(moments):
        m = m.replace(second=0, microsecond=0)
        zone = list(zones)[k % 6]
        shown.append(m.strftime(forms[k % 5]) + zone)
        expected.append((m - dt.timedelta(hours=zones[zone])).strftime("%Y-%m-%dT%H:%M:%S+00:00"))
    assert values(spark, shown, lambda c: iso8601(to_utc(c))) == expected


def read_by_pandas(text: str) -> str | None:
    """The moment that pandas reads, month first, else day first; whole microseconds."""
    names = {"UTC": 0, "Z": 0, "EST": -5, "PST": -8, "CET": 1}
    name = next((n for n in names if text.endswith(" " + n) or (text.endswith(n) and text[: -len(n)][-1:].isdigit())), None)
    shown = f"{text[: -len(name)].strip()} {names[name]:+03d}:00" if name else text
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        both = [pd.to_datetime(shown, utc=True, errors="coerce", dayfirst=d) for d in (False, True)]
    return next((t.floor("us").isoformat() for t in both if not pd.isna(t)), None)


@st.composite
def grammar(draw):
    """Texts of the grammar that to_utc states."""
    y, m, d = draw(st.integers(1970, 2060)), draw(st.integers(1, 12)), draw(st.integers(1, 28))
    long, short = dt.date(2000, m, 1).strftime("%B"), dt.date(2000, m, 1).strftime("%b")
    mark, month = draw(st.sampled_from("-/.")), draw(st.sampled_from([long, short]))
    date = draw(st.sampled_from([
        f"{y}{mark}{m:02}{mark}{d:02}", f"{y}{m:02}{d:02}", f"{m}{mark}{d}{mark}{y}", f"{d:02}{mark}{m:02}{mark}{y}", f"{m:02}/{d:02}/{y % 100 if 1977 <= y <= 2060 else 24:02}",
        f"{month} {d}, {y}", f"{month} {d:02} {y}", f"{d} {month} {y}", f"{d:02}-{short}-{y}", f"{dt.date(y, m, d):%a}, {d:02} {short} {y}",
    ]))
    h, n, s = draw(st.integers(0, 23)), draw(st.integers(0, 59)), draw(st.integers(0, 59))
    fraction = draw(st.integers(1, 999_999_999))
    time = draw(st.sampled_from(["", f" {h:02}:{n:02}", f" {h}:{n:02}:{s:02}", f" {h:02}:{n:02}:{s:02}.{fraction:09}", f" {h:02}:{n:02}:{s:02}.{fraction % 1000:03}", f" {(h - 1) % 12 + 1}:{n:02} {'AP'[h > 11]}M", f" {(h - 1) % 12 + 1:02}:{n:02}:{s:02} {'ap'[h > 11]}m"]))
    zone = draw(st.sampled_from(["", " Z", " UTC", " EST", " CET", "+02:00", " -0530", "+02"])) if time else ""
    return date + time + zone


@settings(max_examples=6, deadline=None)
@given(st.lists(grammar(), min_size=40, max_size=80))
def test_dates_like_pandas(spark, texts):
    assert values(spark, texts, lambda c: iso8601(to_utc(c))) == [read_by_pandas(x) for x in texts]


def test_no_dates(spark):
    texts = ["2024-02-30", "2024-01-01 24:10", "2024-01-01 10:60", "2024-01-01 10:10:60", "13:00", "2024-01-01 13:00 PM", "3000-01-01", "1500-01-01", "5 Foo 2024", "2024-01/02", "1\x012\x013", "2024-01-01 10:00 +25:00"]
    assert values(spark, texts, lambda c: iso8601(to_utc(c))) == [None] * len(texts)


def test_hours_may_be_negative(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 10:30:00' a, timestamp'2024-01-01 09:00:00' b").select(hours_between(F.col("a"), F.col("b")).alias("h")).first()
    assert row["h"] == -1.5


def test_missing_when_read(spark):
    df = spark.createDataFrame([("NaN", 1), ("none", 2), ("-", 3), ("", 4), (" NA", 5)], "x string, n int")
    assert [r["x"] for r in read_missing(df).orderBy("n").collect()] == [None, "none", "-", None, " NA"]


def test_blank_rows_go(spark):
    df = spark.createDataFrame([(None, None), ("-", None), ("a", "b")], "x string, y string")
    assert drop_blank_rows(df).count() == 2
