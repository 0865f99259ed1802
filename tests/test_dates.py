"""Dates in texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates

ABSOLUTE = {
    "on 2024-03-05 and 2023-01-01": dt.datetime(2024, 3, 5),
    "at 2024-03-05T10:20:30": dt.datetime(2024, 3, 5, 10, 20, 30),
    "at 2024-03-05 10:20": dt.datetime(2024, 3, 5, 10, 20),
    "2024-02-31": dt.datetime(2024, 3, 2),
    "2024-13-01 or May 3rd, 2022": dt.datetime(2022, 5, 3),
    "1/2/2020 or june 9 2021": dt.datetime(2021, 6, 9),
    "12/31/2020": dt.datetime(2020, 12, 31),
    "31/12/2020": None,
    "2024-03-05  10:20": dt.datetime(2024, 3, 5),
    "2024-03-05 10:20:305": dt.datetime(2024, 3, 5, 10, 20),
    "2024-03-05T10:20:30Z": dt.datetime(2024, 3, 5, 10, 20),
    "2024-03-05T10:20Z": None,
    "x2024-03-05, 2024-03-056 and 2023-01-02": dt.datetime(2023, 1, 2),
    "(2024-03-05)": dt.datetime(2024, 3, 5),
    "MARCH\u00a021ST,\n2019": dt.datetime(2019, 3, 21),
    "march 5 , 2019": None,
    "march 5,2019": None,
    "marching 5, 2019": None,
    "00/05/2019": None,
    "1/2/20201": None,
    "nothing": None,
    "": None,
    None: None,
}
ANCHOR = dt.date(2026, 3, 31)  # a Tuesday
RELATIVE = {
    "Yesterday": dt.date(2026, 3, 30),
    "tomorrow": dt.date(2026, 4, 1),
    "3 days ago": dt.date(2026, 3, 28),
    "2 weeks ago": dt.date(2026, 3, 17),
    "1 month ago": dt.date(2026, 2, 28),
    "last tuesday": dt.date(2026, 3, 24),
    "next tuesday": dt.date(2026, 4, 7),
    "last monday": dt.date(2026, 3, 30),
    "next sunday": dt.date(2026, 4, 5),
    "last  friday, not yesterdays": dt.date(2026, 3, 27),
    "12 Months\nago": dt.date(2025, 3, 31),
    "13 months ago": dt.date(2025, 2, 28),
    "1234567 days ago or last monday": None,
    "99999999999999999999 days ago": None,
    "x3 days ago, last monday": dt.date(2026, 3, 30),
    "3 days agos": None,
    "last year": None,
    None: None,
}


@pytest.mark.parametrize(("kind", "cases"), [("absolute", ABSOLUTE), ("relative", RELATIVE)])
def test_dates(spark, kind, cases):
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    date = dates.absolute(F.col("text")) if kind == "absolute" else dates.relative(F.col("text"), F.lit(ANCHOR))
    assert {r["text"]: r["d"] for r in df.select("text", date.alias("d")).collect()} == cases


def test_key_comes_first(spark):
    df = spark.createDataFrame([("since 2020-01-01", "2021-01-01, yesterday")], "key string, value string")
    row = df.select(*dates.of_record(F.col("key"), F.col("value"), F.lit(ANCHOR))).first()
    assert tuple(row) == (dt.datetime(2020, 1, 1), dt.date(2026, 3, 30))
