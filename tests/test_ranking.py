"""Rankings by time and convention checks by example."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import quality, recall

TEMPORAL = {
    "when": True, "When?": True, "what day is it": True, "what dates": False, "last time": True, "last": False, "yesterday's": True, "sunday": True, "sundays": False, "2024-01-01": True, "12024-01-01": False, "1/2/2024": True,
    "1/2": False, "may 3": True, "May 3rd": True, "3rd may": True, "may 2024": True, "may 123": False, "may": False, "before may": True, "ago": False, "2 years ago": True, "two years ago": False, "before it": False, "": False, None: False,
}


def test_temporal(spark):
    df = spark.createDataFrame([(t,) for t in TEMPORAL], "text string")
    assert {r.text: r.d for r in df.select("text", dates.temporal(F.col("text")).alias("d")).collect()} == TEMPORAL


SCORED = "id long, semantic double, text double, confidence double, updated_on date, created_on date, referenced timestamp, relative date"
ROWS = [
    (1, 0.5, 0.5, 0.5, date(2025, 8, 20), date(2024, 1, 1), datetime(2024, 7, 9), None), (2, 0.5, 0.5, 0.5, date(2025, 8, 20), date(2025, 8, 31), None, None), (3, 0.5, 0.5, 1.0, date(2024, 1, 1), date(2024, 1, 1), None, date(2024, 7, 10)),
    (3, 0.1, 0.1, 1.0, date(2024, 1, 1), date(2024, 1, 1), None, date(2024, 7, 10)), (4, 0.5, 0.5, 0.5, date(2025, 8, 21), date(2024, 1, 1), None, None), (5, 0.0, 0.0, 0.5, date(2025, 8, 21), date(2024, 1, 1), None, None),
]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("how it works", [(4, 0.575), (1, 0.575), (2, 0.575), (3, 0.575), (5, 0.0)]),
        ("on July 9, 2024", [(1, 0.575 * 1.5), (3, 0.575 * 1.25), (4, 0.575 * (1 + 0.5 / 191)), (2, 0.575 * (1 + 0.5 / 419)), (5, 0.0)]),
        ("when", [(2, 0.5 * 1.25), (3, 0.575 * (1 + 0.5 / 419)), (1, 0.5 * (1 + 0.5 / 420)), (4, 0.5 * (1 + 0.5 / 610)), (5, 0.0)]),
    ],
)
def test_ranked(spark, query, want):
    got = [(r.id, r.score) for r in recall.ranked(spark.createDataFrame(ROWS, SCORED), query, "2025-09-01").collect()]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])
    assert recall.ranked(spark.createDataFrame([], SCORED), query).count() == 0


def test_reordered(spark):
    pool = spark.createDataFrame([(1, 0, None, None), (2, 1, None, None), (3, 2, datetime(2024, 7, 9), None), (4, 3, None, date(2024, 7, 9))], "id long, place long, referenced timestamp, relative date")
    assert [r.id for r in recall.reordered(pool, "on 2024-07-09").collect()] == [1, 2, 3, 4]
    pool = pool.where("id <> 2").withColumn("place", F.when(F.col("id") == 1, 5).otherwise(F.col("place")))
    assert [r.id for r in recall.reordered(pool, "on 2024-07-09").collect()] == [3, 4, 1]
    assert [r.id for r in recall.reordered(pool, "of it").collect()] == [3, 4, 1]


def test_gate(spark):
    leg = lambda sims: spark.createDataFrame([(k, s) for k, s in enumerate(sims)], "id long, sim double")
    assert recall.gated(leg([0.9, 0.2])).count() == 2 and recall.gated(leg([0.3, 0.2])).count() == 0
    assert recall.gated(leg([0.7] + [0.1] * 20)).count() == 21 and recall.gated(leg([0.3] * 20)).count() == 0


def test_convention_checks(spark):
    schema = "id long, project_id string, type string, key string, value string"
    old = [(1, "p", "convention", "tabs", "always indent code with tabs not spaces"), (2, "p", "convention", "k", "never commit secrets"), (3, "p", "lesson", "l", "never indent code with tabs"), (4, "q", "convention", "m", "never indent code with tabs")]
    new = [(10, "p", "x", "a", "never indent code with tabs"), (11, "p", "x", "b", "indent code with tabs not spaces"), (12, "p", "x", "tabs", "indent code with tabs not spaces"), (13, "p", "x", "c", "something else"), (1, "p", "x", "d", "never indent code with tabs"), (14, "p", "x", "e", None)]
    got = {r.id: (r.status, r.convention) for r in quality.convention_checks(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == {10: ("violation", 1), 11: ("warning", 1), 12: ("compliant", None), 13: ("compliant", None), 1: ("compliant", None), 14: ("compliant", None)}
