"""Guides against records, and archives, by example."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import guides
from tessera.operators.storage import shared_dir
from tessera.sources.archive import Archive


def test_sections_of(spark):
    rows = [("fix-git-flow", "v", "decision", None, ["Git workflow"]), ("unit test", "v", "convention", ["x"], ["Testing", "Code style"]), ("k", "run the spec", "execution", None, ["Testing"]), ("k", "run", "pattern", None, ["Commands"]), ("commit", "run", "pattern", None, ["Git workflow"])]
    rows += [("k", "v", "lesson", ["GIT"], ["Boundaries"]), ("k", "v", "lesson", ["code STYLE"], ["Code style"]), ("k", "v", "entity", None, ["Project structure"]), ("k", "v", "entity", ["Testing"], ["Testing"]), ("gitter", "v", "architecture", [], ["Project structure"])]
    df = spark.createDataFrame(rows, "key string, value string, type string, tags array<string>, want array<string>")
    for r in df.select("*", guides.sections_of(*(F.col(c) for c in ("key", "value", "type", "tags"))).alias("got")).collect():
        assert r.got == r.want, r


def test_drift(spark):
    text = "# Guide\n## code style rules\n- Use **tabs** for indenting.\nNever commit `generated` files. End\n## Boundaries\n## Code style\nignored"
    rows = [(1, "p", "k", "use tabs for indenting", "convention"), (2, "p", "k", "commit generated files with care", "convention"), (3, "p", "k", "never commit generated files", "convention"), (4, "p", "k", "something else entirely here", "convention"), (5, "p", "k", "x", "execution"), (6, "q", "k", "x", "execution"), (7, "p", "k", "", "lesson"), (8, "p", "k", "a bc", "lesson")]
    records = spark.createDataFrame(rows, "id long, project_id string, key string, value string, type string").withColumn("tags", F.lit(None).cast("array<string>"))
    found = guides.drift(records, spark.createDataFrame([("p", text), ("empty", None)], "project_id string, text string"))
    got = {r.id: (r.section, r.kind, r.fragment) for r in found.collect()}
    assert got == {2: ("Code style", "contradicting", " never commit generated files"), 4: ("Code style", "stale", None), 5: ("Commands", "missing", None), 8: ("Boundaries", "stale", None)}


def test_archive(spark):
    a = Archive(spark, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}", 10)
    assert a.newest().count() == 0 and a.purge("2030-01-01").count() == 0
    rows = lambda *xs: spark.createDataFrame([("p", k, v) for k, v in xs], "project_id string, key string, value string")
    a.add(rows(("a", "1"), ("b", "1")), "old", "2024-01-01")
    a.add(rows(("a", "2"), ("c", "2")), "unused", "2024-01-05")
    newest = lambda: {r.key: (r.record, r.reason, str(r.expires_on)) for r in a.newest().collect()}
    assert newest() == {"a": ('{"project_id":"p","key":"a","value":"2"}', "unused", "2024-01-15"), "b": ('{"project_id":"p","key":"b","value":"1"}', "old", "2024-01-11"), "c": ('{"project_id":"p","key":"c","value":"2"}', "unused", "2024-01-15")}
    assert [r.record for r in a.restore(rows(("a", "x"), ("none", "x")), "2024-01-06").collect()] == ['{"project_id":"p","key":"a","value":"2"}']
    assert set(newest()) == {"b", "c"}
    assert [tuple(r) for r in a.purge("2024-01-12").collect()] == [("p", 1)] and set(newest()) == {"c"}
    a.add(rows(("a", "3")), "again", "2024-01-07")
    assert newest()["a"][1] == "again" and set(newest()) == {"a", "c"}
