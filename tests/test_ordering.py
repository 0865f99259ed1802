"""Places and running sums over groups that span ranges."""

import random

from tessera.operators import sinks
from tessera.operators.ordering import numbered


def test_places_and_sums_against_a_loop(spark):
    r = random.Random(2)
    data = [(k, r.choice(["hot", "hot", "hot", "a", None]), r.randint(0, 3), r.choice([None, 1, 5])) for k in range(500)]
    rows = spark.createDataFrame(data, "id long, kind string, x int, n int")
    got = {d["id"]: (d["place"], d["size"], d["running"]) for d in numbered(rows, ["kind"], ["x", "id"], "n").collect()}
    assert len(got) == 500
    for kind in ("hot", "a", None):
        own, total = sorted((x, k, n or 0) for k, g, x, n in data if g == kind), 0
        for place, (_, k, n) in enumerate(own, 1):
            total += n
            assert got[k] == (place, len(own), total)
    assert numbered(rows.limit(0), ["kind"], ["x", "id"], "n").count() == 0


def test_exported_files_hold_the_lines_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("p", "t", f"k{n:03}", n) for n in range(200)] + [("q", "t", "z", 1)], "project_id string, type string, key string, id long")
    sinks.write_lines(sinks.export_lines(rows), str(tmp_path / "out"))
    files = sorted((tmp_path / "out/project_id=p/type=t").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == [f"- k{n:03}" for n in range(200)]
    assert [f.read_text() for f in (tmp_path / "out/project_id=q/type=t").glob("part-*")] == ["- z\n"]
