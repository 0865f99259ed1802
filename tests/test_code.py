"""Source trees by example."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import code

FILES = [
    ("src/a.ts", "import x from './b'\nimport y from \"../lib\"\nimport z from '@s/z'\nimport 'fs'\nexport default function f() {}\nexport { p as q, r }\nconst d = await import('./c')\nconst e = require('../../out')"),
    ("src/b.tsx", "export class B {}\nexport const c = 1\nexport async function no() {}"), ("src/b/index.ts", ""), ("src/c/index.js", "import './missing'\nimport '../a.ts'\n\nexport {  , k }"),
    ("lib/index.ts", None), ("src/node_modules/x.ts", "export const no = 1"), ("README.md", "import './a'"), ("top.py", "import os"), ("src/.ts", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_modules(files):
    got = {r.path: (r.exports, r.imports, r.n_lines) for r in code.modules(files).collect()}
    assert set(got) == {"src/a.ts", "src/b.tsx", "src/b/index.ts", "src/c/index.js", "lib/index.ts", "top.py"}
    assert got["src/a.ts"] == (["f", "q", "r"], ["./b", "../lib", "@s/z", "./c", "../../out"], 8)
    assert got["src/b.tsx"] == (["B", "c"], [], 3) and got["src/c/index.js"][0] == ["k"] and got["lib/index.ts"] == ([], [], 1)


def test_dependencies(files):
    """A folder of the very name comes before files with an extension."""
    got = {(r.path, r.to): r.n for r in code.dependencies(files).collect()}
    assert got == {("src/a.ts", "src/b"): 1, ("src/a.ts", "lib"): 1, ("src/a.ts", "src/c"): 1, ("src/c/index.js", "src/a.ts"): 1}


def test_boundaries(files):
    got = {r["name"]: (r.n_files, r.n_lines, r.n_exports) for r in code.boundaries(code.modules(files)).collect()}
    assert got == {} or all(v[0] >= 2 for v in got.values())
    more = files.withColumn("path", F.concat(F.lit("pkg/x/"), "path"))
    assert {r["name"]: r.n_files for r in code.boundaries(code.modules(more)).collect()} == {"pkg/x": 6}


def test_paths(spark):
    rows = [("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "../../c", None), ("", "./x", "x"), ("a", "../../a/x", None), ("a/b", "..", "a"), ("a", "..", "")]
    for r in spark.createDataFrame(rows, "d string, n string, want string").select("*", code.resolved(F.col("d"), F.col("n")).alias("got")).collect():
        assert r.got == r.want, r


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert code.modules(none).count() == code.dependencies(none).count() == code.boundaries(code.modules(none)).count() == 0
