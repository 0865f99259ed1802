"""Records from documents."""

import json

from tessera.sources import imports

PAGE = """# Notes
before
## use-tabs
**type:** Convention
**tags:** style, , format
**files:** a.ts,b.ts

Always use tabs.
Everywhere.

## empty
**type:** fact

## plain
just text
"""


def frame(spark, *texts):
    return spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, text string")


def test_markdown(spark):
    rows = imports.markdown(frame(spark, PAGE, "", None, "no heading")).orderBy("path", "place").collect()
    assert [(r["key"], r["value"], r["type"], r["tags"], r["files"]) for r in rows] == [
        ("use-tabs", "Always use tabs.\nEverywhere.", "convention", ["style", "format"], ["a.ts", "b.ts"]),
        ("plain", "just text", "fact", [], []),
    ]


def test_typed_markdown(spark):
    text = "## Decision\n### one\nbody 1\n### two\n\nbody 2\nmore\n## Fact\n### three\n### four\nbody 4"
    rows = imports.typed_markdown(frame(spark, text, None)).collect()
    assert sorted((r["type"], r["key"], r["value"]) for r in rows) == [("decision", "one", "body 1"), ("decision", "two", "body 2\nmore"), ("fact", "four", "body 4")]


def test_bullets(spark):
    text = "## A\n- one\n  * two\n```\n- code\n```\ntext\n## B\nno items"
    assert [(r["title"], r["item"]) for r in imports.bullets(frame(spark, text)).collect()] == [("A", "one"), ("A", "two")]


def test_json(spark):
    good = json.dumps([{"key": "k", "value": "v", "type": "fact", "tags": ["t"]}, {"value": "no key"}])
    rows = imports.json_records(frame(spark, good, "{", "[" + " " * imports.MAX_JSON_BYTES + "]", None)).orderBy("path").collect()
    assert [(r["path"], r["error"], r["key"], r["tags"]) for r in rows] == [
        ("p0", None, "k", ["t"]),
        ("p1", "not an array of records", None, None),
        ("p2", "too long", None, None),
        ("p3", "not an array of records", None, None),
    ]
