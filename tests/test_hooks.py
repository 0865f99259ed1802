"""Hook payloads and line-state importers by example."""

import json
from datetime import datetime

import pytest

from tessera.functions.scrub import capped, scrub
from tessera.sources import imports
from tessera.sources.hooks import event, hook_events


@pytest.mark.parametrize(
    ("value", "want", "n"),
    [
        ({"config": {"api_key": "abcdefghijklmnopqrst"}}, {"config": {"api_key": "[REDACTED:api_key]"}}, 1),
        (["--password", "hunter22", "--verbose", "true"], ["--password", "[REDACTED:password]", "--verbose", "true"], 1),
        ({"card": 4111111111111111, "n": 7, "x": 1.5, "ok": True, "no": None}, {"card": "[REDACTED:Credit card]", "n": 7, "x": 1.5, "ok": True, "no": None}, 1),
        ([[["a.b@c.org and d@e.org"]]], [[["[REDACTED:Email address] and [REDACTED:Email address]"]]], 2),
        ({}, {}, 0), ([], [], 0), ("x", "x", 0), ({"a": []}, {"a": []}, 0),
    ],
)
def test_scrub(value, want, n):
    assert scrub(value) == (want, n)


def test_any_depth():
    deep = "password: hunter22"
    for _ in range(50_000):
        deep = [deep]
    out, n = scrub(deep)
    while isinstance(out, list):
        out = out[0]
    assert n == 1 and out == "[REDACTED:Password field]"


def test_long_leaves_are_cut():
    assert capped("x" * 501) == "x" * 500 + "…[truncated, 501 chars total]" and capped("x" * 500) == "x" * 500


def payload(name="PostToolUse", **more):
    return json.dumps({"session_id": "s", "hook_event_name": name, **more})


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, None), ("", None), ("[]", None), ("{", None), ("[" * 100_000, None), (payload("Other"), None), (json.dumps({"hook_event_name": "Stop"}), None), (json.dumps({"session_id": "", "hook_event_name": "Stop"}), None), (json.dumps({"session_id": "s", "hook_event_name": ["Stop"]}), None),
        (payload("Stop", stop_hook_active=False), ("s", "stop", None, None, None, None, "stop_hook_active=false", 0)),
        (payload("SessionEnd", reason="password: hunter22", tool_name="T"), ("s", "session_end", None, None, None, None, "[REDACTED:Password field]", 1)),
        (payload(tool_name="T", tool_input={"file_path": "a.ts"}, tool_response={"exitCode": 2, "error": "e"}), ("s", "post_tool_use", "T", 2.0, "a.ts", '{"file_path":"a.ts"}', "e", 0)),
        (payload(tool_input=[1], tool_response={"exit_code": True, "interrupted": True}), ("s", "post_tool_use", None, None, None, None, "interrupted", 0)),
        (payload(tool_response={"stderr": "", "interrupted": False}), ("s", "post_tool_use", None, None, None, None, "completed", 0)),
        (payload("PreToolUse", tool_name="T", tool_input={"a": "é"}), ("s", "pre_tool_use", "T", None, None, '{"a":"é"}', None, 0)),
    ],
)
def test_events(raw, want):
    assert event(raw) == want


def test_durations(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    calls = [("PreToolUse", "A"), ("PreToolUse", "B"), ("PostToolUse", "A"), ("PostToolUse", "A"), ("PreToolUse", "A"), ("PreToolUse", "A"), ("PostToolUse", "A"), ("PostToolUse", None)]
    rows = [(k, at(k), payload(n, tool_name=t)) for k, (n, t) in enumerate(calls)] + [(9, at(9), "junk"), (10, at(10), None)]
    got = {r.id: r.duration_us for r in hook_events(spark.createDataFrame(rows, "id long, at timestamp, payload string")).collect()}
    assert got == {0: None, 1: None, 2: 2_000_000, 3: None, 4: None, 5: None, 6: 1_000_000, 7: None}


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "path string, text string")


def test_instructions(spark):
    text = "before\n## Our Rules!\n a\n\n### Sub of it\nb\n## Plain\nc\n## Lessons\n\n## !!\nlost\n## Empty\n \n### End\nlast\n#### deeper\nstays"
    got = [(r.key, r.value, r.type) for r in imports.instructions(docs(spark, text, None, "", "no heading")).orderBy("path", "place").collect()]
    assert got == [("our-rules", "a", "convention"), ("sub-of-it", "b", "convention"), ("plain", "c", "convention"), ("end", "last\n#### deeper\nstays", "lesson")]


def test_lessons_and_architecture(spark):
    text = "## Known failure patterns\n- **Lock up**: waits for ever \nprose\n- **x**\n- ** **:  y\n## Second\n- **Not one**: here\n### third\nz"
    got = {(r.key, r.value) for r in imports.lessons(docs(spark, text)).collect()}
    assert got == {("failure-lock-up", "waits for ever"), ("lesson-known-failure-patterns", "prose\n- **x**"), ("failure-", "y"), ("lesson-second", "- **Not one**: here\n### third\nz")}
    got = {(r.key, r.type) for r in imports.architecture(docs(spark, text)).collect()}
    assert got == {("arch-known-failure-patterns", "architecture"), ("arch-second", "architecture"), ("arch-third", "architecture")}


def test_diffs(spark):
    stat = " src/a.ts | 4 ++--\n b c.ts   |  Bin\n 2 files changed\n"
    got = imports.changed_files(docs(spark, stat, "nothing", None)).collect()
    assert [(r.files, r.value) for r in got] == [(["src/a.ts", "b c.ts"], "Files changed: src/a.ts, b c.ts")]
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@ f\n a\n+b\n+diff --git no\n-c\n@@ -9 +10 @@\n-d\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-e\n"
    got = [(r.file, r.hunk, r.start, r.added, r.removed) for r in imports.hunks(docs(spark, diff, "", None)).orderBy("file", "hunk").collect()]
    assert got == [("x", 1, 1, 2, 1), ("x", 2, 10, 0, 1), ("y", 1, 0, 0, 1)]
