"""Events from the JSON payloads of tool hooks, redacted before anything else sees them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scrub import capped, redact, scrub

# The kinds of payload and what they become.
KINDS = {"PreToolUse": "pre_tool_use", "PostToolUse": "post_tool_use", "SessionEnd": "session_end", "Stop": "stop"}
EVENT = "session_id string, event_type string, tool_name string, exit_code double, file_path string, args string, result_summary string, redacted long"


def _text(x) -> str | None:
    return x if isinstance(x, str) and x else None


def _object(x) -> dict | None:
    return x if isinstance(x, dict) else None


def _outcome(response: dict) -> tuple[float | None, str | None]:
    """Exit code and summary that a tool's response tells."""
    code = next((response[k] for k in ("exit_code", "exitCode") if response.get(k) is not None), None)
    code = float(code) if isinstance(code, (int, float)) and not isinstance(code, bool) else None
    if _text(response.get("stderr")):
        return code, response["stderr"]
    if isinstance(response.get("error"), str):
        return code, response["error"]
    interrupted = response.get("interrupted")
    return code, ("interrupted" if interrupted else "completed") if isinstance(interrupted, bool) else None


def event(payload: str | None) -> tuple | None:
    """The fields of EVENT, or None for what isn't a known payload."""
    try:
        raw = _object(json.loads(payload or ""))
    except (ValueError, RecursionError):
        return None
    if not raw or not _text(raw.get("session_id")) or _text(raw.get("hook_event_name")) not in KINDS:
        return None
    kind, of_tool = raw["hook_event_name"], raw["hook_event_name"].endswith("ToolUse")
    args = _object(raw.get("tool_input")) if of_tool else None
    path = args.get("file_path") if args and isinstance(args.get("file_path"), str) else None
    code, summary = None, None
    if kind == "PostToolUse":
        code, summary = _outcome(_object(raw.get("tool_response")) or {})
    elif kind == "SessionEnd":
        summary = _text(raw.get("reason"))
    elif kind == "Stop" and isinstance(raw.get("stop_hook_active"), bool):
        summary = f"stop_hook_active={str(raw['stop_hook_active']).lower()}"
    clean, n = scrub(args) if args is not None else (None, 0)
    path, n_path = redact(path) if path else (None, 0)
    summary, n_summary = redact(summary) if summary else (None, 0)
    return (
        raw["session_id"], KINDS[kind], _text(raw.get("tool_name")) if of_tool else None, code, path,
        json.dumps(clean, ensure_ascii=False, separators=(",", ":")) if clean is not None else None, capped(summary) if summary else None, n + n_path + n_summary,
    )


def hook_events(payloads: DataFrame) -> DataFrame:
    """id, at and EVENT of every known payload of (id, at, payload), with duration_us: of a finished tool call, the time since the call of that tool in its session just before it, if that was its start."""
    fields = [x.strip().split(" ")[0] for x in EVENT.split(",")]
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    schema = [(f, kinds[x.strip().split(" ")[1]]) for f, x in zip(fields, EVENT.split(","), strict=True)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [event(p) for p in batch.column(2).to_pylist()]
            known = pa.array([r is not None for r in rows])
            rows = [r for r in rows if r]
            if rows:
                cols = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), batch.column(1).filter(known), *cols], names=["id", "at", *fields])

    found = payloads.select(F.col("id").cast("long").alias("id"), F.unix_micros("at").alias("at"), "payload").mapInArrow(part, f"id long, at long, {EVENT}")
    of_tool = F.col("event_type").isin("pre_tool_use", "post_tool_use") & F.col("tool_name").isNotNull()
    by_tool = W.partitionBy("session_id", "tool_name", of_tool).orderBy("at", "id")
    ended = (F.col("event_type") == "post_tool_use") & of_tool & (F.lag("event_type").over(by_tool) == "pre_tool_use")
    return found.withColumn("duration_us", F.when(ended, F.col("at") - F.lag("at").over(by_tool))).withColumn("at", F.timestamp_micros("at"))
