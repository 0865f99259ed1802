"""Records from Markdown and JSON documents. Each document is one row (path, text); splitting it stays in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longer JSON documents are refused.
MAX_JSON_BYTES = 256 * 1024
RECORD = "key string, value string, type string, tags array<string>, files array<string>"
#: What a record is when its document doesn't say.
DEFAULT_TYPE = "fact"

FIELD = r"(?mi)^\*\*{}:\*\*[ \t]*(.*)$"
ANY_FIELD = r"(?mi)^\*\*(?:type|tags|files):\*\*.*\n?"


def _field(body: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(body, FIELD.format(name), 1))


def _names(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")


def sections(documents: DataFrame, mark: str = "##") -> DataFrame:
    """path, place (from 1), title and body of every section under a heading of that level; what stands before the first has none."""
    parts = F.split(F.coalesce("text", F.lit("")), rf"(?m)^{mark}[ \t]+")
    each = documents.select("path", F.posexplode(parts).alias("place", "_s")).where("place > 0")
    lines = F.split("_s", "\n", 2)
    return each.select("path", "place", F.trim(F.get(lines, F.lit(0))).alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("body"))


def markdown(documents: DataFrame) -> DataFrame:
    """A record for each `## key` section: its type, tags and files lines are fields, the rest is its value. Sections without a value are left out."""
    s = sections(documents)
    kind = F.lower(_field(F.col("body"), "type"))
    value = F.trim(F.regexp_replace("body", ANY_FIELD, ""))
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    out = s.select(
        "path", "place", F.col("title").alias("key"), value.alias("value"),
        F.when(kind != "", kind).otherwise(DEFAULT_TYPE).alias("type"),
        _names(_field(F.col("body"), "tags")).alias("tags"), _names(_field(F.col("body"), "files")).alias("files"),
    )
    return out.where((F.col("key") != "") & (F.col("value") != ""))


def typed_markdown(documents: DataFrame) -> DataFrame:
    """A record for each `### key` below a `## type`."""
    types = sections(documents).select("path", F.col("place").alias("_type_place"), F.lower("title").alias("type"), F.concat(F.lit("\n"), F.col("body")).alias("body"))
    parts = F.split("body", r"(?m)^###[ \t]+")
    each = types.select("path", "_type_place", "type", F.posexplode(parts).alias("_place", "_s")).where("_place > 0")
    lines = F.split("_s", "\n", 2)
    value = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
    out = each.select("path", "_type_place", "_place", "type", F.trim(F.get(lines, F.lit(0))).alias("key"), value.alias("value"))
    return out.where((F.col("key") != "") & (F.col("value") != "")).drop("_type_place", "_place")


def bullets(documents: DataFrame) -> DataFrame:
    """path, title, item: the list items of every section, code fences left out."""
    s = sections(documents).withColumn("body", F.regexp_replace("body", r"(?s)```.*?(?:```|\z)", ""))
    items = F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*[-*][ \t]+(.+)$"), 1)
    return s.select("path", "title", F.explode(items).alias("item")).withColumn("item", F.trim("item"))


def json_records(documents: DataFrame) -> DataFrame:
    """The records of JSON arrays, and a row with only an error for each document that is refused or can't be read."""
    d = documents.withColumn("_long", F.octet_length(F.coalesce("text", F.lit(""))) > MAX_JSON_BYTES)
    d = d.withColumn("_r", F.when(~F.col("_long"), F.from_json("text", f"array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>")))
    error = F.when(F.col("_long"), "too long").when(F.col("_r").isNull(), "not an array of records")
    d = d.select("path", error.alias("error"), F.explode_outer("_r").alias("r"))
    out = d.select("path", "error", "r.*")
    return out.where(F.col("error").isNotNull() | (F.coalesce(F.length("key"), F.lit(0)) > 0))


# The words of a section's heading that tell the type of its records, tried in this order.
HEADING_TYPES = [("convention", "convention"), ("architecture", "architecture"), ("pattern", "pattern"), ("rule", "convention"), ("decision", "decision"), ("preference", "preference"), ("entity", "entity"), ("entities", "entity"), ("lesson", "lesson")]
MAX_KEY = 80
EDGES = r"^[\s\x{FEFF}\x{00A0}]+|[\s\x{FEFF}\x{00A0}]+$"


def _slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, MAX_KEY)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def headed(documents: DataFrame, levels: list[int]) -> DataFrame:
    """path, place (the heading's line), level, title and lines of every stretch below a heading of one of these levels, up to the next of them. A document's lines are split once."""
    lines = documents.select("path", F.split(F.coalesce("text", F.lit("")), "\n").alias("all"))
    heading = f"^(?:{'|'.join('#' * n for n in levels)}) [^\\r\\x{{2028}}\\x{{2029}}]+"
    places = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).rlike(heading))
    each = lines.withColumn("heads", places).select("path", "all", "heads", F.posexplode("heads").alias("k", "place"))
    ends = F.coalesce(F.get("heads", F.col("k") + 1), F.size("all"))
    marks = F.regexp_extract(F.get("all", F.col("place")), "^#+", 0)
    title = _trimmed(F.regexp_extract(F.get("all", F.col("place")), "^#+ ([^\\r\\x{2028}\\x{2029}]+)", 1))
    return each.select("path", "place", F.length(marks).alias("level"), title.alias("title"), F.slice("all", F.col("place") + 2, ends - F.col("place") - 1).alias("lines"))


def _records(sections: DataFrame, key: Column, kind: Column | str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    out = sections.select("path", "place", key.alias("key"), _trimmed(F.array_join("lines", "\n")).alias("value"), kind.alias("type"))
    return out.where("value <> ''")


def instructions(documents: DataFrame) -> DataFrame:
    """path, place, key, value, type: a record for each section and subsection. A section's heading sets the type from there on if it has a word of HEADING_TYPES; at first it is convention."""
    named = [F.when(F.contains(F.lower("title"), F.lit(w)), t) for w, t in HEADING_TYPES]
    told = F.when(F.col("level") == 2, F.coalesce(*named))
    before = W.partitionBy("path").orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # headings of one document
    s = headed(documents, [2, 3]).withColumn("type", F.coalesce(F.last(told, ignorenulls=True).over(before), F.lit("convention")))
    return _records(s, _slug(F.col("title")), F.col("type")).where("key <> ''")


def architecture(documents: DataFrame) -> DataFrame:
    """The same with keys `arch-...`, all of type architecture."""
    s = headed(documents, [2, 3]).where("title <> ''")
    return _records(s, F.concat(F.lit("arch-"), _slug(F.col("title"))), "architecture")


FAILURE = r"^- \*\*([^\r\x{2028}\x{2029}]+?)\*\*:\s*([^\r\x{2028}\x{2029}]+)"


def lessons(documents: DataFrame) -> DataFrame:
    """A record `lesson-...` for each section; in one of known failure patterns each `- **name**: text` line is a record `failure-...` of its own instead."""
    s = headed(documents, [2]).where("title <> ''")
    listed = F.contains(F.lower("title"), F.lit("known failure patterns"))
    failing = F.filter("lines", lambda x: listed & x.rlike(FAILURE))
    rest = s.withColumn("lines", F.filter("lines", lambda x: ~(listed & x.rlike(FAILURE))))
    each = s.select("path", "place", F.explode(failing).alias("line"))
    own = each.select("path", "place", F.concat(F.lit("failure-"), _slug(F.regexp_extract("line", FAILURE, 1))).alias("key"), _trimmed(F.regexp_extract("line", FAILURE, 2)).alias("value"), F.lit("lesson").alias("type"))
    return _records(rest, F.concat(F.lit("lesson-"), _slug(F.col("title"))), "lesson").unionByName(own.where("value <> ''"))


def changed_files(stats: DataFrame) -> DataFrame:
    """path, files, value: the files that a diff's summary lists, one before each bar; summaries without any are left out."""
    line = r"^\s*([^\r\x{2028}\x{2029}]+?)\s*\|"
    found = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(line))
    files = F.filter(F.transform(found, lambda x: F.trim(F.regexp_extract(x, line, 1))), lambda x: x != "")
    return stats.select("path", files.alias("files")).where(F.size("files") > 0).withColumn("value", F.concat(F.lit("Files changed: "), F.array_join("files", ", ")))


def hunks(diffs: DataFrame) -> DataFrame:
    """path, file, hunk (from 1 in a file), start, added, removed: the hunks of unified diffs. Within a hunk lines begin with a blank, + or -, so a line that begins otherwise ends it."""
    files = diffs.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?m)^(?=diff --git )")).alias("part")).where(F.startswith("part", F.lit("diff --git ")))
    new, old = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(.+)$", 1), F.regexp_extract("part", r"(?m)^--- (?:a/)?(.+)$", 1)
    files = files.withColumn("file", F.when(new == "/dev/null", old).otherwise(new))
    each = files.select("path", "file", F.posexplode(F.split("part", r"(?m)^(?=@@ )")).alias("hunk", "h")).where("hunk > 0")
    lines = F.slice(F.split("h", "\n"), F.lit(2), F.size(F.split("h", "\n")))
    count = lambda mark: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(mark)))).cast("long")
    return each.select("path", "file", F.col("hunk").cast("long").alias("hunk"), F.regexp_extract("h", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("long").alias("start"), count("+").alias("added"), count("-").alias("removed"))
