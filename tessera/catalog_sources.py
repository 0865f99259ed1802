"""Queries on hook payloads, importers, limits of requests and deltas, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalog import AGE, C, COS, M, VECTOR, VECTOR_SQL, query, r6
from tessera.catalog_quality import OPPOSED_SQL, opposed
from tessera.functions import classify, dates
from tessera.operators import guides as guides_
from tessera.operators import conflicts, quality, recall, sync
from tessera.operators.storage import shared_dir
from tessera.sources import archive, code, hooks, imports
from tessera.sources.records import calls, memories, vectors
from tessera.streaming import limits

# --- hook payloads, made of calls: four kinds and an unknown one, with nested secrets -------------------------------------

KIND = "CASE event_id % 6 WHEN 0 THEN 'PreToolUse' WHEN 1 THEN 'PreToolUse' WHEN 2 THEN 'PostToolUse' WHEN 3 THEN 'PostToolUse' WHEN 4 THEN 'SessionEnd' ELSE 'Other' END"
ID, USER = "CAST(event_id AS VARCHAR(20))", "CAST(user_id AS VARCHAR(20))"
#: Leaves of a tool's input, as they come and as they stay.
CARD, CARD_CLEAN = (f"CASE WHEN event_id % 3 = 0 THEN '{x}' ELSE {ID} END" for x in ("4111111111111111", '"[REDACTED:Credit card]"'))
NOTE, NOTE_CLEAN = (f"CASE WHEN event_id % 5 = 0 THEN 'mail {x} now' WHEN event_id % 7 = 0 THEN '{long}' ELSE 'plain' END" for x, long in (("a.b@c.org", "x" * 600), ("[REDACTED:Email address]", "x" * 500 + "…[truncated, 600 chars total]")))
ARGS = "'{{\"file_path\":\"src/' || {id} || '.ts\",\"config\":{{\"deep\":[{{\"api_key\":\"' || {key} || '\"}},{{\"n\":' || {card} || '}}],\"argv\":[\"--password\",\"' || {word} || '\",\"--verbose\",\"true\"]}},\"note\":\"' || {note} || '\"}}'"
RAW_ARGS = ARGS.format(id=ID, key="CASE WHEN event_id % 4 < 2 THEN 'abcdefghijklmnopqrst' ELSE 'short' END", card=CARD, word=f"'hunter' || {ID}", note=NOTE)
CLEAN_ARGS = ARGS.format(id=ID, key="CASE WHEN event_id % 4 < 2 THEN '[REDACTED:api_key]' ELSE 'short' END", card=CARD_CLEAN, word="'[REDACTED:password]'", note=NOTE_CLEAN)
PAYLOAD = f"""'{{"session_id":"s' || {USER} || '","hook_event_name":"' || {KIND} || '","tool_name":"T' || CAST(event_id % 2 AS VARCHAR(1)) || '","reason":"done","tool_input":' || {RAW_ARGS} || ',"tool_response":{{"exit_code":' || CAST(event_id % 3 AS VARCHAR(1)) || ',"stderr":"Bearer abcdefghijklmnopqrstu"}}}}'"""


@query(f"""{C}, k AS (SELECT *, {KIND} AS kind FROM calls),
e AS (SELECT event_id, ts, 's' || user_id AS session_id, CASE kind WHEN 'PreToolUse' THEN 'pre_tool_use' WHEN 'PostToolUse' THEN 'post_tool_use' ELSE 'session_end' END AS event_type, CASE WHEN kind <> 'SessionEnd' THEN 'T' || event_id % 2 END AS tool_name,
  CASE WHEN kind = 'PostToolUse' THEN (event_id % 3)::DOUBLE END AS exit_code, CASE WHEN kind <> 'SessionEnd' THEN 'src/' || event_id || '.ts' END AS file_path, CASE WHEN kind <> 'SessionEnd' THEN md5({CLEAN_ARGS}) END AS args,
  CASE kind WHEN 'PostToolUse' THEN '[REDACTED:Bearer token]' WHEN 'SessionEnd' THEN 'done' END AS result_summary,
  CASE WHEN kind <> 'SessionEnd' THEN 1 + (event_id % 4 < 2)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT ELSE 0 END + (kind = 'PostToolUse')::INT AS redacted FROM k WHERE kind <> 'Other')
SELECT event_id AS id, session_id, event_type, tool_name, exit_code, file_path, args, result_summary, redacted::BIGINT AS redacted,
  CASE WHEN event_type = 'post_tool_use' AND lag(event_type) OVER w = 'pre_tool_use' THEN epoch_us(ts) - epoch_us(lag(ts) OVER w) END AS duration_us FROM e WINDOW w AS (PARTITION BY session_id, tool_name ORDER BY ts, event_id)""")
def hook_events(spark, sf_dir):
    raw = calls(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.expr(PAYLOAD).alias("payload"))
    return hooks.hook_events(raw).drop("at").withColumn("args", F.md5("args"))


# --- importers: a document of headings, lists and prose around each record's value ----------------------------------------

GUIDE = "'preamble' || chr(10) || '## Our Rules of ' || agent || chr(10) || value || chr(10) || '### Sub ' || id || chr(10) || 'sub text' || chr(10) || '## Known Failure Patterns' || chr(10) || '- **Lock ' || id || '**: waits ' || type || chr(10) || 'prose' || chr(10) || '## Lessons' || chr(10) || '   ' || chr(10) || '## Entities ' || agent || chr(10) || ' last '"
TRIMMED = "regexp_replace(value, '^[\\s\\x{feff}\\x{00a0}]+|[\\s\\x{feff}\\x{00a0}]+$', '', 'g')"


def guides(spark, sf_dir) -> DataFrame:
    return memories(spark, sf_dir).select(F.col("id").cast("string").alias("path"), F.expr(GUIDE).alias("text"))


@query(f"""{M} SELECT id::VARCHAR AS path, 'our-rules-of-' || agent AS key, md5({TRIMMED}) AS hash, 'convention' AS type FROM memories WHERE {TRIMMED} <> ''
UNION ALL SELECT id::VARCHAR, 'sub-' || id, md5('sub text'), 'convention' FROM memories
UNION ALL SELECT id::VARCHAR, 'known-failure-patterns', md5('- **Lock ' || id || '**: waits ' || type || chr(10) || 'prose'), 'pattern' FROM memories
UNION ALL SELECT id::VARCHAR, 'entities-' || agent, md5('last'), 'entity' FROM memories""")
def imported_instructions(spark, sf_dir):
    return imports.instructions(guides(spark, sf_dir)).select("path", "key", F.md5("value").alias("hash"), "type")


@query(f"""{M} SELECT id::VARCHAR AS path, 'lesson-our-rules-of-' || agent AS key, md5(regexp_replace({TRIMMED.replace("value", "value || chr(10) || '### Sub ' || id || chr(10) || 'sub text'", 1)}, '', '')) AS hash FROM memories
UNION ALL SELECT id::VARCHAR, 'failure-lock-' || id, md5('waits ' || type) FROM memories
UNION ALL SELECT id::VARCHAR, 'lesson-known-failure-patterns', md5('prose') FROM memories
UNION ALL SELECT id::VARCHAR, 'lesson-entities-' || agent, md5('last') FROM memories""")
def imported_lessons(spark, sf_dir):
    return imports.lessons(guides(spark, sf_dir)).select("path", "key", F.md5("value").alias("hash"))


@query(f"""{M} SELECT id::VARCHAR AS path, 'arch-our-rules-of-' || agent AS key, md5({TRIMMED}) AS hash FROM memories WHERE {TRIMMED} <> ''
UNION ALL SELECT id::VARCHAR, 'arch-sub-' || id, md5('sub text') FROM memories
UNION ALL SELECT id::VARCHAR, 'arch-known-failure-patterns', md5('- **Lock ' || id || '**: waits ' || type || chr(10) || 'prose') FROM memories
UNION ALL SELECT id::VARCHAR, 'arch-entities-' || agent, md5('last') FROM memories""")
def imported_architecture(spark, sf_dir):
    return imports.architecture(guides(spark, sf_dir)).select("path", "key", F.md5("value").alias("hash"))


#: A diff of two files, the first of two hunks; the first adds the record's lines.
DIFF = "'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,2 +' || id || ',9 @@ f' || chr(10) || ' kept' || chr(10) || '-gone' || chr(10) || '+' || {value} || chr(10) || '@@ -7 +8 @@' || chr(10) || '-a' || chr(10) || '-b' || chr(10) || 'diff --git a/old.ts b/old.ts' || chr(10) || '--- a/old.ts' || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1 +0,0 @@' || chr(10) || '-z'"


@query(f"""{M} SELECT id::VARCHAR AS path, path AS file, 1::BIGINT AS hunk, id::BIGINT AS start, (1 + length(value) - length(replace(value, chr(10), '')))::BIGINT AS added, 1::BIGINT AS removed FROM memories
UNION ALL SELECT id::VARCHAR, path, 2, 8, 0, 2 FROM memories UNION ALL SELECT id::VARCHAR, 'old.ts', 1, 0, 0, 1 FROM memories""")
def diff_hunks(spark, sf_dir):
    d = memories(spark, sf_dir).select(F.col("id").cast("string").alias("doc"), F.expr(DIFF.format(value="replace(value, chr(10), concat(chr(10), '+'))")).alias("text"))
    return imports.hunks(d.withColumnRenamed("doc", "path"))


@query(f"""{M} SELECT id::VARCHAR AS path, 'Files changed: ' || path || ', b ' || type || '.ts' AS value FROM memories""")
def changed_files(spark, sf_dir):
    stat = F.expr("' ' || path || ' | 4 ++--' || chr(10) || '   b ' || type || '.ts   |  Bin' || chr(10) || ' 2 files changed' || chr(10)")
    return imports.changed_files(memories(spark, sf_dir).select(F.col("id").cast("string").alias("doc"), stat.alias("text")).withColumnRenamed("doc", "path")).select("path", "value")

# --- limits, misses, deltas -----------------------------------------------------------------------------------------------

WEEK_MS = 7 * 86_400_000


# The twin decides the n-th request of every user at once, for n from 1 on.
@query(f"""{C.replace("WITH ", "WITH RECURSIVE ", 1)}, q AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, 1 + event_id % 40 AS texts, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM calls),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(ms BIGINT, texts BIGINT)[] AS granted, NULL::BIGINT AS event_id, false AS allowed, 0::BIGINT AS retry FROM q
  UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(live, {{'ms': ms, 'texts': texts}}) ELSE live END, event_id, ok, CASE WHEN ok THEN 0 WHEN len(live) = 0 THEN 1 ELSE greatest(1, ceil((live[1].ms + {WEEK_MS} - ms) / 1000.0))::BIGINT END
  FROM (SELECT *, len(live) < 3 AND coalesce(list_sum(list_transform(live, lambda g: g.texts)), 0) + texts <= 60 AS ok FROM (SELECT r.user_id, q.n, q.event_id, q.ms, q.texts, list_filter(granted, lambda g: g.ms > q.ms - {WEEK_MS}) AS live FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1)))
SELECT user_id::VARCHAR AS identity, event_id AS id, allowed, retry AS retry_after FROM r WHERE n > 0""")
def rate_decisions(spark, sf_dir):
    asked = calls(spark, sf_dir).select(F.col("user_id").alias("identity"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("event_id") % 40).alias("texts"))
    return limits.decisions(asked, WEEK_MS, 3, 60)


@query(f"""{C}, l AS (SELECT agent AS project_id, ts AS moment, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'miss' ELSE 'hit' END AS kind, tool AS query FROM calls),
m AS (SELECT project_id, max(moment) FILTER (WHERE kind = 'clear') AS cleared FROM l GROUP BY project_id)
SELECT project_id, query, count(*) AS n, max(epoch_us(moment)) AS last FROM l JOIN m USING (project_id) WHERE kind = 'miss' AND (cleared IS NULL OR moment > cleared) GROUP BY project_id, query""")
def open_misses(spark, sf_dir):
    log = calls(spark, sf_dir).select(F.col("agent").alias("project_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.expr("CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'miss' ELSE 'hit' END").alias("kind"), F.col("tool").alias("query"))
    return limits.open_misses(log)


MARK = "2025-01-20"


# The local copy lacks a record in 50 that changed since, has one in 17 with an edit of its own, and one that the remote has lost.
@query(f"""{M}, l AS (SELECT id, id % 17 = 0 AS dirty, CASE WHEN id % 17 = 0 THEN 'mine' ELSE 'old' END AS value FROM memories WHERE NOT (updated_on > DATE '{MARK}' AND id % 50 = 0) UNION ALL SELECT -1, false, 'lost'),
t AS (SELECT id FROM memories WHERE updated_on > DATE '{MARK}'), h AS (SELECT count(*) AS held FROM t JOIN l USING (id) WHERE dirty)
SELECT id, value, 'delta' AS mode, CASE WHEN held > 0 THEN '{MARK}' ELSE 'now' END AS mark, held FROM (SELECT id, 'remote' AS value FROM t WHERE id NOT IN (SELECT id FROM l WHERE dirty) UNION ALL SELECT id, value FROM l WHERE dirty OR id NOT IN (SELECT id FROM t)), h""")
def delta_pull(spark, sf_dir):
    remote = memories(spark, sf_dir).select("id", "updated_on", F.lit("remote").alias("value"))
    local = remote.where(f"NOT (updated_on > DATE '{MARK}' AND id % 50 = 0)").unionByName(remote.limit(1).select(F.lit(-1).cast("long").alias("id"), "updated_on", "value"))
    local = local.select("id", "updated_on", F.expr("CASE WHEN id = -1 THEN 'lost' WHEN id % 17 = 0 THEN 'mine' ELSE 'old' END").alias("value"), F.expr("id % 17 = 0").alias("dirty"))
    p = sync.pull(remote, local, MARK, "now")
    return p.rows.select("id", "value", F.lit(p.mode).alias("mode"), F.lit(p.mark).alias("mark"), F.lit(p.held.count()).alias("held"))


@query(f"{C} SELECT event_id AS id, tool FROM calls WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def unsynced_events(spark, sf_dir):
    return sync.unsynced(calls(spark, sf_dir).select(F.col("event_id").alias("id"), "tool"), 100)

# --- queries that ask for a time, and conventions -------------------------------------------------------------------------

#: What is asked, and whether it asks for a time.
ASKED = [("when did it fail", True), ("what may cause this", False), ("what broke before March", True), ("before the refactor", False), ("on march 3", True), ("notes of 2024-03-01", True), ("3 years ago", True), ("last  friday", True), ("how long  ago", True), ("whenever it fails", False), ("the 3rd May", True), ("3/4/24", True), ("august", False), ("what dates", False)]


# Of what asks for a time, values hold only `when` and dates.
@query(f"{M} SELECT id, ({[b for _, b in ASKED]})[id % {len(ASKED)} + 1] OR regexp_matches(lower(value), '\\bwhen\\b|\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b|\\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\\b') AS temporal FROM memories")
def temporal_queries(spark, sf_dir):
    asked = F.get(F.array(*[F.lit(t) for t, _ in ASKED]), (F.col("id") % len(ASKED)).cast("int"))
    return memories(spark, sf_dir).select("id", dates.temporal(F.concat_ws(" # ", "type", asked, "value")).alias("temporal"))


DATED = {"referenced": "CASE WHEN id % 4 = 0 THEN DATE '2024-03-01' + CAST(id % 300 AS INT) END", "relative": "CASE WHEN id % 4 < 2 THEN DATE '2024-05-01' + CAST(id % 200 AS INT) END", "text": "CAST(id * 17 % 10 AS DOUBLE) / 10"}
SCORED_SQL = f"""{M}, s AS (SELECT m.id, confidence, updated_on, created_on, {", ".join(f"{sql.replace('id', 'm.id')} AS {c}" for c, sql in DATED.items())}, greatest(0.0::DOUBLE, {COS}) AS semantic
FROM memories m JOIN (SELECT vec_id, embedding::DOUBLE[] AS e, {VECTOR_SQL} AS q FROM embeddings) ON vec_id = m.id WHERE status = 'live'),
b AS (SELECT *, (0.6::DOUBLE * semantic + 0.4::DOUBLE * text) * (1 + (confidence - 0.5::DOUBLE) * 0.3::DOUBLE) AS base, CASE WHEN {AGE} < 30 THEN 1.15::DOUBLE ELSE 1 END AS fresh FROM s)"""
RANKED = "SELECT id, round({}, 6) AS score FROM b ORDER BY round({}, 10) DESC, updated_on DESC, id LIMIT 40"
NEAR_TO = "1 / (1 + abs(date_diff('day', {}, DATE '{}'))::DOUBLE)"


def scored(spark, sf_dir) -> DataFrame:
    m = memories(spark, sf_dir).where("status = 'live'").select("id", "confidence", "updated_on", "created_on", *[F.expr(sql).alias(c) for c, sql in DATED.items()])
    near = recall.vector_leg(vectors(spark, sf_dir), VECTOR, -2.0).select("id", F.greatest("sim", F.lit(0.0)).alias("semantic"))
    return m.join(near, "id")


def ranking(name: str, asked: str, factor: str) -> None:
    def ranked_by(spark, sf_dir):
        return recall.ranked(scored(spark, sf_dir), asked, limit=40).select("id", r6("score").alias("score"))

    ranked_by.__name__ = name
    query(f"{SCORED_SQL} {RANKED.format(f'base * {factor}', f'base * {factor}')}")(ranked_by)


ranking("ranked_recall", "the build of may", "fresh")
ranking("ranked_by_target_date", "what happened on July 9, 2024?", f"fresh * (1 + 0.5::DOUBLE * {NEAR_TO.format('coalesce(referenced, relative, created_on)', '2024-07-09')})")
ranking("ranked_by_recency", "when did it happen", f"(1 + 0.5::DOUBLE * {NEAR_TO.format('coalesce(referenced, relative, created_on)', '2025-09-01')})")


@query(f"""{SCORED_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY round(base, 10) DESC, id) - 1 AS place FROM b QUALIFY place < 50)
SELECT id, place, round(score, 6) AS score FROM (SELECT id, place, 1 / (1 + place)::DOUBLE * (1 + 0.5::DOUBLE * coalesce({NEAR_TO.format("coalesce(referenced, relative)", "2024-07-09")}, 0)) AS score FROM p)""")
def temporal_reorder(spark, sf_dir):
    """The 50 best of a recall, put in order once more."""
    s = scored(spark, sf_dir).withColumn("base", (0.6 * F.col("semantic") + 0.4 * F.col("text")) * (1 + (F.col("confidence") - 0.5) * 0.3))
    best = s.orderBy(F.desc(F.round("base", 10)), "id").limit(50)
    pool = best.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("base", 10)), "id")).cast("long") - 1)
    return recall.reordered(pool, "what happened on July 9, 2024?").select("id", "place", r6("score").alias("score"))


MARKED = "({})".format(" OR ".join("contains(lower(value), '{}')".format(w) for w in quality.text.POSITIVE)), "({})".format(" OR ".join("contains(lower(value), '{}')".format(w) for w in quality.AGAINST))


@query(f"""{OPPOSED_SQL}, r AS (SELECT id, project_id, type, key, {MARKED[0]} AS pos, {MARKED[1]} AS neg, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(value), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)) AS s FROM memories),
e AS (SELECT *, len(s) AS n, unnest(s) AS w FROM r),
p AS (SELECT x.id, y.id AS c, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS overlap, any_value((x.pos AND y.neg) OR (x.neg AND y.pos)) AS against, any_value(x.key <> y.key) AS other
  FROM e x JOIN e y ON x.w = y.w AND x.project_id = y.project_id AND x.id <> y.id AND y.type = 'convention' GROUP BY x.id, y.id),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c) AS k FROM p WHERE (overlap >= 0.3 - 1e-12 AND against) OR (overlap > 0.4 + 1e-12 AND other))
SELECT r.id, CASE WHEN c IS NULL THEN 'compliant' WHEN against THEN 'violation' ELSE 'warning' END AS status, c AS convention, round(overlap, 6) AS overlap FROM r LEFT JOIN f ON f.id = r.id AND k = 1""")
def convention_checks(spark, sf_dir):
    m = opposed(memories(spark, sf_dir))
    return quality.convention_checks(m, m).withColumn("overlap", r6("overlap"))

# --- guides and archives --------------------------------------------------------------------------------------------------


def bare_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[*`_]', '', 'g'), '(?m)^\\s*[->]\\s*', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def says_sql(x: str, words: list[str]) -> str:
    each = "|".join(words).replace("'", "''")
    return f"regexp_matches({x}, '(^|[^A-Za-z0-9_])({each})([^A-Za-z0-9_]|$)')"


#: A project's guide: three of six sections, made of its first and last record's values.
GUIDE_PARTS = {guides_.COMMANDS: ("## Commands", "'- **' || v1 || '**'"), guides_.STRUCTURE: ("## project STRUCTURE and more", "'Do not use ' || substring(v2, 1, 300) || '. End'"), guides_.BOUNDARIES: ("## Boundaries", "v2 || '. avoid ' || v1")}
GUIDE_TEXT = "'# Guide' || " + " || ".join(f"chr(10) || '{title}' || chr(10) || {body}" for title, body in GUIDE_PARTS.values())
BODIES = " UNION ALL ".join(f"SELECT project_id, '{s}' AS section, {bare_sql(('' if s != guides_.STRUCTURE else chr(39) + ' and more' + chr(39) + ' || ') + f'chr(10) || {body}')} AS body FROM g" for s, (_, body) in GUIDE_PARTS.items())


@query(f"""{M}, g AS (SELECT project_id, arg_min(value, id) AS v1, arg_max(value, id) AS v2 FROM memories GROUP BY project_id), b AS ({BODIES}),
r AS (SELECT id, project_id, key, type, {bare_sql("value")} AS said, {says_sql("lower(key)", guides_.GIT_WORDS)} AS git, {says_sql("lower(key)", guides_.TEST_WORDS)} AS test, {says_sql("lower(value)", guides_.TEST_VALUE_WORDS)} AS tv FROM memories),
s AS (SELECT id, project_id, said, unnest(CASE WHEN type IN ('anti_pattern', 'lesson', 'preference') THEN ['Boundaries'] WHEN len(a) > 0 THEN a ELSE ['Project structure'] END) AS section FROM (SELECT *, list_filter([CASE WHEN git THEN 'Git workflow' END, CASE WHEN test THEN 'Testing' END, CASE type WHEN 'architecture' THEN 'Project structure' WHEN 'convention' THEN 'Code style' END,
  CASE WHEN type IN ('execution', 'pattern') THEN CASE WHEN NOT test AND tv THEN 'Testing' WHEN NOT git THEN 'Commands' END END], lambda x: x IS NOT NULL) AS a FROM r)),
m AS (SELECT s.*, body, list_filter(string_split(said, ' '), lambda w: length(w) > 3) AS w, list_slice(list_filter(string_split(said, ' '), lambda w: length(w) > 4 AND NOT list_contains({guides_.NO_SUBJECT}, w)), 1, 4) AS k FROM s LEFT JOIN b USING (project_id, section)),
f AS (SELECT *, CASE WHEN NOT {says_sql("said", guides_.DENYING)} THEN substring(list_filter(string_split(body, '.'), lambda x: {says_sql("x", guides_.GUIDE_DENYING)} AND len(list_filter(k, lambda q: contains(x, q))) > 0)[1], 1, 120) END AS fragment FROM m),
o AS (SELECT *, CASE WHEN body IS NULL THEN 'missing' WHEN fragment IS NOT NULL THEN 'contradicting' WHEN NOT (contains(body, said) OR (len(w) > 0 AND len(list_filter(w, lambda q: contains(body, q))) / len(w)::DOUBLE >= 0.7)) THEN 'stale' END AS kind FROM f)
SELECT project_id, section, kind, id, fragment FROM o WHERE kind IS NOT NULL""")
def guide_drift(spark, sf_dir):
    m = memories(spark, sf_dir)
    ends = m.groupBy("project_id").agg(F.min_by("value", "id").alias("v1"), F.max_by("value", "id").alias("v2"))
    return guides_.drift(m.withColumn("tags", F.lit(None).cast("array<string>")), ends.select("project_id", F.expr(GUIDE_TEXT).alias("text")))


# Copies of three runs, one of which expires; a third of the second's is restored before the last.
@query(f"""{M}, c AS (SELECT project_id, key, id, 'old' AS reason, 1 AS run FROM memories WHERE id % 2 = 0 UNION ALL SELECT project_id, key, id, 'unused', 2 FROM memories WHERE id % 3 = 0 UNION ALL SELECT project_id, key, id, 'again', 3 FROM memories WHERE id % 15 = 0),
k AS (SELECT DISTINCT project_id, key FROM memories WHERE id % 9 = 0)
SELECT project_id, key, reason, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY run DESC, id DESC) AS n FROM c WHERE run > 1 AND NOT (run = 2 AND EXISTS (SELECT 1 FROM k WHERE k.project_id = c.project_id AND k.key = c.key))) WHERE n = 1""")
def archived(spark, sf_dir):
    m = memories(spark, sf_dir).select("project_id", "key", F.format_string("%012d", "id").alias("id"))
    a = archive.Archive(spark, f"{shared_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}", 30)
    a.add(m.where("CAST(id AS LONG) % 2 = 0"), "old", "2024-01-01 10:00:00")
    a.add(m.where("CAST(id AS LONG) % 3 = 0"), "unused", "2024-03-01 10:00:00")
    a.restore(m.where("CAST(id AS LONG) % 9 = 0"), "2024-03-02 10:00:00")
    a.add(m.where("CAST(id AS LONG) % 15 = 0"), "again", "2024-03-03 10:00:00")
    a.purge("2024-02-15")
    return a.newest().select("project_id", "key", "reason", F.get_json_object("record", "$.id").cast("long").alias("id"))

# --- source trees: a file for each record, which imports others by relative names -------------------------------------------

FILE = "'src/pkg' || CAST({0} % 7 AS VARCHAR(9)) || '/m' || CAST({0} AS VARCHAR(20)) || CASE {0} % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END"
CODE = "'import a from ''../pkg' || CAST((id + 1) % 7 AS VARCHAR(9)) || '/m' || CAST(id + 1 AS VARCHAR(20)) || '''' || chr(10) || 'import b from ''./m' || CAST(id + 7 AS VARCHAR(20)) || '''' || chr(10) || 'import c from ''../m' || CAST(id + 7 AS VARCHAR(20)) || '''' || chr(10) || 'import ''@scope/x''' || chr(10) || 'export function f() {}' || chr(10) || 'export { p as q, r }' || chr(10) || value"
CODE_SPARK = CODE.replace("''''", '"\'"').replace("'import a from ''../pkg'", '"import a from \'../pkg"').replace("'import b from ''./m'", '"import b from \'./m"').replace("'import c from ''../m'", '"import c from \'../m"').replace("'import ''@scope/x'''", '"import \'@scope/x\'"')


def tree(spark, sf_dir) -> DataFrame:
    return memories(spark, sf_dir).select(F.expr(FILE.format("id")).alias("file"), F.expr(CODE_SPARK).alias("text")).withColumnRenamed("file", "path")


# An import of a name that is a folder means the folder.
@query(f"""{M}, t AS (SELECT id, CASE id % 3 WHEN 2 THEN regexp_replace({FILE.format("id")}, '/index.ts$', '') ELSE {FILE.format("id")} END AS p FROM memories)
SELECT {FILE.format("m.id")} AS path, t.p AS to, count(*) AS n FROM memories m JOIN t ON (m.id % 3 < 2 AND t.id IN (m.id + 1, m.id + 7)) OR (m.id % 3 = 2 AND t.id = m.id + 7) GROUP BY ALL""")
def file_dependencies(spark, sf_dir):
    return code.dependencies(tree(spark, sf_dir))


@query(f"""{M} SELECT 'src/pkg' || id % 7 AS name, count(*) AS n_files, sum(7 + length(value) - length(replace(value, chr(10), '')))::BIGINT AS n_lines, (3 * count(*))::BIGINT AS n_exports FROM memories GROUP BY 1 HAVING count(*) >= 2""")
def module_boundaries(spark, sf_dir):
    return code.boundaries(code.modules(tree(spark, sf_dir)))

# --- unified scores, summaries, conflicts ----------------------------------------------------------------------------------


@query(f"""{M}, v AS (SELECT vec_id AS id, {COS} AS semantic FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {VECTOR_SQL} AS q FROM embeddings)),
n AS (SELECT v.id, semantic FROM v JOIN memories m ON m.id = v.id WHERE semantic > 0.3 AND status = 'live'), t AS (SELECT id FROM memories WHERE status = 'live' AND (contains(lower(key), 'thation') OR contains(lower(value), 'thation')) ORDER BY updated_on DESC, id LIMIT 50)
SELECT coalesce(n.id, t.id) AS id, round(coalesce(semantic, 0), 6) AS semantic, CASE WHEN t.id IS NULL THEN 0.0::DOUBLE ELSE 1 END AS text FROM n FULL JOIN t ON n.id = t.id""")
def unified_scores(spark, sf_dir):
    return recall.scored_query(memories(spark, sf_dir), vectors(spark, sf_dir), "Thation", VECTOR, 25).select("id", r6("semantic").alias("semantic"), "text")


SUMMARY_SQL = "CASE " + " ".join("WHEN regexp_matches(lower(s), '\\b({})\\b') THEN '{}'".format("|".join(w.replace("_", " ") for w in words.split()), "{" + str(k) + "}") for k, (_, _, words) in enumerate(classify.SUMMARY)) + " END"
SUMMARY_TYPE, SUMMARY_BEGIN = (SUMMARY_SQL.format(*[row[k] for row in classify.SUMMARY]) for k in (0, 1))
SPOKEN = "value || '. We decided on ' || agent || '. Never skip ' || type || ' checks' || chr(10) || ' the layout of ' || type || ' ' || chr(10) || 'Tiny. Watch out for x1.  New in ' || id"


@query(f"""{M}, s AS (SELECT id, unnest(list_filter(list_transform(string_split(replace(regexp_replace({SPOKEN}, '\\.\\s+([A-Z])', '.' || chr(1) || '\\1', 'g'), chr(10), chr(1)), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10)) AS s FROM memories),
k AS (SELECT id, s, {SUMMARY_TYPE} AS type, {SUMMARY_BEGIN} AS begin FROM s)
SELECT id, concat_ws('-', begin, regexp_replace(regexp_replace(lower(substring(s, 1, 50)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS key, md5(s) AS hash, type FROM k WHERE type IS NOT NULL""")
def summary_records(spark, sf_dir):
    each = memories(spark, sf_dir).select("id", F.inline(classify.summary_records(F.expr(SPOKEN))))
    return each.select("id", "key", F.md5("value").alias("hash"), "type")


#: A conflict between a record and the next but one, for a record in three; a record in nine is in two. Some are settled, some lack a side.
CONFLICT = {"conflict_id": "id", "a": "id", "b": "CASE WHEN id % 9 = 0 THEN id + 3 WHEN id % 30 = 3 THEN id + 1000000 ELSE id + 2 END", "reason": "type", "resolved": "id % 12 = 0", "created_on": "created_on", "base": "CASE WHEN id % 2 = 0 THEN 'base' END"}
CONFLICTS_SQL = f"{M}, r AS (SELECT *, id % 25 AS updated_by FROM memories), conflicts AS (SELECT {', '.join(f'{x} AS {c}' for c, x in CONFLICT.items())} FROM memories WHERE id % 3 = 0)"


def clashes(m: DataFrame) -> DataFrame:
    return m.where("id % 3 = 0").selectExpr(*[f"{x} AS {c}" for c, x in CONFLICT.items()])


@query(f"""{CONFLICTS_SQL}, u AS (SELECT DISTINCT n_nationkey AS user_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS full_name, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) || '@x.org' END AS email FROM nation)
SELECT conflict_id, a, b, reason, c.created_on::VARCHAR AS created_on, x.key AS a_key, md5(x.value) AS a_value, coalesce(ux.full_name, string_split(ux.email, '@')[1], 'Unknown') AS a_updated_by, y.key AS b_key, md5(y.value) AS b_value, coalesce(uy.full_name, string_split(uy.email, '@')[1], 'Unknown') AS b_updated_by
FROM conflicts c JOIN r x ON x.id = c.a JOIN r y ON y.id = c.b LEFT JOIN u ux ON ux.user_id = x.updated_by LEFT JOIN u uy ON uy.user_id = y.updated_by WHERE NOT resolved""")
def open_conflicts(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("updated_by", F.col("id") % 25)
    users = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS user_id", "CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS full_name", "CASE WHEN n_nationkey % 3 = 1 THEN concat(lower(n_name), '@x.org') END AS email")
    out = conflicts.open_conflicts(clashes(m), m, users)
    return out.select("conflict_id", "a", "b", "reason", F.col("created_on").cast("string").alias("created_on"), "a_key", F.md5("a_value").alias("a_value"), "a_updated_by", "b_key", F.md5("b_value").alias("b_value"), "b_updated_by")


@query(f"""{CONFLICTS_SQL}, o AS (SELECT * FROM conflicts WHERE NOT resolved), e AS (SELECT a AS id, created_on, conflict_id FROM o UNION ALL SELECT b, created_on, conflict_id FROM o),
f AS (SELECT id, conflict_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_on, conflict_id) AS n FROM e) WHERE n = 1),
p AS (SELECT o.conflict_id, x.id AS xi, y.id AS yi, x.value AS xv, y.value AS yv, x.updated_on >= y.updated_on AS first FROM o JOIN f g ON g.id = o.a AND g.conflict_id = o.conflict_id JOIN f h ON h.id = o.b AND h.conflict_id = o.conflict_id LEFT JOIN r x ON x.id = o.a LEFT JOIN r y ON y.id = o.b)
SELECT conflict_id, CASE WHEN xi IS NOT NULL AND yi IS NOT NULL THEN CASE WHEN first THEN xi ELSE yi END END AS kept, CASE WHEN xi IS NOT NULL AND yi IS NOT NULL THEN CASE WHEN first THEN yi ELSE xi END END AS removed,
CASE WHEN xi IS NOT NULL AND yi IS NOT NULL THEN md5(CASE WHEN first THEN xv ELSE yv END) END AS value, CASE WHEN xi IS NULL OR yi IS NULL THEN 'gone' ELSE 'settled' END AS outcome FROM p""")
def settled_conflicts(spark, sf_dir):
    m = memories(spark, sf_dir)
    return conflicts.settled(clashes(m), m, "keep_newer").withColumn("value", F.md5("value"))
