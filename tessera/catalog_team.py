"""Queries on sessions, files, members, imports, merges and classifiers, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import AGE, C, COS, M, ME, SPLIT, VECTOR, VECTOR_SQL, query, r6
from tessera.functions import classify, dates
from tessera.operators import metrics, overlap, team, usage
from tessera.sources.records import AS_OF, EDGES_SQL, calls, edges, memories, vectors

# --- sessions and agents --------------------------------------------------------------------------------------------

SESSION = "agent, CAST(ts AS DATE) AS day"
SESSIONS_SQL = f"""{C}, s AS (SELECT {SESSION}, count(*) AS calls, count(*) FILTER (WHERE tool = 'view') AS hits, count(*) FILTER (WHERE tool = 'click') AS misses,
 count(*) FILTER (WHERE tool = 'purchase') AS created, count(*) FILTER (WHERE tool = 'signup') AS verified, count(*) FILTER (WHERE tool = 'error') AS violations, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM calls GROUP BY ALL),
m AS (SELECT *, coalesce(hits::DOUBLE / nullif(hits + misses, 0), 0) AS hit_rate, CASE WHEN verified > 0 THEN created::DOUBLE / verified ELSE created END AS create_to_verify FROM s)"""


def sessions(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return metrics.session_metrics(c, ["agent", "day"], "view", "click", "purchase", "signup", "error")


@query(f"{SESSIONS_SQL} SELECT agent, CAST(day AS VARCHAR) AS day, calls, hits, misses, created, violations, duration_us, round(hit_rate, 6) AS hit_rate, round(create_to_verify, 6) AS create_to_verify FROM m")
def session_metrics(spark, sf_dir):
    return sessions(spark, sf_dir).select("agent", F.col("day").cast("string").alias("day"), "calls", "hits", "misses", "created", "violations", "duration_us", r6("hit_rate").alias("hit_rate"), r6("create_to_verify").alias("create_to_verify"))


@query(f"""{SESSIONS_SQL} SELECT agent, count(*) AS sessions, round(avg(hit_rate), 6) AS hit_rate, sum(created)::BIGINT AS created, sum(violations)::BIGINT AS violations,
floor(40 * avg(hit_rate) + 30 * (1 - least(sum(violations)::DOUBLE / greatest(sum(calls), 1), 1)) + 30 * least(sum(created)::DOUBLE / 10, 1) + 0.5) AS score FROM m GROUP BY agent""")
def agent_metrics(spark, sf_dir):
    return metrics.agent_metrics(sessions(spark, sf_dir)).select("agent", "sessions", r6("hit_rate").alias("hit_rate"), "created", "violations", "score")


@query(f"""{C}, c AS (SELECT agent, count(*) AS checked, count(*) FILTER (WHERE value > 90) AS violations FROM calls WHERE tool = 'purchase' AND user_id % 3 = 0 GROUP BY agent)
SELECT a.agent, coalesce(checked, 0) AS checked, coalesce(violations, 0) AS violations, round(CASE WHEN checked > 0 THEN 100.0::DOUBLE * (checked - violations) / checked ELSE 100 END, 6) AS percent FROM (SELECT DISTINCT agent FROM calls) a LEFT JOIN c USING (agent)""")
def compliance(spark, sf_dir):
    c = calls(spark, sf_dir)
    checks = c.where("tool = 'purchase' and user_id % 3 = 0").select("agent", (F.col("value") > 90).alias("violation"))
    return metrics.compliance(checks, c).withColumn("percent", r6("percent"))


@query(f"""{C}, sd AS (SELECT user_id, 1 - 1.0::DOUBLE / count(DISTINCT trim(tool)) AS i FROM calls GROUP BY user_id),
c AS (SELECT agent, tool, count(*) FILTER (WHERE ts < TIMESTAMP '{SPLIT}') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}') AS b FROM calls GROUP BY ALL),
n AS (SELECT agent, sum(a) AS na, sum(b) AS nb FROM c GROUP BY agent HAVING sum(a) >= 5 AND sum(b) >= 5), v AS (SELECT DISTINCT tool FROM calls), k AS (SELECT count(*) AS k FROM v),
g AS (SELECT n.agent, na + nb AS calls, (coalesce(a, 0) + 1)::DOUBLE / (na + k) AS p, (coalesce(b, 0) + 1)::DOUBLE / (nb + k) AS q FROM n CROSS JOIN v CROSS JOIN k LEFT JOIN c ON c.agent = n.agent AND c.tool = v.tool),
d AS (SELECT agent, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) / ln(2.0) AS drift FROM g GROUP BY agent, calls ORDER BY calls DESC, agent LIMIT 20),
o AS (SELECT (SELECT avg(i) FROM sd) AS semantic, coalesce((SELECT avg(drift) FROM d), 0) AS behavioural)
SELECT round(semantic, 6) AS semantic, round(behavioural, 6) AS behavioural, round(0.7 * semantic + 0.3 * behavioural, 6) AS drift FROM o""")
def overall_drift(spark, sf_dir):
    c = calls(spark, sf_dir)
    changes = usage.semantic_drift(c.select(F.col("user_id").alias("id"), F.col("tool").alias("value")))
    by_agent = usage.behavioural_drift(c, SPLIT).join(c.groupBy("agent").agg(F.count("*").alias("calls")), "agent")
    return metrics.overall_drift(changes, by_agent).select(*[r6(k).alias(k) for k in ("semantic", "behavioural", "drift")])


MISSES_SQL = "WITH q AS (SELECT lower(trim(text)) AS pattern, conv_id AS seen FROM conversations WHERE role = 'user'), p AS (SELECT pattern, count(*) AS n, max(seen) AS last FROM q WHERE pattern <> '' GROUP BY pattern ORDER BY n DESC, pattern LIMIT 200)"


def missed(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select("text", F.col("conv_id").alias("at"))
    return metrics.missed(talk, 200)


@query(f"{MISSES_SQL} SELECT md5(pattern) AS pattern, n, last FROM p")
def top_misses(spark, sf_dir):
    return missed(spark, sf_dir).withColumn("pattern", F.md5("pattern"))


@query(f"{MISSES_SQL} SELECT split_part(regexp_replace(pattern, '[ \\t\\n]+', ' ', 'g'), ' ', 1) AS word, sum(n)::BIGINT AS n, round(least(1.0::DOUBLE, sum(n) / 10.0::DOUBLE), 6) AS confidence FROM p GROUP BY ALL")
def miss_suggestions(spark, sf_dir):
    return metrics.suggestions(missed(spark, sf_dir)).select("word", "n", r6("confidence").alias("confidence"))


@query(f"{M} SELECT project_id, count(*) AS n, sum(accesses)::BIGINT AS accesses, count(*) FILTER (WHERE accesses = 0 AND {AGE} > 7) AS never_used, round(sum(accesses)::DOUBLE / count(*), 2) AS mean FROM memories GROUP BY project_id")
def usage_stats(spark, sf_dir):
    return metrics.usage_stats(memories(spark, sf_dir), F.datediff(F.lit(AS_OF).cast("date"), "updated_on") > 7)


@query(f"{M} SELECT agent, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low FROM memories WHERE status = 'pending' GROUP BY agent")
def pending_stats(spark, sf_dir):
    return metrics.pending_stats(memories(spark, sf_dir))


@query(f"{M}, a AS (SELECT type AS kind, confidence > 0.5 AS correct, accesses > 10 AS found FROM memories) SELECT kind, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(found::INT), 6) AS recall FROM a GROUP BY GROUPING SETS ((kind), ())")
def evaluation(spark, sf_dir):
    a = memories(spark, sf_dir).select(F.col("type").alias("kind"), (F.col("confidence") > 0.5).alias("correct"), (F.col("accesses") > 10).alias("found"))
    return metrics.evaluation(a).select("kind", "n", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"))


@query(f"""{M}, s AS (SELECT type AS stratum, count(*) AS size FROM memories GROUP BY type), f AS (SELECT *, 50.0::DOUBLE * size / (SELECT sum(size) FROM s) AS exact FROM s),
g AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY round(exact - floor(exact), 12) DESC, stratum) AS place FROM f)
SELECT stratum, least(size, fl + (place <= 50 - (SELECT sum(floor(exact)) FROM f))::INT)::BIGINT AS take FROM g""")
def stratified_sample(spark, sf_dir):
    return metrics.allocation(memories(spark, sf_dir).groupBy(F.col("type").alias("stratum")).agg(F.count("*").alias("size")), 50)


@query(f"{C} SELECT user_id, max(event_id) FILTER (WHERE s IS NULL OR event_id < s) AS watermark FROM (SELECT user_id, event_id, min(event_id) FILTER (WHERE value > 150) OVER (PARTITION BY user_id) AS s FROM calls) GROUP BY user_id")
def sync_watermark(spark, sf_dir):
    c = calls(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), (~F.coalesce(F.col("value") > 150, F.lit(False))).alias("ok"))
    return metrics.watermark(c.select("user_id", "id", "ok"), "user_id")


# --- recall by chunks, files, tasks ---------------------------------------------------------------------------------


@query(f"""{ME}c AS (SELECT vec_id - vec_id % 3 AS memory_id, vec_id % 3 AS chunk_index, {COS} AS sim FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {VECTOR_SQL} AS q FROM embeddings)),
b AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY sim DESC, chunk_index) AS n FROM c WHERE sim > 0.1)
SELECT memory_id, chunk_index, round(sim, 6) AS similarity FROM b WHERE n = 1 AND memory_id IN (SELECT id FROM memories WHERE status = 'live') ORDER BY sim DESC, memory_id LIMIT 20""")
def chunk_recall(spark, sf_dir):
    chunks = vectors(spark, sf_dir).select((F.col("vec_id") - F.col("vec_id") % 3).alias("memory_id"), (F.col("vec_id") % 3).alias("chunk_index"), "embedding")
    return team.chunk_recall(chunks, memories(spark, sf_dir), VECTOR, 20, 0.1).withColumn("similarity", r6("similarity"))


FILES = ["src/en/mod3.ts", "src/de/", "src/fr/mod1.ts/part.ts"]
PRIORITY_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(team.PRIORITY)) + " END"


@query(f"""{M}, s AS (SELECT id, type, CASE WHEN path IN ('src/en/mod3.ts', 'src/de/', 'src/fr/mod1.ts/part.ts') THEN 3 WHEN starts_with('src/fr/mod1.ts/part.ts', path || '/') THEN 2 WHEN starts_with(path, 'src/de/') THEN 1 ELSE 0 END AS score FROM memories WHERE status = 'live')
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, {PRIORITY_SQL}, id LIMIT 40""")
def file_recall(spark, sf_dir):
    return team.file_recall(memories(spark, sf_dir), FILES, 40).select("id", "score")


WARN = ["anti_pattern", "lesson", "convention"]


@query(f"""{M}, r AS (SELECT id, path, contains(b, 'thation')::INT + contains(b, 'fix')::INT + contains(b, 'ering')::INT AS hits FROM (SELECT id, path, lower(key || ' ' || value) AS b FROM memories WHERE status = 'live' AND type IN ('anti_pattern', 'lesson', 'convention'))),
u AS ((SELECT id, hits FROM r WHERE hits > 0 ORDER BY hits DESC, id LIMIT 20) UNION ALL (SELECT id, 0 FROM r WHERE contains(path, 'mod7') OR contains('mod7', path)))
SELECT id, max(hits) AS hits FROM u GROUP BY id""")
def pre_check(spark, sf_dir):
    return team.pre_check(memories(spark, sf_dir), "fix thation ering at", ["mod7"], WARN)




def sections(spark, sf_dir):
    m = memories(spark, sf_dir).where("status = 'live'")
    s = m.groupBy("project_id", F.col("type").alias("name")).agg(F.ceil(F.sum(F.length("value")) / 4).alias("tokens"))
    return s.withColumn("place", F.array_position(F.array(*map(F.lit, team.PRIORITY)), F.col("name")))


BRIEF = 8000


# The twin goes from place to place, for all projects at once.
@query(f"""{M.replace("WITH ", "WITH RECURSIVE ", 1)}, s AS (SELECT project_id, type AS name, ceil(sum(length(value)) / 4.0)::BIGINT AS tokens, coalesce(list_position({team.PRIORITY}, type), 0) AS place FROM memories WHERE status = 'live' GROUP BY project_id, type),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY place, name) AS n FROM s),
r AS (SELECT DISTINCT project_id, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[] AS names FROM s
  UNION ALL SELECT r.project_id, k.n, CASE WHEN used + tokens <= {BRIEF} THEN used + tokens ELSE used END, CASE WHEN used + tokens <= {BRIEF} THEN list_append(names, name) ELSE names END FROM r JOIN k ON k.project_id = r.project_id AND k.n = r.n + 1)
SELECT project_id, used, array_to_string(names, ',') AS names FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC) AS last FROM r) WHERE last = 1""")
def project_brief(spark, sf_dir):
    """Sections by priority that fit the budget; a large one is passed over."""
    return team.packed_brief(sections(spark, sf_dir), "project_id", BRIEF)


@query(f"{M}, s AS (SELECT id, confidence * 0.5 AS score, updated_on FROM memories UNION ALL SELECT id, confidence AS score, created_on FROM memories WHERE id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, updated_on DESC) AS n FROM s) SELECT id, round(score, 6) AS score FROM b WHERE n = 1 ORDER BY round(score, 9) DESC, updated_on DESC, id LIMIT 50")
def composite_rank(spark, sf_dir):
    m = memories(spark, sf_dir)
    both = m.select("id", (F.col("confidence") * 0.5).alias("score"), "updated_on").unionByName(m.where("id % 2 = 0").select("id", F.col("confidence").alias("score"), F.col("created_on").alias("updated_on")))
    return team.composite_rank(both, 50).select("id", r6("score").alias("score"))


# --- tenants, federation, imports, merges ---------------------------------------------------------------------------


@query(f"{M} SELECT id, project_id FROM memories WHERE project_id IN (SELECT project_id FROM memories WHERE id % 50 = 1 AND agent = 'agent3' UNION SELECT project_id FROM memories WHERE id % 40 = 3 AND agent = 'agent3' AND confidence > 0.5)")
def visible_records(spark, sf_dir):
    m = memories(spark, sf_dir)
    owners = m.where("id % 50 = 1").select("project_id", F.col("agent").alias("user"))
    members = m.where("id % 40 = 3").select("project_id", F.col("agent").alias("user"), (F.col("confidence") > 0.5).alias("active"))
    return team.visible(m, owners, members, "agent3").select("id", "project_id")


SIDES = {"local": "id % 3 = 0", "override": "id % 5 = 0", "federated": "id % 2 = 0"}


@query(f"{M} SELECT id AS key, md5(value) AS value, CASE WHEN id % 3 = 0 THEN 'local' WHEN id % 5 = 0 THEN 'override' ELSE 'federated' END AS source FROM memories WHERE id % 3 = 0 OR id % 5 = 0 OR id % 2 = 0")
def federated_values(spark, sf_dir):
    kv = memories(spark, sf_dir).select(F.col("id").alias("key"), F.md5("value").alias("value"))
    parts = [kv.where(w.replace("id", "key")) for w in SIDES.values()]
    return team.resolved(kv.select("key"), *parts)


@query(f"{M} SELECT id FROM memories WHERE created_on < updated_on AND id % 4 = 0")
def outdated_copies(spark, sf_dir):
    m = memories(spark, sf_dir)
    return team.outdated(m.where("id % 4 = 0").select("id", F.col("created_on").alias("updated_on")), m)


@query(f"{M} SELECT id, CASE WHEN id % 7 = 0 THEN 'local' WHEN id % 3 <> 0 THEN 'remote' ELSE 'local' END AS side FROM memories WHERE id % 2 = 0 OR id % 3 <> 0")
def pulled_rows(spark, sf_dir):
    m = memories(spark, sf_dir)
    local = m.where("id % 2 = 0 or id % 7 = 0").select("id", F.lit("local").alias("side"), (F.col("id") % 7 == 0).alias("dirty")).where("id % 2 = 0 or id % 3 <> 0")
    return team.pulled(local, m.where("id % 3 <> 0").select("id", F.lit("remote").alias("side")), ["id"])


CHANGED = {"l": "CASE WHEN id % 3 = 0 THEN 'lesson' ELSE type END AS type, CASE WHEN id % 4 = 0 THEN 'ada' ELSE agent END AS agent, confidence * 0.9::DOUBLE AS confidence", "r": "CASE WHEN id % 5 = 0 THEN 'pattern' ELSE type END AS type, CASE WHEN id % 6 = 0 THEN 'bob' ELSE agent END AS agent, confidence"}


@query(f"""{M}, l AS (SELECT id, {CHANGED["l"]} FROM memories), r AS (SELECT id, {CHANGED["r"]} FROM memories)
SELECT id, CASE WHEN l.type = r.type THEN l.type WHEN l.type = b.type THEN r.type ELSE l.type END AS type, CASE WHEN l.agent = r.agent THEN l.agent WHEN l.agent = b.agent THEN r.agent ELSE l.agent END AS agent,
round(greatest(l.confidence, r.confidence), 6) AS confidence,
concat_ws(',', CASE WHEN l.type <> r.type AND l.type <> b.type AND r.type <> b.type THEN 'type' END, CASE WHEN l.agent <> r.agent AND l.agent <> b.agent AND r.agent <> b.agent THEN 'agent' END) AS conflicts
FROM l JOIN r USING (id) JOIN memories b USING (id)""")
def three_way_merge(spark, sf_dir):
    m = memories(spark, sf_dir)
    left = m.selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'lesson' ELSE type END AS type", "CASE WHEN id % 4 = 0 THEN 'ada' ELSE agent END AS agent", "confidence * 0.9D AS confidence")
    right = m.selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'pattern' ELSE type END AS type", "CASE WHEN id % 6 = 0 THEN 'bob' ELSE agent END AS agent", "confidence")
    out = team.three_way(m, left, right, ["type", "agent"])
    return out.select("id", "type", "agent", r6("confidence").alias("confidence"), F.array_join("conflicts", ",").alias("conflicts"))


@query(f"""{M}, n AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE evidence END AS evidence, CASE WHEN id % 2 = 0 THEN 'agent0' ELSE agent END AS agent, evidence AS old_e, agent AS old_a FROM memories)
SELECT id, 'evidence' AS field, 'removed' AS change FROM n WHERE old_e IS NOT NULL AND evidence IS NULL UNION ALL SELECT id, 'agent', 'modified' FROM n WHERE agent <> old_a""")
def field_changes(spark, sf_dir):
    m = memories(spark, sf_dir)
    new = m.select("id", F.when(F.col("id") % 3 != 0, F.col("evidence")).alias("evidence"), F.when(F.col("id") % 2 == 0, "agent0").otherwise(F.col("agent")).alias("agent"))
    return team.field_diff(m, new, ["evidence", "agent"])


def import_sql(value: str, tags: str, action: str) -> str:
    return f"""{M}, b AS (SELECT id AS key, value AS v, tags AS t FROM memories WHERE id % 2 = 0), n AS (SELECT id AS key, CASE WHEN id % 9 = 0 AND id % 2 = 1 THEN 'first' ELSE value || CASE WHEN id % 4 = 0 THEN ' more' ELSE '' END END AS value, CASE WHEN id % 9 = 0 AND id % 2 = 1 THEN ['x'] ELSE [agent] END AS tags FROM memories WHERE id % 3 = 0)
SELECT key, md5({value}) AS value, array_to_string({tags}, ',') AS tags, CASE WHEN v IS NULL THEN 'new' ELSE '{action}' END AS action FROM n LEFT JOIN b USING (key)"""


def import_tables(spark, sf_dir):
    m = memories(spark, sf_dir)
    base = m.where("id % 2 = 0").select(F.col("id").alias("key"), "value", "tags")
    rows = m.where("id % 3 = 0").select(F.col("id").alias("key"), F.expr("concat(value, CASE WHEN id % 4 = 0 THEN ' more' ELSE '' END)").alias("value"), F.array("agent").alias("tags"), F.expr("id % 2").alias("position"))
    # a key in three comes twice: before its other row if it is odd, else behind it
    again = m.where("id % 9 = 0").select(F.col("id").alias("key"), F.lit("first").alias("value"), F.array(F.lit("x")).alias("tags"), F.expr("1 - id % 2").alias("position"))
    return base, rows.unionByName(again)


def imported(spark, sf_dir, strategy):
    out = team.imported(*import_tables(spark, sf_dir), strategy)
    return out.select("key", F.md5("value").alias("value"), F.array_join("tags", ",").alias("tags"), "action")


@query(import_sql("coalesce(v, value)", "CASE WHEN v IS NULL THEN tags ELSE t END", "skipped"))
def import_skip(spark, sf_dir):
    return imported(spark, sf_dir, "skip")


@query(import_sql("value", "tags", "overwritten"))
def import_overwrite(spark, sf_dir):
    return imported(spark, sf_dir, "overwrite")


@query(import_sql("CASE WHEN v IS NULL OR length(value) > length(v) THEN value ELSE v END", "list_concat(coalesce(t, []), tags)", "merged"))
def import_merge(spark, sf_dir):
    return imported(spark, sf_dir, "merge")


@query(f"""{M} SELECT a.id, md5(CASE WHEN length(b.value) > length(a.value) THEN b.value ELSE a.value END) AS value, greatest(a.confidence, b.confidence) AS confidence,
array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags FROM memories a JOIN memories b ON b.id = a.id + 1 WHERE a.id % 2 = 0""")
def consolidated(spark, sf_dir):
    m = memories(spark, sf_dir)
    return team.consolidated(m.where("id % 2 = 0").withColumn("victim", F.col("id") + 1), m).select("id", F.md5("value").alias("value"), "confidence", F.array_join("tags", ",").alias("tags"))


@query(f"{ME}{EDGES_SQL} SELECT DISTINCT src - src % 2 AS src, dst - dst % 2 AS dst FROM edges WHERE src - src % 2 <> dst - dst % 2")
def redirected_edges(spark, sf_dir):
    m = memories(spark, sf_dir)
    return team.redirected(edges(m), m.where("id % 2 = 1").select(F.col("id").alias("victim"), (F.col("id") - 1).alias("id")))


TEMPLATES = [("docs", r"\.md$"), ("german", "^src/de/"), ("tens", r"mod1[0-9]\.ts$"), ("any", r"\.ts$")]


@query(f"{M} SELECT DISTINCT path, CASE WHEN starts_with(path, 'src/de/') THEN 'german' WHEN regexp_matches(path, 'mod1[0-9]\\.ts$') THEN 'tens' ELSE 'any' END AS template FROM memories")
def template_matches(spark, sf_dir):
    return team.first_template(memories(spark, sf_dir).select("path").distinct(), TEMPLATES)


@query(f"{M} SELECT id FROM memories WHERE path NOT IN (SELECT path FROM memories WHERE id % 9 = 0)")
def missing_files(spark, sf_dir):
    m = memories(spark, sf_dir)
    return team.by_files(m, m.where("id % 9 = 0"))


@query(f"{C}, v AS (SELECT user_id AS id, event_id, tool, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM calls) SELECT id, tool AS value, (SELECT max(version) FROM v x WHERE x.id = v.id) + 1 AS version FROM v WHERE version = 2")
def reverted(spark, sf_dir):
    from pyspark.sql import Window as W

    v = calls(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("tool").alias("value"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"))
    users = v.select("id").distinct()
    return team.reverted(users, v, users.withColumn("version", F.lit(2).cast("long")))


# --- gates, filters, classifiers ------------------------------------------------------------------------------------


@query(f"{M} SELECT id FROM memories WHERE list_contains(phases, 'phase1') AND (conditions IS NULL OR list_has_any(conditions, ['local', 'remote']))")
def phase_filter(spark, sf_dir):
    wanted = F.array(F.lit("local"), F.lit("remote"))
    return memories(spark, sf_dir).where(F.array_contains("phases", "phase1") & (F.col("conditions").isNull() | F.arrays_overlap("conditions", wanted))).select("id")


@query(f"{M} SELECT id, len(list_distinct(list_concat(coalesce(tags, []), coalesce(phases, [])))) AS n_all, len(list_intersect(coalesce(tags, []), ['t1', 's2'])) AS n_both FROM memories")
def merged_arrays(spark, sf_dir):
    none = F.array().cast("array<string>")
    tags, phases = F.coalesce("tags", none), F.coalesce("phases", none)
    return memories(spark, sf_dir).select("id", F.size(F.array_union(tags, phases)).alias("n_all"), F.size(F.array_intersect(tags, F.array(F.lit("t1"), F.lit("s2")))).alias("n_both"))


OBSERVED_SQL = "CASE WHEN length(b) < 15 THEN NULL " + " ".join("WHEN regexp_matches(b, '\\b({})\\b') THEN '{}'".format(w.replace("'", "''"), n) for n, w in classify.OBSERVED) + " END"


@query(f"{M} SELECT id, {OBSERVED_SQL} AS kind FROM (SELECT id, trim(lower(value || CASE id % 7 WHEN 0 THEN ' we decided this' WHEN 1 THEN ' a new module' WHEN 2 THEN ' the bug' ELSE '' END)) AS b FROM memories)")
def observed_types(spark, sf_dir):
    end = F.when(F.col("id") % 7 == 0, " we decided this").when(F.col("id") % 7 == 1, " a new module").when(F.col("id") % 7 == 2, " the bug").otherwise("")
    return memories(spark, sf_dir).select("id", classify.observation(F.concat("value", end)).alias("kind"))


HEADED_SQL = "CASE " + " ".join("WHEN " + " OR ".join("contains(h, '{}')".format(p.replace("'", "''")) for p in parts) + f" THEN '{n}'" for n, parts in classify.HEADED) + " ELSE 'preference' END"


@query(f"{M} SELECT id, {HEADED_SQL} AS kind FROM (SELECT id, lower(key || CASE id % 5 WHEN 0 THEN ' Rules' WHEN 1 THEN ' Design' WHEN 2 THEN ' Avoid' ELSE '' END) AS h FROM memories)")
def heading_types(spark, sf_dir):
    end = F.when(F.col("id") % 5 == 0, " Rules").when(F.col("id") % 5 == 1, " Design").when(F.col("id") % 5 == 2, " Avoid").otherwise("")
    return memories(spark, sf_dir).select("id", classify.heading(F.concat("key", end)).alias("kind"))


@query(f"{M} SELECT id, CASE WHEN n < 1 THEN 'just now' WHEN n < 60 THEN n || 'm ago' WHEN n < 1440 THEN n // 60 || 'h ago' ELSE n // 1440 || 'd ago' END AS label FROM (SELECT id, (id * 17) % 3000 AS n FROM memories)")
def age_labels(spark, sf_dir):
    return memories(spark, sf_dir).select("id", classify.age_label((F.col("id") * 17) % 3000).alias("label"))


@query(f"{M} SELECT project_id, CASE WHEN count(*) < 50 THEN 4000 WHEN count(*) < 200 THEN 6000 ELSE 8000 END AS budget FROM memories GROUP BY project_id")
def context_budgets(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", classify.budget(F.col("n")).alias("budget"))


@query("""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_slice(embedding::DOUBLE[], 1, 32) AS s FROM embeddings)
SELECT vec_id, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS cut_first, 96 AS n_long, round(e[64], 6) AS long_64 FROM c""")
def resized_vectors(spark, sf_dir):
    e = F.col("embedding")
    longer = classify.resized(e, 96)
    return vectors(spark, sf_dir).select("vec_id", r6(F.get(classify.resized(e, 32), F.lit(0))).alias("cut_first"), F.size(longer).alias("n_long"), r6(F.get(longer, F.lit(63))).alias("long_64"))


@query(f"{M} SELECT id, 1 + (id % 4)::INT AS depth FROM memories")
def json_depths(spark, sf_dir):
    nested = F.concat(F.lit('{"a}]": '), F.expr("repeat('[', CAST(id % 4 AS INT))"), F.lit('"x\\"[["'), F.expr("repeat(']', CAST(id % 4 AS INT))"), F.lit("}"))
    return memories(spark, sf_dir).select("id", classify.json_depth(nested).alias("depth"))


@query(f"{M} SELECT id, path FROM memories WHERE contains(path, '/mod1') AND status = 'live' AND id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark, sf_dir):
    """Live records on a path, a page after a cursor."""
    return memories(spark, sf_dir).where(F.col("path").contains("/mod1") & (F.col("status") == "live") & (F.col("id") > 100)).select("id", "path").orderBy("id").limit(50)


@query(f"{M} SELECT id FROM memories ORDER BY evidence DESC NULLS LAST, id OFFSET 50 LIMIT 50")
def offset_page(spark, sf_dir):
    """The second page of a listing, records without evidence last."""
    return memories(spark, sf_dir).select("id", "evidence").orderBy(F.desc_nulls_last("evidence"), "id").offset(50).limit(50).select("id")


# No record's own value names a date.
@query(f"""{M}, d AS (SELECT id, CASE id % 4 WHEN 0 THEN 'due 2024-03-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') || ' end' WHEN 1 THEN 'on March ' || (id % 28 + 1) || ', 2024' WHEN 2 THEN 'by 3/' || (id % 28 + 1) || '/2024.' ELSE 'none' END AS t FROM memories)
SELECT id, CASE WHEN id % 4 < 3 THEN CAST(make_date(2024, 3, (id % 28 + 1)::INT) AS VARCHAR) END AS day FROM d""")
def absolute_dates(spark, sf_dir):
    n = (F.col("id") % 28 + 1).cast("string")
    t = F.when(F.col("id") % 4 == 0, F.concat(F.lit("due 2024-03-"), F.lpad(n, 2, "0"), F.lit(" end"))).when(F.col("id") % 4 == 1, F.concat(F.lit("on March "), n, F.lit(", 2024"))).when(F.col("id") % 4 == 2, F.concat(F.lit("by 3/"), n, F.lit("/2024."))).otherwise("none")
    return memories(spark, sf_dir).select("id", F.to_date(dates.absolute(F.concat_ws(" ", "value", t))).cast("string").alias("day"))


@query(f"{M} SELECT id, CAST(DATE '2025-09-01' - (CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 * (id % 9 + 1) ELSE id % 9 + 1 END)::INT AS VARCHAR) AS day FROM memories")
def relative_dates(spark, sf_dir):
    n = (F.col("id") % 9 + 1).cast("string")
    t = F.when(F.col("id") % 3 == 0, "seen Yesterday").when(F.col("id") % 3 == 1, F.concat(n, F.lit(" weeks ago"))).otherwise(F.concat(F.lit("some "), n, F.lit(" days ago,")))
    return memories(spark, sf_dir).select("id", dates.relative(F.concat_ws(" ", "value", t), F.lit(AS_OF).cast("date")).cast("date").cast("string").alias("day"))


WORDS_SQL = "array_to_string(list_filter(regexp_split_to_array({}, '[\\t\\n\\v\\f\\r \\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+'), lambda w: w <> ''), ' ')"


# The left side ends every second text with a word of its own, the right begins every third with one; where both did, both stay.
@query(f"""{M} SELECT id, md5(CASE WHEN value = '' AND id % 6 = 0 THEN 'zzright' WHEN id % 6 = 0 THEN concat_ws(' ', 'zzright', nullif({WORDS_SQL.format("value")}, ''), 'zzleft') WHEN id % 2 = 0 AND value <> '' THEN value || ' zzleft' WHEN id % 3 = 0 THEN 'zzright ' || value ELSE value END) AS hash,
CASE WHEN tags IS NOT NULL OR id % 4 = 0 THEN array_to_string(list_concat(coalesce(tags, []), CASE WHEN id % 4 = 0 THEN ['new'] ELSE [] END), ',') END AS tags,
CASE WHEN id % 5 = 0 AND type NOT IN ('lesson', 'pattern') THEN 'partial' ELSE 'clean' END AS strategy FROM memories""")
def three_way_texts(spark, sf_dir):
    m = memories(spark, sf_dir)
    left = m.withColumn("value", F.expr("CASE WHEN id % 2 = 0 AND value <> '' THEN concat(value, ' zzleft') ELSE value END")).withColumn("type", F.expr("CASE WHEN id % 5 = 0 THEN 'lesson' ELSE type END"))
    right = m.withColumn("value", F.expr("CASE WHEN id % 3 = 0 THEN concat('zzright ', value) ELSE value END")).withColumn("type", F.expr("CASE WHEN id % 5 = 0 THEN 'pattern' ELSE type END"))
    right = right.withColumn("tags", F.expr("CASE WHEN id % 4 = 0 THEN array('new') ELSE tags END"))
    out = team.three_way(m, left, right, ["type"], ["value"], ["tags"])
    return out.select("id", F.md5("value").alias("hash"), F.array_join("tags", ",").alias("tags"), "strategy")


# A record in 5 has an excerpt of it and one with a similar key beside it.
EXCERPTS_SQL = f"{M}, more AS (SELECT id, project_id, key, value, confidence FROM memories WHERE status = 'live' UNION ALL SELECT id + 1000000, project_id, substring(key, 1, 16) || ' v2', substring(value, 30, 30 + id % 90), 0 FROM memories WHERE id % 5 = 0)"


def with_excerpts(m):
    own = m.where("status = 'live'").select("id", "project_id", "key", "value", "confidence")
    return own.unionByName(m.where("id % 5 = 0").selectExpr("id + 1000000 AS id", "project_id", "concat(substring(key, 1, 16), ' v2') AS key", "substring(value, 30, CAST(30 + id % 90 AS INT)) AS value", "0D AS confidence"))


@query(f"""{EXCERPTS_SQL}, k AS (SELECT project_id, lower(key) AS k, count(*) AS n FROM more WHERE key <> '' GROUP BY ALL),
p AS (SELECT a.project_id, a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b FROM k a JOIN k b ON a.project_id = b.project_id AND a.k < b.k),
s AS (SELECT *, list_max(list_transform(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) + 2 - i), lambda n: substring(a, i, n)))), lambda x: CASE WHEN contains(b, x) THEN length(x) ELSE 0 END)) AS shared FROM p)
SELECT project_id, a, b, shared::BIGINT AS shared, n_a, n_b FROM s WHERE 100 * shared > 60 * least(length(a), length(b))""")
def overlapping_keys(spark, sf_dir):
    return overlap.overlapping_keys(with_excerpts(memories(spark, sf_dir)))


@query(f"""{M}, g AS (SELECT project_id, type, path, lower(key) AS k, count(*) AS n FROM memories GROUP BY ALL)
SELECT a.project_id, a.type, a.path, (sum(DISTINCT t.n))::BIGINT AS n_records, sum(a.n * b.n)::BIGINT AS n_pairs FROM g a JOIN g b ON a.project_id = b.project_id AND a.type = b.type AND a.path = b.path AND a.k < b.k
JOIN (SELECT project_id, type, path, sum(n) AS n FROM g GROUP BY ALL) t ON t.project_id = a.project_id AND t.type = a.type AND t.path = a.path GROUP BY ALL""")
def shared_files(spark, sf_dir):
    return overlap.shared_files(memories(spark, sf_dir))


@query(f"""{EXCERPTS_SQL}, n AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, id) AS r, regexp_replace(lower(regexp_replace(value, '[ \t\n\v\f\r]+', ' ', 'g')), '^ | $', '', 'g') AS t FROM more)
SELECT id, of FROM (SELECT a.id, b.id AS of, row_number() OVER (PARTITION BY a.id ORDER BY b.r) AS k FROM n a JOIN n b ON a.project_id = b.project_id AND b.r < a.r AND (a.t = b.t OR length(a.t) >= 40 AND contains(b.t, a.t)) WHERE a.t <> '') WHERE k = 1""")
def contained_values(spark, sf_dir):
    return overlap.contained(with_excerpts(memories(spark, sf_dir)), [-F.col("confidence"), F.col("id").alias("n")])
