"""Queries on quality, pairs, tokens and graphs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import AGE, E, M, ME, RATES, TRIGRAMS, WORD_SET, query, r6
from tessera.functions import tokens
from tessera.operators import graph, quality, search
from tessera.sources.records import MEMORIES_SQL, ROUND_EDGES_SQL, edges, memories, round_edges


def marked(markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(value), '{m}')" for m in markers) + ")"


SPACED = "list_distinct(list_filter(string_split_regex(lower(value), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 2))"


# A record in 22 is advice for something, and has a copy beside it that advises against.
OPPOSED = "id % 22 = 0"
OPPOSED_SQL = f"""WITH {MEMORIES_SQL.replace("memories AS", "base AS", 1)}, memories AS (SELECT * REPLACE (CASE WHEN {OPPOSED} THEN value || ' you must always do it' ELSE value END AS value) FROM base
UNION ALL SELECT * REPLACE (id + 2000000 AS id, value || ' never do it' AS value) FROM base WHERE {OPPOSED})"""


def opposed(m):
    more = m.where(OPPOSED).withColumns({"id": F.col("id") + 2_000_000, "value": F.concat("value", F.lit(" never do it"))})
    return m.withColumn("value", F.when(F.expr(OPPOSED), F.concat("value", F.lit(" you must always do it"))).otherwise(F.col("value"))).unionByName(more)


def polar(positive: list[str], negative: list[str], where: str = "true") -> str:
    """c: pairs of opposite guidance and their overlap, by comparing all records that share a word."""
    return f"""
r AS (SELECT id, type, {SPACED} AS s, {marked(positive)} AS pos, {marked(negative)} AS neg FROM memories WHERE {where}),
e AS (SELECT id, type, pos, neg, len(s) AS n, unnest(s) AS w FROM r WHERE pos OR neg),
c AS (SELECT x.id AS a, y.id AS b, count(*)::DOUBLE / max(greatest(x.n, y.n)) AS overlap FROM e x JOIN e y ON x.w = y.w AND x.type = y.type AND x.id < y.id
      WHERE (x.pos AND y.neg) OR (x.neg AND y.pos) GROUP BY x.id, y.id)"""


from tessera.functions.text import NEGATIVE, POSITIVE  # noqa: E402


@query(f"""{ME}s AS (SELECT id, type, {WORD_SET.format("key || ' ' || value")} AS s FROM memories WHERE status = 'live'), e AS (SELECT id, type, len(s) AS n, unnest(s) AS w FROM s),
p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.type = y.type AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS similarity FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.7 - 1e-12""")
def near_duplicates(spark, sf_dir):
    return quality.near_duplicates(memories(spark, sf_dir)).select("a", "b", r6("similarity").alias("similarity"))


@query(f"""{ME}g AS (SELECT id, project_id, {TRIGRAMS.format("key")} AS s FROM memories), e AS (SELECT id, project_id, len(s) AS n, unnest(s) AS w FROM g),
p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.project_id = y.project_id AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS similarity FROM p WHERE k::DOUBLE / (na + nb - k) > 0.5 + 1e-12 ORDER BY k::DOUBLE / (na + nb - k) DESC, a, b LIMIT 20""")
def similar_keys(spark, sf_dir):
    return quality.similar_keys(memories(spark, sf_dir)).select("a", "b", r6("similarity").alias("similarity"))


@query(f"{OPPOSED_SQL}, {polar(POSITIVE, NEGATIVE)} SELECT a, b, round(overlap, 6) AS overlap FROM c WHERE overlap >= 0.25 - 1e-12")
def contradictions(spark, sf_dir):
    return quality.contradictions(opposed(memories(spark, sf_dir))).select("a", "b", r6("overlap").alias("overlap"))


def quality_sql(where: str = "true") -> str:
    return f"""{OPPOSED_SQL}, {polar(quality.CONSISTENT_POSITIVE, quality.CONSISTENT_NEGATIVE, where)},
bad AS (SELECT a AS id FROM c WHERE overlap > 0.3 + 1e-12 UNION SELECT b FROM c WHERE overlap > 0.3 + 1e-12),
q AS (SELECT id, project_id, status,
 5 * ((coalesce(len(conditions), 0) > 0)::INT + (coalesce(len(examples), 0) > 0)::INT + (coalesce(len(tags), 0) > 0)::INT + (n_refs > 0)::INT + 1) AS completeness,
 greatest(0, floor(25 * (1 - least({AGE} / 180.0::DOUBLE, 1.0::DOUBLE)) + 0.5)) AS freshness,
 CASE WHEN id IN (SELECT id FROM bad) THEN 0 ELSE 25 END AS consistency,
 floor(confidence * 15 + 0.5) + least(floor(length(value) / 20.0::DOUBLE + 0.5), 10) AS usefulness FROM memories WHERE {where}),
t AS (SELECT *, completeness + freshness + consistency + usefulness AS total FROM q)"""


@query(f"{quality_sql()} SELECT id, completeness, freshness, consistency, usefulness, total FROM t")
def quality_scores(spark, sf_dir):
    return quality.quality(opposed(memories(spark, sf_dir))).select("id", "completeness", "freshness", "consistency", "usefulness", "total")


LIVE = "status = 'live'"


@query(f"""{quality_sql(LIVE)} SELECT project_id, count(*) AS n, floor(avg(total) + 0.5) AS health, count(*) FILTER (WHERE total >= 80) AS excellent, count(*) FILTER (WHERE total >= 60 AND total < 80) AS good,
count(*) FILTER (WHERE total >= 40 AND total < 60) AS fair, count(*) FILTER (WHERE total < 40) AS poor, array_to_string(list_slice(list(id ORDER BY total, id), 1, 5), ',') AS worst FROM t GROUP BY project_id""")
def project_health(spark, sf_dir):
    h = quality.health(quality.quality(opposed(memories(spark, sf_dir)).where(LIVE)))
    return h.withColumn("worst", F.array_join(F.col("worst").cast("array<string>"), ","))


@query(f"{quality_sql()} SELECT t.id, total FROM t JOIN memories m USING (id) WHERE {AGE} >= 60 AND date_diff('day', created_on, DATE '2025-09-01') >= 60 AND total <= 45 AND m.status = 'live'")
def auto_archive(spark, sf_dir):
    m = opposed(memories(spark, sf_dir))
    return quality.archivable(m, quality.quality(m), at_most=45)


@query(f"""{M} SELECT id, round(d, 6) AS decay FROM (SELECT id, status, accesses, {AGE} AS age, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - pow(2.0::DOUBLE, -({AGE} - 30) / 90.0::DOUBLE)) * {RATES} * (1 - 0.4::DOUBLE * least(accesses / 10.0::DOUBLE, 1.0::DOUBLE)))) AS d FROM memories)
WHERE status = 'live' AND age >= 180 AND accesses <= 5 AND d >= 0.7""")
def decay_sweep(spark, sf_dir):
    return quality.decayed(memories(spark, sf_dir), accesses=5, at_least=0.7).select("id", r6("decay").alias("decay"))


@query(f"""{M}, a AS (SELECT project_id, 20 * count(DISTINCT type) FILTER (WHERE type IN ('anti_pattern', 'lesson', 'pattern', 'execution', 'convention')) AS coverage,
 coalesce(count(*) FILTER (WHERE type IN ('convention', 'anti_pattern', 'lesson') AND regexp_matches(value, '\\b(ALWAYS|NEVER|MUST|DO NOT|STOP|AVOID|REQUIRE|ENSURE|USE)\\b'))::DOUBLE
  / nullif(count(*) FILTER (WHERE type IN ('convention', 'anti_pattern', 'lesson')), 0), 0) AS imperative FROM memories GROUP BY project_id)
SELECT project_id, coverage, round(imperative, 6) AS imperative, floor(coverage * 0.6::DOUBLE + imperative * 100 * 0.4::DOUBLE + 0.5) AS score FROM a""")
def audit_by_project(spark, sf_dir):
    return quality.audit(memories(spark, sf_dir)).withColumn("imperative", r6("imperative"))


IMPACT_SQL = f"""{E.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON e.src = c.dst),
d AS (SELECT dst AS id, count(*) AS degree FROM edges GROUP BY dst),
i AS (SELECT u.id, max(d.degree) + sum(coalesce(v.degree, 0)) AS impact FROM (SELECT DISTINCT dst AS id, src AS via FROM c WHERE src <> dst) u JOIN d ON d.id = u.id LEFT JOIN d v ON v.id = u.via GROUP BY u.id),
k AS (SELECT m.id, impact::BIGINT AS impact, impact * (0.4::DOUBLE + 0.3::DOUBLE * (1 - confidence) + 0.3::DOUBLE * least({AGE} / 30.0::DOUBLE, 1.0::DOUBLE)) AS risk FROM memories m JOIN i USING (id)),
l AS (SELECT *, CASE WHEN risk >= 5 THEN 'critical' WHEN risk >= 3 THEN 'high' WHEN risk >= 1 THEN 'medium' ELSE 'low' END AS level FROM k)"""


@query(f"{IMPACT_SQL} SELECT id, impact, round(risk, 6) AS risk, level FROM l")
def risk_scores(spark, sf_dir):
    m = memories(spark, sf_dir)
    return quality.risks(m, edges(m)).withColumn("risk", r6("risk"))


@query(f"""{IMPACT_SQL} SELECT id, impact, round(risk, 6) AS risk, level, (SELECT count(*) FROM l WHERE level IN ('high', 'critical')) AS n_high,
(SELECT count(*) FROM memories WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)) AS n_orphans FROM l ORDER BY round(risk, 9) DESC, id LIMIT 10""")
def risk_report(spark, sf_dir):
    m = memories(spark, sf_dir)
    return quality.risk_report(m, edges(m)).withColumn("risk", r6("risk"))


RE = f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {ROUND_EDGES_SQL}"
ROUND_CLOSURE = f"{RE}, c AS (SELECT src, dst FROM round_edges UNION SELECT c.src, e.dst FROM c JOIN round_edges e ON e.src = c.dst)"


@query(f"{ROUND_CLOSURE} SELECT DISTINCT src AS id FROM c WHERE src = dst")
def cyclic_records(spark, sf_dir):
    return graph.on_cycles(round_edges(memories(spark, sf_dir)))


# The twin walks all simple paths of up to five edges between records of one component; no shortest cycle there is longer.
@query(f"""{ROUND_CLOSURE}, k AS (SELECT e.src, e.dst FROM round_edges e JOIN c ON c.src = e.dst AND c.dst = e.src),
p AS (SELECT src AS s, dst AS t, [src, dst] AS path FROM k UNION ALL SELECT s, dst, list_append(path, dst) FROM p JOIN k ON src = t WHERE t <> s AND (dst = s OR NOT list_contains(path, dst)) AND len(path) < 6),
b AS (SELECT s, path[:-2] AS path FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY len(path), path) AS r FROM p WHERE t = s) WHERE r = 1)
SELECT DISTINCT len(path) AS n, array_to_string(list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]), '>') AS cycle FROM b""")
def reference_cycles(spark, sf_dir):
    return graph.cycles(round_edges(memories(spark, sf_dir))).select("n", F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"))


@query(f"""{ROUND_CLOSURE}, u AS (SELECT DISTINCT dst AS id, src AS via FROM c WHERE src <> dst), d AS (SELECT dst AS id, count(*) AS degree FROM round_edges GROUP BY dst)
SELECT u.id, count(*) AS dependents, (max(d.degree) + sum(coalesce(v.degree, 0)))::BIGINT AS impact FROM u JOIN d ON d.id = u.id LEFT JOIN d v ON v.id = u.via GROUP BY u.id""")
def impact_through_cycles(spark, sf_dir):
    return graph.impact(round_edges(memories(spark, sf_dir)), condense=True)


NAME = "regexp_replace({}key, '[^a-zA-Z0-9_]', '_', 'g')"


@query(f"""{ROUND_CLOSURE} SELECT 0 AS part, id AS a, 0::BIGINT AS b, '  ' || {NAME.format('')} || '["' || key || ' [' || type || ']"]' AS line FROM memories
UNION ALL SELECT 1, src, dst, '  ' || {NAME.format('s.')} || ' --> ' || {NAME.format('t.')} FROM round_edges JOIN memories s ON s.id = src JOIN memories t ON t.id = dst
UNION ALL SELECT 2, id, 0, '  style ' || {NAME.format('')} || ' fill:#ff6b6b,stroke:#cc0000' FROM memories WHERE id IN (SELECT src FROM c WHERE src = dst)""")
def graph_document(spark, sf_dir):
    m = memories(spark, sf_dir)
    return graph.mermaid(m, round_edges(m))


@query(f"""{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, p AS (SELECT [src, dst] AS path FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION ALL SELECT list_append(path, dst) FROM p JOIN edges ON src = path[-1] WHERE NOT list_contains(path, dst) AND len(path) < 6)
SELECT len(path)::INT AS n, array_to_string(path, '>') AS chain FROM p ORDER BY len(path) DESC, array_to_string(path, '>') LIMIT 5""")
def longest_chains(spark, sf_dir):
    return graph.chains(edges(memories(spark, sf_dir)), longest=6).select("n", F.array_join(F.col("path").cast("array<string>"), ">").alias("chain")).orderBy(F.desc("n"), "chain").limit(5)


# --- tokens ---------------------------------------------------------------------------------------------------------

LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(x, '{e}') AND length(x) >= {n}{' AND NOT ends_with(x, ' + chr(39) + 'ss' + chr(39) + ')' if e == 's' else ''} THEN left(x, length(x) - {d}) || '{a}'" for e, n, d, a in tokens.ENDINGS) + " ELSE x END"
CAMEL_SQL = "CASE WHEN regexp_matches(w, '^[A-Z]+$') THEN [w] ELSE list_filter(string_split(regexp_replace(regexp_replace(w, '([A-Z][a-z])', ' \\1', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda y: y <> '') END"
SEPARATED = tokens.SEPARATORS.replace("'", "''")


def tokens_sql(value: str) -> str:
    parts = f"list_filter(list_transform({CAMEL_SQL}, lambda y: lower(y)), lambda y: length(y) >= 2 AND NOT list_contains({LISTED(tokens.STOP_WORDS)}, y))"
    stems = f"list_filter(list_transform({parts}, lambda x: {STEM_SQL}), lambda x: length(x) >= 2)"
    raw = f"list_filter(string_split_regex({value}, '{SEPARATED}'), lambda w: w <> '')"
    return f"flatten(list_transform({raw}, lambda w: CASE WHEN list_contains({LISTED(tokens.TECHNICAL)}, w) THEN [lower(w)] ELSE {stems} END))"


CODE = "key || ' handleAuthRequest HTTPServer user_ids JSON ' || value"


@query(f"{M} SELECT id, md5(array_to_string({tokens_sql(CODE)}, ' ')) AS tokens FROM memories")
def code_tokens(spark, sf_dir):
    code = F.concat("key", F.lit(" handleAuthRequest HTTPServer user_ids JSON "), F.col("value"))
    return memories(spark, sf_dir).select("id", F.md5(F.array_join(tokens.tokenize(code), " ")).alias("tokens"))


PHRASE = "the thation"


@query(f"""{M}, d AS (SELECT id, {tokens_sql("value")} AS w FROM memories), q AS (SELECT {tokens_sql(f"'{PHRASE} erer'")} AS q),
h AS (SELECT id, len(w) AS n, len(q) AS k, len(list_filter(range(1, len(w) - len(q) + 2), lambda i: w[i:i + len(q) - 1] = q)) AS matches FROM d, q WHERE len(w) >= len(q))
SELECT id, round(matches::DOUBLE / n * k, 6) AS score FROM h WHERE matches > 0""")
def phrase_search(spark, sf_dir):
    return search.phrase(memories(spark, sf_dir), f"{PHRASE} erer").select("id", r6("score").alias("score"))


@query(f"""{M}, d AS (SELECT id, {tokens_sql("value")} AS w FROM memories), q AS (SELECT {tokens_sql(f"'{PHRASE} erer inger'")} AS q)
SELECT id, round(len(list_filter(w, lambda t: list_contains(q, t)))::DOUBLE / len(list_distinct(q)), 6) AS score FROM d, q WHERE len(list_filter(w, lambda t: list_contains(q, t))) > 0 ORDER BY round(len(list_filter(w, lambda t: list_contains(q, t)))::DOUBLE / len(list_distinct(q)), 9) DESC, id LIMIT 30""")
def token_hits(spark, sf_dir):
    return search.token_hits(memories(spark, sf_dir), f"{PHRASE} erer inger", 30).select("id", r6("score").alias("score"))
