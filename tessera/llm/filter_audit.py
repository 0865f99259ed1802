"""Filter interaction audit: what every order of a set of filters removes, where.

Orders share their prefixes: the documents that survive a set of filters don't
depend on the order inside it, so n filters have 2^n states and n * 2^(n-1)
edges (a state and the filter applied next), however many orders run through
them. A depth-first walk keeps each state's survivors persisted while its
subtree is walked, derives a child's survivors from its parent's, visits each
unordered state once, and at every edge counts by part what the filter removes.
At most n + 1 states are persisted at a time; a lost executor's part of one is
computed again from the flags, which are a table in the shared folder. The counts
stay tables too, one row a part and edge. All 120 orders then look them up.

Defined results: a null text is empty (it fails A); a null source is the part
''; a null doc_id is no larger than any other, so it never fails E; rows that
repeat a doc_id are documents of their own, and copies with the same doc_id don't
fail E for one another; labels that repeat count if any row says so, and where
null or absent not at all; an empty table gives no parts and no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, small, table, words

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
COUNTS = ["kept", "removed", "good_lost", "toxic_lost"]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit k: filter k of FILTERS refuses the document), good and toxic of every document."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    n = F.size("w")
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("w")).cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > MAX_CAPITALS_PERCENT * F.length("t").cast("long"),
        F.col("t").rlike("[#$%&*|]"),
    ]
    own = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    d = cut(d.select("doc_id", "part", own.alias("fails"), F.unhex(F.sha2("t", 256)).alias("digest")), "own-failures")
    # texts that occur once, nearly all, needn't meet anything
    copies = cut(d.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "copies")
    d = d.join(small(copies), "digest", "left")
    yes = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    known = cut(known.where("good or toxic"), "known-labels")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    d = d.select("doc_id", "part", (F.col("fails") + copy).alias("fails")).join(small(known), "doc_id", "left")
    return d.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def refuses(k: int):
    return F.col("fails").bitwiseAND(1 << k) != 0


def edge_counts(judged: DataFrame, n_filters: int) -> DataFrame:
    """part, state (bits of the filters applied before), k (the filter applied) and COUNTS for every edge where the part has survivors."""
    spark = judged.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    visited: dict[int, str] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        left = [k for k in range(n_filters) if not state >> k & 1]
        one = lambda x: F.count_if(x)
        sums = [F.struct(F.lit(k).alias("k"), one(~refuses(k)).alias("kept"), one(refuses(k)).alias("removed"), one(refuses(k) & F.col("good")).alias("good_lost"), one(refuses(k) & F.col("toxic")).alias("toxic_lost")) for k in left]
        each = survivors.groupBy("part").agg(F.array(*sums).alias("x")).select("part", F.lit(state).alias("state"), F.inline("x"))
        visited[state] = f"{folder}/{state}"
        each.write.parquet(visited[state])
        for k in left:
            below = state | 1 << k
            if below not in visited and below != 2**n_filters - 1:  # where all filters are applied, no edge leaves
                child = survivors.where(~refuses(k)).persist()
                visit(below, child)
                child.unpersist()

    root = judged.persist()
    visit(0, root)
    root.unpersist()
    schema = "part string, state int, k int, " + ", ".join(f"{c} long" for c in COUNTS)
    return spark.read.schema(schema).parquet(*visited.values())


def audit(judged: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters, zeros included.

    judged: part, fails, good, toxic. names: a letter for each filter, at most six, as the rows are n! * n for each part.
    """
    n = len(names)
    if not 1 <= n <= 6:
        raise ValueError("1 to 6 filters")
    key = lambda state, k: state * n + k
    steps, edges = [], {}
    for order in permutations(range(n)):
        state = 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": step, "key": key(state, k), "k": k})
            edges[state, k] = edges.get((state, k), 0) + 1
            state |= 1 << k
    assert all(many == factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for (s, _), many in edges.items())

    counts = edge_counts(judged, n)
    # a part has at most n * 2^(n-1) edges
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("state") * n + F.col("k"), F.struct(*COUNTS)))).alias("m"))
    at = lambda name, c: F.coalesce(F.try_element_at("m", c)[name], F.lit(0).cast("long"))
    whole = [F.struct(at("removed", F.lit(key(0, k))).alias("fails"), at("removed", F.lit(key(2**n - 1 - (1 << k), k))).alias("unique_fails"), sum((many * at("removed", F.lit(key(s, f))) for (s, f), many in edges.items() if f == k), F.lit(0).cast("long")).alias("shapley")) for k in range(n)]
    by_part = by_part.select("part", "m", F.array(*whole).alias("filters"))
    grid = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, key: int, k: int>>")
    rows = by_part.select("part", "m", "filters", F.explode(grid).alias("s"))
    own = F.get("filters", F.col("s.k"))
    return rows.select(
        "part", "s.filter_order", "s.step", at("kept", F.col("s.key")).alias("kept"), at("removed", F.col("s.key")).alias("removed"),
        (own["fails"] - at("removed", F.col("s.key"))).alias("redundant"), own["unique_fails"].alias("unique_fails"),
        at("good_lost", F.col("s.key")).alias("good_lost"), at("toxic_lost", F.col("s.key")).alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cut(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "judged")
    return audit(judged)


SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, x.b, (SELECT coalesce(sum(y.b), 0) FROM x y WHERE position(y.f IN filter_order) < step)::INT AS state
      FROM o, (SELECT unnest(range(1, 6)) AS step) t, x WHERE x.f = substring(filter_order, step, 1)),
st AS (SELECT DISTINCT state, b FROM s),
r AS (SELECT part, state, b,
        coalesce(sum(n) FILTER (WHERE mask & (state | b) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE mask & state = 0 AND mask & b <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE mask & state <> 0 AND mask & b <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = b), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & state = 0 AND mask & b <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE mask & state = 0 AND mask & b <> 0), 0) AS toxic_lost
      FROM g, st GROUP BY part, state, b),
h AS (SELECT part, b, sum(removed) AS shapley FROM s JOIN r USING (state, b) GROUP BY part, b)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM s JOIN r USING (state, b) JOIN h USING (part, b)
"""
