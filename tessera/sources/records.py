"""The memory tables over the given fixtures: records from documents, calls from events, vectors from embeddings.

Everything a record has besides its text follows from its id, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record types, states, and evidence levels with their weights.
TYPES = ["convention", "decision", "architecture", "entity", "lesson", "preference", "pattern", "execution", "operational", "environment", "anti_pattern"]
STATUSES = ["live", "live", "live", "live", "pending", "archived"]
EVIDENCE = {"verified": 1.0, "declared": 0.95, "observed": 0.9, "inferred": 0.75, "disputed": 0.5}

#: The clock of all queries.
AS_OF = "2025-09-01"


def choice(of: str, values: list[str]) -> str:
    """SQL for one of values by a number."""
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Column -> SQL over documents, in words that Spark and ANSI engines share.
COLUMNS = {
    "id": "doc_id",
    "project_id": "coalesce(source, 'none')",
    "key": "lower(substring(coalesce(text, ''), 1, 24))",
    "value": "coalesce(text, '')",
    "type": choice("doc_id", TYPES),
    "status": choice("doc_id", STATUSES),
    "evidence": f"CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {choice('doc_id', list(EVIDENCE))} END",
    "agent": "'agent' || CAST(doc_id % 7 AS VARCHAR(9))",
    "path": "'src/' || coalesce(lang, 'xx') || '/mod' || CAST(doc_id % 20 AS VARCHAR(9)) || '.ts'",
    "tags": "CASE WHEN doc_id % 6 <> 0 THEN split('t' || CAST(doc_id % 5 AS VARCHAR(9)) || ',s' || CAST(doc_id % 3 AS VARCHAR(9)), ',') END",
    "conditions": "CASE WHEN doc_id % 3 = 0 THEN split('on ci' || CAST(doc_id % 4 AS VARCHAR(9)) || ',local', ',') END",
    "phases": "CASE WHEN doc_id % 4 <> 1 THEN split('plan,phase' || CAST(doc_id % 3 AS VARCHAR(9)), ',') END",
    "n_refs": "CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END",
    "examples": "CASE WHEN doc_id % 8 = 0 THEN split('one,two', ',') END",
    "confidence": "CAST((doc_id * 37) % 101 AS DOUBLE) / 100",
    "accesses": "(doc_id * 13) % 60",
    "created_on": "DATE '2024-01-01' + CAST((doc_id * 7) % 400 AS INT)",
    "updated_on": "DATE '2024-01-01' + CAST((doc_id * 7) % 400 + (doc_id * 11) % 200 AS INT)",
}

#: The same as common table expressions, for oracles.
MEMORIES_SQL = "memories AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM documents)"
EDGES_SQL = "edges AS (SELECT DISTINCT r.src, r.dst FROM (SELECT id AS src, id * 3 + 1 AS dst FROM memories WHERE id % 4 < 3 UNION ALL SELECT id, id + 7 FROM memories WHERE id % 5 = 0) r JOIN memories t ON t.id = r.dst WHERE r.src <> r.dst)"
#: Further references that run in circles of two, three and five records, and two circles that share a record.
ROUND = [f"CASE id % 50 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 10 THEN 3 WHEN 13 THEN -3 {' '.join(f'WHEN {k} THEN 1' for k in range(45, 49))} WHEN 49 THEN -4 END", "CASE id % 100 WHEN 20 THEN 1 WHEN 21 THEN -1 WHEN 22 THEN -1 END", "CASE id % 100 WHEN 21 THEN 1 END"]
ROUND_EDGES_SQL = "round_edges AS (SELECT src, dst FROM edges UNION SELECT r.src, r.dst FROM (" + " UNION ALL ".join(f"SELECT id AS src, id + {x} AS dst FROM memories" for x in ROUND) + ") r JOIN memories t ON t.id = r.dst)"
CALLS_SQL = "calls AS (SELECT event_id, ts, 'agent' || CAST(user_id % 25 AS VARCHAR) AS agent, user_id, event_type AS tool, value FROM events)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])


def references(records: DataFrame) -> DataFrame:
    """src, dst of every reference that a record names, whether its target exists or not."""
    refs = F.array_compact(F.array(F.when(F.col("id") % 4 < 3, F.col("id") * 3 + 1), F.when(F.col("id") % 5 == 0, F.col("id") + 7)))
    return records.select(F.col("id").alias("src"), F.explode(refs).alias("dst"))


def edges(records: DataFrame) -> DataFrame:
    """References restricted to known records, without loops of one."""
    known = records.select(F.col("id").alias("dst"))
    return references(records).where("src <> dst").join(known, "dst", "left_semi").select("src", "dst").distinct()


def round_edges(records: DataFrame) -> DataFrame:
    """edges() and the references that run in circles."""
    more = F.array_compact(F.array(*[F.expr(f"id + {x}") for x in ROUND]))
    known = records.select(F.col("id").alias("dst"))
    return edges(records).unionByName(records.select(F.col("id").alias("src"), F.explode(more).alias("dst")).join(known, "dst", "left_semi").select("src", "dst")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.concat(F.lit("agent"), (F.col("user_id") % 25).cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", agent.alias("agent"), "user_id", F.col("event_type").alias("tool"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
