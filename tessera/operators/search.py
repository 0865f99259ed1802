"""Search by tokens of code-like texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.functions.dates import let


def query_tokens(records: DataFrame, query: str) -> list[str]:
    """The query's tokens, by the same rules as the texts'."""
    return records.sparkSession.range(1).select(tokens.tokenize(F.lit(query))).first()[0]


def phrase(records: DataFrame, query: str) -> DataFrame:
    """id, score of records whose value holds the query's tokens one after another: matches per token, times the phrase's length."""
    wanted = query_tokens(records, query)
    k = len(wanted)

    def counted(w: Column) -> Column:
        here = lambda i: reduce(Column.__and__, [F.get(w, i + j) == t for j, t in enumerate(wanted)])
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), here)
        return F.struct(F.size(places).alias("matches"), F.size(w).alias("n"))

    if not k:
        return records.select("id", F.lit(0.0).alias("score")).limit(0)
    found = records.select("id", let(tokens.tokenize(F.col("value")), counted).alias("c")).where("c.matches > 0")
    return found.select("id", (F.col("c.matches") / F.col("c.n") * k).alias("score"))


def token_hits(records: DataFrame, query: str, limit: int) -> DataFrame:
    """id, score: places that hold one of the query's tokens over the number of those tokens."""
    wanted = sorted(set(query_tokens(records, query)))
    known = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    hits = F.size(F.filter(tokens.tokenize(F.col("value")), lambda t: F.array_contains(known, t)))
    out = records.select("id", (hits / max(1, len(wanted))).alias("score")).where("score > 0")
    return out.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
