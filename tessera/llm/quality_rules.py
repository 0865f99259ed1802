"""Quality rules with host verdicts, in DataFrame expressions only.

Base rules judge a document by its own text. Failures are then counted by host
(the source column); each host's failure rate is shrunk towards the corpus with
a beta prior fitted to all hosts by moments, and the verdict on the host comes
back to its documents.

Defined results: a null or empty text has no words, lines or symbols and fails
the base rules; a null source is no host, so only the base rules judge it; a
host that is the only one gets the strongest prior; repeated rows are judged row
by row; an empty table gives an empty table; columns beyond doc_id, text and
source are ignored by score() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, run_hash, small, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is refused when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Limits of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (a hash of the text) and the five counts of every document."""
    d = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("_t")).withColumn("mark", F.xxhash64("_t"))
    d = d.withColumn("_w", words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "doc_id", "source", "mark", "n_words", "_w",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: run_hash(F.col("_w"), i, WINDOW))).alias("_h"),
    )
    # hashes with their places, sorted, only where some window occurs twice
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(
        "doc_id", "source", "mark", "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).alias("_s"),
    )

    def twice(x, k):
        before, after = F.get(F.col("_s"), k - 1), F.get(F.col("_s"), k + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter("_s", twice), lambda x: x["i"].cast("long")))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0).cast("long"))).drop("_s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """source, n_docs, n_failed, the shrunk rate and host_bad for every host. Rows are summed on the map side, so a hot host costs one row a task."""
    hosts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v, each = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()  # three numbers
    low, high = PRIOR_WEIGHT
    m = m or 0.0
    # what of the variance the hosts differ by, beyond what so few documents each would give by chance
    between = (v or 0.0) - m * (1 - m) * (each or 0.0)
    weight = min(high, max(low, m * (1 - m) / between - 1)) if between > 0 else high
    shrunk = (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > max_rate)


def score(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, host_rate and kept of every row of docs."""
    measured = cut(measure(docs), "quality")
    hosts = host_verdicts(measured).select("source", "host_rate", "host_bad")
    out = measured.drop("mark").join(hosts, "source", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_bad", F.lit(False))).drop("host_bad")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    measured = cut(measure(docs), "quality")
    # base rules judge a text, so its hash tells which rows to drop; the texts themselves needn't move
    failed = small(cut(measured.where("base_failed").select("mark").distinct(), "failed"))
    bad = small(host_verdicts(measured).where("host_bad").select(F.col("source").alias("host")))
    out = docs.join(failed, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == failed["mark"], "left_anti")
    return out.join(bad, docs["source"] == bad["host"], "left_anti")


def op9_quality_rules(spark, sf_dir):
    from .common import table

    return score(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON d.rid = cov.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v FROM h),
q AS (SELECT mu, CASE WHEN v > 0 THEN least(1000.0, greatest(2.0, mu * (1 - mu) / v - 1)) ELSE 1000.0 END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((f + mu * k) / (n + k) > 0.5, false) AS kept
FROM b LEFT JOIN h ON b.source = h.source CROSS JOIN q
"""
