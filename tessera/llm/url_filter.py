"""URL verdicts by host rules and, where none fits, by words segmented from host and path.

A unigram model of all words in titles and visible texts splits concatenated
names by Viterbi. Hosts and paths, and addresses within texts, aren't counted: a
name must not be a word because it is a name. Counts stay a table, joined to the
distinct substrings of the distinct runs of letters. Multinomial naive Bayes over
the segmented tokens, hashed into BUCKETS, learns from the urls that a rule
decides and judges the others.

Defined results: host and path are empty for a null url or one without `://`;
a tie, or labels of one kind only, is allowed unless all labels are block; the
longest fitting rule wins (of equal ones the first in order of text); repeated
rows are judged row by row; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .html_text import extract

# The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

MAX_LETTERS = 24
BUCKETS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ADDRESS = r"\S*(?:://|@|\p{L}\.\p{L})\S*"
#: A key with more than one in so many rows is joined by broadcast, which are fewer than so many keys.
HOT = 1000


def parts(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_for(host, path, rules: dict[str, str]):
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(sorted(rules), key=len):  # the last that fits wins
        own, slash, start = rule.partition("/")
        fits = (host == own) | host.endswith(f".{own}")
        out = F.when(fits & path.startswith(slash + start), F.lit(rule)).otherwise(out)
    return out


class Segmenter:
    """Splits runs of letters into the likeliest words."""

    def __init__(self, words: dict[str, int], total: int | None = None):
        total = (sum(words.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in words.items()}
        self.rare = math.log(total)

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = []
            for start in range(max(0, end - MAX_LETTERS), end):
                word = run[start:end]
                # an unknown word costs more with every letter
                options.append((best[start] + self.cost.get(word, self.rare + 2.3 * (end - start)), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, count of all words of titles and visible texts."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    texts = pages.select(title.alias("text")).unionByName(extract(pages).select("text"))
    runs = F.regexp_extract_all(F.lower(F.regexp_replace("text", ADDRESS, " ")), F.lit(r"(\p{L}+)"), 1)
    return texts.select(F.explode(runs).alias("word")).where(F.length("word") <= MAX_LETTERS).groupBy("word").count()


def looked_up(each: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """each joined to known, which has a key once, with the keys' number n of rows in each: hot keys by broadcast."""
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > total
    rest = each.join(F.broadcast(known.where(hot).select(key)), key, "left_anti")
    return each.join(F.broadcast(known.where(hot)), key).unionByName(rest.join(known.where(~hot), key)).drop("n")


def splits(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run and its likeliest words for each run of letters, by the counts in words; n is kept."""
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    starts = F.sequence(F.lit(1), F.length("run"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_LETTERS), F.length("run") - i + 1)), lambda k: F.substring("run", i, k))))
    each = runs.select("run", F.explode(F.array_distinct(pieces)).alias("word"))
    known = cut(each.groupBy("word").agg(F.count("*").alias("n")).join(words, "word"), "pieces")
    found = looked_up(each, known, "word").groupBy("run").agg(F.collect_list("word").alias("known"), F.collect_list("count").alias("counts"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series, counts: pd.Series) -> pd.Series:
        rows = zip(run, known, counts, strict=True)
        return pd.Series([Segmenter({} if k is None else dict(zip(k, map(int, c), strict=True)), total).split(r) for r, k, c in rows], dtype=object)

    return runs.join(found, "run", "left").select("run", "n", split("run", "known", "counts").alias("words"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block, where the method judged) of every row."""
    spark = pages.sparkSession
    words = cut(word_counts(pages), "words")
    host, path = parts(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    d = cut(d, "rows")

    def runs(kind, text):
        return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\p{Nd}+)"), 1), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("run")))

    each = d.select("row", F.explode(F.concat(runs("h:", F.col("host")), runs("p:", F.lower("path")))).alias("x")).select("row", "x.kind", "x.run")
    digits = F.col("run").rlike(r"^\p{Nd}")
    letters = cut(splits(each.where(~digits).groupBy("run").agg(F.count("*").alias("n")), words), "splits")
    # h: words of the host, p: words of the path; a run of digits is its length
    tokens = looked_up(each.where(~digits), letters, "run").select("row", "kind", F.explode("words").alias("word"))
    tokens = tokens.unionByName(each.where(digits).select("row", "kind", F.concat(F.lit("#"), F.length("run")).alias("word")))
    bucket = F.pmod(F.xxhash64(F.concat("kind", "word")), F.lit(BUCKETS)).cast("int")
    buckets = tokens.groupBy("row").agg(F.sort_array(F.collect_list(bucket)).alias("buckets"))
    d = d.join(buckets, "row", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<int>"))).drop("row")
    d = cut(d, "urls")
    blocks = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    known = d.where("rule is not null").withColumn("block", blocks.cast("long"))
    n, n_block = known.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    seen = known.select("block", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("block").alias("block"), F.count("*").alias("n")).collect()  # at most BUCKETS rows
    counts = np.ones((2, BUCKETS))  # add one
    for r in seen:
        counts[0, r["bucket"]] += r["block"]
        counts[1, r["bucket"]] += r["n"] - r["block"]
    p = np.log(counts / counts.sum(axis=1, keepdims=True))
    weight = spark.sparkContext.broadcast((p[0] - p[1]).astype(np.float32))
    prior = math.log(n_block / (n - n_block)) if 0 < n_block < n else (math.inf if n and n_block == n else -math.inf)

    @F.pandas_udf("double")
    def odds(buckets: pd.Series) -> pd.Series:
        return pd.Series([prior + float(weight.value[np.asarray(b, np.int64)].sum()) for b in buckets])

    score = F.when(F.col("rule").isNull(), odds("buckets"))
    d = d.withColumn("score", score)
    by_rule = F.when(blocks, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("score") > 0, "block").otherwise("allow")
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")
