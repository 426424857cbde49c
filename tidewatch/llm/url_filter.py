"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams.

The regression is trained on a small labelled table of URLs, a parameter; ``labelled_urls`` makes the one that is used
if none is given, from the names in ``BLOCKED_NAMES`` and ``ALLOWED_NAMES``. Everything is DataFrame code; the model is
an array of ``BUCKETS`` weights, one constant in the scoring expression.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits, and is judged by the
method like any other; without labelled URLs of both kinds everything that no rule blocks is allowed; repeated rows and
columns beside page_id and url change nothing.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Names of hosts in the labelled table. Every name stands once under every ending and language, so those tell nothing.
BLOCKED_NAMES = (
    "online-casino", "casino-bonus", "bet-bonus", "free-spins", "buy-pills", "pills-shop", "adult-video", "adult-cam", "click-ads",
    "track-ads", "spam-mail", "link-farm", "poker-win", "win-lottery", "cheap-watches", "sport-bets",
)
ALLOWED_NAMES = (
    "library", "museum", "weather", "recipes", "city-news", "school", "garden", "travel-notes", "history", "open-data", "science",
    "radio", "forum", "poetry", "thread", "station", "winter", "northern", "blessing", "mathematics", "translations", "theatre",
    "fishing", "internet", "reading", "another", "thought", "shelter",
)
ENDINGS, LANGUAGES, PREFIXES = ("com", "org", "net"), ("en", "de", "fr", "es"), ("", "www.", "m.", "blog.")
GRAMS = (3, 4)
BUCKETS = 4096
STEPS, RATE, RIDGE, MOMENTUM = 40, 4.0, 1e-4, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case, and path; both empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host, all subdomains, and paths below its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column, grams: tuple = GRAMS, buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the character n-grams of ``^host`` and of ``path$``."""
    parts = []
    for tag, text in (("h", F.concat(F.lit("^"), host, F.lit("^"))), ("p", F.concat(path, F.lit("$")))):
        for n in grams:
            last = F.greatest(F.length(text) - n + 1, F.lit(0))
            starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _bucket(tag, text, n, buckets)))
    return F.array_distinct(F.concat(*parts))


def _bucket(tag: str, text: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int")


def _score(grams: Column, weights: Column, bias: Column) -> Column:
    # Scaled to unit length, as the number of n-grams differs between URLs.
    total = F.aggregate(grams, F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return bias + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def _literal(numbers: np.ndarray) -> Column:
    """An array of doubles as one constant; text, as a literal of thousands of numbers is slow to hand over one by one."""
    return F.from_json(F.lit(json.dumps(numbers.tolist())), "array<double>")


def train(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS) -> tuple[np.ndarray, float] | None:
    """Weights and bias from (grams, y): full-batch gradient steps with momentum on the bounded labelled table.

    All URLs count alike, so that what looks like neither class is judged by the larger one. Each step sums the residuals per bucket in Spark; at most
    ``buckets`` numbers come back. None without both classes.
    """
    seen = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(seen) < 2:
        return None
    total = sum(seen.values())
    weights, bias, speed, speed_b = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    for _ in range(steps):
        residual = (F.col("y") - 1 / (1 + F.exp(-_score(F.col("grams"), _literal(weights), F.lit(bias))))) / total
        share = F.col("r") / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
        spread = labelled.withColumn("r", residual).select(F.explode(F.concat("grams", F.array(F.lit(-1)))).alias("i"), share.alias("g"), "r")
        sums = spread.groupBy("i").agg(F.sum(F.when(F.col("i") < 0, F.col("r")).otherwise(F.col("g"))).alias("g"))
        gradient = np.zeros(buckets + 1)
        for i, g in sums.collect():
            gradient[i] = g  # -1, the bias, is the last
        speed = MOMENTUM * speed + RATE * (gradient[:-1] - RIDGE * weights)
        speed_b = MOMENTUM * speed_b + RATE / 4 * gradient[-1]
        weights, bias = weights + speed, bias + speed_b
    return weights, float(bias)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, y), y = 1 to block: the names under every ending and language, with changing prefixes."""
    names = spark.createDataFrame([(n, 1.0) for n in BLOCKED_NAMES] + [(n, 0.0) for n in ALLOWED_NAMES], "name string, y double")
    named = names.withColumn("end", F.explode(F.array(*map(F.lit, ENDINGS)))).withColumn("lang", F.explode(F.array(*map(F.lit, LANGUAGES))))
    turn = F.pmod(F.xxhash64("name", "end", "lang"), F.lit(10_000))
    prefix = F.get(F.array(*map(F.lit, PREFIXES)), F.pmod(turn, F.lit(len(PREFIXES))).cast("int"))
    return named.select(F.format_string("https://%s%s.example.%s/%s/%d", prefix, "name", "end", "lang", turn).alias("url"), "y")


def judge_urls(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, block_above: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row of ``pages``; ``labelled`` has (url, y)."""
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    host, path = url_parts(F.col("url"))
    examples = durable(labelled.select(gram_buckets(host, path).alias("grams"), "y"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    model = train(examples)
    if model is None:
        p = F.lit(0.0)
    else:
        weights, bias = model
        p = 1 / (1 + F.exp(-_score(gram_buckets(F.col("host"), F.col("path")), _literal(weights), F.lit(bias))))
    method = F.when(F.col("p_block") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.withColumn("p_block", p).select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "p_block")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(documents(spark, folder, "pages")).drop("p_block")
