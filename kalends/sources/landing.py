"""Landed responses of a reservation site: requests in bulk, classification and counts of what came back.

The live fetcher stays outside Spark's parallelism (one polite reader); everything here works on landed rows
(endpoint, url, status, body, attempts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_block_page

#: Statuses that are asked for again.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def classify(status: Column, body: Column, json: Column | None = None, mark: str | None = None) -> Column:
    """ok, retry, error, empty, blocked or malformed. json: whether the body must be a JSON list; mark: what an HTML body, one
    that need not be JSON, must contain (the tag or class of the part that is going to be read)."""
    said = F.when(status.isin(*RETRYABLE), "retry").when((status < 200) | (status >= 300), "error")
    said = said.when(body.isNull() | (F.trim(body) == ""), "empty").when(is_block_page(body), "blocked")
    if json is not None:
        root = F.schema_of_variant(F.try_parse_json(F.regexp_replace(body, "^﻿", "")))
        said = said.when(json & ~F.coalesce(root.startswith("ARRAY"), F.lit(False)), "malformed")
    if mark is not None:
        said = said.when(~body.contains(mark) & (~json if json is not None else F.lit(True)), "malformed")
    return said.otherwise("ok")


#: How often a request is asked again, and the seconds below which its jitter stays.
RETRIES, JITTER = 2, 0.25


def backoff_seconds(attempt: Column, base: float = 0.5, share: Column | None = None) -> Column:
    """The wait before a further attempt (0 is the first one made): doubling, and a share (0 to 1, F.rand() say) of the jitter."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return wait if share is None else wait + share * JITTER


def asks_again(outcome: Column, attempt: Column, retries: int = RETRIES) -> Column:
    """Whether a request whose attempt came out so is made again: only what may pass, and only within the budget. Null is not."""
    return F.coalesce((outcome == "retry") & (attempt < retries), F.lit(False))


def request_counts(requests: DataFrame) -> DataFrame:
    """Attempts per endpoint (null if unknown) and in total: endpoint, n."""
    counted = requests.rollup("endpoint").agg(F.count(F.lit(1)).alias("n"), F.grouping("endpoint").alias("all"))
    return counted.select(F.when(F.col("all") == 1, "total").otherwise(F.col("endpoint")).alias("endpoint"), "n")


def count_delta(before: DataFrame, after: DataFrame, key: str = "endpoint") -> DataFrame:
    """How counts(key, n) grew; keys that never counted anything vanish, a zero growth stays."""
    b, a = before.select(key, F.col("n").alias("b")), after.select(key, F.col("n").alias("a"))
    a_, b_ = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return b.join(a, key, "full").where(F.greatest(a_, b_) > 0).select(key, (a_ - b_).alias("delta"))
