"""URL filtering by rules and, where none fits, by trust that flows along links between hosts.

Hosts of allowed pages are trusted seeds, hosts of blocked pages blocked seeds. Trust follows links (personalised
PageRank); distrust runs against them, from a blocked host to those that link to it. Both run in one table of ranks.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rule (host and path) to verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING = 0.85
#: Rounds go on until masses move by less than this part of the seeds' mass.
TOLERANCE = 1e-6
#: Rounds between two writes to the shared folder.
STAGED_EVERY = 3
#: A host is blocked if its distrust per page is above so many times the average of all pages, and above its trust.
THRESHOLD = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""
_LINK = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path the url's path starts with; or null."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in ordered)) if ordered else F.lit(None).cast("string")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links from pages of one host lead to another. Links inside a host don't count."""
    target = F.translate(F.regexp_extract(F.col("href"), _LINK, 1), _UPPER, _LOWER)
    return (
        pages.select(host_and_path(F.col("url"))[0].alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))).alias("href"))
        .where("src <> ''").select("src", target.alias("dst")).where("dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, max_rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, mass from seeds(kind, host, mass): mass of seeds plus damped mass that arrives along links.

    Trust goes from src to dst, distrust from dst to src, each time split by the number of links; what reaches a
    host without links ends there. Rounds go on until the masses change in sum by less than the tolerance times the seeds'
    mass, which damping guarantees; max_rounds, if given, ends them earlier.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = stage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("n") / F.col("all")).alias("share")))
    seeds = stage(seeds)
    least = tolerance * (seeds.agg(F.sum("mass")).first()[0] or 0.0)
    mass, done, n = seeds, edges.isEmpty(), 0
    while not done and (max_rounds is None or n < max_rounds):
        n += STAGED_EVERY
        for _ in range(STAGED_EVERY):
            before = mass
            arriving = edges.join(mass.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("mass")).alias("mass"))
            mass = seeds.unionByName(arriving).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        old = before.select("kind", "host", F.col("mass").alias("old"))
        mass = stage(mass.join(old, ["kind", "host"], "left").select("kind", "host", "mass", F.abs(F.col("mass") - F.coalesce("old", F.lit(0.0))).alias("moved")))
        done = (mass.agg(F.sum("moved")).first()[0] or 0.0) <= least
        mass = mass.drop("moved")
    return mass


def judge(pages: DataFrame, rules: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page.

    A page that a rule fits gets the rule's verdict. Any other is blocked if its host's distrust per page exceeds
    both `threshold` times the average and the host's trust per page. Masses of either kind are scaled to sum to the
    number of pages, which is the same as handing what reaches hosts without links back to the seeds; so a mass of one
    per page is the average. Null urls and urls without `://` have an
    empty host and path, fit no rule and are allowed; null html has no links. Rows that repeat count as often
    as they come; other columns are ignored; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    said = [F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()]
    ruled = ruled.withColumn("said", F.coalesce(*said) if said else F.lit(None).cast("string"))
    hosts = stage(ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")
    ))
    totals = hosts.agg(F.sum("pages"), F.sum("allowed"), F.sum("blocked")).first()
    seeds = [
        hosts.where(F.col(c) > 0).select(F.lit(k).alias("kind"), "host", (F.col(c) * (float(totals[0]) / t)).alias("mass"))
        for k, c, t in (("trust", "allowed", totals[1]), ("distrust", "blocked", totals[2])) if t
    ]
    if seeds:
        mass = propagate(host_links(pages), reduce(DataFrame.unionByName, seeds))
        whole = F.broadcast(mass.groupBy("kind").agg(F.sum("mass").alias("whole")))  # two rows
        mass = mass.join(whole, "kind").select("kind", "host", (F.col("mass") / F.col("whole") * float(totals[0])).alias("mass"))
        per_page = mass.groupBy("host").agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust")
        )
        def rate(c: str) -> Column:
            return F.round(F.coalesce(c, F.lit(0.0)) / F.col("pages"), 9)

        found = hosts.join(per_page, "host").select("host", rate("trust").alias("trust"), rate("distrust").alias("distrust"))
        bad = stage(found.where((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("by_host")))
        ruled = ruled.join(bad, "host", "left")
    else:
        ruled = ruled.withColumn("by_host", F.lit(None).cast("string"))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("said", "by_host", F.lit("allow")).alias("verdict"))
