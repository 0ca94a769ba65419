"""Quality by weak supervision: rules vote good or bad or abstain, EM estimates how far each is to be trusted.

The votes of a document make a pattern; there are at most 3 ** len(RULES) patterns, so Spark counts documents per
pattern and the driver fits the label model on those counts. Every document then gets its pattern's
posterior probability of being good, in place of a filter that all rules must pass.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_ABOVE = 0.5
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name to vote: 1 good, -1 bad, 0 abstains. Only proportions of the text's own counts, in no one language; its length is left to the base rule.

    Rules may warn early and of much that is good: how far a warning is to be trusted is what the label model finds out.
    Repeated lines also repeat words, so both are one rule: rules should err apart from each other.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean = F.col("word_chars") / words
    symbols, dup = F.col("n_symbols") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    repeat, letters = F.col("n_repeat_words") / words, F.col("n_letters") / chars
    lines = F.col("n_lines") / words
    return {
        "mean_word": _vote(mean.between(4, 7), (mean < 3.5) | (mean > 7.5)),
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "repetition": _vote((dup < 0.05) & (repeat < 0.05), (dup > 0.1) | (repeat > 0.1)),
        "letters": _vote(letters > 0.95, letters < 0.9),
        "line_length": _vote(lines < 0.05, lines > 0.08),
    }


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    lines, seen, dup = text.split("\n"), set(), 0
    n_lines = 0
    for line in lines:
        if line.strip(_SPACES):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, n = 0, len(words)
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often, covered = {w for w, c in Counter(windows).items() if c > 1}, 0
        for i, w in enumerate(windows):
            if w in often:
                repeat += i + 3 - max(covered, i)
                covered = i + 3
    chars = len(text) - sum(map(text.count, _SPACES))
    letters = sum(c for ch, c in Counter(text).items() if ch.isalpha() or ch.isdigit())
    return n, chars, sum(map(text.count, _SYMBOLS)), dup, repeat, n_lines, letters


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every document."""

    def run(batches):
        for b in slices(batches):
            rows = np.array([measure(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What a rule is thought to vote of a bad and of a good document before any is seen, as parts of one document: bad, none, good.
PRIOR = ((0.4, 0.2, 0.4), (0.1, 0.2, 0.7))
#: Documents thought bad and good before any is seen.
PRIOR_SHARE = (1.0, 3.0)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM of the label model over vote patterns (rows of 1, -1, 0) and their document counts.

    A rule has its own odds of voting good, voting bad and abstaining on good and on bad documents, so a warning weighs
    what the other rules bear out, whatever its sign or size. EM starts from the shares of votes, a warning weighing as much
    as all rules together; the prior of each rule and class is worth one document, so data soon outweigh it. Abstentions
    carry no weight.

    Returns the odds (rule, class bad or good, vote bad, none or good), the share of good documents, and each
    pattern's posterior probability of being good.
    """
    vote = np.stack([patterns < 0, patterns == 0, patterns > 0], axis=2).astype(np.float64)  # pattern, rule, vote
    prior, n_rules = np.array(PRIOR), patterns.shape[1]
    warnings, praise = vote[:, :, 0].sum(axis=1), vote[:, :, 2].sum(axis=1)
    posterior, good, odds = (1 + praise) / (2 + praise + n_rules * warnings), 0.5, np.empty((n_rules, 2, 3))
    for _ in range(rounds):
        weight = counts * np.stack([1 - posterior, posterior])  # class, pattern
        odds = np.einsum("cp,prv->rcv", weight, vote) + prior
        odds /= odds.sum(axis=2, keepdims=True)
        good = (weight[1].sum() + PRIOR_SHARE[1]) / (counts.sum() + sum(PRIOR_SHARE))
        ratio = np.log(odds[:, 1] / odds[:, 0])  # rule, vote
        ratio[:, 1] = 0
        score = np.einsum("prv,rv->p", vote, ratio) + math.log(good / (1 - good))
        posterior = 1 / (1 + np.exp(-score))
    return odds, good, posterior


def judge(docs: DataFrame, keep_above: float = KEEP_ABOVE) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (posterior of being good) and kept of every document.

    base_failed: fewer than MIN_WORDS words, or more than half of them in repeated 3-word windows. kept: not
    base_failed and quality of keep_above or more. Null, empty and wordless texts have zero counts and fail. Rows
    that repeat come back as often; a null doc_id is judged like any other; other columns are ignored; an empty table
    gives an empty result. The model learns from all documents that the base rule leaves, as only they await its verdict.
    """
    counts = stage(measured(docs))
    votes = F.concat_ws(",", *(v.cast("string") for v in rules().values()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = counts.withColumn("votes", votes).withColumn("base_failed", failed)
    seen = voted.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("n")).orderBy("votes").collect()  # 3 ** len(rules()) rows at most
    patterns = np.array([list(map(int, r["votes"].split(","))) for r in seen], np.int64).reshape(-1, len(rules()))
    _, _, posterior = fit(patterns, np.array([r["n"] for r in seen], np.float64))
    spark = docs.sparkSession
    quality = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, posterior)], "votes string, quality double")
    return (
        voted.join(F.broadcast(quality), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_above))
        .select("doc_id", *COUNTS, "base_failed", "quality", "kept")
    )
