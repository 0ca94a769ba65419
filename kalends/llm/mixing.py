"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies each of its documents is expected to have. The whole part
is certain. For the rest every document has an inclusion probability p; documents are ranked by u / (1 - u) over
p / (1 - p), u being a hash of doc_id. The sample's size is fixed in words, the unit of the targets: the source takes the
leading documents as long as their words fit in what is left of its target, and passes over one that doesn't until none
fits any more. Buckets of rank, as many as a source's documents ask for, find where words run out, so no source, however large, is
sorted in one task; they don't change what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stage

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
#: Rows of a source that are sorted together, about; of a very large source the root of their number, as many as its buckets.
SORTED_ROWS = 5_000
#: Words from which a document is liked twice as much as a shorter one by the query: fragments seldom make good examples.
WHOLE_WORDS = 50
#: Sources up to which their table, a row each, is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def preferred() -> Column:
    """The query's preference."""
    return F.when(F.col("size") >= WHOLE_WORDS, 2).otherwise(1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds each source's target words to sizes(source, source_size), a row per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops
    at max_copies times the source's size; the excess is shared again by weight until none is above. The sources
    that stop are those least in size over weight, so one ordered pass over the sources finds them.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), (order - 1) % len(weights)))
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum(F.col("source_size") * max_copies).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = weighed.select("*", ((total - before) / rest).alias("level"), (F.col("source_size") * max_copies).alias("most"))
    free = F.max(F.when(F.col("most") > F.col("level") * F.col("w"), F.col("level"))).over(Window.partitionBy())
    stops = F.col("most") <= F.col("level") * F.col("w")
    return leveled.withColumn("target", F.when(stops | free.isNull(), F.col("most").cast("double")).otherwise(free * F.col("w"))).select("source", "source_size", "target")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from md5, the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, sorted_rows: int = SORTED_ROWS, preference: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (copies x size) of every document.

    preference: a positive column of doc_id, source and size that documents of a source are favoured by: expected copies are in proportion to it, as
    long as they are below max_copies, which none exceeds. None: all alike. The result is the same for every sorted_rows. Null texts have size 0; documents of size 0 take no words and aren't drawn. Documents of a null source form one
    source. Equal u (rows that repeat a doc_id) go by doc_id and size; a rerun takes the same. Other columns are
    ignored; an empty table gives an empty result.
    """
    liking = F.lit(1.0) if preference is None else preference.cast("double")
    sized = stage(docs.select(F.col("doc_id").cast("long"), "source", n_words("text").alias("size"), *carry).withColumn("liking", liking))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    shares = targets(sums, weights, max_copies).join(sums.select(F.col("source").alias("s"), F.least(F.ceil(F.col("docs") / sorted_rows), F.ceil(F.sqrt("docs"))).alias("buckets")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shares = _rates(sized, shares, max_copies)
    few = shares.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else lambda df: df

    right = hint(shares.withColumnRenamed("source", "s"))
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(max_copies)), F.col("rate") * F.col("liking"))).otherwise(F.lit(0.0))
    u, p = uniform(F.col("doc_id"), seed), F.col("expected") - F.col("whole")
    odds = F.col("u") / (1 - F.col("u"))
    scored = (
        sized.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("u", u)
        .withColumn("rank", F.when(p > 0, odds / (p / (1 - p))))
        .withColumn("bucket", F.when(p > 0, F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")), F.col("buckets") - 1)).cast("long"))
    )
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()))
    certain = scored.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("whole")).alias("certain"))
    # Sizes are whole numbers, so what fits in the gap fits in its whole part.
    gaps = stage(certain.select(F.col("source").alias("s"), F.floor(F.col("target") - F.col("certain")).alias("gap")))
    open_rows = scored.where("bucket is not null").select("source", "row", "bucket", "rank", "u", "doc_id", "size")
    open_rows = open_rows.join(hint(gaps), F.col("source").eqNullSafe(F.col("s"))).drop("s").where(F.col("size") <= F.col("gap"))
    first = stage(_leading(stage(open_rows), hint))
    used = first.groupBy(F.col("source").alias("t")).agg(F.sum("size").alias("used"))
    gaps = stage(gaps.join(hint(used), F.col("s").eqNullSafe(F.col("t")), "left").select("s", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
    left = open_rows.drop("gap").join(first.select(F.col("row").alias("r")), F.col("row") == F.col("r"), "left_anti")
    left = left.join(hint(gaps), F.col("source").eqNullSafe(F.col("s"))).drop("s").where(F.col("size") <= F.col("gap"))
    extra = first.select(F.col("row").alias("r")).unionByName(_fitting(left).select(F.col("row").alias("r")))
    copies = F.col("whole") + F.col("r").isNotNull().cast("long")
    return scored.join(extra, F.col("row") == F.col("r"), "left").select(
        *carry, "doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def _rates(sized: DataFrame, shares: DataFrame, max_copies: int) -> DataFrame:
    """shares with rate: a document of a source is expected rate x liking times, max_copies at most, so that the target is met.

    What documents at max_copies leave is shared by the others until no more of them reach it; every step aggregates once.
    """
    shares = stage(shares.withColumn("rate", F.lit(0.0)))
    stops = -1
    while True:
        known = shares.select(F.col("source").alias("s"), "target", F.col("rate").alias("before"))
        full = (F.col("before") > 0) & (F.col("before") * F.col("liking") >= max_copies)
        words = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("stopped"), F.count_if(full).alias("stops"),
            F.sum(F.when(full, 0).otherwise(F.col("size") * F.col("liking"))).alias("liked"),
        )
        rate = F.when(F.col("liked") > 0, (F.col("target") - F.col("stopped") * float(max_copies)) / F.col("liked")).otherwise(F.greatest("rate", F.lit(0.0)))
        shares = stage(shares.join(words, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate).drop("s", "stopped", "liked"))
        now = shares.agg(F.sum("stops")).first()[0]
        shares = shares.drop("stops")
        if now == stops or now is None:
            return shares
        stops = now


def _fitting(rows: DataFrame) -> DataFrame:
    """row of what a source takes of its rows in order of rank, each that still fits in its gap, until none does.

    Of documents of one size only the first gap / size can be taken. So a source's rows that are walked through are bounded by
    its gap, which the first document that did not fit exceeds, and not by how many rows there are.
    """
    order = ("rank", "u", "doc_id", "size", "row")
    for key in (["source", "size", "bucket"], ["source", "size"]):  # a size that very many share is cut down by bucket first
        n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        rows = rows.withColumn("n", n).where(F.col("n") <= F.floor(F.col("gap") / F.col("size")))

    def walk(part):
        gap, taken = int(part["gap"].iloc[0]), []
        for row, size in part.sort_values(list(order), na_position="first")[["row", "size"]].itertuples(index=False):
            if size <= gap:
                gap -= size
                taken.append(row)
        return part[part["row"].isin(taken)][["row"]]

    return rows.groupBy("source").applyInPandas(walk, "row long")


def _leading(rows: DataFrame, hint) -> DataFrame:
    """source, row, size of each source's leading rows whose sizes add up to its gap at most. Only one bucket of a source is sorted."""
    source = Window.partitionBy("source")
    run = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("gap").alias("gap")).withColumn("upto", F.sum("words").over(source.orderBy("bucket")))
    cut = run.where(F.col("upto") > F.col("gap")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
    cut = hint(stage(cut.select(F.col("source").alias("s"), F.col("at.bucket").alias("cut"), F.col("at.before").alias("before"))))
    ranked = rows.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    order = source.orderBy("rank", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    close = ranked.where(F.col("bucket") == F.col("cut")).withColumn("upto", F.col("before") + F.sum("size").over(order)).where(F.col("upto") <= F.col("gap"))
    clear = ranked.where(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))
    return clear.select("source", "row", "size").unionByName(close.select("source", "row", "size"))


ORACLE = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM sized GROUP BY source
), leveled AS (
  SELECT *, CAST(source_size AS DOUBLE) * {MAX_COPIES} AS most,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * {MAX_COPIES}) OVER (
      ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sums
), shares AS (
  SELECT source AS s, source_size, CASE WHEN most <= level * w OR free IS NULL THEN most ELSE free * w END AS target
  FROM (SELECT *, max(CASE WHEN most > level * w THEN level END) OVER () AS free FROM leveled)
), liked AS (
  SELECT source, CASE WHEN size >= {WHOLE_WORDS} THEN 2 ELSE 1 END AS liking, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL
), halves AS (
  SELECT s, source_size, target, coalesce(sum(words) FILTER (liking = 1), 0) AS fragments, coalesce(sum(words) FILTER (liking = 2), 0) AS wholes
  FROM shares JOIN liked ON source IS NOT DISTINCT FROM s GROUP BY ALL
), rates AS (
  SELECT s, source_size, target, CASE WHEN fragments > 0 AND target / (fragments + 2.0 * wholes) * 2 >= {MAX_COPIES} THEN (target - wholes * {MAX_COPIES}.0) / fragments
    WHEN fragments + wholes > 0 THEN target / (fragments + 2.0 * wholes) ELSE 0.0 END AS rate FROM halves
), scored AS (
  SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM (
    SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM (
      SELECT *, CASE WHEN size > 0 THEN least({MAX_COPIES}.0, rate * CASE WHEN size >= {WHOLE_WORDS} THEN 2 ELSE 1 END) ELSE 0.0 END AS expected
      FROM sized JOIN rates ON source IS NOT DISTINCT FROM s))
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, doc_id, size) AS n,
    floor(target - sum(size * whole) OVER (PARTITION BY source)) AS gap FROM scored
), walk AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS n, gap FROM ordered
  UNION ALL
  SELECT w.source, min(o.n), w.gap - arg_min(o.size, o.n) FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source
  WHERE o.rank IS NOT NULL AND o.n > w.n AND o.size <= w.gap GROUP BY w.source, w.gap
)
SELECT doc_id, size, o.source, source_size, target, whole + CAST(w.n IS NOT NULL AS BIGINT) AS copies, (whole + CAST(w.n IS NOT NULL AS BIGINT)) * size AS taken
FROM ordered o LEFT JOIN walk w ON o.source IS NOT DISTINCT FROM w.source AND o.n = w.n
"""
