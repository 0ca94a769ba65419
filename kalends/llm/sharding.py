"""Placement of documents by a weighted hash tree of regions, racks and shards, in DataFrame functions alone.

At each level the children of the chosen node draw -ln(u) / weight, u being a hash of level, node and doc_id, and the
least draw wins; a node's weight is the sum of its shards'. A changed weight changes one draw per level on its path,
so rows move only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_buckets, stage

SHARDS = 40
#: Rows that one window numbers, about.
NUMBERED_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, racks: int = 2, per_rack: int = 4) -> tuple[Leaf, ...]:
    """A tree of so many equal shards, filled region by region."""
    return tuple(Leaf(i // (racks * per_rack), i // per_rack % racks, i) for i in range(shards))


def grown(leaves: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a region of its own: it is the only subtree that gains, so rows move only into it."""
    return (*leaves, Leaf(max(x.region for x in leaves) + 1, 0, max(x.shard for x in leaves) + 1, weight))


def _at(constants: list, index: Column) -> Column:
    """An element of a constant list by a zero-based index column."""
    return F.get(F.array(*map(F.lit, constants)), index)


def _least_draw(level: int, parent: list[Column], weights: list[Column], key: Column) -> Column:
    """The position of the child with the least draw; children without weight draw nothing."""
    draws = []
    for k, w in enumerate(weights):
        mixed = F.xxhash64(F.lit(level).cast("long"), *parent, F.lit(k).cast("long"), key)
        u = (F.shiftrightunsigned(mixed, 11).cast("double") + 1) / float(1 << 53)
        draws.append(F.when(w > 0, F.struct((-F.ln(u) / w).alias("draw"), F.lit(k).alias("k"))))
    return F.array_min(F.array(*draws))["k"]


def place(docs: DataFrame, leaves: tuple[Leaf, ...], key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Adds the shard that a row's key falls to. Rows with a null key share one place."""
    regions = sorted({x.region for x in leaves})
    racks = {r: sorted({x.rack for x in leaves if x.region == r}) for r in regions}
    shards = {(r, k): sorted(((x.shard, x.weight) for x in leaves if (x.region, x.rack) == (r, k))) for r in regions for k in racks[r]}
    wide, deep = max(map(len, racks.values())), max(map(len, shards.values()))
    by_rack = [[shards[r, racks[r][k]] if k < len(racks[r]) else [] for k in range(wide)] for r in regions]
    weight = [[[s[1] for s in rack] + [0.0] * (deep - len(rack)) for rack in region] for region in by_rack]
    name = [s for region in by_rack for rack in region for s in [s[0] for s in rack] + [-1] * (deep - len(rack))]
    rack_sum = [[float(sum(w)) for w in region] for region in weight]
    hashed, region, rack, leaf = F.col(key).cast("long"), F.col("_region"), F.col("_rack"), F.col("_leaf")
    of_region = [F.lit(float(sum(x))) for x in rack_sum]
    of_rack = [_at([x[i] for x in rack_sum], region) for i in range(wide)]
    of_leaf = [_at([w[i] for x in weight for w in x], region * wide + rack) for i in range(deep)]
    return (
        docs.withColumn("_region", _least_draw(1, [], of_region, hashed))
        .withColumn("_rack", _least_draw(2, [region.cast("long")], of_rack, hashed))
        .withColumn("_leaf", _least_draw(3, [region.cast("long"), rack.cast("long")], of_leaf, hashed))
        .withColumn(into, _at(name, (region * wide + rack) * deep + leaf))
        .drop("_region", "_rack", "_leaf")
    )


def numbered(placed: DataFrame, rows: int, per_bucket: int = NUMBERED_ROWS) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: rows are numbered in hashed buckets, after all rows of lower buckets."""
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets(rows, per_bucket))))
    sizes = bucketed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        bucketed.withColumn("inside", inside).join(before, ["shard", "bucket"])
        .withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside", "bucket")
    )


def shard(docs: DataFrame, leaves: tuple[Leaf, ...] | None = None, per_bucket: int = NUMBERED_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every document.

    size: UTF-8 bytes of the text plus 16; a null text counts as empty, its crc32 as 0. The law is `key`: doc_id and
    the tree decide alone, so equal texts of different documents may part. Rows that repeat a doc_id share a
    shard and get slots of their own; null doc_ids share one shard. Texts aren't shuffled. Other columns are
    ignored; an empty table gives an empty result.
    """
    leaves = leaves or tree()
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = stage(place(place(digest, leaves), grown(leaves), into="grown_shard"))
    return numbered(placed, placed.count(), per_bucket).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
