"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths are small integers, so documents of one length are alike to the packer: it only needs how many pieces there are
of each length, at most `capacity` numbers. The driver packs those, longest first: a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and all pieces and bins that are alike move together, which
gives the bins that one-by-one best-fit decreasing gives. The plan says which ranks within a length go to which
run of bins; ranks are found by Spark, two-level, so that a length that a third of the pieces share is spread out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_buckets, stage, text_slices, tidy
from .tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096
#: Pieces that one window sorts, about.
RANKED_ROWS = 50_000
#: Bytes of text that are encoded together, about; bounds what a worker holds besides the words it remembers.
ENCODED_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity that says which have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, first: int, n: int) -> None:
        """Opens n bins, numbered from first, with this capacity remaining."""
        self.groups[remaining].append((first, n))
        at = remaining + self.leaves
        while at and not self.open[at]:
            self.open[at] = True
            at //= 2

    def take(self, remaining: int) -> tuple[int, int]:
        group = self.groups[remaining].pop()
        if not self.groups[remaining]:
            at = remaining + self.leaves
            self.open[at] = False
            while at > 1 and not (self.open[at] or self.open[at ^ 1]):
                at //= 2
                self.open[at] = False
        return group

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds length."""
        at = length + self.leaves
        while not self.open[at]:
            while at & 1:
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, pieces per bin, first bin, offset), by length and rank: how pieces fill bins."""
    tree, bins, plan = CapacityTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                new = -(-left // (capacity // length))
                tree.put(capacity, bins, new)
                bins += new
                continue
            first, n = tree.take(remaining)
            each = remaining // length  # a bin that has just taken a piece is the tightest for the next
            filled = min(n, left // each)
            if not filled:
                filled, each = 1, left
            plan.append((length, rank, each, first, capacity - remaining))
            tree.put(remaining - each * length, first, filled)
            if n > filled:
                tree.put(remaining, first + filled, n - filled)
            rank, left = rank + filled * each, left - filled * each
    return sorted(plan)


def cut_pieces(batches, vocabulary: str, capacity: int):
    """Arrow batches of doc_id, text to batches of PIECES."""
    e = encoder(vocabulary)
    for b in text_slices(batches, size=ENCODED_BYTES):
        ids, n = e.encode_column(b.column(1))
        ids, n = np.insert(ids, np.cumsum(n), END_ID), n + 1
        cuts, ends = -(-n // capacity), np.cumsum(n)
        doc = np.repeat(np.arange(len(n)), cuts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = piece * capacity
        length = np.minimum(n[doc] - start, capacity)
        at = (ends - n)[doc] + start
        raw = memoryview(ids).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces: one of all ids, or cuts of exactly capacity ids and a rest."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        yield from cut_pieces(batches, vocabulary, capacity)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def _ranked(table: DataFrame, rows: int, per_bucket: int) -> DataFrame:
    """Adds each piece's rank among those of its length, from 0 and gapless, ordered by bucket, then doc_id and piece."""
    bucketed = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets(rows, per_bucket))))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return bucketed.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece.

    Null and empty texts are the end id alone. Only documents longer than capacity are cut. Repeated rows are packed as
    often as they come; null doc_ids are packed too. Other columns are ignored; an empty table gives an empty result.
    Only the histogram of lengths, at most `capacity` rows, passes the driver.
    """
    table = stage(pieces(docs, vocabulary, capacity))
    counts = dict(table.groupBy("length").count().collect())
    plan = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 5)
    key = plan[:, 0] << 44 | plan[:, 1]

    def place(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            seg = plan[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth, each = rank - seg[:, 1], seg[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(5)), pa.array(seg[:, 3] + nth // each), pa.array(seg[:, 4] + nth % each * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = _ranked(table, sum(counts.values()), ranked_rows)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
