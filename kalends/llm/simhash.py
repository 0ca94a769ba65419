"""SimHash near-duplicate search over bit planes.

Fingerprints are built in Arrow batches. Candidates are fingerprints that agree in two of four 16-bit blocks,
which every pair within radius 2 does; those of crowded buckets, in six of eight 8-bit blocks. Inside such a bucket the fingerprints are stored vertically: plane b holds bit b
of 64 fingerprints in one machine word. One XOR compares a query bit with 64 fingerprints, bitwise counters
add it to 64 distances by passing carries on, and a block of 64 leaves the work list as soon as all its
distances exceed the radius.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import slices, stage
from .components import connected_components

SEED = 42
RADIUS = 2
#: Number of blocks, and how many of them must agree.
BLOCKS, FINE_BLOCKS = (4, 2), (8, 6)
#: Buckets above this many distinct fingerprints are filed anew under six of eight 8-bit blocks, where a bucket holds
#: 2 ** 16 fingerprints at most.
BUCKET = 8192
#: (query, block of 64) items that are worked on at once; bounds memory.
ITEMS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a whole text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digests = np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document; null texts count as empty."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, links) -> np.ndarray:
    """Least index of each one's component over chunks of index pairs: hook to the smaller root, then halve paths."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def bit_sliced_links(fp: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j), j < i, of all pairs in one bucket at radius or fewer differing bits.

    fp: uint64 fingerprints, bucket after bucket; start, end: of each one's bucket. The counters have as many bits as
    the radius needs and start so high that they overflow, into a sticky bit, just beyond it.
    """
    width = (radius + 1).bit_length()
    above = (1 << width) - 1 - radius
    n = len(fp)
    words = -(-n // 64)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[:n] = fp
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1)  # row: fingerprint, column: bit, highest first
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)  # plane, block of 64
    first, last = start // 64, np.arange(n) // 64  # pairs with j < i: blocks up to its own
    reach = last - first + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(np.cumsum(reach[done:]), ITEMS)) + done)
        each = reach[done:upto]
        query = np.repeat(np.arange(done, upto), each)
        block = np.arange(len(query)) - np.repeat(np.cumsum(each) - each, each) + first[query]
        low = np.maximum(start[query] - block * 64, 0).astype(np.uint64)
        high = np.minimum(query - block * 64, 64)
        mask = (full << low) & np.where(high >= 64, full, ~(full << np.minimum(high, 63).astype(np.uint64)))
        over = ~mask  # lanes of other buckets, and of the query and what follows it
        live = over != full
        query, block, over = query[live], block[live], over[live]
        value = fp[query]
        count = [np.full(len(query), full if above >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(64):
            if not len(query):
                break
            carry = planes[b][block] ^ (np.uint64(0) - ((value >> np.uint64(63 - b)) & np.uint64(1)))
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over = over | carry
            if b % 4 == 3:
                live = over != full
                if not live.all():
                    query, block, over, value, *count = (y[live] for y in (query, block, over, value, *count))
        if len(query):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, lane = np.nonzero(hit)
            yield query[item], block[item] * 64 + lane
        done = upto


def _bucket_links(batches):
    """key, fp, rep rows in key order to links (u, v) between reps: one star for each component in a bucket."""

    def solve(key, fp, rep):
        cut = np.flatnonzero(np.diff(key)) + 1
        edges = np.concatenate([[0], cut, [len(key)]])
        size = np.diff(edges)
        start, end = np.repeat(edges[:-1], size), np.repeat(edges[1:], size)
        root = _roots(len(fp), bit_sliced_links(fp.view(np.uint64), start, end))
        linked = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["u", "v"])

    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    for b in batches:
        held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        key = held[0]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield solve(*(h[:cut].copy() for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield solve(*(h.copy() for h in held))


def _banded(nodes: DataFrame, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """Each fingerprint once for each choice of so many of its blocks, under a key made of the choice's number and the bits."""
    n, agree = blocks
    width = 64 // n
    block = [F.shiftright("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(n)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), agree)):
        key = F.lit(number << width * agree)
        for at, k in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(block[k], width * at))
        keys.append(key)
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")


def _compared(banded: DataFrame) -> DataFrame:
    """Links of the fingerprints under each key of banded(key, fp, rep)."""
    return banded.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, "u long, v long")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect the reps of nodes(fp, rep) exactly as all pairs within radius 2 do."""

    def sized(banded: DataFrame) -> DataFrame:
        return banded.join(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")

    coarse = sized(_banded(nodes))
    crowded = stage(coarse.where(F.col("n") > bucket).select("fp", "rep").distinct())
    found = _compared(coarse.where(F.col("n") <= bucket))
    return found if crowded.isEmpty() else found.unionByName(_compared(sized(_banded(crowded, FINE_BLOCKS))))


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Every document's doc_id, fingerprint (16 lowercase hex digits) and component_id.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the least doc_id reachable by links, the
    document's own included. Null, empty and wordless texts have fingerprint zero and link like any other. Equal
    fingerprints are one node, so a group of copies costs one row after the first aggregate. Rows that repeat a
    doc_id come back as often as they came in; a null doc_id takes its group's component_id (null if the group has
    no id at all). An empty table gives an empty result. Other columns of docs are ignored.
    """
    fps = stage(fingerprints(docs, shingle))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(nodes.where("rep is not null"), bucket))
    classes = nodes.join(found, nodes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
