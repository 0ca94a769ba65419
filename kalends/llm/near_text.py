"""Near copies of whole texts: SimHash proposes, the sets of word shingles decide.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. A text is filed
under its least few shingle hashes (its anchors); near copies share one of them but for about one pair in six hundred
at exactly 0.8, fewer above. Under an anchor the 64-bit SimHashes are compared bit-sliced within a radius that true pairs
exceed about once in a hundred thousand, and pairs within it are measured exactly, nearest first, unless links found so
far connect them. Texts with equal sets are one from the start.

Texts under an anchor that very many share (a stock passage) are compared by prefixes instead: a set's shingles are put
in one order for all texts, rarest first, and two sets that are alike share one of the first few.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .common import drop_rows, few_enough, slices, stage, tidy, with_rows
from .components import connected_components
from .simhash import SEED, bit_sliced_links

SHINGLE = 5
SIMILARITY = 0.8
ANCHORS = 4
RADIUS = 22
#: Texts under one key up to which all pairs are compared in one task. Larger keys are split by a second anchor, and if
#: still larger into parts of this size that share about LEADERS texts; what these leave unconnected is then found by prefixes.
BUCKET = 512
LEADERS = 32
#: Numbers that tell how often shingles occur in crowded texts, several shingles to a number where they are many. Any
#: numbers give the same links; good ones give few candidates.
SLOTS = 1 << 20
#: Slots whose numbers are one row.
SLOT_BLOCK = 1 << 12


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's n-word shingles; a shorter text is one shingle, a wordless one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) > n else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(SEED))), ">u8").astype(np.uint64))


def sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """Key of the set, SimHash and anchors, as signed 64-bit integers."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15), None].view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    fp = np.packbits(2 * ones > len(hashes)).view(np.int64)[0]
    return int(np.array([xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0]), int(fp), hashes[:ANCHORS].view(np.int64).tolist()


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            rows = [sketch(h) for h in map(shingles, b.column(1).cast(pa.large_binary()).to_pylist())]
            cols = list(zip(*rows)) or [()] * 3
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "id", "fp", "anchors"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, id long, fp long, anchors array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id, fp and the set's lower halves, four bytes each, of every document."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                h = shingles(t)
                rows.append((*sketch(h)[:2], np.unique(h.astype(np.uint32)).tobytes()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "fp", "set"])

    return docs.select("text").mapInArrow(tidy(run), "id long, fp long, set binary")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _spanning(ids: list[int], fp: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Links (u, v) that connect what is alike."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs, out = list(bit_sliced_links(fp, np.zeros(len(ids), np.int64), np.full(len(ids), len(ids)), RADIUS)), []
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            u, v = find(a), find(b)
            if u != v and _alike(sets[a], sets[b]):
                root[max(u, v)] = min(u, v)
                out.append((ids[a], ids[b]))
    cols = list(zip(*out)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])


def _by_key(batches):
    """Lists of the rows of each key, without the key, that have two or more; the key comes first and in order."""
    key, held = None, []
    for b in slices(batches, 128):
        for k, *row in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))):
            if k != key:
                if len(held) > 1:
                    yield held
                key, held = k, []
            held.append(row)
    if len(held) > 1:
        yield held


def _bucket_links(batches):
    """Rows key, id, fp, set in key order to links (u, v) that connect what is alike under each key."""
    for rows in _by_key(batches):
        ids, fp, sets = zip(*rows)
        sets = [np.frombuffer(x, np.uint32) for x in sets]
        yield _spanning(ids, np.array(fp, np.int64).view(np.uint64), sets)


def _keyed(nodes: DataFrame, bucket: int) -> DataFrame:
    """key, id: under which keys a text is compared. Only keys of two texts or more are left."""

    def sized(keyed: DataFrame) -> DataFrame:
        return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")

    single = sized(nodes.select("id", "anchors", F.explode("anchors").alias("key")))
    few = single.where(F.col("n") <= bucket).select("key", "id")
    many = single.where(F.col("n") > bucket).select("id", "anchors").distinct()
    pairs = F.array(*(F.struct(F.get("anchors", F.lit(i)).alias("a"), F.get("anchors", F.lit(j)).alias("b")) for i, j in combinations(range(ANCHORS), 2)))
    double = many.select("id", F.explode(pairs).alias("p")).select("id", F.when(F.col("p.b").isNotNull(), F.xxhash64("p.a", "p.b")).otherwise(F.xxhash64("p.a")).alias("key"))
    double = sized(double.where("key is not null").distinct())
    small = double.where(F.col("n") <= bucket).select("key", "id")
    parts = F.ceil(F.col("n") / bucket)
    leads = F.pmod(F.xxhash64("key", "id"), F.col("n")) < LEADERS
    part = F.when(leads, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts)))
    large = double.where(F.col("n") > bucket).select("key", "id", F.explode(part).alias("part")).select(F.xxhash64("key", "part").alias("key"), "id")
    return few.unionByName(small).unionByName(large)


def _crowded(nodes: DataFrame, bucket: int) -> DataFrame:
    """key, id of the texts under every anchor that more than `bucket` texts share."""
    single = nodes.select("id", F.explode("anchors").alias("key"))
    return single.join(single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"), "key")


def _counts(sets: DataFrame) -> DataFrame:
    """block, n: each task's numbers of its texts' shingles, those of SLOT_BLOCK slots to a row, however many texts it has."""

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for b in slices(batches):
            halves = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
            seen += np.bincount(halves & np.uint32(SLOTS - 1), minlength=SLOTS)
        yield _blocks(dict(enumerate(seen.reshape(-1, SLOT_BLOCK))))

    return sets.select("set").mapInArrow(tidy(run), "block long, n binary")


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """block, n of the blocks that hold anything, numbers as unsigned 32-bit integers; larger ones become the largest."""
    sums = {k: np.minimum(n, 0xFFFFFFFF).astype("<u4").tobytes() for k, n in sums.items() if n.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.binary())], names=["block", "n"])


def _commonness(sets: DataFrame) -> np.ndarray:
    """For each slot how many shingles of the texts fall there; SLOTS numbers, however many texts there are."""

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in slices(batches):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(n, "<u4").astype(np.int64)
        yield _blocks(sums)

    found = _counts(sets).repartition("block").mapInArrow(added, "block long, n binary").toArrow()
    common = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint32)
    for k, n in zip(found["block"].to_pylist(), found["n"].to_pylist()):
        common[k] = np.frombuffer(n, "<u4")
    return common.ravel()


def prefix(halves: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's first shingles, rarest first, and how many of them are its short prefix.

    Of two sets that are alike the first shingle that they share is in the short prefix of the one that is not larger
    and in the prefix of the other: a smaller set of n has 2 * SIMILARITY / (1 + SIMILARITY) * n of its shingles in common with
    the larger at least, and a larger one of n has SIMILARITY * n. Shingles of no other text are left out.
    """
    n = len(halves)
    often = common[halves & np.uint32(SLOTS - 1)].astype(np.uint64)
    order = np.sort(often << np.uint64(32) | halves)[: n - math.ceil(SIMILARITY * n - 1e-6) + 1]
    short = n - math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-6) + 1
    alone = int(np.searchsorted(order, np.uint64(2 << 32)))
    return order[alone:].astype(np.uint32), max(0, min(short, len(order)) - alone)


def _prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """id, fp, class, size, key and short, whether key is in the short prefix, of every set's prefix."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for b in slices(batches, 256):
            keys, shorts = [], []
            for x in b.column(4).to_pylist():
                key, short = prefix(np.frombuffer(x, np.uint32), shared.value)
                keys.append(key)
                shorts.append(np.arange(len(key)) < short)
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
            cols = [*(c.take(at) for c in b.columns[:4]), pa.array(np.concatenate([*keys, np.empty(0, np.uint32)]).astype(np.int64)), pa.array(np.concatenate([*shorts, np.empty(0, bool)]))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", "class", "size", "key", "short"])

    return sets.select("id", "fp", "class", "size", "set").mapInArrow(tidy(run), "id long, fp long, class long, size long, key long, short boolean")


def _dealt(entries: DataFrame, bucket: int) -> DataFrame:
    """task and side of the entries under each key that texts of different classes share, if one has it in its short prefix.

    A key of `bucket` texts at most is one task of side 2. Of a larger one each block of short prefixes (side 0) meets
    each block of all its texts (side 1).
    """
    keys = entries.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / bucket).alias("parts"), F.ceil(F.count_if("short") / bucket).alias("short_parts"), (F.min("class") < F.max("class")).alias("several")
    )
    keys = keys.where("several and short_parts > 0").drop("several")
    one, two = F.pmod(F.xxhash64("id"), F.col("short_parts")), F.pmod(F.xxhash64("id"), F.col("parts"))

    def dealt(side, parts, place):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), lambda k: F.struct(F.xxhash64("key", *place(k)).alias("task"), F.lit(side).alias("side")))

    first = F.when(F.col("short"), dealt(0, "parts", lambda k: (one, k))).otherwise(F.array().cast("array<struct<task:bigint,side:int>>"))
    tasks = F.when(F.col("parts") == 1, F.array(F.struct(F.xxhash64("key").alias("task"), F.lit(2).alias("side")))).otherwise(F.concat(first, dealt(1, "short_parts", lambda k: (k, two))))
    return entries.join(keys, "key").select(F.explode(tasks).alias("t"), "id", "fp", "class", "size", "short").select("t.task", "t.side", "id", "fp", "class", "size", "short")


def _candidates(batches):
    """Rows task, side, id, fp, class, size, short in order of task and side to pairs (u, v) that may be alike."""

    def solve(task, side, ids, fp, kind, size, short):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
        start, end = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
        out = [np.empty((0, 2), np.int64)]
        for i, j in bit_sliced_links(fp.view(np.uint64), start, end, RADIUS):
            met = (side[i] == 2) | (side[i] != side[j])
            i, j = i[met & (kind[i] != kind[j])], j[met & (kind[i] != kind[j])]
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            keep = (small >= SIMILARITY * large) & ((short[i] & (size[i] == small)) | (short[j] & (size[j] == small)))
            i, j = ids[i[keep]], ids[j[keep]]
            out.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    held: list[np.ndarray] = []
    for b in batches:
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        held = [np.concatenate(x) for x in zip(held, rows)] if held else rows
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield solve(*(h[:cut].copy() for h in held))
            held = [h[cut:] for h in held]
    if held and len(held[0]):
        yield solve(*(h.copy() for h in held))


def _measured(batches):
    """Rows u, v and both sets to the links (u, v) of those that are alike."""
    for b in slices(batches, 64):
        keep = [_alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def prefix_links(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All links (u, v) between alike texts of different classes, within RADIUS, from staged sets(id, fp, class, size, set)."""
    dealt = _dealt(stage(_prefixes(sets, _commonness(sets))), bucket)
    pairs = dealt.repartition("task").sortWithinPartitions("task", "side").mapInArrow(tidy(_candidates), "u long, v long").distinct()
    one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "set_u", "set_v").mapInArrow(tidy(_measured), "u long, v long")


def near_copies(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id and component_id, the least doc_id of the texts that links connect, of every document.

    Texts without words are copies of each other. Rows that repeat a doc_id each come back; null doc_ids take their
    group's component_id; other columns are ignored; an empty table gives an empty result. All pairs under an anchor
    count, whatever `bucket` is. Work grows with the candidates: texts that share a stock passage and nothing rare are none.
    """
    found = stage(_sketches(docs))
    nodes = found.groupBy("id").agg(F.first("anchors").alias("anchors"))

    def with_sets(keyed: DataFrame) -> DataFrame:
        wanted = stage(found.join(keyed.select("id").distinct(), "id").groupBy("id").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct())
        chosen = docs.join(F.broadcast(wanted) if few_enough(wanted) else wanted, "doc_id", "left_semi")
        return keyed.join(_sets(chosen).dropDuplicates(["id"]), "id")

    keyed = stage(_keyed(nodes, bucket))
    links = with_sets(keyed).select("key", "id", "fp", "set").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_bucket_links), "u long, v long")
    classes = connected_components(links)
    crowded = stage(_crowded(nodes, bucket))
    if not crowded.isEmpty():
        known = crowded.join(classes.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("class"))
        several = known.groupBy("key").agg((F.min("class") < F.max("class")).alias("several")).where("several").select("key")
        texts = stage(known.join(several, "key").select("id", "class").distinct())
        sets = stage(with_sets(texts).select("id", "fp", "class", F.expr("octet_length(set) div 4").alias("size"), "set"))
        classes = connected_components(prefix_links(sets, bucket).unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    named = found.select("doc_id", "id").join(classes.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("class"))
    named = stage(named)
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class").select("doc_id", "component_id")


def without_copies(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs without those whose doc_id is a near copy of a lesser one, all columns kept; for tables with an id a row.

    Rows that repeat a doc_id stay or go together and rows without a doc_id stay; `one_of_each` tells rows apart instead.
    """
    copies = stage(near_copies(docs, bucket).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(copies) if few_enough(copies) else copies, "doc_id", "left_anti").select(docs.columns)


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each group of near copies, that of the least doc_id (nulls last), all columns kept.

    Rows that repeat a doc_id or lack one are told apart, so one row of a group stays whatever their ids are. Texts without
    words are one group; an empty table gives an empty result.
    """
    rows, row = with_rows(docs)
    classes = near_copies(rows.select(F.col(row).alias("doc_id"), "text"), bucket).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))
    named = stage(rows.select(row, "doc_id").join(classes, row))
    first = named.groupBy("component_id").agg(F.min(order).alias("first"))
    return drop_rows(rows, named.join(first, "component_id").where(F.col("first.row") != F.col(row)).select(row), row).select(docs.columns)
