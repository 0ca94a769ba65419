"""Token ids in binary blocks.

Ids are ranked by frequency, so the commonest need one byte. Ranks are coded with one to four bytes each; their
lengths stand apart in control bytes, four two-bit codes a byte, so that numpy decodes a block with a table lookup
and a few gathers. A block holds consecutive documents:

    magic "KTB1" | n documents u32 | control length u64 | data length u64
    | has an id u8[n] | doc ids i64[n] | token counts u64[n] | control bytes | data bytes

Each document's ranks are padded with rank 0 to a multiple of four; the padding is dropped on reading. Blocks are rows
of a Parquet table (shard, block, before, n_tokens, payload), which Spark commits once per task and reads from any
store. Shards are ranges of doc_id in ascending order; `before` counts the shard's tokens before the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_buckets, scratch_dir, stage, text_slices
from .tokens import END_ID, encoder, vocabulary_path

MAGIC = b"KTB1"
#: Tokens of a block and of a shard, about; a document is never cut.
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 23
#: Documents that are coded or decoded together.
BATCH_ROWS = 512
_HEAD = struct.Struct("<4sIQQ")
#: Lengths of the four values that a control byte stands for.
LENGTHS = np.stack([((np.arange(256) >> 2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)
_QUAD_BYTES = LENGTHS.sum(axis=1, dtype=np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a multiple of four unsigned 32-bit values."""
    length = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = (length - 1).astype(np.uint8).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    bytes_ = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), bytes_[np.arange(4) < length[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The inverse of encode_ranks on uint8 arrays."""
    length = LENGTHS[control].ravel()
    at = np.cumsum(length, dtype=np.int64) - length
    values = data[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(length > k)
        values[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def pack_block(doc_ids: list, counts: list[int], ranks: list[np.ndarray]) -> bytes:
    counts_ = np.array(counts, "<u8")
    padded = -(-counts_.astype(np.int64) // 4) * 4
    flat = np.zeros(int(padded.sum()), np.uint32)
    for start, r in zip((np.cumsum(padded) - padded).tolist(), ranks):
        flat[start : start + len(r)] = r
    control, data = encode_ranks(flat)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((_HEAD.pack(MAGIC, len(counts), len(control), len(data)), has.tobytes(), ids.tobytes(), counts_.tobytes(), control, data))


def unpack_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, token counts, and the ranks of all documents in a row."""
    magic, n, n_control, n_data = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    raw = np.frombuffer(payload, np.uint8)
    at = _HEAD.size
    has, ids = raw[at : at + n], raw[at + n : at + 9 * n].copy().view("<i8")
    counts = raw[at + 9 * n : at + 17 * n].copy().view("<u8").astype(np.int64)
    at += 17 * n
    ranks = decode_ranks(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data])
    padded = -(-counts // 4) * 4
    inside = np.arange(len(ranks)) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(counts, padded)
    return [i if h else None for h, i in zip(has.tolist(), ids.tolist())], counts, ranks[inside]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n tokens, control and data bytes of every document's ids, coded as they are; the end id is the last.

    Each task adds one row with n = -1 for how often it met each id: ids in control, counts in data, eight bytes each.
    """

    def run(batches):
        e = encoder(vocabulary)
        total = np.zeros(e.size, np.int64)
        for b in text_slices(batches):
            flat, n = e.encode_column(b.column(1))
            flat, n = np.insert(flat, np.cumsum(n), END_ID), n + 1
            quads = -(-n // 4)
            ids = np.zeros(4 * int(quads.sum()), "<u4")
            ids[np.arange(len(flat)) + np.repeat(4 * (np.cumsum(quads) - quads) - np.cumsum(n) + n, n)] = flat
            control, data = encode_ranks(ids)
            size = np.cumsum(_QUAD_BYTES[np.frombuffer(control, np.uint8)])
            at, upto = np.cumsum(quads), size[np.cumsum(quads) - 1]
            total += np.bincount(ids, minlength=e.size)
            total[0] -= int((4 * quads - n).sum())  # the padding
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), _cut(control, at), _cut(data, upto)], names=["doc_id", "n", "control", "data"]
            )
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([met.astype("<i8").tobytes()], pa.binary()), pa.array([total[met].astype("<i8").tobytes()], pa.binary())],
            names=["doc_id", "n", "control", "data"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, control binary, data binary")


def _cut(raw: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array of raw cut at ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All values of encoded rows, padding included, and which are no padding."""
    n = b.column("n").to_numpy()
    control, data = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8) for c in ("control", "data"))
    padded = -(-n // 4) * 4
    inside = np.arange(int(padded.sum())) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(n, padded)
    return decode_ranks(control, data), inside


def token_counts(rows: DataFrame) -> DataFrame:
    """How often each id occurs in all encoded documents: id, n. At most one row per id of the vocabulary."""

    def run(batches):
        for b in batches:
            ids, n = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<i8") for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    met = rows.where("n < 0").select("control", "data").mapInArrow(run, "id long, n long")
    return met.groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes path/ranks (id, rank) and path/blocks; texts are encoded once, to a staged table.

    Only the ranks, bounded by the vocabulary, pass the driver.
    """
    rows = stage(encoded(docs, vocabulary or vocabulary_path()))
    counted = sorted(((r["n"], r["id"]) for r in token_counts(rows).collect()), key=lambda x: (-x[0], x[1]))
    spark = docs.sparkSession
    ids = [i for _, i in counted]
    spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shards = n_buckets(sum(n for n, _ in counted), shard_tokens)

    def run(batches):
        shard = TaskContext.get().partitionId()
        block, before, held, doc_ids, counts, ranks = 0, 0, 0, [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([held]), pa.array([pack_block(doc_ids, counts, ranks)], pa.binary())],
                names=["shard", "block", "before", "n_tokens", "payload"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                values, inside = _ids(b)
                values, end = rank_of[values[inside]], 0
                for d, n in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist()):
                    if held and held + n > block_tokens:
                        yield flush()
                        block, before, held, doc_ids, counts, ranks = block + 1, before + held, 0, [], [], []
                    doc_ids.append(d)
                    counts.append(n)
                    ranks.append(values[end : end + n])
                    held, end = held + n, end + n
        if held:
            yield flush()

    (
        rows.where("n >= 0").withColumn("h", F.xxhash64("control", "data")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "control", "data")
        .mapInArrow(run, "shard int, block int, before long, n_tokens long, payload binary")
        .write.parquet(f"{path}/blocks")
    )


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents from written blocks: doc_id, start (tokens of all before it), n_tokens, ids_crc32, ids (little-endian u32).

    Blocks are decoded either way; without ids, these stay in the Python worker.
    """
    ranked = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(max(len(ranked), 1), "<u4")
    for r in ranked:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = dict(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())  # a row per shard
    first, total = {}, 0
    for s in sorted(shards):
        first[s], total = total, total + shards[s]

    def run(batches):
        for b in batches:
            for s, before, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
                doc_ids, counts, ranks = unpack_block(payload)
                ids, ends = id_of[ranks], np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - counts).tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(first[s] + before + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(_cut(ids.tobytes(), 4 * ends))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]
    return blocks.select("shard", "before", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes docs to a folder of its own in the shared folder and reads the files back.

    Null and empty texts hold the end id alone. Documents come in ascending doc_id order, nulls first, equal ids in
    the order of a digest of their codes, which also parts the ranges, so one id may fill several shards; repeated rows are written as often as they come. Other columns are ignored. An
    empty table gives an empty result.
    """
    path = scratch_dir(docs.sparkSession)
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path, with_ids)
