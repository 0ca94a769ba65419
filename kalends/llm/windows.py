"""Order-preserving packing: a stream of documents is cut into windows by dynamic programming.

The documents of a partition, in their order, are one stream of tokens. A window may end at a document's end for nothing, at a
sentence's end for a small penalty and inside a sentence for a larger one. Its padding is what it lacks of the capacity, or
nothing where its length is a power of two. With f(j) the least cost of all up to place j,

    f(j) = penalty(j) + min over places i of a capacity before j of f(i) + capacity - (p(j) - p(i))

so the minimum of f(i) + p(i) over a window that slides along is all it takes, which a monotone queue keeps; the few places that
lie exactly a power of two before j are asked besides. Tasks need nothing of each other: no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import BYTE_VOCABULARY, ByteWords, encoder, vocabulary_path
from .common import on_workers, text_slices

CAPACITY, END_ID = 1024, 0
#: What a window's end costs inside a document, in tokens of padding: behind a sentence, and within one.
SENTENCE_PENALTY, INNER_PENALTY = 4, 16
#: Places within a long sentence where a window may end, so many tokens apart.
INNER_STEP = 64
#: Tokens that one run of the program looks at, about; the last windows of a run are planned again with what follows.
RUN_TOKENS = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def places(ends: np.ndarray, sentences: np.ndarray, capacity: int, last: bool, penalties: tuple[int, int] = (SENTENCE_PENALTY, INNER_PENALTY)) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stream, ascending from 0, and what each costs.

    ends: of documents; sentences: of sentences within them. Gaps are filled every INNER_STEP tokens; at the stream's last end
    so are the places from which only powers of two are left.
    """
    total = int(ends[-1])
    step = min(INNER_STEP, capacity)
    at = np.unique(np.concatenate([[0], sentences, ends]))
    extra = (np.diff(at) - 1) // step
    inner = np.repeat(at[:-1], extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    if last:
        left = 1 << np.arange(min(capacity, total).bit_length())
        inner = np.concatenate([inner, total - left[left < total], total - np.cumsum(left)[np.cumsum(left) < total]])
    every = np.unique(np.concatenate([at, inner]))
    cost = np.full(len(every), penalties[1], np.int64)
    cost[np.searchsorted(every, sentences)] = penalties[0]
    cost[np.searchsorted(every, ends)] = 0
    cost[0] = 0
    return every, cost


def windows(at: np.ndarray, cost: np.ndarray, capacity: int) -> np.ndarray:
    """The places at which windows end in a cheapest cutting of [0, at[-1])."""
    index = np.full(int(at[-1]) + 1, -1, np.int32)
    index[at] = np.arange(len(at))
    later, earlier = [], []
    for k in range(capacity.bit_length()):
        back = at - (1 << k)
        hit = np.flatnonzero(back >= 0)
        hit = hit[index[back[hit]] >= 0]
        later.append(hit)
        earlier.append(index[back[hit]])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    # Pairs of places a power of two apart, by the later one, and an end that is never reached.
    after, source = [*later[order].tolist(), len(at)], earlier[order].tolist()
    p, c = at.tolist(), cost.tolist()
    f, before, nth = [0] * len(p), [0] * len(p), 0
    queue = deque([(0, 0, 0)])  # f(i) + p(i), p(i), i: growing in the first
    for j in range(1, len(p)):
        here = p[j]
        while queue[0][1] < here - capacity:
            queue.popleft()
        best, _, i = queue[0]
        best += capacity - here
        while after[nth] == j:
            e = source[nth]
            nth += 1
            if f[e] < best:
                best, i = f[e], e
        best += c[j]
        f[j], before[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    chosen, j = [], len(p) - 1
    while j:
        chosen.append(p[j])
        j = before[j]
    return np.array(chosen[::-1], np.int64)


class Stream:
    """Documents that a task has read and not yet packed: their ids, lengths and places where sentences end."""

    def __init__(self, capacity: int, part: int):
        self.capacity, self.sequence = capacity, part << 40
        self.ids, self.sentences = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.docs, self.left, self.done, self.whole = pa.array([], pa.int64()), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, docs: pa.Array, ids: np.ndarray, n: np.ndarray, sentences: np.ndarray) -> None:
        self.sentences = np.concatenate([self.sentences, sentences + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs = pa.concat_arrays([self.docs, docs])
        self.left, self.whole = np.concatenate([self.left, n]), np.concatenate([self.whole, n])
        self.done = np.concatenate([self.done, np.zeros(len(n), np.int64)])

    def packed(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows but the last few, or of all at the end."""
        if not len(self.ids):
            return None
        ends = np.cumsum(self.left)
        cuts = windows(*places(ends, self.sentences, self.capacity, last), self.capacity)
        if not last:
            cuts = cuts[:-4]
        if not len(cuts):
            return None
        upto = int(cuts[-1])
        bounds = np.unique(np.concatenate([[0], cuts, ends[ends < upto]]))
        begin, length = bounds[:-1], np.diff(bounds)
        doc, window = np.searchsorted(ends, begin, side="right"), np.searchsorted(cuts, begin, side="right")
        raw = memoryview(self.ids).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        first = ends - self.left
        opened = np.concatenate([[0], cuts])[window]
        out = pa.RecordBatch.from_arrays(
            [
                self.docs.take(pa.array(doc)), pa.array(begin - first[doc] + self.done[doc]), pa.array(length), pa.array(crcs, pa.int64()), pa.array(self.whole[doc]),
                pa.array(self.sequence + window), pa.array(begin - opened),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        stay = int(np.searchsorted(ends, upto, side="right"))
        if stay < len(ends):  # the first that stays may be begun
            self.done[stay] += max(0, upto - int(first[stay]))
            self.left[stay] = int(ends[stay]) - max(upto, int(first[stay]))
        self.docs, self.left, self.done, self.whole = self.docs.slice(stay), self.left[stay:], self.done[stay:], self.whole[stay:]
        self.ids, self.sentences = self.ids[upto:].copy(), self.sentences[self.sentences > upto] - upto
        return out


_MARK = np.zeros(256, bool)
_MARK[list(b".!?")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def encoded(words: ByteWords, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with the end id behind it; how many each text has; and where sentences end.

    A sentence ends behind '.', '!' or '?' before ASCII white space, and at a line's end.
    """
    ids, n, size, numbered, n_words = words.column(texts)
    dictionary = numbered.dictionary
    offsets = np.frombuffer(dictionary.buffers()[1], np.int32)[: len(dictionary) + 1] if len(dictionary) else np.zeros(1, np.int32)
    data = np.frombuffer(dictionary.buffers()[2] or b"", np.uint8)
    head, tail = (data[offsets[:-1]], data[offsets[1:] - 1]) if len(dictionary) else (data, data)
    of = numbered.indices.to_numpy()
    head, tail = head[of], tail[of]
    ended = (tail == 10) | (np.append(_BLANK[head[1:]], False) & _MARK[tail]) | np.append(head[1:] == 10, False)
    ended[np.cumsum(n_words)[n_words > 0] - 1] = False
    word_doc = np.repeat(np.arange(len(n)), n_words)
    sentences = (np.cumsum(size, dtype=np.int64) + word_doc)[ended]
    return np.insert(ids, np.cumsum(n), END_ID).astype("<u4"), n + 1, sentences


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Packs all documents in the order of the table: a row per piece, with doc_tokens (of its document, the end id included).

    Null and empty texts are the end id alone. Each id lies in exactly one piece; pieces fill a sequence from 0 without gaps.
    Repeated rows are packed as often as they come; null doc_ids are packed too; other columns are ignored; an empty table
    gives an empty result. Each partition is a stream of its own, so only its last sequence can be short for want of documents,
    and powers of two take that up.
    """
    on_workers(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path(BYTE_VOCABULARY)

    def run(batches):
        words, stream = encoder(ByteWords, vocabulary), Stream(capacity, TaskContext.get().partitionId())
        for b in text_slices(batches):
            stream.add(b.column(0), *encoded(words, b.column(1)))
            if len(stream.ids) >= run_tokens and (out := stream.packed(False)):
                yield out
        if out := stream.packed(True):
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)
