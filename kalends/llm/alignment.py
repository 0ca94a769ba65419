"""Alignment of two tokenizers' ids over the same bytes, by composing fragments.

Byte offsets where a token of each ends cut a document into groups. A byte range of a document gives a fragment: the tokens up
to its first such offset (an open prefix, whose group may have begun before), the groups closed after that, and the tokens
behind the last such offset (an open suffix). Fragments of neighbouring ranges compose, and composition is associative, so a
very long document is encoded in ranges by many tasks and its fragments meet in a tree. A document of one range is a fragment
whose prefix is its first group and whose suffix is empty; most are, and are finished by the task that reads them, many at once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import BYTE_VOCABULARY, PIECE_VOCABULARY, ByteWords, PieceWords, _blank_before, cut, encoder, vocabulary_path
from .common import on_workers, stage, text_slices
from .ctw import commonest
from .tokens import _gather, _pool

#: Bytes of a range; shorter documents are one. A range is longer where a text has no place to cut it.
RANGE = 64 << 10
#: Fragments that one step of the tree composes.
FAN = 8
#: An id pair is one integer: the first id times this and the second. Both vocabularies' ids are below their factors, so it has 31 bits.
PAIR = 32_768
#: Commonest pairs that go to every task, some 16 MB; the others, each held by few documents, are joined.
HOT_PAIRS = 500_000
#: Groups with more pairs of tokens than this are counted by different ids.
LARGE = 4096
TEXT_BYTES = 2 << 20
#: Stretches that a worker remembers of each tokenizer, less than for one tokenizer alone.
REMEMBERED = 120_000
FRAGMENT = (
    "closed boolean, prefix_a array<int>, prefix_b array<int>, groups binary, n_a long, n_b long, n_groups long, n_links long, pairs array<int>, times array<long>, "
    "suffix_a array<int>, suffix_b array<int>, valid boolean"
)
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:int,times:long>>"
_NAMES: list[bytes] = []


def _names() -> list[bytes]:
    """Ids as text behind a comma, a bar or a semicolon, a row of 2^16 each."""
    if not _NAMES:
        _NAMES.extend(f"{mark}{i}".encode() for mark in ",|;" for i in range(1 << 16))
    return _NAMES


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token by its end, and how many common ends there are; tokens behind the last have that number."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def written(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Texts of all tokens in the order of groups, first ids before second ones, each behind its mark; and each text's group."""
    new_a, new_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    code, group = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    code[place_a], group[place_a] = a + (2 * new_a << 16), group_a
    code[place_b], group[place_b] = b + (new_b.astype(np.int64) << 16), group_b
    return list(map(_names().__getitem__, code.tolist())), group


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids that share a group, how often, and the group. Tokens with a group of n or more are in none."""
    a, b = a[: np.searchsorted(group_a, n)], b[: np.searchsorted(group_b, n)]
    group_a, group_b = group_a[: len(a)], group_b[: len(b)]
    m_a, m_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    large = m_a * m_b > LARGE
    each = np.where(large, 0, m_b)[group_a]
    first_b = np.cumsum(m_b) - m_b
    at = np.repeat(first_b[group_a] - np.cumsum(each) + each, each) + np.arange(each.sum())
    pairs, groups = np.repeat(a.astype(np.int64), each) * PAIR + b[at], np.repeat(group_a, each)
    times = np.ones(len(pairs), np.int64)
    for g in np.flatnonzero(large).tolist():
        x, n_x = np.unique(a[group_a == g], return_counts=True)
        y, n_y = np.unique(b[group_b == g], return_counts=True)
        pairs = np.concatenate([pairs, (x.astype(np.int64)[:, None] * PAIR + y[None, :]).ravel()])
        times = np.concatenate([times, (n_x[:, None] * n_y[None, :]).ravel()])
        groups = np.concatenate([groups, np.full(len(x) * len(y), g)])
    if large.any():
        order = np.argsort(groups, kind="stable")
        pairs, times, groups = pairs[order], times[order], groups[order]
    return pairs, times, groups


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs.astype(np.int64), times.astype(np.int64)
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first)


def _none(kind: type = np.int64):
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class Fragment:
    """What is known of a byte range. Without a common end (not closed) it is all prefix."""

    closed: bool = False
    prefix_a: np.ndarray = _none()
    prefix_b: np.ndarray = _none()
    groups: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    pairs: np.ndarray = _none()
    times: np.ndarray = _none()
    suffix_a: np.ndarray = _none()
    suffix_b: np.ndarray = _none()
    valid: bool = True

    @staticmethod
    def of(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, valid: bool = True) -> Fragment:
        """The fragment of the tokens that end in a range."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        if not valid:
            return Fragment(valid=False)
        group_a, group_b, n = grouped(ends_a, ends_b)
        if not n:
            return Fragment(prefix_a=a, prefix_b=b)
        from_a, from_b = np.searchsorted(group_a, 1), np.searchsorted(group_b, 1)
        upto_a, upto_b = np.searchsorted(group_a, n), np.searchsorted(group_b, n)
        inner = a[from_a:upto_a], group_a[from_a:upto_a] - 1, b[from_b:upto_b], group_b[from_b:upto_b] - 1
        pairs, times, _ = linked(*inner, n - 1)
        return Fragment(True, a[:from_a], b[:from_b], b"".join(written(*inner)[0]), len(inner[0]), len(inner[2]), n - 1, int(times.sum()), *summed(pairs, times), a[upto_a:], b[upto_b:])

    @staticmethod
    def group(a: np.ndarray, b: np.ndarray) -> Fragment:
        """One closed group, with nothing open."""
        if not len(a) and not len(b):
            return Fragment(True)
        zeros = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        pairs, times, _ = linked(a, zeros[0], b, zeros[1], 1)
        return Fragment(True, groups=b"".join(written(a, zeros[0], b, zeros[1])[0]), n_a=len(a), n_b=len(b), n_groups=1, n_links=len(a) * len(b), pairs=summed(pairs, times)[0], times=summed(pairs, times)[1])

    def then(self, other: Fragment) -> Fragment:
        """This range and the next one as one: the monoid's operation; Fragment() is its unit."""
        if not (self.valid and other.valid):
            return Fragment(valid=False)
        join = np.concatenate
        if not self.closed:
            prefix = join([self.prefix_a, other.prefix_a]), join([self.prefix_b, other.prefix_b])
            return Fragment(other.closed, *prefix, other.groups, other.n_a, other.n_b, other.n_groups, other.n_links, other.pairs, other.times, other.suffix_a, other.suffix_b)
        middle = join([self.suffix_a, other.prefix_a]), join([self.suffix_b, other.prefix_b])
        if not other.closed:
            return Fragment(True, self.prefix_a, self.prefix_b, self.groups, self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs, self.times, *middle)
        m = Fragment.group(*middle)
        pairs, times = summed(join([self.pairs, m.pairs, other.pairs]), join([self.times, m.times, other.times]))
        return Fragment(
            True, self.prefix_a, self.prefix_b, self.groups + m.groups + other.groups, self.n_a + m.n_a + other.n_a, self.n_b + m.n_b + other.n_b,
            self.n_groups + m.n_groups + other.n_groups, self.n_links + m.n_links + other.n_links, pairs, times, other.suffix_a, other.suffix_b,
        )

    def whole(self) -> Fragment:
        """The fragment of a whole document with its first group closed: before it there is nothing."""
        if not self.valid or not self.closed:
            return Fragment(valid=False)
        return Fragment(True).then(self)


def _tokens(texts: pa.Array, a: ByteWords, b: PieceWords) -> tuple:
    """Ids by both tokenizers of each different stretch, how many each has, the stretches of the texts and how many each text has."""
    words, n_words = cut(texts)
    numbered = words.dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    return *_pool(a.known(distinct)), *_pool(b.known(distinct)), numbered.indices.to_numpy(), n_words


def _aligned(texts: pa.Array, a: ByteWords, b: PieceWords) -> tuple:
    """n_a, n_b, n_groups, n_links, sha256 and (pairs, times, how many) of whole texts, each with a space before it.

    Stretches end with a token of each, so each different stretch is aligned once, and a text's groups are those of its stretches.
    """
    ids_a, size_a, ids_b, size_b, word, n_words = _tokens(texts, a, b)
    broken = np.zeros(len(size_a), bool)
    broken[np.repeat(np.arange(len(size_b)), size_b)[ids_b == b.size]] = True
    ids_b, size_b = ids_b[~np.repeat(broken, size_b)], np.where(broken, 0, size_b)
    ids_a, size_a = ids_a[~np.repeat(broken, size_a)], np.where(broken, 0, size_a)
    group_a, group_b, n = grouped(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    word_a = np.repeat(np.arange(len(size_a)), size_a)
    first = np.flatnonzero(np.diff(group_a, prepend=-1))
    word_of = word_a[first]  # of a group
    texts_of, group_of = written(ids_a.astype(np.int64), group_a, ids_b.astype(np.int64), group_b)
    upto = np.searchsorted(word_of[group_of], np.arange(len(size_a) + 1)).tolist() if n else [0] * (len(size_a) + 1)
    strings = [b"".join(texts_of[x:y]) for x, y in zip(upto, upto[1:])]
    pairs, times, of = linked(ids_a, group_a, ids_b, group_b, n)
    n_groups = np.bincount(word_of, minlength=len(size_a))
    n_pairs = np.bincount(word_of[of], minlength=len(size_a)) if len(of) else np.zeros(len(size_a), np.int64)
    n_links = np.bincount(word_of[of], times, len(size_a)).astype(np.int64) if len(of) else n_pairs
    # From stretches to texts; a text with a broken stretch has no tokens.
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    bad = np.bincount(doc, broken[word], len(n_words)) > 0
    total = lambda x: np.where(bad, 0, np.diff(np.concatenate([[0], np.cumsum(x[word])])[np.concatenate([[0], ends])]))
    order = word.tolist()
    hashes = ["" if w or y == x else hashlib.sha256(b"".join(map(strings.__getitem__, order[x:y]))[1:]).hexdigest() for x, y, w in zip([0, *ends.tolist()], ends.tolist(), bad.tolist())]
    here = word[~bad[doc]]
    both, each = _gather(pairs, n_pairs.astype(np.int32), here)
    often, _ = _gather(times, n_pairs.astype(np.int32), here)
    key = np.repeat(doc[~bad[doc]], each) << 31 | both
    key, often = summed(key, often)
    held = np.bincount(key >> 31, minlength=len(n_words))
    return total(size_a), total(size_b), total(n_groups), total(n_links), hashes, key & (1 << 31) - 1, often, held


def _led(texts: pa.Array) -> pa.Array:
    """Each text behind a space; null and empty ones stay empty."""
    texts = pc.fill_null(texts, "")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))


def _links(pairs: np.ndarray, times: np.ndarray, held: np.ndarray) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(times.astype(np.int64))], names=["pair", "times"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), rows)


def ranges(text: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(from, to, low, high) of each byte range (low, high] of a text that begins with a space: the bytes from..to are to be encoded for it.

    They begin and end where texts may be cut; a range whose beginning has no such place within the range before is one with that.
    """
    data = np.frombuffer(text, np.uint8)
    safe = np.flatnonzero(data == 32)
    safe = np.append(safe[(safe == 0) | ~_blank_before(data, safe)], len(data))
    lows = [0]
    for low in range(size, len(data), size):
        if safe[np.searchsorted(safe, low, side="right") - 1] > lows[-1]:
            lows.append(low)
    return [
        (int(safe[np.searchsorted(safe, low, side="right") - 1]), int(safe[np.searchsorted(safe, high)]), low, high)
        for low, high in zip(lows, [*lows[1:], len(data)])
    ]


def fragment(text: bytes, at: int, low: int, high: int, a: ByteWords, b: PieceWords) -> Fragment:
    """Of the range (low, high] of a document, by the bytes of it from `at` on."""
    ids_a, size_a, ids_b, size_b, word, _ = _tokens(pa.array([text.decode()]), a, b)
    ids_a, ids_b = _gather(ids_a, size_a, word)[0], _gather(ids_b, size_b, word)[0]
    if (ids_b == b.size).any():
        return Fragment(valid=False)
    ends_a, ends_b = at + np.cumsum(a.lengths[ids_a]), at + np.cumsum(b.lengths[ids_b])
    in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
    return Fragment.of(ids_a[in_a], ends_a[in_a], ids_b[in_b], ends_b[in_b])


_COLUMNS = [c.split()[0] for c in FRAGMENT.split(", ")]


def _record(keys: list[tuple[str, pa.Array]], found: list[Fragment]) -> pa.RecordBatch:
    kinds = {"closed": pa.bool_(), "valid": pa.bool_(), "groups": pa.binary(), "times": pa.list_(pa.int64())} | {c: pa.int64() for c in ("n_a", "n_b", "n_groups", "n_links")}
    own = [(c, pa.array([getattr(f, c) for f in found], kinds.get(c, pa.list_(pa.int32())))) for c in _COLUMNS]
    return pa.RecordBatch.from_arrays([v for _, v in (*keys, *own)], names=[k for k, _ in (*keys, *own)])


def _fragments(batch: pa.RecordBatch) -> list[Fragment]:
    def one(r: dict) -> Fragment:
        return Fragment(**{c: np.array(r[c], np.int64) if isinstance(r[c], list) else r[c] for c in _COLUMNS})

    return [one(r) for r in batch.select(_COLUMNS).to_pylist()]


def _long(docs: DataFrame, paths: tuple[str, str], size: int, fan: int) -> DataFrame:
    """Aligned rows of documents longer than one range: their ranges are dealt to all tasks, and fragments composed in a tree."""

    def split(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in text_slices(batches):
            for i, text in zip(b.column(0).to_pylist(), _led(b.column(1)).cast(pa.binary()).to_pylist()):
                cuts = ranges(text, size)
                for k, (x, y, low, high) in enumerate(cuts):
                    row = [(part << 33 | n) * 2 + 1, i, k, len(cuts), x, low, high, text[x:y]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=kinds)
                n += 1

    names = ["row", "doc_id", "chunk", "chunks", "at", "low", "high", "text"]
    kinds = pa.schema([(c, pa.binary() if c == "text" else pa.int64()) for c in names])

    def encode(batches):
        a, b = encoder(ByteWords, paths[0], REMEMBERED), encoder(PieceWords, paths[1], REMEMBERED)
        for batch in text_slices(batches, 7):
            rows = batch.to_pylist()
            found = [fragment(r["text"], r["at"], r["low"], r["high"], a, b) for r in rows]
            yield _record([(c, batch.column(c)) for c in names[:4]], found)

    def compose(batches):
        open_, held = None, []

        def out():
            return _record([(c, pa.array([v], pa.int64())) for c, v in zip(names, open_)], [reduce(Fragment.then, held)])

        for batch in batches:
            for r, f in zip(batch.select(names[:4]).to_pylist(), _fragments(batch)):
                key = (r["row"], r["doc_id"], r["chunk"] // fan, -(-r["chunks"] // fan))
                if key != open_ and open_ is not None:
                    yield out()
                    held = []
                open_ = key
                held.append(f)
        if open_ is not None:
            yield out()

    def finish(batches):
        for batch in batches:
            found = [f.whole() for f in _fragments(batch)]
            empty = pa.array([hashlib.sha256(f.groups[1:]).hexdigest() if f.valid else "" for f in found])
            numbers = [pa.array([getattr(f, c) for f in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            links = _links(np.concatenate([np.zeros(0, np.int64), *(f.pairs for f in found)]), np.concatenate([np.zeros(0, np.int64), *(f.times for f in found)]), np.array([len(f.pairs) for f in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, empty, links], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    keys = "row long, doc_id long, chunk long, chunks long"
    parts = stage(docs.mapInArrow(split, f"{keys}, at long, low long, high long, text binary"))
    most = parts.agg(F.max("chunks")).first()[0] or 0
    found = parts.repartition("row", "chunk").mapInArrow(encode, f"{keys}, {FRAGMENT}")
    while most > 1:
        by = ["row", F.floor(F.col("chunk") / fan)]
        found = found.repartition(*by).sortWithinPartitions("row", "chunk").mapInArrow(compose, f"{keys}, {FRAGMENT}")
        most = -(-most // fan)
    return found.mapInArrow(finish, ALIGNED)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """Rows of ALIGNED: each document's counts, the digest of its groups, and its different id pairs with how often they are linked."""
    paths = paths or (vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY))

    def run(batches):
        a, b = encoder(ByteWords, paths[0], REMEMBERED), encoder(PieceWords, paths[1], REMEMBERED)
        part, n = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, 1, TEXT_BYTES):
            n_a, n_b, n_groups, n_links, hashes, pairs, times, held = _aligned(_led(batch.column(1)), a, b)
            rows = (part << 33 | np.arange(n, n + batch.num_rows)) * 2
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(hashes, pa.string()), _links(pairs, times, held)],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    long_ = F.coalesce(F.octet_length("text") >= size, F.lit(False))
    return texts.where(~long_).mapInArrow(run, ALIGNED).unionByName(_long(texts.where(long_), paths, size, fan))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = RANGE, hot_pairs: int = HOT_PAIRS, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    The first tokenizer is given a space and the text, the second the text, before which it puts one itself. A null or empty text,
    or one whose pieces don't give its bytes, has no tokens: zeros and an empty digest. Links are pairs of token occurrences that
    share a group; a pair's count is how many documents have it, n_best counts links whose pair has the greatest count of
    its first id (ties count), count_sum adds counts up. Rows that repeat are documents of their own, also without an id; other columns
    are ignored; an empty table gives an empty result.
    """
    on_workers(docs.sparkSession)
    found = stage(aligned(docs, paths, size, fan))
    links = found.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.times")
    counted = stage(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    first = F.expr(f"pair div {PAIR}").alias("first")
    best = counted.groupBy(first).agg(F.max("n").alias("most"))  # a row per id of the first vocabulary
    known = stage(counted.select("pair", "n", first).join(F.broadcast(best), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    hot = stage(commonest(known, "n", hot_pairs))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    often = links.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    rare = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(known, "pair").groupBy("row").agg(*sums)
    totals = often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.drop("links").join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
