"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each with a tree of its own whose contexts are the last 0 to DEPTH bytes.
A node's Krichevsky-Trofimov estimate is mixed half and half with the product of its children's mixtures; given the
training corpus, a symbol's probability is then a mixture over all depths with weights that the evidence sets.

Spark counts (DEPTH + 1)-byte grams once and gathers those that agree in all but the last two context bytes and the symbol.
Such a group is a whole subtree, at most 2 ** 24 grams, which numpy sums upwards. The nodes above are summed level by
level in Spark (log evidence and counts in one aggregate); mixture weights come down by joins, and the subtrees give every
gram of the corpus its log10 probability. Scoring a document sums those of its grams.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from .common import stage, text_slices

DEPTH = 5
#: Context bytes below which a subtree is worked on as a whole.
SUBTREE = 2
HELD_OUT_MOD, HELD_OUT = 7, 2
#: Ends a text and fills the context before its first byte; UTF-8 never holds it.
END = b"\xff"
#: Bytes of text that are worked on together, about, and entries after which partial counts are merged and sent on.
CHUNK = 1 << 20
HELD_GRAMS, HELD_WORDS = 1_000_000, 100_000
#: Grams of whole subtrees that are worked on together, about.
TREE_GRAMS = 100_000
#: Commonest words whose counts every task gets; all other words meet their counts in a join. Longer words than
#: WORD_BYTES go by a digest.
HOT_WORDS, WORD_BYTES = 200_000, 64
#: Commonest grams whose probabilities every task gets, in a table of 32 MB at most; the others meet theirs in a join.
HOT_GRAMS = 1_000_000
#: Counts up to which log gamma comes from a table.
TABLE = 1 << 12


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_MOD == HELD_OUT


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of texts in a row, and how many each has (its bytes and the end).

    A gram's lowest byte is the symbol, the byte above it the one just before, and so on.
    """
    pad = END * depth
    raw = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    key = raw[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        key |= raw[depth - j : len(raw) - j].astype(np.uint64) << np.uint64(8 * j)
    starts = np.cumsum(size + depth) - size - depth
    keep = np.ones(len(raw), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[keep[depth:]].view(np.int64), size


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Words per text, all words in a row, and the texts with single spaces; A-Z lower-cased, a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    words = lists.flatten()
    some = pc.not_equal(pc.binary_length(words), 0)
    n = np.bincount(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[some.to_numpy(zero_copy_only=False)], minlength=len(lists))
    words = words.filter(some)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return n, words, pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ").cast(pa.binary()).to_pylist()


def _keys(words: pa.Array) -> pa.Array:
    """What stands for each word in joins: itself, or a space and a digest for a long one."""
    long = pc.greater(pc.binary_length(words), WORD_BYTES)
    if not pc.any(long).as_py():
        return words
    return pa.array([f" {xxh3_128_hexdigest(w)}" if x else w for w, x in zip(words.to_pylist(), long.to_pylist())], pa.string())


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """gram, word, n: counts in training documents of every gram of all documents (word null) and of every word (gram null).

    The empty word is the end token. Grams that only held-out documents have are listed with 0.
    """

    def run(batches):
        parts, held, words = [], 0, Counter()

        def send_words():
            out = pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["gram", "word", "n"])
            words.clear()
            return out

        def send_grams(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.string()), pa.array(n, pa.int64())], names=["gram", "word", "n"])

        for b in text_slices(batches, 1, CHUNK):
            n_words, flat, texts = _split(b.column(1))
            out = np.array([held_out(d) for d in b.column(0).to_pylist()])
            key, size = grams(texts, depth)
            learnt = np.repeat(~out, size)
            for k, w in ((key[learnt], 1), (key[~learnt], 0)):
                k, n = np.unique(k, return_counts=True)
                parts.append((k, n * w))
                held += len(k)
            if held > HELD_GRAMS:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if 2 * held > HELD_GRAMS:
                    yield send_grams(*parts[0])
                    parts, held = [], 0
            seen = flat.filter(pa.array(np.repeat(~out, n_words))).value_counts()
            for w, n in zip(_keys(seen.field(0)).to_pylist(), seen.field(1).to_pylist()):
                words[w] += n
            words[""] += int((~out).sum())
            if len(words) > HELD_WORDS:
                yield send_words()
        if words[""] == 0:
            del words[""]
        if words:
            yield send_words()
        if parts:
            yield send_grams(*_merged(parts))

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "gram long, word string, n long")
    return rows.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x of one half or more: Stirling's series at x + 8."""
    z, down = x + 8, x
    for k in range(1, 8):
        down = down * (x + k)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(down)


def _evidence(a: Column, b: Column) -> Column:
    """Log probability by the KT estimator of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)


_HALVES, _WHOLES = (np.array([math.lgamma(n + x) for n in range(TABLE)]) for x in (0.5, 1.0))


def _log_gammas(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """ln gamma(n + more) of whole numbers, as _log_gamma gives it beyond the table."""
    found = table[np.minimum(n, TABLE - 1)]
    big = np.flatnonzero(n >= TABLE)
    z = n[big] + more
    found[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return found


def _evidences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gammas(a, _HALVES, 0.5) + _log_gammas(b, _HALVES, 0.5) - _log_gammas(a + b, _WHOLES, 1.0) - math.log(math.pi)


class Subtrees:
    """Whole subtrees of grams: nodes of every depth from `depth` up to `top`, the deepest first.

    A node's key is its context above its eight-bit place in the byte: 1, then the bits so far. Keys are distinct; counts are
    those of training.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.order = np.argsort(key)
        key, n = key[self.order].view(np.uint64), n[self.order]
        nodes, zeros, ones, self.at, self.bits, before = [], [], [], [], [], 0
        for k in range(8):
            prefix = key >> np.uint64(8 - k)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first = np.flatnonzero(new)
            bit = (key >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            one = np.add.reduceat(np.where(bit, n, 0), first)
            nodes.append(key[first] >> np.uint64(8) << np.uint64(8) | np.uint64(1 << k) | (key[first] & np.uint64(255)) >> np.uint64(8 - k))
            zeros.append(np.add.reduceat(n, first) - one)
            ones.append(one)
            self.at.append(np.cumsum(new) - 1 + before)
            self.bits.append(bit)
            before += len(first)
        node, a, b = (np.concatenate(x) for x in (nodes, zeros, ones))
        own = mixed = _evidences(a, b)
        self.levels = [(a, b, own, None)]
        self.up = []
        for d in range(depth - 1, top - 1, -1):
            node, up = np.unique(node & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            a, b = (np.bincount(up, x).astype(np.int64) for x in (a, b))
            own, below = _evidences(a, b), np.bincount(up, mixed)
            mixed = np.logaddexp(own, below) - math.log(2)
            self.levels.append((a, b, own, below))
            self.up.append(up)
        self.node, self.mixed = node.view(np.int64), mixed

    def scores(self, total: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol, in the order that the grams were given in.

        total: what the depths above have put together of each top node's probability of a one; rest: the weight left.
        """
        for d in range(len(self.levels) - 1, -1, -1):
            a, b, own, below = self.levels[d]
            weight = 1.0 if below is None else 1 / (1 + np.exp(np.minimum(below - own, 700)))
            total, rest = total + rest * weight * (b + 0.5) / (a + b + 1), rest * (1 - weight)
            if d:
                total, rest = total[self.up[d - 1]], rest[self.up[d - 1]]
        found = np.zeros(len(self.order))
        for at, bit in zip(self.at, self.bits):
            found += np.log10(np.where(bit, total[at], 1 - total[at]))
        out = np.empty(len(found))
        out[self.order] = found
        return out


def _groups(batches, size: int = TREE_GRAMS):
    """Lists of numpy columns of whole groups, about so many rows together; the group is the first column and in order."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, size):
            held.append([c.to_numpy(zero_copy_only=False) for c in b.slice(at, size).columns])
            n += len(held[-1][0])
            if n >= size:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield [c[:cut] for c in whole]
                held = [[c[cut:].copy() for c in whole]]
                n = len(held[0][0])
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def gram_scores(counted: DataFrame, depth: int) -> DataFrame:
    """gram, score, n: log10 probability of each gram's symbol in its context, from counted(gram, n)."""
    top = max(0, depth - SUBTREE)
    grouped = counted.select((F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))).alias("group"), "gram", "n")

    def up(batches):
        for _, key, n in _groups(batches):
            t = Subtrees(key, n, depth, top)
            a, b, own, below = t.levels[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.node), pa.array(a.astype(float)), pa.array(b.astype(float)), pa.array(own), pa.array(own if below is None else below), pa.array(t.mixed)],
                names=["node", "a", "b", "own", "below", "mixed"],
            )

    columns = "node long, a double, b double, own double, below double, mixed double"
    levels = [stage(grouped.repartition("group").sortWithinPartitions("group").mapInArrow(up, columns))]
    for d in range(top - 1, -1, -1):
        parent = F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))  # the context's last d bytes and the place
        above = levels[-1].groupBy(parent.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("mixed").alias("below"))
        above = above.withColumn("own", _evidence(F.col("a"), F.col("b")))
        high, low = F.greatest("own", "below"), F.least("own", "below")
        levels.append(stage(above.withColumn("mixed", high + F.log1p(F.exp(low - high)) - math.log(2))))
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    weight = 1 / (1 + F.exp(F.col("below") - F.col("own")))
    down = levels[-1].withColumn("total", F.lit(0.0)).withColumn("rest", F.lit(1.0))
    for d, level in enumerate(reversed(levels[:-1]), 1):  # from the root
        told = stage(down.select(F.col("node").alias("up"), (F.col("total") + F.col("rest") * weight * one).alias("total"), (F.col("rest") * (1 - weight)).alias("rest")))
        down = level.withColumn("up", F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(told, "up")
    given = down.select(F.shiftright("node", 8).alias("group"), F.lit(False).alias("is_gram"), F.col("node").alias("key"), F.lit(0).cast("long").alias("n"), "total", "rest")
    both = grouped.select("group", F.lit(True).alias("is_gram"), F.col("gram").alias("key"), "n", F.lit(0.0).alias("total"), F.lit(0.0).alias("rest")).unionByName(given)

    def finish(batches):
        for _, is_gram, key, n, total, rest in _groups(batches):
            is_gram = is_gram.astype(bool)
            t = Subtrees(key[is_gram], n[is_gram], depth, top)
            order = np.argsort(key[~is_gram])  # as t.node: keys are distinct
            found = t.scores(total[~is_gram][order], rest[~is_gram][order])
            yield pa.RecordBatch.from_arrays([pa.array(key[is_gram]), pa.array(found), pa.array(n[is_gram])], names=["gram", "score", "n"])

    return both.repartition("group").sortWithinPartitions("group").mapInArrow(finish, "gram long, score double, n long")


class GramTable:
    """Open-addressing hash table from grams to scores, built and asked by numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of those that meet, one stays
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) % slots

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of keys, 0 for those that aren't in the table, and which those are."""
        at = self._first(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            left = left[self.keys[at[left]] != -1]
            at[left] = (at[left] + 1) % len(self.keys)
            left = left[self.keys[at[left]] != keys[left]]
        absent = self.keys[at] != keys
        return np.where(absent, 0.0, self.values[at]), absent


def commonest(counted: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of counted whose n is so large that at most `most` rows have it.

    The limit comes from a histogram of n in steps of an eighth of a power of two, so nothing is sorted.
    """
    step = F.floor(8 * F.log2(F.greatest(F.col(n), F.lit(1)).cast("double")))
    held, least = 0, None
    for at, rows in sorted(counted.groupBy(step.alias("at")).count().collect(), reverse=True):
        held += rows
        if held > most:
            break
        least = at
    return counted.where(step >= least) if least is not None else counted.limit(0)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def score(docs: DataFrame, depth: int = DEPTH, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every document.

    Texts are lower-cased (A-Z) and cut into words; the tokens are the words and one end. The model scores the same: the
    words with single spaces and an end symbol, n_bytes in all. Documents whose crc32 of doc_id modulo 7 is not 2
    are learnt from, in whole; a null doc_id counts as an empty string. base_score is the unigram model with add-one
    smoothing. A null, empty or wordless text is its end alone. Rows that repeat are learnt from and scored as
    often as they come; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = stage(corpus_counts(docs, depth))
    words = counts.where("gram is null AND n > 0").select("word", F.col("n").alias("c"))
    n_train, n_distinct, n_ends = words.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    n_train, n_ends = n_train or 0, n_ends or 0
    hot = commonest(words.where("word <> ''"), "c", hot_words).toArrow()
    known = spark.sparkContext.broadcast((hot.column(0).combine_chunks(), np.log10(np.append(hot.column(1).to_numpy(), 0) + 1.0)))
    scores = stage(gram_scores(counts.where("gram is not null").select("gram", "n"), depth))
    got = commonest(scores, "n", hot_grams).toArrow()
    table = spark.sparkContext.broadcast(GramTable(got.column(0).to_numpy(), got.column(1).to_numpy()))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        names, logs_of = known.value
        for b in text_slices(batches, 1, CHUNK):
            n_words, flat, texts = _split(b.column(1))
            doc = np.repeat(np.arange(len(texts)), n_words)
            numbered = flat.dictionary_encode()
            distinct, word = _keys(numbered.dictionary), numbered.indices.to_numpy()
            at = pc.fill_null(pc.index_in(distinct, value_set=names), -1).to_numpy()
            sure = (at >= 0)[word]
            logs = np.bincount(doc, logs_of[at][word], len(texts)) + math.log10(n_ends + 1)
            n_sure = np.bincount(doc, sure, len(texts)).astype(np.int64) + (n_ends > 0)
            rare = distinct.take(pa.array(word[~sure]))
            key, size = grams(texts, depth)
            ends = np.cumsum(size)
            each, absent = table.value.get(key)
            score = np.add.reduceat(each, ends - size)
            lacking = np.add.reduceat(absent, ends - size, dtype=np.int64)
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part << 33 | np.arange(n, n + len(texts))), ids, pa.array([held_out(d) for d in ids.to_pylist()]), pa.array(n_words + 1), pa.array(n_sure),
                    pa.array(logs), pa.array(score), pa.array(size), _lists(np.bincount(doc[~sure], minlength=len(texts)), rare), _lists(lacking, pa.array(key[absent])),
                ],
                names=[f"c{k}" for k in range(10)],
            )
            n += len(texts)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, sure long, logs double, score double, n_bytes long, rare array<string>, grams array<long>"
    first = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    seldom = first.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    seldom = seldom.join(words, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    result = first.drop("rare", "grams").join(seldom, "row", "left")
    apart = first.select("row", F.explode("grams").alias("gram")).join(scores.select("gram", F.col("score").alias("each")), "gram")
    result = result.join(apart.groupBy("row").agg(F.sum("each").alias("more_score")), "row", "left")
    result = result.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    size = math.log10(n_train + n_distinct + 1)
    return result.select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )
