"""Stretches, alignment, windows and whitening against plain versions of the same."""

import hashlib
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kalends.llm import alignment, whitening, windows
from kalends.llm.byte_words import BYTE_VOCABULARY, PIECE_VOCABULARY, ByteWords, PieceWords, vocabulary_path

BYTES, PIECES = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)
WHOLE = Tokenizer.from_file(BYTES)
WHOLE.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
A, B = ByteWords(BYTES), PieceWords(PIECES)
TEXTS = st.text(
    alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbB'’.,!? \t\n\r\x0b\x0c\x1c\x85 　́̇Iİiß1²漢<|endoftext|>sStTdDmMéÉ▁×÷  \n\n")), max_size=40
)
LONG = " ".join(f"w{i % 977} Ünter{i}." for i in range(20_000))
DOCS = "doc_id long, text string, row long, pair int, n long, chunk int, start long"
ROWS = [
    (1, "One two three. Four\nfive"), (2, None), (3, ""), (4, " \t\n"), (None, "no id"), (None, "no id"), (5, LONG), (6, "x" * 5000 + " y"), (7, " " * 3000), (8, "a▁b"),
    (9, "漢字 　 x<|endoftext|> <s>"), (9, "ab\x00c"), (10, "\n\n a \t é" * 50),
]


def characters():
    """The byte that each character of the byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_OF = characters()
TOKENS = {i: bytes(BYTE_OF[c] for c in t) for t, i in WHOLE.get_vocab(with_added_tokens=False).items()}


def piece(i):
    name = MODEL.id_to_piece(i)
    return bytes([int(name[3:5], 16)]) if MODEL.is_byte(i) else name.replace("▁", " ").encode()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_stretches_are_encoded_like_texts(given_texts):
    for words, front in ((A, ""), (A, " "), (B, " ")):
        ids, n, *_ = words.column(pa.array([front + t for t in given_texts]))
        for t, end, size in zip(given_texts, np.cumsum(n), n):
            got = ids[end - size : end].tolist()
            if words is A:
                assert got == WHOLE.encode(front + t, add_special_tokens=False).ids
            elif t:
                want = MODEL.encode(t)
                assert got == want if b"".join(map(piece, want)) == f" {t}".encode() else B.size in got


def test_stretches_are_forgotten_and_learnt_anew(texts):
    few = ByteWords(BYTES, remembered=50)
    for _, t in texts[:20] + texts[:20]:
        ids, *_ = few.column(pa.array([t or ""]))
        assert ids.tolist() == WHOLE.encode(t or "", add_special_tokens=False).ids


# Alignment


def slow_groups(text):
    if not text:
        return None
    a, b = WHOLE.encode(f" {text}", add_special_tokens=False).ids, MODEL.encode(text)
    if b"".join(TOKENS[i] for i in a) != f" {text}".encode() or b"".join(map(piece, b)) != f" {text}".encode():
        return None
    ends_a, ends_b = (np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((TOKENS.get, a), (piece, b)))
    both, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for end in both:
        x, y = i, j
        while i < len(a) and ends_a[i] <= end:
            i += 1
        while j < len(b) and ends_b[j] <= end:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def slow_alignment(rows):
    found = [(d, slow_groups(t)) for d, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in found]
    held = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), c.total(), sum(n for p, n in c.items() if held[p] == most[p[0]]),
         sum(n * held[p] for p, n in c.items()), hashlib.sha256(shown(g).encode()).hexdigest() if g else "")
        for (d, g), c in zip(found, links)
    ]


def key(row):
    return str(row[0]), row[1:]


@pytest.mark.parametrize("how", [{}, {"size": 700, "hot_pairs": 100, "fan": 2}])
def test_alignment_by_brute_force(spark, texts, how):
    rows = ROWS + texts[:100]
    got = alignment.align(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], DOCS).repartition(4), **how).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow_alignment(rows), key=key)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_fragments_are_a_monoid(data):
    """Any cutting of the tokens of any text at any bytes, composed in any order of brackets, is the whole."""
    text = data.draw(TEXTS.filter(bool))
    groups = slow_groups(text)
    size = len(text.encode()) + 1
    cuts = [0, *sorted(set(data.draw(st.lists(st.integers(1, size), max_size=6))) - {size}), size]
    if groups is None:
        return
    a, b = (np.array([i for g in groups for i in g[k]]) for k in (0, 1))
    ends_a, ends_b = np.cumsum([len(TOKENS[i]) for i in a.tolist()]), np.cumsum([len(piece(i)) for i in b.tolist()])
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        parts.append(alignment.Fragment.of(a[in_a], ends_a[in_a], b[in_b], ends_b[in_b]))

    def tree(fs):
        if len(fs) == 1:
            return fs[0]
        at = data.draw(st.integers(1, len(fs) - 1))
        return tree(fs[:at]).then(tree(fs[at:]))

    unit = alignment.Fragment()
    for whole in (tree(parts), reduce(alignment.Fragment.then, parts, unit), reduce(alignment.Fragment.then, [*parts, unit])):
        f = whole.whole()
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        assert f.groups[1:].decode() == shown(groups) and f.n_groups == len(groups) and (f.n_a, f.n_b) == (len(a), len(b)) and f.n_links == links.total()
        assert dict(zip(f.pairs.tolist(), f.times.tolist())) == {x * alignment.PAIR + y: n for (x, y), n in links.items()}


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(2, 12))
def test_ranges_cover_texts_and_give_the_same_groups(text, size):
    raw = f" {text}".encode()
    cuts = alignment.ranges(raw, size)
    assert [c[2] for c in cuts] == [0, *(c[3] for c in cuts[:-1])] and cuts[-1][3] == len(raw) and all(x <= low and high <= y for x, y, low, high in cuts)
    groups = slow_groups(text)
    if groups is not None:
        f = reduce(alignment.Fragment.then, [alignment.fragment(raw[x:y], x, low, high, A, B) for x, y, low, high in cuts]).whole()
        assert f.groups[1:].decode() == shown(groups)


def test_large_groups_are_counted_by_ids():
    a, b = np.array([5, 6] * 100), np.array([7] * 50)
    pairs, times, groups = alignment.linked(a, np.zeros(200, int), b, np.zeros(50, int), 1)
    assert dict(zip(pairs.tolist(), times.tolist())) == {5 * alignment.PAIR + 7: 5000, 6 * alignment.PAIR + 7: 5000} and not groups.any()


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []


# Windows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.lists(st.integers(1, 400), max_size=20), st.booleans(), st.sampled_from([16, 48, 64]))
def test_windows_cost_least(lengths, inside, last, capacity):
    ends = np.cumsum(lengths)
    sentences = np.array(sorted(s for s in set(inside) if s < ends[-1] and s not in ends), np.int64)
    at, cost = windows.places(ends, sentences, capacity, last)
    assert at[0] == 0 and at[-1] == ends[-1] and np.diff(at).max() <= capacity and set(sentences) | set(ends) <= set(at.tolist())

    def padding(n):
        return 0 if n & (n - 1) == 0 else capacity - n

    least = [0]
    for j in range(1, len(at)):
        least.append(min(least[i] + padding(at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= capacity))
    cuts = windows.windows(at, cost, capacity)
    price = dict(zip(at.tolist(), cost.tolist()))
    assert sum(padding(n) for n in np.diff(cuts, prepend=0).tolist()) + sum(price[c] for c in cuts.tolist()) == least[-1]


def check_pieces(got, rows, capacity):
    """Pieces tile documents and sequences, and hold the right ids; returns the share of padding."""
    ids_of = {}
    for d, t in rows:
        ids_of.setdefault(d, []).append(np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, windows.END_ID], "<u4"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for d, wanted in ids_of.items():
        if len(wanted) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(wanted[0])) and r["ids_crc32"] == zlib.crc32(wanted[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(wanted[0])
        assert sum(r["length"] for r in by_doc[d]) == sum(map(len, wanted))
    pad = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / sum(r["length"] for r in got)


@pytest.mark.parametrize("run_tokens", [windows.RUN_TOKENS, 3000])
def test_window_packing(spark, texts, run_tokens):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert check_pieces(windows.pack(docs, run_tokens=run_tokens).collect(), texts, windows.CAPACITY) < 0.015


def test_window_packing_edges(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in ROWS], DOCS).repartition(3)
    got = windows.pack(docs, capacity=64, run_tokens=500).collect()
    check_pieces(got, ROWS, 64)
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 2] == [(1, 1)]
    assert windows.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_windows_keep_the_order_of_documents(spark, texts):
    got = windows.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r["doc_id"] for r in got))
    assert order == [d for d, _ in texts]


def test_sentences_end_behind_marks_and_lines():
    texts = ["One two. Three four!\nFive 3.5 six? Seven", None, "", "a.b\nc"]
    ids, n, at = windows.encoded(A, pa.array(texts))
    assert n.tolist() == [len(WHOLE.encode(t or "").ids) + 1 for t in texts]
    first = WHOLE.encode(texts[0]).ids
    assert [WHOLE.decode(first[x:y]) for x, y in zip([0, *at[at < n[0]].tolist()], [*at[at < n[0]].tolist(), n[0]])] == ["One two.", " Three four!\n", "Five 3.5 six?", " Seven"]


# Whitening


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(-(2**40), 2**40) | st.integers(-3, 3), min_size=d, max_size=d), min_size=1, max_size=150)))
def test_bit_planes_give_exact_products(rows):
    sums, crossed = whitening.cross_products(np.array(rows, np.int64))
    x = np.array(rows, object)
    assert sums == x.sum(axis=0).tolist() and crossed == (x.T @ x).tolist()


def test_whitening_by_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    nan, twice = float("nan"), table.limit(3)
    odd = spark.createDataFrame([(-1, None), (-2, [nan] * 64), (-3, [None] * 64), (-4, []), (-5, [1e30] * 64), (-6, [1.0, 2.0]), (-7, [float("-inf")] * 64)], "vec_id long, embedding array<float>")
    got = whitening.whiten(table.unionAll(twice).unionAll(odd)).collect()
    data = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], np.float64)).astype(int) + 1_000_000) for r in table.unionAll(twice).collect()]
    fit = np.unique(np.stack([x for _, x in data]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (n * fit.T @ fit - np.outer(s, s)) / n**2
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:16]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert by.keys() == {i for i, _ in data} and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    signs = None
    for i, x in data:
        own = sorted(by[i], key=lambda r: r["component"])
        times = sum(j == i for j, _ in data)
        assert [r["component"] for r in own] == [c for c in range(1, 17) for _ in range(times)] and {r["deviation"] for r in own} == {int(((n * x - s) ** 2).sum())}
        white, want = np.array([r["whitened"] for r in own[::times]]), ((x - s / n) @ vectors[:, order]) / np.sqrt(values[order])
        signs = np.sign(white) * np.sign(want) if signs is None else signs
        assert np.allclose(white, want * signs, atol=1e-7)
    assert np.allclose([r["explained"] for r in sorted(by[data[-1][0]], key=lambda r: r["component"])[:: sum(j == data[-1][0] for j, _ in data)]], values[order] / np.trace(v), rtol=1e-9)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, n int, component string"
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0]), (3, [5.0]), (4, [1.0, 2.0, 3.0]), (5, [3.0, 2.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3), (4, 1, 2), (5, 1, 2)]
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    huge = spark.createDataFrame([(i, [float(2**30 * i), 0.5 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(huge).collect()} == {0: None, 1: None, 2: None, 3: None}
