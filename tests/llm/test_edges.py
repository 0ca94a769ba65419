"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from kalends.llm import chat, ctw, link_trust, mixing, near_text, neighbours, packing, sharding, simhash, token_output, weak_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, id int, fp int, rank int, n int, bucket int, copies int, s int, word string"
LONG = " ".join(f"w{i % 977} x{i}." for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven", "a"), (2, None, None), (3, "", "a"), (4, " \t\n", "b"), (None, "a text without an id", "b"), (5, LONG, "b"), (6, LONG, "c"),
    (7, "same row", "c"), (7, "same row", "c"), (8, "SAME Row", None), (9, "ünï\u0301 cöde 漢字 \u00a0 <|endoftext|> don't", "a"), (None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(d, t, "en", s, 0, 1, 2, 3, 4, 5, 6, 7, 8, "w") for d, t, s in ROWS]
    return spark.createDataFrame(data, DOCS).repartition(3)


OPERATORS = {
    "simhash": simhash.near_duplicates, "tokens": token_output.round_trip, "ctw": lambda d: ctw.score(d, depth=2), "rules": weak_rules.judge,
    "sharding": sharding.shard, "mixing": mixing.mix, "near": near_text.near_copies,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_come_back_whole(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, _, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_packing_edges(spark, docs):
    got = packing.pack(docs, capacity=64).collect()
    assert {r["doc_id"] for r in got} == {d for d, _, _ in ROWS} and max(r["offset"] + r["length"] for r in got) <= 64
    assert [(r["length"], r["piece"]) for r in got if r["doc_id"] == 2] == [(1, 0)]
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_without_copies_keeps_columns_and_rows_without_id(docs):
    got = near_text.without_copies(docs)
    assert got.columns == docs.columns
    ids = sorted(r["doc_id"] or 0 for r in got.collect())
    assert ids == [0, 0, 1, 2, 5, 7, 7, 9]  # 3, 4 are copies of 2 (no words), 6 of 5, 8 of 7


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='http://B.net/x'>"), (3, "http://A.example.NET/en/x?q", None), (3, "http://A.example.NET/en/x?q", None), (None, "http://c.org", ""), (4, "x://d.net", "<a href=//e.org/y>")]
    pages = spark.createDataFrame([(*r, "h", "r", 1) for r in rows], "page_id long, url string, html string, host string, rule string, n int")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.judge(pages).collect())
    assert got[0] == (0, "c.org", "", None, "allow") and got[1] == (1, "", "", None, "allow") and got[2] == (2, "", "", None, "allow")
    assert got[3] == got[4] == (3, "a.example.net", "/en/x", "example.net/en/", "allow") and got[5][:4] == (4, "d.net", "", None)
    assert link_trust.judge(pages.limit(0)).collect() == []


def test_turns_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, None, None), (1, 2, "bob", "<|im_end|>"), (1, 2, "bob", "<|im_end|>"), (2, None, "system", "x"), (None, 1, "eve", "hi"), (None, None, "eve", "ho")]
    turns = spark.createDataFrame([(*r, 9, "p") for r in rows], "conv_id long, turn long, role string, text string, start int, perspective string")
    got = chat.perspectives(turns).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "bob"), (1, "\\unknown"), (None, "eve")}
    assert sum(r["conv_id"] == 1 and r["perspective"] == "bob" for r in got) == 4
    assert [r["turn"] for r in sorted(got, key=lambda r: r["position"]) if r["conv_id"] is None] == [None, 1]
    assert chat.perspectives(turns.limit(0)).collect() == []


def test_vectors_edges(spark):
    v = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [3.0, 4.0]), (10, [])]
    vectors = spark.createDataFrame([(*x, 1) for x in v], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in neighbours.search(vectors).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 2, 0.0), (100, 4, 9, 20**0.5)]
    assert neighbours.search(vectors.limit(0)).collect() == [] and neighbours.search(vectors.where("vec_id = 1")).collect() == []
    assert neighbours.search(vectors.where(F.col("vec_id") == 100)).collect() == []


def test_words_end_and_long_urls_of_pages(spark):
    rows = [(1, "http://a.com/" + "p" * 200_000, "<a href='http://b.net/'>" + "x " * 200_000)]
    got = link_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["host"], len(r["path"])) for r in got] == [("a.com", 200_001)]


def test_model_edges_at_the_querys_depth(docs):
    got = ctw.score(docs).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 and r["n_bytes"] >= 1 for r in got)


PLAIN = " ".join(f"word{i} and{i * 7 % 31}" for i in range(60)) + "."
STAGED = [(None, PLAIN), (None, PLAIN), (7, PLAIN), (7, PLAIN), (None, "two words"), (3, None), (4, ""), (9, PLAIN.replace("word", "other")), (None, PLAIN.replace("word", "third")), (9, "short")]


@pytest.fixture(scope="module")
def staged(spark):
    rows = [(d, t, "en", f"s{n % 2}" if n % 5 else None, 1, n, 2, 3, 4, 5) for n, (d, t) in enumerate(STAGED)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, row int, _id int, _copies int, _copy int, key int")


def test_stages_take_rows_one_by_one(spark, staged):
    import corpus_pipeline

    kept = corpus_pipeline.quality_rules(spark, staged, "")
    assert kept.columns == staged.columns and sorted(r["row"] for r in kept.collect()) == [0, 1, 2, 3, 7, 8]
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    got = single.collect()
    assert single.columns == staged.columns and sorted((r["doc_id"] or 0, r["row"]) for r in got) in ([(0, 8), (7, 2), (9, 7)], [(0, 8), (7, 3), (9, 7)])
    mixed = corpus_pipeline.mix_sources(spark, staged, "")
    words, targets = {}, {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(staged).collect()}
    assert mixed.columns == staged.columns
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert all(n <= targets[s][0] + 1e-6 for s, n in words.items()) and words


def test_stages_of_an_empty_table(spark, staged):
    import corpus_pipeline

    docs = staged.limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, "")
        assert out.collect() == []
        docs = out if name != "pack_sequences" else docs


def test_pipeline_of_rows_without_ids(spark, staged, tmp_path):
    import corpus_pipeline

    staged.drop("row").withColumnRenamed("key", "row").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert got and {r["doc_id"] for r in got} <= {None, 7, 9} and all(r["offset"] + r["length"] <= 4096 for r in got)
