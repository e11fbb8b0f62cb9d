"""Gram postings against plain scans of the texts."""

import random

import random

import pyarrow as pa
import pytest
from lodestone.operators import gram_index as G
from lodestone.operators import search as S
from pyspark.sql import functions as F

ODD = [None, "", "a", "ab", "Ab", " ", "ΟΔΟΣ", "ΟΔΟΣ ΟΔΟΣΑ", "οδός", "İstanbul", "straße STRASSE", "x😀y😀", "😀", "\n\tab\x0b", "KK k", "x" * 50_000 + "needle", "the And that", "The AND THAT", "%_\\.*"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randrange(1, 9)))
    texts = ODD + [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["same text"] * 100
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    return G.GramIndex.build(docs, file_bytes=20_000)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize("few", [G.FEW, 0])
@pytest.mark.parametrize("query", ["the And THAT", "ΟΔΟΣ", "οδοσ", "ab", "b", "Ab ba", "é", "😀", "y😀", "needle", "zq9", "", "  ", "straße", "İ", "K", "%_", "same TEXT"])
def test_words_as_a_scan_finds_them(monkeypatch, docs, index, query, few):
    monkeypatch.setattr(G, "FEW", few)
    assert ids(index.text_search(query)) == ids(S.text_search(docs, query))


@pytest.mark.parametrize("few", [G.FEW, 0])
@pytest.mark.parametrize("needles", [["ab"], ["b", "zq9"], ["οδος"], ["οδοσ", "needle"], ["i̇st"], ["😀"], [""], [], ["zq9"], ["bab ", "é", "a b"], ["x" * 200]])
def test_any_needle_as_a_scan_finds_it(monkeypatch, docs, index, needles, few):
    monkeypatch.setattr(G, "FEW", few)
    plain = docs.where(F.exists(F.array(*map(F.lit, needles)).cast("array<string>"), lambda n: F.contains(F.lower("text"), n)))
    assert ids(index.containing_any(needles)) == ids(plain)


def test_many_needles_in_one_join(spark, docs, index):
    needles = [(0, "ab"), (0, "ab"), (1, "b"), (2, "needle"), (3, "zq9"), (4, None), (5, ""), (6, "same text"), (7, "οδοσ"), (8, "😀"), (9, "bab a"), (10, "aab"), (10, "bba")]
    df = spark.createDataFrame(needles, "needle_id long, needle string")
    want = df.where("needle <> ''").distinct().join(docs, F.contains(F.lower("text"), F.col("needle"))).select("needle_id", "needle", "doc_id")
    got = index.matches(df)
    assert got.columns == ["needle_id", "doc_id", "text"]
    assert sorted((r["needle_id"], r["doc_id"]) for r in got.collect()) == sorted((r["needle_id"], r["doc_id"]) for r in want.collect())


def test_rare_needles_read_little(spark, docs, index):
    """A rare needle proposes few documents, and the scan is told their places."""
    assert index.share(["needle"]) < 0.01 and index.share(["zq9"]) == 0 and index.share([]) == 1
    read = index.text_search("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in read and "GreaterThanOrEqual(index_place" in read
    assert index._read([G.needle_grams("needle")]).count() == 1


def test_ranges_cover_their_places():
    assert G.cover([]) == [] and G.cover([5]) == [(5, 5)]
    assert G.cover([1, 2, 3, 9, 9]) == [(1, 3), (9, 9)]
    assert G.cover([1, 5, 100, 104, 1000], 2) == [(1, 104), (1000, 1000)]
    rng = random.Random(1)
    places = [rng.randrange(10**6) for _ in range(5000)]
    ranges = G.cover(places)
    assert len(ranges) <= G.RANGES and all(any(a <= p <= b for a, b in ranges) for p in places)


def test_postings_are_bounded_and_grouped_without_a_second_shuffle(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    many = spark.createDataFrame([(i, "same") for i in range(200)], "doc_id long, text string").repartition(2)
    index = G.GramIndex.build(many)
    assert index.postings().agg(F.max(F.size("places"))).first()[0] <= 16
    assert index.containing_any(["same"]).count() == 200
    again = G.GramIndex.load(spark, index.path)
    assert (again.column, again.rows) == ("text", 200) and again.containing_any(["am"]).count() == 200


def test_empty_table_and_clashing_names(spark):
    index = G.GramIndex.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.text_search("a").count() == 0 and index.containing_any(["", "a"]).count() == 0
    assert index.matches(spark.createDataFrame([(1, "a")], "needle_id long, needle string")).count() == 0
    with pytest.raises(ValueError, match="index_place"):
        G.GramIndex.build(spark.createDataFrame([(1, "a")], f"{G.PLACE} long, text string"))
    odd = G.GramIndex.build(spark.createDataFrame([(1, "ab", "c", 2, 3)], "block int, text string, gram string, offset int, n int"))
    assert odd.containing_any(["ab"]).collect()[0].asDict() == {"block": 1, "text": "ab", "gram": "c", "offset": 2, "n": 3}


@pytest.mark.parametrize("piece, merged", [(60, 100), (G.PIECE, G.MERGED)])
def test_posting_rows_equal_a_plain_list(monkeypatch, piece, merged):
    """All grams of odd texts, long ones in pieces, merged by ranges; every row states its number of places."""
    monkeypatch.setattr(G, "PIECE", piece)
    monkeypatch.setattr(G, "MERGED", merged)
    r = random.Random(1)
    rows = [(b, o, "".join(r.choice("ab \0é\U0010ffff中x") for _ in range(r.choice([0, 1, 2, 3, 50, 300])))) for b in (3, 7) for o in range(0, 4096, 37)]
    want = {}
    for b, o, t in rows:
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                want.setdefault((t[i : i + n], b), set()).add(o)
    kinds = (pa.int64(), pa.int32(), pa.string())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 40], strict=True), kinds, strict=True)], ["block", "offset", "text"]) for i in range(0, len(rows), 40)]
    got = [tuple(x.values()) for y in G.posting_rows(batches) for x in y.to_pylist()]
    assert len(got) == len(want) and {(g, b): p for g, b, p, _ in got} == {k: sorted(v) for k, v in want.items()}
    assert all(n == len(p) for *_, p, n in got)


def test_postings_are_dealt_by_the_size_of_the_texts(spark, monkeypatch):
    """Work a task does not grow with the table; few needles meet the postings without a shuffle of these."""
    monkeypatch.setattr(G, "BLOCK", 16)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 20) AS text")
    index = G.GramIndex.build(docs, file_bytes=2000)
    assert len(index.postings().inputFiles()) > 10
    found = index.matches(spark.createDataFrame([(1, "word399 word399"), (2, "nowhere")], "needle_id int, needle string"))
    assert [(x["needle_id"], x["doc_id"]) for x in found.collect()] == [(1, 399)]
