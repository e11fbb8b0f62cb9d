"""Registered queries of the training-data operators and the pipeline."""

import pytest

pytest.importorskip("lodestone.llm")

from harness import compare, connect  # noqa: E402

from lodestone.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, sf):
    compare(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"op12_schema_rewrite"}))  # op12 has files, not documents
def test_covers_all_rows(name, spark, sf):
    rows = registry.queries()[name](spark, sf).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        if name != "mixing":
            now = docs.count()
            assert 0 < now <= before, name
            before = now
    got = pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() >= 1


def test_pipeline_equals_brute_force(spark, sf):
    """Each stage's rows against a plain computation on the same documents: verdicts, equal texts, all pairs of shingle sets, targets, tokens."""
    import re
    from collections import Counter, defaultdict

    import public_tokenizers
    from test_near_copies import brute
    from tokenizers import Tokenizer

    from lodestone.llm import mixing, packing, quality

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    field = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stages = dict(pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    rows = [r for r in rows if quality.judge(r["text"], field)[6]]
    docs = stages["quality_rules"](spark, docs, sf).cache()
    assert ids(docs) == sorted(r["doc_id"] for r in rows)

    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    rows = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]
    docs = stages["exact_dedup"](spark, docs, sf).cache()
    assert ids(docs) == sorted(r["doc_id"] for r in rows)

    rows.sort(key=lambda r: r["doc_id"])
    classes = brute([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i] == i]
    docs = stages["simhash_near_dedup"](spark, docs, sf).cache()
    assert ids(docs) == [r["doc_id"] for r in rows]

    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    by_source = Counter()
    for r in rows:
        by_source[r["source"]] += size[r["doc_id"]]
    targets = mixing.weighted_targets(by_source)
    docs = stages["mixing"](spark, docs, sf).cache()
    copies, taken = Counter(ids(docs)), Counter()
    for r in rows:
        taken[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    for s, t in targets.items():
        longest = max(size[r["doc_id"]] for r in rows if r["source"] == s)
        assert abs(taken[s] - t) <= max(0.02 * t, longest / 2)

    encode = Tokenizer.from_file(public_tokenizers.path(packing.MODEL)).encode
    tokens = {r["doc_id"]: len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}
    pieces = stages["packing"](spark, docs, sf).collect()
    got, places = Counter(), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["doc_tokens"] == tokens[p["doc_id"]]
    assert got == Counter({d: n * tokens[d] for d, n in copies.items()})
    for sequence in places.values():
        ends = [0, *(o + n for o, n in sorted(sequence))]
        assert [o for o, _ in sorted(sequence)] == ends[:-1] and ends[-1] <= 2048
    assert Counter((p["doc_id"], p["start"], p["length"]) for p in pipeline.run(spark, sf).collect()) == Counter((p["doc_id"], p["start"], p["length"]) for p in pieces)
