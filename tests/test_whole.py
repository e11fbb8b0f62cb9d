"""Queries over whole tables, beside those whose SQL states a fixed part."""

from lodestone.operators import search as S
from lodestone.plans import registry


def test_every_vector_is_asked(spark, sf):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    asked = {r["query_id"] for r in registry.queries()["vector_topk_batch"](spark, sf).collect()}
    assert asked == {i for i in ids if i % 20 == 0} and max(asked) >= 20
    near = {r["query_id"] for r in registry.queries()["near_duplicates_whole"](spark, sf).collect()}
    assert max(near) >= 20


def test_one_query_equals_many(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = S.query_vectors(e, e.vec_id == 7)
    rows = lambda df: [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert rows(S.nearest(e, q[0], 15)) == rows(S.top_k(e, q, 15))
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [0.0, 0.0]), (5, [3.0, None]), (6, [0.0, 2.0]), (9, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert rows(S.nearest(odd, (9, [1.0, 1.0]), 10)) == rows(S.top_k(odd, [(9, [1.0, 1.0])], 10))


def test_blocks_change_nothing(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(S.top_k_blocks(e, e.where("vec_id < 90"), 5, block=40)) == rows(S.top_k(e, S.query_vectors(e, e.vec_id < 90), 5))


def test_every_edge_is_merged(spark, sf):
    from lodestone.plans.common import entity_edges

    pairs = lambda df: {(r["source"], r["target"]) for r in df.collect()}
    merged = registry.queries()["edge_merge"](spark, sf)
    assert pairs(merged) == pairs(entity_edges(spark, sf))
    assert {r["source"].split(":")[0] for r in merged.collect()} == {"customer", "supplier", "nation", "part"}
