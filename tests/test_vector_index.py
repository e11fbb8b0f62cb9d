"""The inverted-file index: exact mode against brute force, approximate mode's recall, what bounds leave out."""

import math
import random

import pytest
from lodestone.operators import search as S
from lodestone.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, cell string, chunk int"


def brute(rows, queries, k, least=-2.0):
    """Cosine of every query with every row of another key; null, empty, zero and mismatched vectors score 0."""
    found = set()
    for q, a in queries:
        scores = []
        for key, b in rows:
            if key != q and key is not None:
                good = a and b and len(a) == len(b) and None not in a and None not in b
                length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if good else 0
                scores.append((-round(sum(x * y for x, y in zip(a, b, strict=True)) / length, 9) if length else -0.0, key))
        found |= {(q, key, -s, i) for i, (s, key) in enumerate(sorted(scores)[:k], 1) if -s >= least}
    return found


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], SCHEMA)


def hits(df):
    return {(r["query_id"], r["vec_id"], round(r["score"], 9), r["rank"]) for r in df.collect()}


def rows_of(n, dims=4, seed=1, odd=True):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [round((x + rng.gauss(0, 0.05)) * 64) / 64 for x in middles[i % 6]]) for i in range(n)]
    same = [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    strange = [(2000, None), (2001, []), (2002, [0.0] * dims), (2003, [1.0]), (2004, [1.0, None, 0.0, 0.0]), (2005, [-x for x in rows[0][1]]), (None, rows[1][1])]
    return rows + same + (strange if odd else [])


@pytest.mark.parametrize("cells,pack", [(1, 4096), (5, 16), (12, 7)])
def test_exact_equals_brute_force(spark, cells, pack):
    rows = rows_of(120)
    df = frame(spark, rows)
    index = V.build(df, cells=cells, pack=pack, recall=None)
    asked = [r for r in rows if r[0] is not None]
    assert hits(V.exact(index, df, 4)) == brute(rows, asked, 4)
    assert hits(V.exact(index, df, 3, 0.97)) == brute(rows, asked, 3, 0.97)
    assert hits(V.exact(index, df.where("vec_id % 7 = 0"), 500)) == brute(rows, [r for r in asked if r[0] % 7 == 0], 500)


def test_bounds_leave_cells_out_on_clustered_vectors(spark):
    """Packs of far clusters are never read for queries whose neighbours are near."""
    rows = rows_of(300, dims=8, odd=False)
    df = frame(spark, rows)
    index = V.build(df, cells=6, recall=None)
    met = []
    dealt = V._dealt

    def counted(asked, index, choose, most):
        out = dealt(asked, index, choose, most)
        met.append(out.selectExpr("sum(size(ids))").first()[0] or 0)
        return out

    V._dealt = counted
    try:
        got = hits(V.exact(index, df, 3))
    finally:
        V._dealt = dealt
    assert met[0] == len(rows) and met[1] < 0.2 * len(rows) * (len(index.centroids) - 1)
    assert {h[:2] for h in got} == {h[:2] for h in brute(rows, rows, 3)}


def test_stored_index_and_recall(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    V.build(e, f"file://{tmp_path}/index")
    index = V.load(spark, f"file://{tmp_path}/index")
    asked = e.where("vec_id % 20 = 0")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in e.collect()]
    want = {h[:2]: h[2] for h in brute(rows, [r for r in rows if r[0] % 20 == 0], 10)}
    got = {h[:2]: h[2] for h in hits(V.search(index, asked, 10))}
    assert len(got) == len(want) and sum(h in want for h in got) >= 0.9 * len(want)
    assert all(abs(want[h] - s) < 1e-8 for h, s in got.items() if h in want)
    assert V.candidates(index, asked, 40).groupBy("query_id").count().agg({"count": "max"}).first()[0] == 40
    assert index.packs(spark, [0]).select("cell").distinct().count() == 1


def test_empty_and_one(spark):
    none = frame(spark, [])
    index = V.build(none)
    assert V.exact(index, none).count() == V.search(index, none).count() == 0
    one = frame(spark, [(1, [1.0, 2.0])])
    index = V.build(one)
    assert V.exact(index, one).count() == 0 and V.search(index, one).count() == 0


def test_blocks_take_each_query_of_its_own_size(spark):
    rows = [(1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 1.0]), (4, [0.1, 1.0, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(q, v, r) for q, v, _, r in hits(S.top_k_blocks(df, df, 1))} == {(q, v, r) for q, v, _, r in brute(rows, rows, 1)}


def test_exact_sends_a_query_once_to_a_tile(spark):
    """Where no bound prunes, the second pass moves a row a query and tile of cells, not one a cell."""
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 1) * 64) / 64 for _ in range(16)]) for i in range(200)] + [(200, None), (201, [0.0] * 16)]
    df = frame(spark, rows)
    index, met, tiled = V.build(df, cells=20, recall=None), [], V._tiled

    def counted(*a):
        out = tiled(*a)
        met.append(out.selectExpr("sum(size(ids))").first()[0])
        return out

    V._tiled = counted
    try:
        got = hits(V.exact(index, df, 3))
    finally:
        V._tiled = tiled
    assert met[0] <= len(rows) * 3 and got == brute(rows, rows, 3)
