"""Sort-means against a plain Lloyd iteration in Python integers."""

import hashlib
import math
import random

import pytest

pytest.importorskip("lodestone.llm")

import numpy as np  # noqa: E402

from lodestone.llm import sort_means as M  # noqa: E402


def lloyd(rows, k, rounds, seed):
    """(key, vector) rows -> cluster and distance of each, and the centroids."""
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    starts = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in rows if key is not None)[:k]
    centroids = [list(v) for _, v in starts]
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(rows, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((key if key is not None else -1), near(v)[1], near(v)[0]) for key, v in rows), centroids


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v int")
    found, centroids = M.sort_means(df, **args)
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), centroids


@pytest.mark.parametrize("spread", [2, 40, 4000])
def test_equals_lloyd(spark, spread):
    """Few distinct values make ties and equal centroids, many make none; other columns have the operator's own names."""
    rng = random.Random(spread)
    rows = [(i // 2, [rng.randrange(-spread, spread) / 256 for _ in range(3)]) for i in range(200)] + [(None, [0.0, 0.0, 0.0])]
    got, centroids = run(spark, [(i, v, "x", 1) for i, v in rows], k=9, rounds=4, dims=3)
    want, means = lloyd([(i, [math.floor(256 * x) for x in v]) for i, v in rows], 9, 4, M.SEED)
    assert got == want and centroids == means


def test_left_out_and_small_tables(spark):
    good = [0.5, -0.001]
    odd = [None, [], [1.0], [1.0, 2.0, 3.0], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0], [3e38, 0.0]]
    got, centroids = run(spark, [(i, v, None, None) for i, v in enumerate([*odd, good, good])], k=5, dims=2)
    assert got == [(8, 0, 0), (9, 0, 0)] and centroids == [[128, -1], [128, -1]]
    assert run(spark, [(1, None, None, None)], dims=2) == ([], [])
    assert run(spark, [], dims=2) == ([], [])


def test_stops_early_and_loses_nothing():
    """Far fewer distances than vectors times centroids on clustered data; large components stay exact."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-(2**26), 2**26, (30, 4))
    rows = middles[rng.integers(0, 30, 3000)] + rng.integers(-1000, 1000, (3000, 4))
    ordered = M.Ordered(middles.tolist())
    full = ((rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
    before = full.argmin(axis=1)
    best, least, tried = ordered.assign(rows, before)
    assert (best == before).all() and (least == full.min(axis=1)).all() and tried < 3 * len(rows)
    best, least, _ = ordered.assign(rows, np.zeros(3000, dtype=np.int64))
    assert (best == before).all() and (least == full.min(axis=1)).all()
