"""Stored adjacency against plain breadth-first searches; which buckets a hop reads."""

import os
import random
import re
from collections import deque

import pytest
from lodestone.operators import adjacency as A
from lodestone.operators import graph as G


def plain(edges, starts, hops, ways=("upstream", "downstream")):
    found = set()
    for way in ways:
        follow = {}
        for a, b in edges:
            if a is not None and b is not None:
                follow.setdefault(a if way == "upstream" else b, set()).add(b if way == "upstream" else a)
        for s in starts:
            depth, queue = {}, deque([(s, 0)])
            while queue:
                node, d = queue.popleft()
                if d < hops:
                    for x in follow.get(node, ()):
                        if x not in depth:
                            depth[x] = d + 1
                            queue.append((x, d + 1))
            found |= {(way, s, x, d) for x, d in depth.items()}
    return found


def rows(df):
    got = [(r["direction"], r["start"], r["name"], r["depth"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def graph(n, m, seed):
    rng = random.Random(seed)
    hub = [("hub", f"n{i}") for i in range(n // 2)]  # half of all nodes follow one
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + hub + hub + [("n1", "hub"), (None, "n1"), ("n2", None), ("a>b", "n3"), ("n3", "a>b")]


@pytest.mark.parametrize("few,many,hot", [(A.FEW, A.MANY, A.HOT), (A.FEW, A.MANY, 7), (6, 100, 7), (0, 0, 7)])
def test_search_equals_plain(spark, monkeypatch, few, many, hot):
    """By names on the driver, by joins from some hop on, or from the start; with and without split nodes."""
    monkeypatch.setattr(A, "FEW", few)
    monkeypatch.setattr(A, "NAMED", 4)
    monkeypatch.setattr(A, "MANY", many)
    edges = graph(60, 80, 1)
    stored = A.Adjacency.build(spark.createDataFrame(edges, "source string, target string"), hot=hot)
    assert stored.hot == (hot == 7)
    starts = ["n1", "hub", "n3", "a>b", "nowhere"]
    df = spark.createDataFrame([(s,) for s in [*starts, "n1", None]], "name string")
    assert rows(G.search(stored, df, 2)) == plain(edges, starts, 3)
    assert rows(stored.search(df, 2, ("downstream",), inclusive_depth=False)) == plain(edges, starts, 2, ("downstream",))


def test_hops_read_only_their_buckets_and_do_not_shuffle_the_edges(spark, tmp_path):
    edges = graph(2000, 3000, 2)
    A.Adjacency.build(spark.createDataFrame(edges, "source string, target string"), f"file://{tmp_path}/graph", bucket_rows=200)
    stored = A.Adjacency.load(spark, f"file://{tmp_path}/graph")
    assert stored.buckets > 30
    plan = lambda df: df._jdf.queryExecution().toString()
    wide = spark.range(100_000).selectExpr("'upstream' as direction", "'s' as start", "concat('n', id) as name")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(stored.hop(wide))
        scan = joined[joined.index("== Physical Plan =="):]
        assert scan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan
        assert stored.hop(wide).count() == sum(a is not None and a.startswith("n") for a, b in {e for e in edges if None not in e})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # files of all other buckets can go: a hop from two nodes never opens them
    asked = [("upstream", "n5"), ("downstream", "n7")]
    slots = spark.createDataFrame([(f"{d}>{n}",) for d, n in asked], "slot string")
    needed = {r[0] for r in slots.selectExpr(f"pmod(hash(slot), {stored.buckets})").collect()}
    files = [f for f in os.listdir(f"{tmp_path}/graph/edges") if f.endswith(".parquet")]
    gone = [f for f in files if int(re.search(r"_(\d+)\.c\d+", f)[1]) not in needed]
    assert len(gone) >= len(files) - 2 > 20
    for f in gone:
        os.remove(f"{tmp_path}/graph/edges/{f}")
    clean = {e for e in edges if None not in e}
    want = {("upstream", "n5", b) for a, b in clean if a == "n5"} | {("downstream", "n7", a) for a, b in clean if b == "n7"}
    assert {tuple(r) for r in stored.neighbours(asked).collect()} == want
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FILE_NOT"):
        stored.rows().collect()


def test_empty_graph(spark):
    stored = A.Adjacency.build(spark.createDataFrame([], "source string, target string"))
    assert rows(stored.search(spark.createDataFrame([("a",)], "name string"))) == set()
    assert rows(stored.search(spark.createDataFrame([], "name string"))) == set()


@pytest.mark.parametrize("few,many", [(A.FEW, A.MANY), (6, 100), (0, 0)])
def test_scanned_edges_equal_plain_and_store_no_edges(spark, monkeypatch, few, many):
    monkeypatch.setattr(A, "FEW", few)
    monkeypatch.setattr(A, "NAMED", 2)
    monkeypatch.setattr(A, "MANY", many)
    edges = graph(60, 80, 3)
    scanned = A.Scanned(spark, spark.createDataFrame(edges + edges[:20], "source string, target string"))
    paths, new_path = [], A.new_path
    monkeypatch.setattr(A, "new_path", lambda s, label: paths.append(label) or new_path(s, label))
    starts = ["n1", "hub", "a>b", "nowhere"]
    df = spark.createDataFrame([(s,) for s in [*starts, "n1", None]], "name string")
    assert rows(G.search(scanned, df, 2)) == plain(edges, starts, 3)
    assert rows(G.search(scanned, df, 1, ("upstream",))) == plain(edges, starts, 2, ("upstream",))
    assert all(p.startswith("hop-") for p in paths)
