"""The copy-on-write table against dictionaries; what a change writes, what stays readable."""

import glob
import os
import random

import pytest
from lodestone.operators.snapshots import SnapshotTable
from lodestone.plans import index as plans
from pyspark.sql import functions as F

SCHEMA = "k string, v int"


def parts(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_changes_equal_a_dictionary(spark, tmp_path):
    """Random upserts of whole keys and deletions, null keys, keys that stand several times, changes without rows."""
    rng = random.Random(4)
    stored = SnapshotTable(spark, f"file://{tmp_path}/t", ["k"], F.pmod(F.xxhash64("k"), F.lit(5)), keep=2)
    now, past = {}, {}
    for version in range(1, 7):
        rows = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(9)) for _ in range(rng.choice([0, 3, 6]))]
        gone = [rng.choice(["a", "b", "z", None]) for _ in range(rng.randrange(3))] if version > 1 else []
        for k in [*gone, *(k for k, _ in rows)]:
            now.pop(k, None)
        for k, v in rows:
            now.setdefault(k, []).append(v)
        got = stored.change(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k,) for k in gone], "k string"))
        assert got == version
        past[version] = {k: sorted(v) for k, v in now.items()}
        assert stored.versions() == [v for v in (version - 1, version) if v > 0]
        for v in stored.versions():
            seen = {}
            for r in stored.read(v).collect():
                seen.setdefault(r["k"], []).append(r["v"])
            assert {k: sorted(x) for k, x in seen.items()} == past[v]
    with pytest.raises(ValueError):
        stored.read(1)
    with pytest.raises(ValueError):
        stored.change(spark.createDataFrame([], SCHEMA), version=6)


def test_small_changes_write_little(spark, sf):
    """One hundredth of documents rewrites under a twentieth of the bytes; the other files stay as they are."""
    stored = plans.documents_table(spark, sf)
    path = stored.path.removeprefix("file://")
    sizes = parts(path)
    share = lambda s: sum(n for f, n in sizes.items() if f"/s={s}/" in f)
    assert 0 < share(2) < 0.05 * share(1) and share(3) < 0.05 * share(1)
    assert stored.versions() == [1, 2, 3]
    for _ in range(2):  # the first two snapshots expire; their folders go where no later one needs them
        stored.change(gone=spark.createDataFrame([(-5,)], "doc_id long"))
    left = parts(path)
    assert stored.versions() == [3, 4, 5] and set(left) < set(sizes) and stored.read(5).count() == stored.read(3).count()


def test_rollback_and_dead_writers(spark, tmp_path):
    stored = SnapshotTable(spark, f"file://{tmp_path}/t", ["k"], F.lit(0))
    with pytest.raises(ValueError):
        stored.read()
    assert stored.change(gone=spark.createDataFrame([("a",)], "k string")) == 0
    stored.change(spark.createDataFrame([("a", 1)], SCHEMA))
    os.makedirs(f"{tmp_path}/t/data/s=2/bucket=0")  # left by a writer that died
    (tmp_path / "t/data/s=2/bucket=0/part-0.parquet").write_bytes(b"broken")
    stored.change(spark.createDataFrame([("b", 2)], SCHEMA))
    assert sorted(map(tuple, stored.read().collect())) == [("a", 1), ("b", 2)]
    stored.rollback(1)
    assert stored.versions() == [1] and [tuple(r) for r in stored.read().collect()] == [("a", 1)]
