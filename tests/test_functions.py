import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as K
from lodestone.functions import metrics as M
from lodestone.functions import paths as P
from lodestone.functions import text as X


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_paths(spark):
    paths = ["src/domain.py", "lib/x/tests/a.py", "a/vendor/b.ts", "services/x/main.py", "a/b/c.d.ts", "x/services"]
    assert values(spark, paths, P.is_test) == [False, True, False, False, False, False]
    assert values(spark, paths, P.is_low_value) == [False, False, True, False, True, False]
    assert values(spark, paths, P.service_file_bonus)[0] == 100.0
    assert values(spark, paths, P.entry_boost)[:4] == [0.0, 0.0, 0.0, 8.0]
    assert values(spark, paths, lambda c: P.service(c, "scope")) == ["", "", "", "x", "", ""]
    assert values(spark, ["libraries/python/foo/x", "libraries/bar", "q/r"], P.component_name) == ["foo", "bar", "q"]
    assert values(spark, ["a/b/p.proto", "agents/z/p.proto"], lambda c: P.service(c, "proto")) == ["a", "z"]
    assert values(spark, ["a/node_modules/b.js", "x.pyc", "a.py", "q.egg-info/r"], P.skipped) == [True, True, False, True]
    assert values(spark, ["services/a/b.py", "services/b.py", "x/y", "z"], P.group_key) == ["services/a", "services", "x", "__root__"]
    assert values(spark, ["mylib/a", "x/utils.py", "services/a", "a.py"], P.location_class) == ["library", "utility", "service", "inline"]


def test_text(spark):
    assert values(spark, ["x>=1", "x[y]==2", "x @ file:", "x!=3"], X.requirement_name) == ["x", "x", "x", "x!=3"]
    assert values(spark, ["a/b c\\d", ""], X.slug) == ["a-b-c-d", "unnamed"]
    assert values(spark, ["Add the Login page, login now", ""], lambda c: F.array_join(X.history_keywords(c), "|")) == ["login|page,|login", ""]
    assert values(spark, ["a/Dockerfile", "x.TSX", "y", ".toml"], X.language) == ["dockerfile", "typescript", "unknown", "unknown"]
    assert values(spark, ["a\nb\n", "", "a\n\n"], lambda c: F.size(X.lines(c))) == [2, 0, 2]
    assert values(spark, ["H\n\na\nb", "x"], lambda c: X.snippet(c, 1)) == ["a\n... (truncated)", "x"]


def test_classifiers(spark):
    texts = ["Add a route", "latest news", "fix it", "readme", "plain", "Migrate api"]
    assert values(spark, texts, K.task_type) == ["endpoint", "test", "fix", "docs", "feature", "refactor"]
    df = spark.createDataFrame([("db", "postgres:1", None), ("init-x", "", None), ("a", "", "no"), ("a", "", None)], "n string, i string, r string")
    got = [r[0] for r in df.select(K.compose_class(F.col("n"), F.col("i"), F.col("r"))).collect()]
    assert got == ["data_store", "init", "init", "service"]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "x", "a"], ["a", "b", "c"], {"a": 0.9, "b": 0.9, "c": 0.8})], "r array<string>, t array<string>, g map<string,double>")
    df = df.withColumn("g", F.create_map(*(F.lit(v) for v in ("a", 0.9, "b", 1.0, "c", 0.8))))
    row = df.select(M.precision_at(F.col("r"), F.col("t"), 3), M.recall_at(F.col("r"), F.col("t"), 3), M.mrr(F.col("r"), F.col("t")), M.ndcg_at(F.col("r"), F.col("g"), 3)).first()
    assert row[0] == pytest.approx(2 / 3) and row[1] == pytest.approx(1 / 3) and row[2] == 1.0
    assert row[3] == pytest.approx(0.6860325, abs=1e-6)
    empty = spark.createDataFrame([([], ["a"]), (["a"], [])], "p array<string>, t array<string>")
    assert [tuple(r) for r in empty.select(*M.overlap(F.col("p"), F.col("t")).values()).collect()] == [(0.0, 0.0, 0.0)] * 2
    rev = spark.createDataFrame([([], [], [], []), (["x"], [], [], ["w"])], "fc array<string>, ec array<string>, fw array<string>, ew array<string>")
    got = [r[0] for r in rev.select(M.review_quality(F.col("fc"), F.col("ec"), F.col("fw"), F.col("ew"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0
