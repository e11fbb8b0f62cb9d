import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import shared
from lodestone.operators import chunking as H
from lodestone.operators import graph as G
from lodestone.operators import history as T
from lodestone.operators import index as I
from lodestone.operators import repomap as R
from lodestone.operators import search as S
from lodestone.operators import sessions as N
from lodestone.sources import files as SRC
from lodestone.sources import manifests as MAN
from lodestone.sources import sinks


def loop_bfs(edges, start, depth):
    """The bounded search written as a loop: a node is expanded while its hop is at most depth."""
    seen, front, hop = {}, [start], 0
    while front and hop <= depth:
        hop += 1
        following = []
        for n in front:
            for m in sorted(edges.get(n, ())):
                if m not in seen:
                    seen[m] = hop
                    following.append(m)
        front = following
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bfs_equals_loop(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(8), rnd.randrange(8)) for _ in range(14)}
    edges = {}
    for a, b in pairs:
        edges.setdefault(str(a), set()).add(str(b))
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string")
    starts = spark.createDataFrame([(str(i),) for i in range(8)], "name string")
    got = {(r["start"], r["name"]): r["depth"] for r in G.upstream(e, starts, 2).collect()}
    assert got == {(str(i), n): d for i in range(8) for n, d in loop_bfs(edges, str(i), 2).items()}


def test_bfs_example(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")], "source string, target string")
    a = spark.createDataFrame([("a",)], "name string")
    assert {r["name"]: r["depth"] for r in G.upstream(e, a, 1).collect()} == {"b": 1, "c": 2}
    assert {r["name"]: r["depth"] for r in G.upstream(e, a, 2).collect()} == {"b": 1, "c": 2, "d": 3, "a": 3}
    assert {r["name"]: r["depth"] for r in G.bfs(e, a, 2, inclusive_depth=False).collect()} == {"b": 1, "c": 2}


def test_merges(spark):
    e = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "y", 2)], "source string, target string, edge_type string, seq int")
    assert [r["edge_type"] for r in G.merge_edges(e).collect()] == ["y"]
    n = spark.createDataFrame([("a", "svc", None, 1), ("a", None, "p", 2)], "name string, node_type string, path string, seq int")
    assert [tuple(r) for r in G.merge_nodes(n).collect()] == [("a", "svc", "p")]


@pytest.mark.parametrize("n, ends", [(100, [(1, 100)]), (101, [(1, 100), (96, 101)]), (0, [(1, 0)]), (195, [(1, 100), (96, 195)]), (196, [(1, 100), (96, 195), (191, 196)])])
def test_windows(spark, n, ends):
    f = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(n)))], "file_path string, content string")
    got = sorted((r["line_start"], r["line_end"]) for r in H.windows(f, 100, 5).collect())
    assert got == ends


def test_history_rules(spark):
    c = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 3, 30), (4, 4, 40), (5, 100, 5000)], "commit int, files int, lines int")
    assert T.upper_median_of(c.where("commit < 5"), ["files"]).first()[0] == 3
    odd = spark.createDataFrame([(x,) for x in (None, 7, 1, 1, 9)], "files int")
    assert T.upper_median_of(odd, ["files"]).first()[0] == 7 and T.upper_median_of(odd.where("false"), ["files"]).first()[0] is None
    assert {r["commit"] for r in T.remove_outliers(c).collect()} == {1, 2, 3, 4}
    assert T.remove_outliers(c.where("commit in (1, 5)")).count() == 2
    assert T.statistics(c.where("commit > 9")).count() == 0
    m = spark.createDataFrame([(1, "fix a"), (2, "test b"), (3, "fix c")], "commit int, message string")
    assert T.type_filter(m, "fix").count() == 3  # fewer than three fit, so all stay
    r = spark.createDataFrame([], "ts timestamp, files int, lines int")
    assert tuple(T.recent(r, 30).first()) == (0, 0.0, 0.0, None)


def test_budget_and_services(spark):
    b = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "position int, chars int")
    assert [r["position"] for r in R.within_budget(b, [F.col("position")], budget=10).collect()] == [1]
    files = spark.createDataFrame([("s/a/main.py", 1.0), ("s/a/x.py", 5.0), ("s/b.py", 2.0)], "rel_path string, score double")
    services = spark.createDataFrame([("outer", "s/", 1), ("inner", "s/a/", 2)], "name string, path string, seq int")
    got = {r["service"]: r["rel_path"] for r in R.best_per_service(files, services).collect()}
    assert got == {"outer": "s/a/main.py", "inner": "s/a/x.py"}


def test_index(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", None)], "file_path string, content_hash string")
    assert {r[0]: r[1] for r in I.change_classes(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert {r[1] for r in I.change_classes(old, new, full=True).collect()} == {"new", "deleted"}
    up = I.upsert(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), ["file_path"], F.col("v"))
    assert {r["file_path"]: r["content_hash"] for r in up.collect()} == {"a": "1", "b": "9", "c": "3", "d": None}


def test_search_ties_and_empty(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"]) for r in S.top_k(e, [(9, [1.0, 0.0])], 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert S.top_k(e.where("false"), [(9, [1.0, 0.0])], 3).count() == 0
    assert S.keyword_search(spark.createDataFrame([("x",)], "text string"), "add a to").count() == 0


def test_fanout(spark):
    s = spark.createDataFrame([("x", 0, 60000), ("empty", 0, 0)], "id string, time_created long, time_updated long")
    m = spark.createDataFrame([("x", 1, "a" * 8), ("x", 2, "b" * 8)], "session_id string, id int, data string")
    p = spark.createDataFrame([("x", i, "c" * 4) for i in range(3)], "session_id string, id int, data string")
    both = s.join(m.toDF("id", "mid", "md"), "id", "left").join(p.toDF("id", "pid", "pd"), "id", "left").groupBy("id").agg(F.floor(F.sum(F.length("md")) / 4), F.floor(F.sum(F.length("pd")) / 4))
    want = {r[0]: tuple(r)[1:] for r in both.collect()}
    assert {r["id"]: (r["message_tokens"], r["part_tokens"]) for r in N.activity(s, m, p).collect()} == want


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "r/node_modules").mkdir(parents=True)
    (tmp_path / "r/services/a").mkdir(parents=True)
    (tmp_path / "r/services/a/main.py").write_text("def f():\n    return 1\n")
    (tmp_path / "r/node_modules/x.js").write_text("1")
    (tmp_path / "r/notes.bin").write_text("1")
    found = SRC.scan(spark, f"{tmp_path}/r").collect()
    assert [(r["file_path"], r["language"]) for r in found] == [("services/a/main.py", "python")]
    assert SRC.gitignore_patterns(["", "# c", "dist/", " x "]) == ["dist", "x"]
    nodes = spark.createDataFrame([("a", "service")], "name string, node_type string")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    sinks.write_graph(nodes, edges, f"{tmp_path}/g")
    n, e = SRC.graph_json(spark, f"{tmp_path}/g")
    assert [(r["name"], r["node_type"]) for r in n.collect()] == [("a", "service")] and [(r["source"], r["target"]) for r in e.collect()] == [("a", "b")]
    (tmp_path / "one.json").write_text('{"directed": true, "nodes": [{"id": "x", "node_type": "library"}, {"id": "y"}], "edges": [{"source": "x", "target": "y"}]}')
    n, e = SRC.graph_json(spark, f"{tmp_path}/one.json")
    assert {r["name"] for r in n.collect()} == {"x", "y"} and e.count() == 1
    for odd in ("a+b", "a(b"):
        (tmp_path / odd).mkdir()
        (tmp_path / odd / "x.py").write_text("1")
        assert [r["file_path"] for r in SRC.scan(spark, f"{tmp_path}/{odd}").collect()] == ["x.py"]
    (tmp_path / "bad.json").write_text("{oops")
    n, e = SRC.graph_json(spark, f"{tmp_path}/bad.json")
    assert n.count() == 0 and e.count() == 0
    sinks.write_csv(sinks.flatten_for_csv(spark.createDataFrame([([1], 2)], "a array<int>, b int")), f"{tmp_path}/c")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c").count() == 1


def test_manifests(spark):
    t = spark.createDataFrame([("compose.yml", "services: {a: {image: redis}, b: {depends_on: [a]}}"), ("docker-compose.yml", "services: {z: {}}"), ("x/pyproject.toml", "bad [")], "file_path string, content string")
    services = MAN.compose_services(MAN.compose_file(t))
    assert {(r["name"], r["node_type"]) for r in services.collect()} == {("a", "data_store"), ("b", "service")}
    assert [tuple(r) for r in MAN.compose_edges(services).collect()] == [("b", "a", "uses_datastore")]
    odd = "services: {a: {depends_on: db}, b: text, c: null, d: {depends_on: [redis, x], ports: 80}, e: {depends_on: {a: {condition: ok}}, build: ''}, x: {image: 'postgres:16'}}"
    services = MAN.compose_services(spark.createDataFrame([("compose.yml", odd), ("y", "when: 2024-13-45")], "file_path string, content string"))
    assert {r["name"] for r in services.collect()} == {"a", "d", "e", "x"}
    assert {tuple(r) for r in MAN.compose_edges(services).collect()} == {("d", "redis", "uses_datastore"), ("d", "x", "uses_datastore"), ("e", "a", "depends_on")}
    assert MAN.closing("{ a } } rest", 1) == 5 and MAN.closing("no end", 0) == 6
    assert MAN.components(t).count() == 0
    odd = ['project = "x"', "tool = 1\n[project]\nname = 3", '[project]\nname = "a"\ndependencies = 5\n[tool]\nuv = "x"', '[project]\nname = "b"\ndescription = [1]\ndependencies = ["c", 1]\n[tool.uv.sources]\nc = {path = "../c"}\nd = 1']
    found = MAN.components(spark.createDataFrame([(f"libs/p{i}/pyproject.toml", x) for i, x in enumerate(odd)], "file_path string, content string"))
    assert sorted((r["package_name"], r["description"], r["requirements"], r["path_sources"]) for r in found.collect()) == [("3", "", [], []), ("a", "", [], []), ("b", "[1]", ["c"], ["c"])]


def test_streaming_upsert(spark, tmp_path):
    from lodestone.streaming import refresh

    schema = "file_path string, content_hash string, ts timestamp"
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")]]):
        spark.createDataFrame([(p, h) for p, h in rows], "file_path string, content_hash string").withColumn("ts", F.expr(f"timestamp'2024-01-01' + interval {i} hours")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    refresh.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    last = spark.read.parquet(f"{tmp_path}/out/v=1")
    assert {r["file_path"]: r["content_hash"] for r in last.collect()} == {"a": "2", "b": "1"}
    spark.createDataFrame([("c", "3")], "file_path string, content_hash string").withColumn("ts", F.lit("2024-01-03").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/more")
    refresh.run_available(spark.readStream.schema(schema).parquet(f"{tmp_path}/more"), f"{tmp_path}/out", f"{tmp_path}/new-checkpoint")
    assert refresh.versions(spark, f"{tmp_path}/out") == [0, 1, 2]
    assert {r["file_path"]: r["content_hash"] for r in spark.read.parquet(f"{tmp_path}/out/v=2").collect()} == {"a": "2", "b": "1", "c": "3"}


def test_sqlite_sessions(spark, tmp_path):
    import sqlite3

    from lodestone.sources import sqlite as Q

    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE session (id TEXT, title TEXT, directory TEXT, time_created INT, time_updated INT, time_compacting INT)")
    con.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
    con.execute("INSERT INTO session VALUES ('ses_a', 't', 'd', 0, 90000, NULL)")
    con.executemany("INSERT INTO message VALUES (?, 'ses_a', ?)", [(str(i), "x" * 8) for i in range(3)])
    con.commit()
    con.close()
    s, m, p = Q.sessions(spark, str(tmp_path / "s.db"))
    assert tuple(N.timing(s).select("id", "duration_min", "compacted").first()) == ("ses_a", 1.5, False)
    row = N.activity(s, m, p).first()
    assert (row["messages"], row["parts"], row["message_tokens"], row["part_tokens"]) == (3, 0, 6, None)


def test_layouts_and_patterns(spark):
    from lodestone.operators import evaluation as E

    rows = [("a", (0.5,), None), ("a", None, ((1.0,),)), ("b", None, None)]
    df = spark.createDataFrame(rows, "scenario string, retrieval_metrics struct<mrr:double>, metrics struct<retrieval:struct<mrr:double>>")
    assert {r["scenario"]: r["mrr"] for r in E.layout_means(df, ["scenario"], ["mrr"]).collect()} == {"a": 0.75, "b": None}
    hits = spark.createDataFrame([(1, "lib/a.py", "retry logic"), (2, "x/b.py", "retry"), (3, "lib/c.py", "Retry"), (4, "lib/a.py", "retry"), (5, "y.py", "other")], "rank int, file_path string, document string")
    r = S.dominant_pattern(hits, "add retry handling").first()
    assert (r["pattern_type"], r["count"], r["locations"]) == ("library", 3, ["lib/a.py", "lib/c.py"]) and r["recommendation"].endswith("lib/a.py")
    assert S.dominant_pattern(hits, "nothing here").first()["pattern_type"] == "none"


def test_config(tmp_path):
    from lodestone import config as C

    (tmp_path / "t/.git").mkdir(parents=True)
    (tmp_path / "t/.git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "t/.git/config").write_text('[remote "origin"]\n\turl = https://x/y.git\n')
    made = C.init(str(tmp_path / "t"), "my repo", tmp_path)
    assert (made.branch, made.remote_url) == ("main", "https://x/y.git") and C.listed(tmp_path) == [made]
    assert C.resolve("my-repo", tmp_path) == C.resolve(made.path, tmp_path) == C.resolve(None, tmp_path, made.path) == made
    assert C.resolve("other", tmp_path) is None and C.resolve(None, tmp_path / "none") is None
    assert C.slug("") == "unnamed"


def test_usable_judges_repeated_files_without_building_them(spark):
    """Each text, alone and 3 times over, against the built file; a file too large to build has a verdict too."""
    texts = ["", " \t", "\n", "a", "a\n", "\n\na", "a\r\nb", "é\nü\n", None, "x\n" * H.MAX_FILE_LINES, "x\n" * H.MAX_FILE_LINES + "y", "\n".join("x" * 3334), "\n".join("x" * 3333), "\n" * 20_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    keep = lambda df, *a: {r["id"] for r in H.usable(df, *a).collect()}
    plain = lambda t: t is not None and t.strip(" \n\t\r") != "" and len(t.removesuffix("\n").split("\n")) <= H.MAX_FILE_LINES
    assert keep(rows) == {i for i, t in enumerate(texts) if plain(t)}
    assert keep(rows, F.when(F.lit(False), 1)) == keep(rows)
    assert keep(rows, F.lit(3)) == {i for i, t in enumerate(texts) if t is not None and plain((t + "\n") * 3)}
    assert keep(rows, F.lit(1 << 30)) == set()


def _parts(df):
    """Partitions of the largest shuffle."""
    return max(int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", df._jdf.queryExecution().toString()))


def test_merged_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    edges = spark.range(300).selectExpr("concat('a', id % 50) AS source", "'b' AS target", "concat('t', id) AS edge_type", "id AS seq")
    merged = G.merge_edges(edges)
    assert _parts(merged) == 30
    assert {(r["source"], r["edge_type"]) for r in merged.collect()} == {(f"a{i % 50}", f"t{i}") for i in range(250, 300)}


def test_common_files_are_dealt_by_the_number_of_changes(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    changes = spark.createDataFrame([(c, f) for c in range(50) for f in (1, 1, c % 2, None)] + [(None, 1), (99, 1)], "commit long, file long")
    found = T.common_files(changes, spark.createDataFrame([(c,) for c in [*range(50), None]], "commit long"), 0.5)
    assert _parts(found) == 21
    assert {tuple(r) for r in found.collect()} == {(1, 50), (None, 50)}
