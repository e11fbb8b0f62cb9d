"""Queries over a literal tree and literal outputs: scans, manifests, definitions, symbols, maps, stored graphs, reports.

The tree is small and stated here, so the expected rows are stated too, as VALUES.
Queries that read files first write the tree to the shared folder.
"""

from __future__ import annotations

import sqlite3
from itertools import chain

from pyspark.sql import functions as F

from ..api import Repository
from ..functions import text as X
from ..operators import chunking as H
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import repomap as R
from ..operators import symbols as Y
from ..shared import new_path, put
from ..sources import files as S
from ..sources import manifests as M
from ..sources import sinks
from ..sources import sqlite as Q
from .common import table

TREE = {
    "services/api/app/main.py": "import os\nfrom typing import Any\n\nclass A(Base):\n    def long(self, x: int) -> int:\n        a = 1\n        b = 2\n        c = 3\n        d = 4\n        e = 5\n        return a\n\n    def short(self):\n        pass\n\nasync def go(q):\n    return q\n",
    "services/api/broken.py": "def (:\n  x\n",
    "libs/web/index.ts": "export class Box<T> {\n  size(a: number): number {\n    return a;\n  }\n}\nexport interface Shape {\n  area(): number;\n  name: string;\n}\ntype Id = string;\nconst f = (x: number) => x + 1;\nexport async function load(u: string) {\n  return u;\n}\n",
    "compose.yml": "services:\n  db:\n    image: postgres:16\n  api:\n    build: .\n    depends_on: [db, cache]\n  cache:\n    image: redis:7\n  init-db:\n    depends_on:\n      db: {condition: service_healthy}\n",
    "services/api/pyproject.toml": '[project]\nname = "api-server"\ndependencies = ["faa-models>=1", "requests"]\n[tool.uv.sources]\n"faa-events" = {path = "../x"}\n',
    "libraries/python/faa-models/pyproject.toml": '[project]\nname = "faa-models"\n',
    "libraries/python/faa-events/pyproject.toml": '[project]\nname = "faa_events"\n',
    "services/api/p.proto": "package a.b;\nservice Greeter {\n  rpc Hello (X) returns (Y) {}\n  rpc Bye (X) returns (Y);\n}\n",
    "agents/bot/p.proto": "package a.b;\nservice Greeter { rpc Hello (X) returns (Y); }\nservice Other { rpc Do (X) returns (Y); }\n",
}
#: Beside the tree: files that a scan leaves out, each for another reason.
LEFT_OUT = {"node_modules/x.js": "1", "generated/y.py": "2", "notes.bin": "3", "services/api/trace.tmp.py": "4"}
GITIGNORE = "# built\n\n generated/ \n*.tmp.py\n"
DIFFS = {1: "def f():\n    The wording is bad\n", 2: "password  == x\nwhat the thing is\nthat THAT\n", 3: ""}
#: A file with more symbols and methods than a map shows.
WIDE = {"services/web/app.py": "".join(f"def f{i}():\n    pass\n" for i in range(12)), "services/web/view.py": "class V:\n" + "".join(f"    def m{i}(self):\n        pass\n" for i in range(7)), "tools/run.py": "def run():\n    pass\n"}


def tree(spark, more=()):
    return spark.createDataFrame(list(chain(TREE.items(), more)), "file_path string, content string")


def stored_tree(spark, files=None) -> str:
    root = new_path(spark, "tree")
    for path, text in (files or TREE | LEFT_OUT | {".gitignore": GITIGNORE}).items():
        put(spark, f"{root}/{path}", text)
    return root


def tree_scan(spark, sf):
    root = stored_tree(spark)
    patterns = Repository(spark, root, root).gitignore()
    return S.scan(spark, root, gitignore=patterns).select("file_path", "language", "length", "content_hash")


def gitignore(spark, sf):
    return spark.createDataFrame([(p,) for p in S.gitignore_patterns(GITIGNORE.split("\n"))], "pattern string")


def python_ast(spark, sf):
    c = H.python_chunks(tree(spark).where("file_path LIKE '%.py'"))
    return c.select("file_path", "symbol_name", "symbol_type", "parent_class", "line_start", "line_end", F.array_join("imports", ",").alias("imports"), "valid", F.substring_index("content", "\n", 1).alias("first_line"))


def chunk_dispatch(spark, sf):
    return H.documents(H.chunk_files(tree(spark))).select("file_path", "line_start", "line_end", "symbol_name", "symbol_type", "language", F.concat_ws("|", F.slice(F.split("document", "\n"), 1, 4)).alias("head"))


def file_symbols(spark, sf):
    t = tree(spark).select(F.col("file_path").alias("rel_path"), X.language(F.col("file_path")).alias("language"), "content")
    top = Y.file_symbols(t).select("rel_path", "language", F.explode("symbols").alias("s"))
    own = F.struct(F.col("s.name"), F.col("s.kind"), F.col("s.signature"), F.col("s.line"), F.lit("").alias("parent"))
    below = F.transform("s.children", lambda c: F.struct(c["name"], c["kind"], c["signature"], c["line"], F.col("s.name").alias("parent")))
    each = top.select("rel_path", "language", F.explode(F.concat(F.array(own), below)).alias("x"))
    return each.select("rel_path", "language", *(F.col(f"x.{c}").alias(a) for c, a in zip(each.schema["x"].dataType.names, ("name", "kind", "signature", "line", "parent"), strict=True)))


def symbol_counts(spark, sf):
    t = tree(spark, WIDE.items()).select(F.col("file_path").alias("rel_path"), X.language(F.col("file_path")).alias("language"), "content")
    return Y.file_symbols(t).select("rel_path", *(c.alias(n) for n, c in Y.kind_counts(F.col("symbols")).items()))


def _services(spark):
    return M.compose_services(M.compose_file(tree(spark)))


def compose_services(spark, sf):
    return _services(spark).select("name", "image", "build", F.array_join("depends_on", ",").alias("depends_on"), "node_type", "data_store_type")


def compose_graph(spark, sf):
    return M.compose_edges(_services(spark))


def toml_components(spark, sf):
    return M.components(tree(spark)).select("component", "component_type", "path", "package_name", F.array_join("requirements", ",").alias("requirements"), F.array_join("path_sources", ",").alias("path_sources"))


def toml_graph(spark, sf):
    c = M.components(tree(spark))
    needs = c.select("component", F.explode(F.concat("path_sources", F.transform("requirements", X.requirement_name))).alias("requirement"))
    return G.resolve_dependencies(needs, c.select("package_name", "component"))


def proto_services(spark, sf):
    return M.proto_services(tree(spark)).select("service", "package", "file_path", "owning_service", F.array_join("rpcs", ",").alias("rpcs"))


def proto_graph(spark, sf):
    return G.grpc_edges(M.proto_services(tree(spark)))


def proto_owners(spark, sf):
    nodes = spark.createDataFrame([("api",), ("web",)], "name string")
    found = G.attach_proto(nodes, M.proto_services(tree(spark)))
    return found.select("name", F.array_join("grpc_services", ",").alias("grpc_services"), F.array_join("grpc_rpcs", ",").alias("grpc_rpcs"))


def _repository(spark):
    return Repository(spark, stored_tree(spark), new_path(spark, "store"))


def repository_graph(spark, sf):
    """The graph built from all three kinds of manifests, stored, and read back."""
    return _repository(spark).graph()[1].select("source", "target", "edge_type")


def repository_nodes(spark, sf):
    repo = _repository(spark)
    stats = repo.build_graph()
    return repo.graph()[0].select("name", "node_type", "parsed_from", F.lit(stats["nodes"]).alias("nodes"), F.lit(stats["edges"]).alias("edges"))


def repository_runs(spark, sf):
    """The run log after a first run, a run over a changed tree, and a run over the same tree."""
    repo = _repository(spark)
    repo.index()
    put(spark, f"{repo.root}/libs/web/more.ts", "export function more() {\n  return 1;\n}\n")
    put(spark, f"{repo.root}/compose.yml", "services: {}\n")
    put(spark, f"{repo.root}/services/api/broken.py", "\n")
    repo.index()
    repo.index()
    return repo.runs().select("id", "files_scanned", "files_indexed", "files_skipped", "files_deleted", "chunks_created", "status")


def repository_deleted(spark, sf):
    repo = _repository(spark)
    repo.index()
    repo.delete_all()
    return repo.runs().agg(F.count("*").alias("runs")).withColumn("version", F.lit(repo.version()))


def repo_map_services(spark, sf):
    """The map of the tree with one file of each service first, written as text and read back."""
    t = tree(spark, WIDE.items()).select(F.col("file_path").alias("rel_path"), X.language(F.col("file_path")).alias("language"), "content")
    s = Y.file_symbols(t)
    n = Y.kind_counts(F.col("symbols"))
    files = s.withColumn("score", R.file_score(F.col("rel_path"), n["classes"], n["functions"], n["types"], n["methods"]))
    services = spark.createDataFrame([("web", "services/web", 1), ("libs", "libs/", 2)], "name string, path string, seq int")
    path = new_path(spark, "map")
    sinks.write_text(R.repo_map(R.rank_files(files, services)), path)
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", r"\n+\z", "")).alias("map"))


def reviews(spark, sf):
    text = "## Review\n\n### Summary\nFine.\n\n### Issues\n\n#### Critical (Must Fix)\n1. **Bad** - `a.py:3`\n   - x\n\n#### Warning (Should Fix)\n1. **Odd** - `b.py:1`\n2. **Old** - `c.py:2`\n"
    r = E.parse_reviews(spark.createDataFrame([(text,)], "text string"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["title"], F.lit("@"), x["location"])), ",").alias(c)
    return r.select(F.rtrim(F.translate("summary", "\n", " ")).alias("summary"), shown("critical_issues"), shown("warnings"))


def printed(spark, sf):
    text = "[1] a/b.py — fragment: x\n    Score: 0.61\n[2] c.py — class: Y\n    Score: 0.5\n- **api** (3 hits)\n- `a/b.py` — Foo\n"
    p = E.parse_scope_output(E.parse_search_output(spark.createDataFrame([(text,)], "text string")))
    return p.select(F.array_join("retrieved", ",").alias("retrieved"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"), F.array_join("services", ",").alias("services"), F.array_join("files", ",").alias("files"))


def search_report(spark, sf):
    hits = spark.createDataFrame([(2, "c.py", "class", "Y", 0.5), (1, "a/b.py", "fragment", "x", 0.61)], "rank int, file_path string, symbol_type string, symbol_name string, score double")
    return spark.createDataFrame([(sinks.search_report(hits),)], "report string")


def session_lines(spark, sf):
    lines = [(1, "not json"), (2, '{"type":"x"}'), (3, '{"sessionID":"ses_a1"}'), (4, '{"sessionID":"ses_b2"}')]
    return S.first_session_id(spark.createDataFrame(lines, "line int, value string"))


def rule_lines(spark, sf):
    rules = (("a", "critical", r"the \w+ing", "x"), ("b", "critical", r"password\s*==", "y"), ("d", "warning", r"\bthat\b", "w"))
    return E.rule_scan(spark.createDataFrame(list(DIFFS.items()), "id long, text string"), "id", rules=rules)


RESULT = '{"test_id": "t%d", "scenario": "%s", "test_type": "search", "description": "d", "metrics": {"retrieval": {"precision@1": %s, "precision@3": 0.5, "recall@1": 0.25, "recall@3": 0.5, "mrr": 1.0}, "performance": {"latency": {"p50_ms": %s}, "tokens": {"total": 7}}}}'


def result_rows(spark, sf):
    """Result files, flattened, exported as CSV and read back."""
    root, out = new_path(spark, "results"), new_path(spark, "csv")
    for i, row in enumerate([("a", "1.0", "12.5"), ("b", "null", "0.0")]):
        put(spark, f"{root}/r{i}.json", RESULT % (i, *row))
    sinks.write_csv(E.flatten_results(S.results(spark, root)), out)
    names = {"precision@1": "precision_1", "recall@3": "recall_3"}
    csv = spark.read.option("header", "true").csv(out)
    return csv.select("test_id", "scenario", *(F.col(f"`{c}`").cast("double").alias(a) for c, a in names.items()), F.col("latency_ms").cast("double").alias("latency_ms"), F.col("tokens").cast("long").alias("tokens"))


def test_case_rows(spark, sf):
    path = f"{new_path(spark, 'cases')}/search.json"
    put(spark, path, '{"description": "x", "test_cases": [{"id": "s1", "query": "q", "metadata": {"difficulty": "easy"}}, {"id": "s2", "query": "r", "metadata": {"difficulty": "hard"}}]}')
    return S.test_cases(spark, path).select("id", "query", F.col("metadata.difficulty").alias("difficulty"))


def sqlite_sessions(spark, sf):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE session (id TEXT, title TEXT, directory TEXT, time_created INT, time_updated INT, time_compacting INT)")
    con.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
    con.execute("CREATE TABLE part (id TEXT, session_id TEXT, type TEXT, data TEXT)")
    con.executemany("INSERT INTO session VALUES (?, ?, '/x', ?, ?, NULL)", [("s1", "one", 0, 60000), ("s2", "two", 5, 10)])
    con.executemany("INSERT INTO message VALUES (?, ?, ?)", [(f"m{i}", f"s{i % 2 + 1}", "{}") for i in range(5)])
    path = f"{new_path(spark, 'sessions')}/a.db"
    put(spark, path, con.serialize())
    s, m, _ = Q.sessions(spark, path)
    return s.join(m.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages")), "id").select("id", "title", (F.col("time_updated") - F.col("time_created")).alias("ms"), "messages")


def changed_paths(spark, sf):
    d = table(spark, sf, "documents")
    h = X.content_hash(F.coalesce("text", F.lit("")))
    before = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("file_path"), F.when(F.col("doc_id") % 5 == 0, F.concat(h, F.lit("x"))).otherwise(h).alias("content_hash"))
    return S.changed_paths(before, d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("file_path"), h.alias("content_hash")))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(names: str, rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"


_kept = {p: t for p, t in TREE.items()}
_languages = "CASE WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.ts') THEN 'typescript' WHEN ends_with(file_path, '.yml') THEN 'yaml' WHEN ends_with(file_path, '.toml') THEN 'toml' ELSE 'protobuf' END"
_main, _ts = "services/api/app/main.py", "libs/web/index.ts"
_whole = lambda path, last, language: (path, 1, last, "__file__", "module", language, f"File: {path}|module: __file__|Language: {language}|")
_definition = lambda first, last, name, kind, line: (_ts, first, last, name, kind, "typescript", f"File: {_ts}|{kind.capitalize()}: {name}||{line}")
_MAP = [
    *R.HEADER[:3], R.HEADER[3], "", "## services/web/app.py", *(f"  def f{i}()" for i in range(10)), "", "## libs/web/index.ts", "  export class Box<T>", "    size(a: number): number", "  export interface Shape", "    area(): number", "    name: string",
    "  type Id = string;", "  const f = (x: number) => x + 1;", "  export async function load(u: string)", "", "## services/api/app/main.py", "  class A(Base)", "    def long(self, x: int) -> int", "    def short(self)", "  async def go(q)", "",
    "## services/web/view.py", "  class V", *(f"    def m{i}(self)" for i in range(5)), "", "## tools/run.py", "  def run()",
]

QUERIES = {
    "tree_scan": (tree_scan, f"SELECT file_path, {_languages} AS language, strlen(content) AS length, sha256(content)[1:16] AS content_hash FROM ({_values('file_path, content', list(_kept.items()))})"),
    "gitignore_patterns": (gitignore, _values("pattern", [("generated",), ("*.tmp.py",)])),
    "ingest_python_ast": (
        python_ast,
        _values(
            "file_path, symbol_name, symbol_type, parent_class, line_start, line_end, imports, valid, first_line",
            [
                (_main, "A", "class", None, 4, 14, "os,typing", True, "class A(Base):"),
                (_main, "long", "method", "A", 5, 11, "os,typing", True, "    def long(self, x: int) -> int:"),
                (_main, "go", "function", None, 16, 17, "os,typing", True, "async def go(q):"),
                ("services/api/broken.py", "__module__", "module", None, 1, 2, "", False, "def (:"),
            ],
        ),
    ),
    "chunk_dispatch": (
        chunk_dispatch,
        _values(
            "file_path, line_start, line_end, symbol_name, symbol_type, language, head",
            [
                (_main, 4, 14, "A", "class", "python", f"File: {_main}|class: A|Language: python|"),
                (_main, 5, 11, "long", "method", "python", f"File: {_main}|method: A.long|Language: python|"),
                (_main, 16, 17, "go", "function", "python", f"File: {_main}|function: go|Language: python|"),
                _definition(1, 5, "Box", "class", "export class Box<T> {"), _definition(6, 9, "Shape", "interface", "export interface Shape {"),
                _definition(10, 11, "Id", "type", "type Id = string;"), _definition(12, 14, "load", "function", "export async function load(u: string) {"),
                _whole("services/api/broken.py", 2, "python"), _whole("compose.yml", 11, "yaml"), _whole("services/api/pyproject.toml", 5, "toml"), _whole("libraries/python/faa-models/pyproject.toml", 2, "toml"),
                _whole("libraries/python/faa-events/pyproject.toml", 2, "toml"), _whole("services/api/p.proto", 5, "protobuf"), _whole("agents/bot/p.proto", 3, "protobuf"),
            ],
        ),
    ),
    "file_symbols": (
        file_symbols,
        _values(
            "rel_path, language, name, kind, signature, line, parent",
            [
                (_main, "python", "A", "class", "class A(Base)", 4, ""), (_main, "python", "long", "method", "def long(self, x: int) -> int", 5, "A"), (_main, "python", "short", "method", "def short(self)", 13, "A"),
                (_main, "python", "go", "function", "async def go(q)", 16, ""), (_ts, "typescript", "Box", "class", "export class Box<T>", 1, ""), (_ts, "typescript", "size", "method", "size(a: number): number", 2, "Box"),
                (_ts, "typescript", "Shape", "interface", "export interface Shape", 6, ""), (_ts, "typescript", "area", "method", "area(): number", 7, "Shape"), (_ts, "typescript", "name", "property", "name: string", 8, "Shape"),
                (_ts, "typescript", "Id", "type", "type Id = string;", 10, ""), (_ts, "typescript", "f", "function", "const f = (x: number) => x + 1;", 11, ""), (_ts, "typescript", "load", "function", "export async function load(u: string)", 12, ""),
            ],
        ),
    ),
    "symbol_counts": (symbol_counts, _values("rel_path, classes, functions, types, methods", [(_main, 1, 1, 0, 2), (_ts, 2, 2, 1, 3), ("services/web/app.py", 0, 12, 0, 0), ("services/web/view.py", 1, 0, 0, 7), ("tools/run.py", 0, 1, 0, 0)])),
    "compose_services": (
        compose_services,
        _values("name, image, build, depends_on, node_type, data_store_type", [("db", "postgres:16", False, "", "data_store", "PostgreSQL"), ("api", "", True, "db,cache", "service", None), ("cache", "redis:7", False, "", "data_store", "Redis"), ("init-db", "", False, "db", "init", None)]),
    ),
    "compose_graph": (compose_graph, _values("source, target, edge_type", [("api", "db", "uses_datastore"), ("api", "cache", "uses_datastore"), ("init-db", "db", "uses_datastore")])),
    "toml_components": (
        toml_components,
        _values(
            "component, component_type, path, package_name, requirements, path_sources",
            [
                ("api", "service", "services/api", "api-server", "faa-models>=1,requests", "faa-events"),
                ("faa-models", "library", "libraries/python/faa-models", "faa-models", "", ""),
                ("faa-events", "library", "libraries/python/faa-events", "faa_events", "", ""),
            ],
        ),
    ),
    "toml_graph": (toml_graph, _values("source, target", [("api", "faa-models"), ("api", "faa-events")])),
    "proto_services": (
        proto_services,
        _values("service, package, file_path, owning_service, rpcs", [("Greeter", "a.b", "services/api/p.proto", "api", "Hello,Bye"), ("Greeter", "a.b", "agents/bot/p.proto", "bot", "Hello"), ("Other", "a.b", "agents/bot/p.proto", "bot", "Do")]),
    ),
    "proto_graph": (proto_graph, _values("source, target, edge_type", [("api", "bot", "grpc")])),
    "proto_owners": (proto_owners, _values("name, grpc_services, grpc_rpcs", [("api", "Greeter", "Bye,Hello"), ("web", None, None)])),
    "repository_graph": (
        repository_graph,
        _values("source, target, edge_type", [("api", "db", "uses_datastore"), ("api", "cache", "uses_datastore"), ("init-db", "db", "uses_datastore"), ("api", "faa-models", "library_dependency"), ("api", "faa-events", "library_dependency"), ("api", "bot", "grpc")]),
    ),
    "repository_nodes": (
        repository_nodes,
        _values(
            "name, node_type, parsed_from, nodes, edges",
            [("db", "data_store", "compose", 7, 6), ("api", "service", "compose+toml", 7, 6), ("cache", "data_store", "compose", 7, 6), ("init-db", "init", "compose", 7, 6), ("faa-models", "library", "toml", 7, 6), ("faa-events", "library", "toml", 7, 6), ("bot", None, None, 7, 6)],
        ),
    ),
    "repository_runs": (
        repository_runs,
        _values("id, files_scanned, files_indexed, files_skipped, files_deleted, chunks_created, status", [(1, 9, 9, 0, 0, 14, "completed"), (2, 10, 2, 8, 0, 2, "completed"), (3, 10, 0, 10, 0, 0, "completed")]),
    ),
    "repository_deleted": (repository_deleted, _values("runs, version", [(0, 0)])),
    "repo_map_services": (repo_map_services, f"SELECT array_to_string([{', '.join(map(_q, _MAP))}], chr(10)) AS map"),
    "review_parse": (reviews, _values("summary, critical_issues, warnings", [("Fine.", "Bad@a.py:3", "Odd@b.py:1,Old@c.py:2")])),
    "output_parse": (printed, _values("retrieved, scores, services, files", [("a/b.py,c.py", "0.61,0.5", "api", "a/b.py")])),
    "search_report": (search_report, "SELECT array_to_string(['[1] a/b.py — fragment: x', '    Score: 0.61', '[2] c.py — class: Y', '    Score: 0.5'], chr(10)) AS report"),
    "session_lines": (session_lines, _values("session_id", [("ses_a1",)])),
    "rule_lines": (
        rule_lines,
        _values("id, agent, severity, description, line", [(1, "a", "critical", "x", 2), (2, "a", "critical", "x", 2), (2, "b", "critical", "y", 1), (2, "d", "warning", "w", 3), (2, "d", "warning", "w", 3)]),
    ),
    "result_rows": (result_rows, _values("test_id, scenario, precision_1, recall_3, latency_ms, tokens", [("t0", "a", 1.0, 0.5, 12.5, 7), ("t1", "b", None, 0.5, 0.0, 7)]).replace("1.0,", "1.0::DOUBLE,").replace("0.5,", "0.5::DOUBLE,").replace("12.5,", "12.5::DOUBLE,")),
    "test_case_rows": (test_case_rows, _values("id, query, difficulty", [("s1", "q", "easy"), ("s2", "r", "hard")])),
    "sqlite_sessions": (sqlite_sessions, _values("id, title, ms, messages", [("s1", "one", 60000, 3), ("s2", "two", 5, 2)])),
    "changed_paths": (
        changed_paths,
        """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS x FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id AS file_path FROM o FULL JOIN n USING (doc_id) WHERE x IS NULL OR n.doc_id IS NULL OR x = 1""",
    ),
}
