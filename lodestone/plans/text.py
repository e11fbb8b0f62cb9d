"""Queries: classifiers, keywords, paths, hashes, chunks, documents, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import embedding as V
from ..functions import paths as P
from ..functions import text as X
from ..operators import chunking as H
from ..operators import symbols as Y
from .common import LINES_SQL, PATHS_SQL, page_paths, table


def task_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.task_type(F.col("text")).alias("task_type"))


def keywords(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(X.history_keywords(F.col("text")), ",").alias("history"), F.array_join(X.pattern_keywords(F.col("text")), ",").alias("pattern"))


def path_service(spark, sf):
    p = page_paths(spark, sf)
    rules = {r: P.service(F.col("path"), r) for r in ("chunker", "scope", "proto")}
    return p.select("page_id", *(c.alias(f"by_{r}") for r, c in rules.items()), P.component_name(F.col("path")).alias("component"), P.component_type(F.col("path")).alias("component_type"))


def path_language(spark, sf):
    return page_paths(spark, sf).select("page_id", X.language(F.col("path")).alias("language"))


def requirement_names(spark, sf):
    suffix = F.array(*(F.lit(x) for x in (">=1.0", "[all]==2", " @ file:x", "!=3", "~=1", " ")))
    raw = F.concat(F.element_at(F.split("p_name", " "), 1), F.element_at(suffix, (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", X.requirement_name(raw).alias("requirement"), X.slug(F.col("p_type")).alias("slug"), X.truncate(F.col("p_type"), 8, "...").alias("short"))


def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def _windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return H.windows(d, 20, 5, "doc_id")


def chunk_windows(spark, sf):
    return _windows(spark, sf).select("doc_id", "line_start", "line_end", "symbol_name", "symbol_type", X.content_hash(F.col("content")).alias("content_hash"))


def chunk_ids(spark, sf):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    w = _windows(spark, sf)
    return w.select(
        "doc_id", "line_start", H.window_chunk_id(path, F.col("line_start"), F.col("symbol_name") == "__file__").alias("chunk_id"),
        X.span_chunk_id(path, F.col("line_start") - 1, F.col("line_end") - 1).alias("span_id"),
    )


def document_text(spark, sf):
    d = table(spark, sf, "documents")
    service = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    parent = F.when(F.col("doc_id") % 2 == 0, "Base")
    doc = X.document_text(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("text"), F.col("lang"), service, F.lit("main"), F.lit("function"), parent)
    return d.select("doc_id", F.length(doc).alias("chars"), F.sha2(doc, 256).alias("sha256"), X.token_estimate(F.length(doc)).alias("tokens"))


def snippets(spark, sf):
    d = table(spark, sf, "documents")
    doc = F.concat(F.lit("File: x\n\n"), F.col("text"))
    return d.select("doc_id", F.sha2(X.snippet(doc, 5), 256).alias("snippet_sha256"))


def chunk_line_count(spark, sf):
    return H.line_counts(_windows(spark, sf), "doc_id")


def compose_class(spark, sf):
    kinds = F.array(*(F.lit(x) for x in ("postgres:16", "app", "redis:7", "nginx", "minio/minio", "job")))
    names = F.array(*(F.lit(x) for x in ("db-", "init-", "web-", "kafka-", "setup-")))
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")), F.col("source")).alias("name"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("image"),
        F.when(F.col("doc_id") % 7 == 0, "no").alias("restart"),
    )
    return d.select("doc_id", K.compose_class(F.col("name"), F.col("image"), F.col("restart")).alias("node_type"), K.data_store_type(F.col("name"), F.col("image")).alias("data_store_type"), K.edge_type(K.is_data_store(F.col("name"), F.col("image"))).alias("edge_type"))


def test_file_filter(spark, sf):
    p = page_paths(spark, sf)
    return p.select("page_id", P.is_test(F.col("path")).alias("is_test"), P.is_low_value(F.col("path")).alias("is_low_value"), P.skipped(F.col("path")).alias("skipped"), P.group_key(F.col("path")).alias("group_key"))


def symbols_regex(spark, sf):
    s = Y.html_symbols(table(spark, sf, "pages"))
    return s.select("page_id", F.size("headings").alias("headings"), F.size("links").alias("links"), "scripts", F.md5(F.array_join("links", "|")).alias("links_md5"), F.md5(F.array_join("headings", "|")).alias("headings_md5"))


def regex_definitions(spark, sf):
    """Lines that begin with a word count as definitions of that name."""
    text = F.regexp_replace("text", r"(^|\n)(\w+)", "$1function $2")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.lit("shell").alias("language"), text.alias("content"))
    return H.regex_definitions(d).select(F.col("file_path").alias("doc_id"), "line_start", "line_end", "symbol_type", "symbol_name")


def usable_files(spark, sf):
    """Documents, every seventh 1,500 times over, that are neither blank nor of more than 10,000 lines."""
    long = F.col("doc_id") % 7 == 0
    text = F.when(long, F.col("text")).when(F.col("doc_id") % 13 == 0, " \n\t").otherwise(F.col("text"))
    return H.usable(table(spark, sf, "documents").select("doc_id", text.alias("content")), F.when(long, 1500)).select("doc_id")


def embedded(spark, sf):
    """Sizes and lengths of the hashing embedder's vectors, and each document's similarity to itself in upper case."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))
    one, other = V.embed(d), V.embed(d.withColumn("document", F.concat("document", F.lit("\n\n"))))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    both = one.select("chunk_id", "vec_id", F.size("embedding").alias("size"), F.round(length, 6).alias("length"), F.col("embedding").alias("a")).join(other.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    same = F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6)
    return both.select(F.col("chunk_id").alias("doc_id"), "size", "length", same.alias("similarity"))


def overall_recommendation(spark, sf):
    e = table(spark, sf, "events")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    kind, n, band = at(_PATTERNS, 4), (F.col("event_id") % 5), at(_BANDS, 3)
    files, lines = (F.col("event_id") % 12).cast("int"), (F.col("user_id") % 900).cast("int")
    text = K.overall_recommendation(files, lines, (F.lit(1), F.lit(2)), (F.lit(30), F.lit(4000)), kind, n, band)
    return e.select("event_id", text.alias("recommendation"))


_PATTERNS, _BANDS = ("library", "utility", "service", "none"), ("LOW", "MEDIUM", "HIGH")
_any = lambda col, words: " OR ".join(f"contains({col}, '{w}')" for w in words)
_stop = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_kw = lambda stop, n: f"array_to_string(([w FOR w IN regexp_split_to_array(lower(trim(text)), '\\s+') IF length(w) > 3 AND NOT list_contains({_stop(stop)}, w)])[1:{n}], ',')"
WINDOWS_SQL = f"""
{LINES_SQL},
w AS (
  SELECT doc_id, text, ls, len(ls) AS n, CAST(s AS INTEGER) AS s FROM lines,
  unnest(CASE WHEN len(ls) <= 20 THEN [0::BIGINT] ELSE generate_series(0::BIGINT, greatest(len(ls) - 5 - 1, 0)::BIGINT, 15::BIGINT) END) AS u(s)),
win AS (
  SELECT doc_id, s + 1 AS line_start, CAST(least(s + 20, n) AS INTEGER) AS line_end, n <= 20 AS whole,
    CASE WHEN n <= 20 THEN text ELSE array_to_string(ls[s + 1:s + 20], chr(10)) END AS content FROM w)"""
_marker = lambda m: f"regexp_extract(path, '(?:^|/)(?:{m})/([^/]+)', 1)"
_store = "postgres|timescaledb|neo4j|chromadb|chroma|redis|kafka|minio|langfuse"
_low = r"""(len(list_intersect([lower(x) FOR x IN p[:len(p) - 1]], ['vendor', 'vendored', 'third_party', 'third-party', 'thirdparty', 'external', 'extern', 'deps', 'node_modules', 'bower_components', 'wwwroot', 'repos'])) > 0
  OR regexp_matches(name, '(\.d\.ts|\.min\.js|\.min\.ts|\.generated\.ts|\.generated\.py)$') OR name IN ('package.json', 'setup.py', 'conftest.py', '__init__.py') OR regexp_matches(path, 'migrations?/\d|alembic/versions/'))"""
_test = r"(len(list_intersect(p, ['tests', 'test', '__tests__', 'spec', 'specs', 'fixtures'])) > 0 OR regexp_matches(name, '^test_|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$|^conftest'))"
_parts = f"{PATHS_SQL}, pp AS (SELECT *, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name FROM paths)"
_group = "CASE WHEN len(p) > 2 AND lower(p[1]) IN ('services', 'mcp_servers', 'libraries', 'packages', 'apps', 'modules', 'agents') THEN p[1] || '/' || p[2] WHEN len(p) > 1 THEN p[1] ELSE '__root__' END"

QUERIES = {
    "task_type": (
        task_type,
        f"""SELECT doc_id, CASE
  WHEN ({_any('lower(text)', K.ENDPOINT_NOUNS)}) AND ({_any('lower(text)', K.ENDPOINT_VERBS)}) THEN 'endpoint'
  {' '.join(f"WHEN {_any('lower(text)', words)} THEN '{kind}'" for kind, words in K.TASK_TYPES)}
  ELSE 'feature' END AS task_type FROM documents""",
    ),
    "keywords": (keywords, f"SELECT item_id, {_kw(X.HISTORY_STOP_WORDS, 4)} AS history, {_kw(X.PATTERN_STOP_WORDS, 3)} AS pattern FROM benchmark"),
    "path_service": (
        path_service,
        f"""WITH {PATHS_SQL}
SELECT page_id, {_marker('services|libraries|mcp_servers|agents')} AS by_chunker, {_marker('services|libs|mcp-servers|packages|apps')} AS by_scope,
  CASE WHEN {_marker('services|mcp_servers|agents')} <> '' THEN {_marker('services|mcp_servers|agents')} ELSE string_split(path, '/')[1] END AS by_proto,
  CASE WHEN {_marker('services|libraries|mcp_servers|agents')} <> '' THEN {_marker('services|libraries|mcp_servers|agents')} ELSE string_split(path, '/')[1] END AS component,
  CASE WHEN starts_with(path, 'services/') THEN 'service' WHEN starts_with(path, 'libraries/') THEN 'library' WHEN starts_with(path, 'mcp_servers/') THEN 'mcp_server' WHEN starts_with(path, 'agents/') THEN 'agent' ELSE 'unknown' END AS component_type
FROM paths""",
    ),
    "path_language": (
        path_language,
        f"""WITH {PATHS_SQL}
SELECT page_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%/Dockerfile' THEN 'dockerfile' WHEN path LIKE '%.toml' THEN 'toml' ELSE 'unknown' END AS language FROM paths""",
    ),
    "requirement_names": (
        requirement_names,
        r"""SELECT p_partkey, trim(regexp_replace(string_split(p_name, ' ')[1] || (['>=1.0', '[all]==2', ' @ file:x', '!=3', '~=1', ' '])[CAST(p_partkey % 6 AS INTEGER) + 1], '(>=|<=|==|~=|\[|@).*$', '')) AS requirement,
  coalesce(nullif(translate(p_type, '/\ ', '---'), ''), 'unnamed') AS slug, CASE WHEN length(p_type) > 8 THEN p_type[1:8] || '...' ELSE p_type END AS short FROM part""",
    ),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text)[1:16] AS content_hash FROM documents"),
    "chunk_windows": (
        chunk_windows,
        f"""WITH {WINDOWS_SQL}
SELECT doc_id, line_start, line_end, CASE WHEN whole THEN '__file__' ELSE 'lines_' || line_start || '_' || line_end END AS symbol_name, CASE WHEN whole THEN 'module' ELSE 'fragment' END AS symbol_type, sha256(content)[1:16] AS content_hash FROM win""",
    ),
    "chunk_ids": (
        chunk_ids,
        f"""WITH {WINDOWS_SQL}
SELECT doc_id, line_start, sha256('doc/' || doc_id || ':' || line_start || ':' || CASE WHEN whole THEN '__file__' ELSE '__window_' || (line_start - 1) || '__' END)[1:20] AS chunk_id,
  sha256('doc/' || doc_id || ':' || (line_start - 1) || ':' || (line_end - 1))[1:16] AS span_id FROM win""",
    ),
    "document_text": (
        document_text,
        """WITH d AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Service: ' || source || chr(10) END, 'File: doc/', doc_id, chr(10), 'function: ', CASE WHEN doc_id % 2 = 0 THEN 'Base.' ELSE '' END, 'main', chr(10),
  'Language: ', lang, chr(10), chr(10), text) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS sha256, length(t) / 4 AS tokens FROM d""",
    ),
    "snippets": (
        snippets,
        "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) SELECT doc_id, sha256(array_to_string(p[1:5], chr(10)) || CASE WHEN len(p) > 5 THEN chr(10) || '... (truncated)' ELSE '' END) AS snippet_sha256 FROM d",
    ),
    "chunk_line_count": (chunk_line_count, f"WITH {WINDOWS_SQL} SELECT doc_id, CAST(sum(line_end - line_start + 1) AS BIGINT) AS line_count FROM win GROUP BY doc_id"),
    "compose_class": (
        compose_class,
        f"""WITH d AS (SELECT doc_id, (['db-', 'init-', 'web-', 'kafka-', 'setup-'])[CAST(doc_id % 5 AS INTEGER) + 1] || source AS name, (['postgres:16', 'app', 'redis:7', 'nginx', 'minio/minio', 'job'])[CAST(doc_id % 6 AS INTEGER) + 1] AS image, doc_id % 7 = 0 AS no FROM documents),
s AS (SELECT *, regexp_matches(lower(name) || ' ' || lower(image), '{_store}') AS store FROM d)
SELECT doc_id, CASE WHEN store THEN 'data_store' WHEN regexp_matches(lower(name), 'init|migrations|setup') OR no THEN 'init' ELSE 'service' END AS node_type,
  CASE WHEN contains(name || image, 'postgres') THEN 'PostgreSQL' WHEN contains(name || image, 'redis') THEN 'Redis' WHEN contains(name || image, 'kafka') THEN 'Kafka' WHEN contains(name || image, 'minio') THEN 'MinIO' END AS data_store_type,
  CASE WHEN store THEN 'uses_datastore' ELSE 'depends_on' END AS edge_type FROM s""",
    ),
    "test_file_filter": (
        test_file_filter,
        f"""WITH {_parts} SELECT page_id, {_test} AS is_test, {_low} AS is_low_value, len(list_intersect(p, ['.git', '.venv', 'venv', 'node_modules', 'dist', 'build', 'target', 'coverage'])) > 0 AS skipped, {_group} AS group_key FROM pp""",
    ),
    "symbols_regex": (
        symbols_regex,
        r"""WITH s AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS h, regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"', 1) AS a, regexp_extract_all(coalesce(html, ''), '<(script)[ >]', 1) AS c FROM pages)
SELECT page_id, CAST(len(h) AS INTEGER) AS headings, CAST(len(a) AS INTEGER) AS links, CAST(len(c) AS INTEGER) AS scripts, md5(array_to_string(a, '|')) AS links_md5, md5(array_to_string(h, '|')) AS headings_md5 FROM s""",
    ),
    "regex_definitions": (
        regex_definitions,
        f"""WITH {LINES_SQL}, l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines),
f AS (SELECT doc_id, n, i, regexp_extract(line, '^([0-9A-Za-z_]+)', 1) AS name FROM l WHERE regexp_matches(line, '^[0-9A-Za-z_]'))
SELECT doc_id, CAST(i AS INTEGER) AS line_start, CAST(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS INTEGER) AS line_end, 'function' AS symbol_type, name AS symbol_name FROM f""",
    ),
    "usable_files": (
        usable_files,
        f"""WITH {LINES_SQL} SELECT doc_id FROM lines WHERE CASE WHEN doc_id % 7 = 0 THEN regexp_matches(text || chr(10), '[^\\n\\r\\t ]') AND len(p) * 1500 <= 10000 WHEN doc_id % 13 = 0 THEN false ELSE regexp_matches(text, '[^\\n\\r\\t ]') AND len(ls) <= 10000 END""",
    ),
    "embedded_documents": (embedded, "SELECT doc_id, 256 AS size, w AS length, w AS similarity FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z][a-z]|[A-Z]|[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM documents)"),
    "overall_recommendation": (
        overall_recommendation,
        f"""WITH x AS (SELECT event_id, {list(_PATTERNS)}[event_id % 4 + 1] AS kind, event_id % 5 AS n, {list(_BANDS)}[event_id % 3 + 1] AS band, event_id % 12 AS files, user_id % 900 AS lines FROM events)
SELECT event_id, 'Historical: Median ' || files || '.0 files, ' || lines || '.0 lines (range: 1-30 files, 2-4000 lines); ' ||
  CASE WHEN kind = 'library' AND n >= 3 THEN 'Pattern: ' || n || ' library implementations exist - consider using existing code' WHEN kind = 'none' OR n = 0 THEN 'Pattern: No similar code found - start with inline solution' ELSE 'Pattern: ' || n || ' ' || kind || ' implementations exist' END ||
  '; Complexity: ' || band || ' - ' || CASE band WHEN 'LOW' THEN 'inline solution recommended' WHEN 'MEDIUM' THEN 'consider modular approach' ELSE 'plan carefully, test thoroughly' END AS recommendation FROM x""",
    ),
}
