"""Repository: indexing, search, context, scope, graph, map, status and refresh over a source tree.

State lives in versioned Parquet folders under `store`; a version is complete once its
run is logged, so readers never see half an index and a failed run leaves the last one
as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as K
from .functions import embedding as E
from .functions import paths as P
from .functions import text as X
from .operators import chunking as H
from .operators import graph as G
from .operators import history as T
from .operators import index as I
from .operators import repomap as R
from .operators import scope as C
from .operators import search as S
from .operators import symbols as Y
from .operators.adjacency import Adjacency
from .operators.snapshots import SnapshotTable
from .shared import delete, exists, get
from .sources import files as FILES
from .sources import manifests as M
from .sources import sinks

#: Buckets of the chunk table, by a hash of the file's path.
CHUNK_BUCKETS = 256
FILE_SCHEMA = "file_path string, content_hash string, language string, service string, chunk_count long, line_count long"
RUN_SCHEMA = "id long, files_scanned long, files_indexed long, files_skipped long, files_deleted long, chunks_created long, status string, started_at timestamp, completed_at timestamp"


class Repository:
    """A source tree at `root` with its index in `store`; both may be on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str, store: str, max_lines: int = 100, overlap: int = 5, extra_skip: tuple[str, ...] = ()):
        self.spark, self.root, self.store = spark, root, store.rstrip("/")
        self.max_lines, self.overlap, self.extra_skip = max_lines, overlap, extra_skip

    # -- state --
    def run_log(self) -> DataFrame:
        """The log's rows: one when a run starts, one when it is complete."""
        path = f"{self.store}/runs"
        return self.spark.read.schema(RUN_SCHEMA).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], RUN_SCHEMA)

    def runs(self) -> DataFrame:
        """One row a run; one that failed stays with status running."""
        return I.upsert(self.run_log(), self.run_log().where("false"), ["id"], F.col("status") == "completed")

    def _log(self, row: DataFrame) -> None:
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        row.select(*(F.col(n) if n in row.columns else F.lit(None).alias(n) for n in names)).select(*(F.col(n).cast(t) for n, t in (c.split() for c in RUN_SCHEMA.split(", ")))).write.mode("append").parquet(f"{self.store}/runs")

    def version(self) -> int:
        """Number of the last complete run; 0 without one."""
        return self.run_log().where("status = 'completed'").agg(F.max("id")).first()[0] or 0

    def chunk_table(self) -> SnapshotTable:
        """The chunks, copy-on-write by file: a run rewrites only the buckets of the files it touches."""
        return SnapshotTable(self.spark, f"{self.store}/chunks", ["file_path"], F.pmod(F.xxhash64("file_path"), F.lit(CHUNK_BUCKETS)))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        if name == "chunks":
            return self.chunk_table().read(version or self.version())
        return self.spark.read.parquet(f"{self.store}/{name}/v={version or self.version()}")

    def gitignore(self) -> tuple[str, ...]:
        path = f"{self.root.rstrip('/')}/.gitignore"
        if not exists(self.spark, path):
            return ()
        return tuple(FILES.gitignore_patterns(get(self.spark, path).split("\n")))

    def scan(self) -> DataFrame:
        return FILES.scan(self.spark, self.root, self.extra_skip, self.gitignore())

    # -- indexing --
    def index(self, full: bool = False) -> dict:
        """Indexes new and changed files, drops deleted ones, keeps the rest; returns the run's counters."""
        before = self.version()
        now = before + 1
        self.chunk_table().rollback(before)
        full = full or (before > 0 and before not in self.chunk_table().versions())
        started = self.spark.range(1).select(F.lit(now).alias("id"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"))
        self._log(started)
        scanned = self.scan()
        stored = self.table("files", before) if before else self.spark.createDataFrame([], FILE_SCHEMA)
        found = self._written(I.change_classes(stored, scanned, full=full), "classes", now)
        dirty = scanned.join(found.where("change IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        dirty = self._written(dirty, "dirty", now)  # a file's hash and its chunks come from one read
        chunks = H.chunk_files(dirty.select("file_path", "content"), self.max_lines, self.overlap).withColumn("service", P.service(F.col("file_path"), "chunker"))
        symbol = F.when(F.col("symbol_type") == "fragment", F.concat(F.lit("__window_"), (F.col("line_start") - 1).cast("string"), F.lit("__"))).otherwise(F.col("symbol_name"))
        by_span = X.span_chunk_id(F.col("file_path"), F.col("line_start") - 1, F.col("line_end") - 1)
        chunks = H.documents(chunks.withColumn("chunk_id", F.when(F.col("definition"), by_span).otherwise(X.chunk_id(F.col("file_path"), F.col("line_start"), symbol))))
        columns = ["chunk_id", "file_path", "language", "service", "symbol_name", "symbol_type", "line_start", "line_end", "document"]
        fresh = self._written(E.embed(chunks.select(columns)), "fresh", now)
        classes = I.with_chunks(found, fresh)
        gone = classes.where("change NOT IN ('unchanged', 'skipped')").select("file_path")
        self.chunk_table().change(fresh, gone, now)
        per_file = fresh.groupBy("file_path").agg(F.count("*").alias("chunk_count"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("line_count"), F.first("service").alias("service"))
        indexed = dirty.select("file_path", "content_hash", "language").join(per_file, "file_path").select("file_path", "content_hash", "language", "service", "chunk_count", "line_count")
        self._written(I.delete_by(stored, gone, "file_path").unionByName(indexed), "files", now)
        self._log(I.run_counters(classes, fresh).select(F.lit(now).alias("id"), "*", F.lit("completed").alias("status"), F.current_timestamp().alias("completed_at")))
        for name in ("fresh", "dirty"):
            delete(self.spark, f"{self.store}/{name}")
        return self.run_log().where((F.col("id") == now) & (F.col("status") == "completed")).first().asDict()

    def _written(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.store}/{name}/v={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete_all(self) -> None:
        """Forgets the index: every version of its tables and the log."""
        for name in ("classes", "chunks", "files", "fresh", "dirty", "runs", "graph", "adjacency"):
            delete(self.spark, f"{self.store}/{name}")

    def refresh(self, changed: DataFrame) -> DataFrame:
        """What a list of changed paths (file_path) asks for: reindex or delete."""
        return I.refresh_delta(changed, self.scan().select("file_path"))

    def status(self) -> DataFrame:
        return I.status(self.table("files"), self.runs())

    # -- questions --
    def search(self, query: str, limit: int = S.SEARCH_LIMIT, service: str | None = None, language: str | None = None) -> DataFrame:
        """rank, file_path, symbol, lines, score and snippet of the nearest chunks; filters hold before the cut."""
        where = F.lit(True)
        if service:
            where &= F.col("service") == service
        if language:
            where &= F.col("language") == language
        hits = S.nearest(self.table("chunks"), (0, E.embed_text(query)), limit, where)
        return S.search_columns(hits).drop("query_id", "vec_id").orderBy("rank")

    def context(self, query: str, limit: int = S.CONTEXT_LIMIT) -> str:
        """The nearest chunks as text for a prompt."""
        rows = self.search(query, limit).collect()
        out = [f"## Relevant Code ({len(rows)} chunks)", ""]
        for r in rows:
            out += [f"### {r['file_path']}:{r['line_start']}-{r['line_end']}", f"```{r['language']}", r["snippet"], "```", ""]
        return "\n".join(out)

    def scope(self, description: str, limit: int = S.SCOPE_LIMIT, depth: int = 2) -> DataFrame:
        """One row: services, key files, dependencies, risks, reading order of a task."""
        hits = self.search(description, limit)
        return C.scope(description, hits.select("rank", "service", "file_path", "score"), self.graph()[0], self.adjacency(), depth)

    def history(self, commits: DataFrame, description: str, most: int = 50) -> DataFrame:
        """Statistics of similar commits (commit, message, ts, files, lines); no row without similar ones."""
        stop = set(X.HISTORY_STOP_WORDS)
        words = [w for w in description.lower().split() if len(w) > 3 and w not in stop][:4]
        kind = self.spark.range(1).select(K.task_type(F.lit(description))).first()[0]
        return T.statistics(T.remove_outliers(T.type_filter(T.similar(commits, words, most), kind)))

    def intelligence(self, description: str, commits: DataFrame | None = None) -> DataFrame:
        """One row: complexity band, pattern and the overall recommendation, from similar commits and similar code."""
        near = S.nearest(self.table("chunks"), (0, E.embed_text(description)), S.PATTERN_LIMIT)
        pattern = S.dominant_pattern(near, description).select("pattern_type", F.col("count").alias("occurrences"), "locations", F.col("recommendation").alias("pattern_recommendation"))
        names = ["median_files", "median_lines", "min_files", "min_lines", "max_files", "max_lines"]
        one = self.spark.range(1).select(F.lit(1).alias("__one"))
        if commits is None:
            past = one.select(*(F.lit(None).cast("double").alias(n) for n in names))
        else:
            past = one.join(self.history(commits, description).select(*names), F.lit(True), "left").select(*names)
        both = past.crossJoin(pattern).withColumn("complexity_estimate", K.complexity(F.col("median_files"), F.col("median_lines")))  # one row each
        c = F.col
        text = K.overall_recommendation(c("median_files"), c("median_lines"), (c("min_files"), c("min_lines")), (c("max_files"), c("max_lines")), c("pattern_type"), c("occurrences"), c("complexity_estimate"))
        return both.withColumn("recommendation", text)

    # -- structure --
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the stored graph; built first where none is stored."""
        path = f"{self.store}/graph"
        if not exists(self.spark, path):
            self.build_graph()
        return FILES.graph_json(self.spark, path)

    def adjacency(self) -> Adjacency:
        """The stored edges for searches; built first where none are stored."""
        path = f"{self.store}/adjacency"
        if not exists(self.spark, f"{path}/adjacency.json"):
            return Adjacency.build(self.graph()[1], path)
        return Adjacency.load(self.spark, path)

    def build_graph(self) -> dict:
        """Builds the graph from the tree's manifests and stores it; returns its numbers of nodes and edges."""
        nodes, edges = self._graph()
        sinks.write_graph(nodes, edges, f"{self.store}/graph")
        Adjacency.build(FILES.graph_json(self.spark, f"{self.store}/graph")[1], f"{self.store}/adjacency")
        return G.counts(*FILES.graph_json(self.spark, f"{self.store}/graph")).first().asDict()

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges from compose, pyproject and proto files."""
        tree = FILES.scan(self.spark, self.root, self.extra_skip, self.gitignore()).select("file_path", "content")
        services = M.compose_services(M.compose_file(tree))
        parts = M.components(tree)
        needs = parts.select("component", F.explode(F.concat("path_sources", F.transform("requirements", X.requirement_name))).alias("requirement"))
        proto = M.proto_services(tree)
        nodes = G.merge_compose_and_toml(services.select("name", "node_type"), parts.select(F.col("component").alias("name"), "component_type", "path", "package_name", "description"))
        nodes = G.attach_proto(nodes, proto)
        library = G.resolve_dependencies(needs, parts.select("package_name", "component")).withColumn("edge_type", F.lit("library_dependency")).withColumn("seq", F.lit(2))
        edges = M.compose_edges(services).withColumn("seq", F.lit(1)).unionByName(library).unionByName(G.grpc_edges(proto).withColumn("seq", F.lit(3)))
        edges = G.merge_edges(edges)
        return G.all_nodes(nodes, edges), edges

    def repo_map(self, most: int = R.MAX_FILES, budget: int = R.CHAR_BUDGET) -> str:
        """The budgeted map of the tree's symbols, with one file of each service first."""
        nodes = self.graph()[0]
        files = self.scan().select(F.col("file_path").alias("rel_path"), "language", "content")
        symbols = Y.file_symbols(files)
        counts = Y.kind_counts(F.col("symbols"))
        named = nodes.select("name", F.xxhash64("name").alias("seq"))
        first = G.first_node_in_path(symbols.select("rel_path"), named, "rel_path")
        boost = first.join(G.dependents(self.adjacency(), nodes.select("name"), 1), "name").select("rel_path", G.graph_boost(F.col("dependents")).alias("boost"))
        scored = symbols.join(boost, "rel_path", "left").withColumn("score", R.file_score(F.col("rel_path"), counts["classes"], counts["functions"], counts["types"], counts["methods"], F.coalesce("boost", F.lit(0.0))))
        services = nodes.where("node_type = 'service' AND path IS NOT NULL").select("name", "path", F.xxhash64("name").alias("seq"))
        row = R.repo_map(R.rank_files(scored.drop("boost"), services, most), budget).first()
        return row["map"]

    def architecture(self) -> str:
        """A summary of components and dependencies as text; lists are cut to what a page holds."""
        nodes = self.graph()[0]
        kinds = F.when(F.col("node_type").isin("service", "library"), F.col("node_type")).otherwise("other")
        listed = nodes.select("name", "description", kinds.alias("kind"))
        out = ["# Repository Architecture", "", "## Services & Components", ""]
        for title, kind, most in (("Services", "service", 50), ("Libraries", "library", 20), ("Other components", "other", 20)):
            found = listed.where(F.col("kind") == kind).orderBy("name").limit(most).collect()  # a page's list
            if found:
                out += [f"**{title}:**", *(f"- `{r['name']}`" + (f": {r['description']}" if r["description"] else "") for r in found), ""]
        out += ["## Dependencies", ""]
        for r in G.listing(nodes, self.adjacency(), 10).orderBy("name").collect():
            if r["upstream"] or r["downstream"]:
                out.append(f"**{r['name']}**:")
                out += [f"  - Depends on: {', '.join(r['upstream'][:5])}"] if r["upstream"] else []
                out += [f"  - Used by: {', '.join(r['downstream'][:5])}"] if r["downstream"] else []
        return "\n".join(out)

    def summarize_context(self) -> str:
        """A prompt for an architecture summary: the map, a README's first 3000 characters, all components with their dependencies."""
        nodes = self.graph()[0]
        parts = {"Repository map": self.repo_map()}
        for name in ("README.md", "README.rst", "README.txt", "README"):
            path = f"{self.root.rstrip('/')}/{name}"
            if exists(self.spark, path):
                text = get(self.spark, path).strip()
                parts[name] = text if len(text) <= 3000 else text[:3000] + "\n\n... (truncated)"
                break
        listing = G.listing(nodes, self.adjacency())
        return sinks.architecture_prompt(parts, nodes.select("name", "node_type", "description").join(listing, "name"))
