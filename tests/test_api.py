from pyspark.sql import functions as F

from lodestone.api import Repository
from lodestone.plans.ingest import TREE
from lodestone.sources import sinks


def write(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_repository(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    repo = Repository(spark, str(root), str(tmp_path / "store"))
    first = repo.index()
    assert first["id"] == 1 and first["files_indexed"] == first["files_scanned"] == len(TREE) and first["chunks_created"] >= len(TREE)
    (root / "services/api/app/main.py").write_text("def renamed_function():\n    return 1\n")
    (root / "libs/web/index.ts").unlink()
    second = repo.index()
    assert (second["files_indexed"], second["files_deleted"], second["files_skipped"]) == (1, 1, len(TREE) - 2)
    assert repo.index()["files_indexed"] == 0
    assert repo.index(full=True)["files_indexed"] == len(TREE) - 1

    (root / "empty.py").write_text(" \n")
    (root / "libraries/python/faa-models/pyproject.toml").write_text("\n")  # had chunks, now has none: they stay, and the file is skipped
    third = repo.index()
    assert (third["files_indexed"], third["files_skipped"]) == (0, len(TREE))
    assert repo.table("chunks").where("file_path LIKE '%faa-models%'").count() == 1 and repo.index()["files_skipped"] == len(TREE)
    (root / "empty.py").unlink()
    (root / "libraries/python/faa-models/pyproject.toml").write_text(TREE["libraries/python/faa-models/pyproject.toml"])
    assert repo.runs().where("status = 'running'").count() == 0 and repo.run_log().where("status = 'running'").count() == 6

    hits = repo.search("renamed function", 5).collect()
    assert hits[0]["file_path"] == "services/api/app/main.py" and hits[0]["rank"] == 1
    assert {r["language"] for r in repo.search("postgres", 5, language="yaml").collect()} == {"yaml"}
    assert {r["service"] for r in repo.search("anything", 5, service="api").collect()} == {"api"}
    assert "```" in repo.context("renamed function")

    nodes, edges = repo.graph()
    assert {(r["source"], r["target"], r["edge_type"]) for r in edges.collect()} >= {("api", "db", "uses_datastore"), ("api", "faa-models", "library_dependency"), ("api", "faa-events", "library_dependency"), ("api", "bot", "grpc")}
    assert "bot" in {r["name"] for r in nodes.collect()}
    row = repo.scope("renamed function")
    assert row.count() == 1 and "# Scope: renamed function" in sinks.scope_report(row)
    text = repo.repo_map()
    assert text.startswith("# Repository Map") and "services/api/app/main.py" in text and len(text) <= 24_000
    assert "**api**" in repo.architecture()
    status = repo.status().first()
    assert status["total_files"] == len(TREE) - 1 and status["last_run"]["id"] == 6
    changed = spark.createDataFrame([("libs/web/index.ts",), ("compose.yml",)], "file_path string")
    assert {tuple(r) for r in repo.refresh(changed).collect()} == {("libs/web/index.ts", "delete"), ("compose.yml", "reindex")}
    commits = spark.createDataFrame([(i, "fix renamed function", i + 1, 10 * i) for i in range(5)], "commit int, message string, files int, lines int").withColumn("ts", F.current_timestamp())
    assert {r["symbol_name"] for r in repo.table("chunks").collect()} >= {"renamed_function"}
    row = repo.intelligence("fix the renamed function", commits).first()
    assert row["complexity_estimate"] == "LOW" and row["recommendation"].startswith("Historical: Median 3.0 files, 20.0 lines (range: 1-5 files, 0-40 lines); Pattern: ") and row["recommendation"].endswith("Complexity: LOW - inline solution recommended")
    assert repo.intelligence("zzz qqqq").first()["complexity_estimate"] == "UNKNOWN"
    text = repo.summarize_context()
    assert "# Repository Map" in text and "- **api**" in text and "  - needs: " in text
    repo.delete_all()
    assert repo.version() == 0
