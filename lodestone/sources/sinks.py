"""Sinks: result JSON, CSV export, graph JSON, map and report text, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", "true").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (name as id) and links as two JSON-lines tables, written in parallel; sources.files.graph_json reads them."""
    nodes.withColumnRenamed("name", "id").write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def write_text(one: DataFrame, path: str, column: str = "map") -> None:
    """A one-row text as one file."""
    one.select(column).coalesce(1).write.mode("overwrite").text(path)


def write_index(files: DataFrame, path: str) -> None:
    """The file index as Parquet, partitioned by language for pruning; a new folder replaces the old one when it is complete."""
    files.write.mode("overwrite").partitionBy("language").parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def search_report(hits: DataFrame) -> str:
    """Printed search results; hits are at most a page."""
    lines = []
    for h in hits.orderBy("rank").collect():
        lines += [f"[{h['rank']}] {h['file_path']} — {h['symbol_type']}: {h['symbol_name']}", f"    Score: {h['score']}"]
    return "\n".join(lines)


def scope_report(scope: DataFrame) -> str:
    """Printed scope of the one-row scope table."""
    r = scope.first()
    out = [f"# Scope: {r['description_summary']}", "", "## Affected services"]
    out += [f"- **{s['service']}** ({s['hit_count']} hits)" for s in r["affected_services"]]
    out += ["", "## Key files"] + [f"- `{f['file_path']}`" for f in r["key_files"][:12]]
    out += ["", "## Dependencies"] + [f"- {d['direction']}: {d['name']}" for d in r["dependencies"]]
    return "\n".join([*out, "", "## Risk", *(f"- {x}" for x in r["risk_assessment"])])


def architecture_prompt(parts: dict[str, str], dependencies: DataFrame) -> str:
    """A prompt that asks for an architecture summary: the given sources by title, the dependencies, the sections wanted.

    dependencies: name, node_type, description, upstream, downstream (arrays of names), one row a component.
    """
    out: list[str] = []
    for title, text in parts.items():
        out += [f"## {title}", "", text, ""]
    out += ["## Components and their dependencies", ""]
    for r in dependencies.orderBy("name").toLocalIterator():
        out.append(f"- **{r['name']}** ({r['node_type'] or 'unknown'})" + (f": {r['description']}" if r["description"] else ""))
        out += [f"  - needs: {', '.join(r['upstream'])}"] if r["upstream"] else []
        out += [f"  - needed by: {', '.join(r['downstream'])}"] if r["downstream"] else []
    wanted = ("what the repository is for", "each component in a line", "patterns and where they are implemented", "shared code and who uses it", "how components talk to each other", "notes for developers")
    return "\n".join([*out, "", "## Task", "", "Summarise the architecture in at most 4000 characters of markdown, from the sources above only:", *(f"{i}. {w}" for i, w in enumerate(wanted, 1))])


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Arrays as text, so any table can go to CSV."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
