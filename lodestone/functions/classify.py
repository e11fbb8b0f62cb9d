"""Classifiers: task types, compose services, complexity, risk, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a task an endpoint task (a noun and a verb), and the ordered other types.
ENDPOINT_NOUNS, ENDPOINT_VERBS = ("endpoint", "route", "api"), ("add", "create")
TASK_TYPES = (
    ("refactor", ("refactor", "standardize", "restructure", "migrate")),
    ("fix", ("fix", "bug", "issue", "error")),
    ("test", ("test", "spec", "unit", "integration")),
    ("docs", ("docs", "documentation", "readme")),
)
#: Names and images of data stores, in order.
DATA_STORES = {
    "postgres": "PostgreSQL", "timescaledb": "TimescaleDB", "neo4j": "Neo4j", "chromadb": "ChromaDB", "chroma": "ChromaDB", "redis": "Redis", "kafka": "Kafka", "minio": "MinIO", "langfuse": "Langfuse",
}
INIT_NAMES = ("init", "migrations", "setup")


def any_of(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def task_type(text: Column) -> Column:
    """Ordered substring tests, so a text with "latest" is a test."""
    low = F.lower(text)
    out = F.when(any_of(low, ENDPOINT_NOUNS) & any_of(low, ENDPOINT_VERBS), "endpoint")
    for kind, needles in TASK_TYPES:
        out = out.when(any_of(low, needles), kind)
    return out.otherwise("feature")


def is_data_store(name: Column, image: Column) -> Column:
    return any_of(F.lower(name), DATA_STORES) | any_of(F.lower(F.coalesce(image, F.lit(""))), DATA_STORES)


def compose_class(name: Column, image: Column, restart: Column) -> Column:
    """data_store, init or service; restart counts only as the string "no"."""
    init = any_of(F.lower(name), INIT_NAMES) | (F.coalesce(restart, F.lit("")) == "no")
    return F.when(is_data_store(name, image), "data_store").when(init, "init").otherwise("service")


def data_store_type(name: Column, image: Column) -> Column:
    """Type by the first pattern found in name or image; null for other services."""
    out = F
    for pattern, kind in DATA_STORES.items():
        out = out.when(any_of(F.lower(name), [pattern]) | any_of(F.lower(F.coalesce(image, F.lit(""))), [pattern]), F.lit(kind))
    return out


def edge_type(target_is_store: Column) -> Column:
    return F.when(target_is_store, "uses_datastore").otherwise("depends_on")


def complexity(median_files: Column, median_lines: Column) -> Column:
    """LOW up to 3 files and under 300 lines, MEDIUM up to 8 and under 1200, else HIGH; UNKNOWN without history."""
    return (
        F.when(median_files.isNull() | median_lines.isNull(), "UNKNOWN")
        .when((median_files <= 3) & (median_lines < 300), "LOW")
        .when((median_files <= 8) & (median_lines < 1200), "MEDIUM")
        .otherwise("HIGH")
    )


def risk(name: Column, dependents: Column) -> Column:
    """Risk text by the number of dependents; null at three or fewer."""
    return F.when(dependents > 10, F.concat(F.lit("HIGH RISK: "), name, F.lit(" has "), dependents.cast("string"), F.lit(" dependents. Changes here have wide blast radius."))).when(
        dependents > 3, F.concat(F.lit("MODERATE RISK: "), name, F.lit(" has "), dependents.cast("string"), F.lit(" dependents."))
    )


LOW_RISK = "LOW RISK: Changes appear localized to specific services."


def history_recommendation(files: Column, lines: Column, least: Column, most: Column, common: Column) -> Column:
    """Size class with the medians, the range of files with its advice, and up to three common files."""
    size = F.when(files <= 5, "Simple").when(files <= 10, "Moderate").otherwise("Complex")
    advice = F.when(files <= 5, "start with minimal approach").when(files <= 10, "balance simplicity & completeness").otherwise("plan carefully, test thoroughly")
    return F.concat_ws(
        "; ",
        F.format_string("%s (median: %d files, ~%d lines)", size, files.cast("long"), lines.cast("long")),
        F.format_string("Range: %d-%d files - %s", least.cast("long"), most.cast("long"), advice),
        F.when(F.size(common) > 0, F.concat(F.lit("Commonly modified: "), F.array_join(F.slice(common, 1, 3), ", "))),
    )


def pattern_recommendation(kind: Column, count: Column, first: Column) -> Column:
    n = count.cast("string")
    return (
        F.when((kind == "library") & (count >= 3), F.concat(F.lit("Library pattern detected ("), n, F.lit(" occurrences). Consider using existing library: "), first))
        .when((kind == "utility") & (count >= 2), F.concat(F.lit("Utility pattern detected ("), n, F.lit(" occurrences). Consider adding to existing utility: "), first))
        .when((kind == "service") & (count >= 2), F.concat(F.lit("Service pattern detected ("), n, F.lit(" occurrences). Follow existing service pattern")))
        .when(count == 1, "Single occurrence found. Inline solution likely sufficient.")
        .otherwise("No established pattern. Start with inline solution, refactor if needed.")
    )


def overall_recommendation(files: Column, lines: Column, least: tuple[Column, Column], most: tuple[Column, Column], kind: Column, occurrences: Column, band: Column) -> Column:
    """History, pattern and complexity sentences joined by "; "; parts without data are left out, null without any."""
    long = lambda c: c.cast("long").cast("string")
    history = F.concat(
        F.lit("Historical: Median "), F.round(files, 1).cast("double").cast("string"), F.lit(" files, "), F.round(lines, 0).cast("double").cast("string"), F.lit(" lines (range: "),
        long(least[0]), F.lit("-"), long(most[0]), F.lit(" files, "), long(least[1]), F.lit("-"), long(most[1]), F.lit(" lines)"),
    )
    n = occurrences.cast("string")
    pattern = (
        F.when((kind == "library") & (occurrences >= 3), F.concat(F.lit("Pattern: "), n, F.lit(" library implementations exist - consider using existing code")))
        .when((kind == "none") | (occurrences == 0), "Pattern: No similar code found - start with inline solution")
        .when(kind.isNotNull(), F.concat(F.lit("Pattern: "), n, F.lit(" "), kind, F.lit(" implementations exist")))
    )
    advice = F.when(band == "LOW", "inline solution recommended").when(band == "MEDIUM", "consider modular approach").when(band == "HIGH", "plan carefully, test thoroughly")
    return F.nullif(F.concat_ws("; ", history, pattern, F.concat(F.lit("Complexity: "), band, F.lit(" - "), advice)), F.lit(""))
