"""Registry of the engine's queries: name -> callable, and their DuckDB SQL."""

from __future__ import annotations

from . import evaluation, graph, history, index, ingest, repomap, search, sessions, text

_MODULES = (search, text, index, graph, history, repomap, evaluation, sessions, ingest)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark, sf_dir: str):
    return graph.scope_flagship(spark, sf_dir)
