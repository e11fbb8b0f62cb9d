"""Plans keep their shape: filters and columns reach the scans, ranks are limited early, no cross joins of tables."""

import io
import re
from contextlib import redirect_stdout

import pytest

from lodestone.plans import registry


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    q = registry.queries()
    text = plan(q["upsert_latest"](spark, sf))
    assert "props" not in text and "event_type" not in text
    text = plan(q["delete_by_file"](spark, sf))
    assert re.search(r"PushedFilters: \[.*EqualTo\(quality,0\)", text) and "n_chars" not in text
    assert "WindowGroupLimit" in plan(q["group_cap"](spark, sf))
    assert "TakeOrderedAndProject" in plan(q["last_run_all"](spark, sf))


def scans(df):
    return plan(df).count("Scan parquet")


def test_searches_read_written_frontiers(spark, sf):
    """A search's plan reads the tables of its hops, whatever the depth; statistics read the commits in single passes."""
    from lodestone.operators import graph as G
    from lodestone.plans.common import entity_edges

    edges, starts = entity_edges(spark, sf), spark.createDataFrame([("nation:1",)], "name string")
    assert {scans(G.search(edges, starts, depth)) for depth in (1, 2, 4)} == {scans(G.search(edges, starts, 0))}
    q = registry.queries()
    assert scans(q["graph_context"](spark, sf)) <= 2 and scans(q["risk_levels"](spark, sf)) <= 12
    assert scans(q["history_stats"](spark, sf)) <= 12


#: Queries whose theta joins or one-row products are meant, with what stands on the small side.
MEANT = {
    "first_node": "declared nodes", "best_per_service": "declared services", "graph_counts": "one row", "status_report": "one row", "risk_levels": "one row", "risk_none": "one row", "scope_flagship": "one row",
    "history_type_filter": "one row", "history_outliers": "one row", "history_stats": "one row", "common_files": "one row", "recent_patterns": "one row", "session_compare": "one row", "ab_difference": "one row",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_unmeant_products(name, spark, sf):
    text = plan(registry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text or name in MEANT
    assert "BroadcastNestedLoopJoin" not in text or name in MEANT
    assert "BatchEvalPython" not in text
