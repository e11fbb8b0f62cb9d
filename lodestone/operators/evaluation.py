"""Evaluation analytics: metrics of result lists, scenario means, A/B summaries, reviews."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M

#: Agent, severity, pattern, description of the rule scan.
RULES = (
    ("artemis", "critical", r"jwt\.secret\s*=\s*['\"][^'\"]+['\"]", "JWT secret hardcoded"),
    ("artemis", "critical", r"password\s*==", "Timing-unsafe password comparison"),
    ("artemis", "warning", r"jwt\.expir.*=.*[0-9]{2,}.*day", "JWT expiration too long"),
    ("dara", "critical", r"def downgrade\(\):\s*pass", "Missing downgrade implementation"),
    ("dara", "critical", r"Integer\(.*primary_key.*autoincrement", "Using auto-increment IDs"),
    ("dara", "warning", r"\.execute\(.*\%", "Possible SQL injection (string formatting)"),
    ("arik", "critical", r"@app\.(get|post).*\n(?!.*@limiter)", "Missing rate limiting"),
    ("arik", "warning", r"HTTPException\(.*detail=.*user", "User enumeration risk"),
    ("reina", "warning", r"useEffect\(\[.*\],\s*\[\]\)", "Empty dependency array in useEffect"),
    ("reina", "warning", r"any", "Using 'any' type"),
)


def retrieval_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Adds precision, recall and NDCG at each k, MRR and the mean score; results: retrieved, relevant, gains (map), scores."""
    r, rel = F.col("retrieved"), F.col("relevant")
    out = {f"precision_at_{k}": M.precision_at(r, rel, k) for k in ks} | {f"recall_at_{k}": M.recall_at(r, rel, k) for k in ks} | {"mrr": M.mrr(r, rel)}
    if "gains" in results.columns:
        out |= {f"ndcg_at_{k}": M.ndcg_at(r, F.col("gains"), k) for k in ks if k > 1}
    if "scores" in results.columns:
        out["avg_score"] = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, b: a + b) / F.size("scores")).otherwise(0.0)
    return results.withColumns(out)


def scope_metrics(results: DataFrame, kinds: tuple[str, ...] = ("files", "services", "dependencies")) -> DataFrame:
    """Adds precision, recall, f1 of each kind; results: predicted_<kind>, true_<kind>."""
    out = {}
    for kind in kinds:
        out |= {f"{kind}_{m}": c for m, c in M.overlap(F.col(f"predicted_{kind}"), F.col(f"true_{kind}")).items()}
    return results.withColumns(out)


def flatten_results(results: DataFrame) -> DataFrame:
    """One flat row a result for the CSV export; missing metric blocks are null."""
    r, p = "metrics.retrieval", "metrics.performance"
    return results.select(
        "test_id", "scenario", "test_type", "description", *(F.col(f"{r}.`{m}`").alias(m) for m in ("precision@1", "precision@3", "recall@1", "recall@3", "mrr")),
        F.col(f"{p}.latency.p50_ms").alias("latency_ms"), F.col(f"{p}.tokens.total").alias("tokens"),
    )


def scenario_means(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count and plain means of the columns a group."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"avg_{c}") for c in columns))


def performance_means(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means that ignore zeros and nulls, beside the count of all rows; 0 if nothing is left."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)).alias(f"avg_{c}") for c in columns))


def layout_means(results: DataFrame, by: list[str], metrics: list[str], old: str = "retrieval_metrics", new: str = "metrics.retrieval") -> DataFrame:
    """Means with the older layout first, then the newer; zeros count."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(f"{old}.`{m}`"), F.col(f"{new}.`{m}`"))).alias(m) for m in metrics))


def evaluation_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario", "test_type").agg(F.count("*").alias("n"))


def percent_difference(base: Column, other: Column) -> Column:
    """(base - other) / base in percent; 0 where base is not positive."""
    return F.when(base > 0, (base - other) / base * 100).otherwise(0.0)


def improvement(value: Column, base: Column) -> Column:
    """(value - base) / max(base, 0.001) in percent."""
    return (value - base) / F.greatest(base, F.lit(0.001)) * 100


def speed_ratio(slow: Column, fast: Column) -> Column:
    return slow / F.greatest(fast, F.lit(1.0))


def arm_summary(tasks: DataFrame, arm: str = "arm") -> DataFrame:
    """arm, num_tasks, successful, failed, sums and means over successful tasks; tasks: success, tokens, cost, duration, messages."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    return tasks.groupBy(arm).agg(
        F.count("*").alias("num_tasks"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        *(F.coalesce(F.sum(ok(c)), F.lit(0)).alias(f"total_{c}") for c in ("tokens", "cost")),
        *(F.coalesce(F.avg(ok(c)), F.lit(0.0)).alias(f"avg_{c}") for c in ("tokens", "cost", "duration", "messages")),
    )


def token_usage(messages: DataFrame, by: list[str]) -> DataFrame:
    """Token sums of assistant messages; messages: role, input, output, cache_read, cache_write, total, cost."""
    rows = messages.where("role = 'assistant'")
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_write", "total", "cost")))


def tool_calls(messages: DataFrame, by: list[str]) -> DataFrame:
    """Content items of type tool_use; messages: content array<struct<type>>."""
    calls = F.size(F.filter(F.coalesce("content", F.array()), lambda i: i["type"] == "tool_use"))
    return messages.groupBy(*by).agg(F.sum(calls).alias("tool_calls"))


def route_agents(changes: DataFrame, path: str, rules: dict[str, str]) -> DataFrame:
    """Adds agents: the distinct, sorted agents of the rules (text in a path -> agent) that hold for the path. A repository's rules are few, so this is a projection."""
    hits = F.array(*(F.when(F.contains(F.col(path), F.lit(p)), F.lit(a)) for p, a in rules.items())) if rules else F.array().cast("array<string>")
    return changes.withColumn("agents", F.array_sort(F.array_distinct(F.filter(hits, lambda a: a.isNotNull()))))


def agents_of_review(changes: DataFrame, key: str, path: str, rules: dict[str, str]) -> DataFrame:
    """key, agents over all changed files of a review."""
    each = route_agents(changes, path, rules).select(key, F.explode_outer("agents").alias("agent"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("agent")).alias("agents"))


def agent_usage(reviews: DataFrame) -> DataFrame:
    """agent, uses, most used first; reviews: agents."""
    return reviews.select(F.explode("agents").alias("agent")).groupBy("agent").agg(F.count("*").alias("uses"))


def issue_coverage(reviews: DataFrame, expected: int = 5) -> DataFrame:
    """One row: mean of min(1, issues / expected), and mean agents a review."""
    return reviews.agg(F.avg(F.least(F.lit(1.0), F.col("issues") / expected)).alias("issue_coverage"))


def rule_counts(diffs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Adds the number of matches of each severity over all rules, without Python."""
    count = lambda rx: F.size(F.regexp_extract_all(F.col(text), F.lit(f"(?im)({rx})"), F.lit(1)))
    by = {}
    for _, severity, rx, _ in rules:
        by[severity] = by.get(severity, F.lit(0)) + count(rx)
    return diffs.withColumns(by)


def rule_scan(diffs: DataFrame, key: str, text: str = "text", agents: list[str] | None = None, rules=RULES) -> DataFrame:
    """key, agent, severity, description, line of every match; lines count the newlines before it."""
    chosen = [(a, s, re.compile(rx, re.M | re.I), d) for a, s, rx, d in rules if agents is None or a in agents]

    def run(batches):
        for b in batches:
            rows = [(k, a, s, d, t.count("\n", 0, m.start()) + 1) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for a, s, rx, d in chosen for m in rx.finditer(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [key, "agent", "severity", "description", "line"])

    kind = dict(diffs.dtypes)[key]
    return diffs.select(key, text).mapInArrow(run, f"{key} {kind}, agent string, severity string, description string, line int")


def parse_reviews(reviews: DataFrame, text: str = "text") -> DataFrame:
    """Adds summary, critical and warnings (titles and locations) of markdown reviews."""
    section = lambda name: F.regexp_extract(text, rf"(?s)#### {name}.*?\n(.*?)(?:####|\z)", 1)
    item = r"\d+\.\s+\*\*(.+?)\*\*\s+-\s+`(.+?)`"
    both = lambda s: F.arrays_zip(F.regexp_extract_all(s, F.lit(item), F.lit(1)).alias("title"), F.regexp_extract_all(s, F.lit(item), F.lit(2)).alias("location"))
    return reviews.withColumns({"summary": F.trim(F.regexp_extract(text, r"(?s)### Summary\n(.*?)\n###", 1)), "critical_issues": both(section("Critical")), "warnings": both(section("Warning"))})


def parse_search_output(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Adds retrieved paths and scores read from printed search results."""
    return outputs.withColumns({"retrieved": F.regexp_extract_all(text, F.lit(r"\[\d+\]\s+(.*?)\s+—"), F.lit(1)), "scores": F.transform(F.regexp_extract_all(text, F.lit(r"Score:\s+([\d.]+)"), F.lit(1)), lambda s: s.cast("double"))})


def parse_scope_output(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Adds services (lower-case names with dashes) and files that have a symbol, read from a printed scope."""
    return outputs.withColumns({"services": F.regexp_extract_all(text, F.lit(r"- \*\*([a-z0-9-]+)\*\*"), F.lit(1)), "files": F.regexp_extract_all(text, F.lit(r"- `([^`]+)` —"), F.lit(1))})
