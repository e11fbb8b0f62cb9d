"""Queries: retrieval, scope and review metrics, agents, rules, scenario and A/B summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .common import HITS_SQL, PATHS_SQL, WHOLE, page_paths, table, whole_hits


def _results(spark, sf):
    """One row a query: its hits in order, the vectors of its own label as relevant, and gains for those near in label."""
    hits = whole_hits(spark, sf, WHOLE, 10)
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    lists = hits.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("retrieved"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")
    )
    asked = e.where(WHOLE).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    judged = hits.select("query_id", "vec_id", "label").join(asked, "query_id")
    relevant = judged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("own") == F.col("label"), F.col("vec_id")))).alias("relevant"), F.map_from_entries(F.collect_list(F.struct("vec_id", (F.lit(1.0) / (1 + F.abs(F.col("own") - F.col("label")))).alias("g")))).alias("gains"))
    return lists.join(relevant, "query_id")


def retrieval(spark, sf):
    m = E.retrieval_metrics(_results(spark, sf))
    cols = ["precision_at_1", "precision_at_3", "precision_at_5", "recall_at_3", "recall_at_5", "mrr", "avg_score"]
    return m.select("query_id", *(F.round(c, 4).alias(c) for c in cols))


def ndcg(spark, sf):
    m = E.retrieval_metrics(_results(spark, sf))
    return m.select("query_id", *(F.round(c, 4).alias(c) for c in ("ndcg_at_3", "ndcg_at_5")))


def scope_prf1(spark, sf):
    hits = whole_hits(spark, sf, WHOLE, 10)
    sets = hits.groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") <= 5, F.col("label"))).alias("predicted_services"), F.collect_set(F.when(F.col("rank") % 2 == 0, F.col("label"))).alias("true_services"))
    m = E.scope_metrics(sets, ("services",))
    return m.select("query_id", *(F.round(f"services_{c}", 4).alias(f"services_{c}") for c in ("precision", "recall", "f1")))


def review_quality(spark, sf):
    from ..functions import metrics as M

    lab = table(spark, sf, "labels")
    g = lab.groupBy((F.col("doc_id") % 50).alias("review")).agg(
        F.collect_set(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("ec"), F.collect_set(F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.col("doc_id"))).alias("fc"),
        F.collect_set(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("ew"), F.collect_set(F.when(F.col("doc_id") % 7 == 0, F.col("doc_id"))).alias("fw"),
    )
    return g.select("review", F.round(M.review_quality(F.col("fc"), F.col("ec"), F.col("fw"), F.col("ew")), 4).alias("quality"))


_RULES = {"services/": "arik", "libs/": "orion", "main.py": "kai", "tests/": "luna", "src/common": "dara", "server": "marco"}


def agents(spark, sf):
    return E.route_agents(page_paths(spark, sf), "path", _RULES).select("page_id", F.array_join("agents", ",").alias("agents"))


def agent_usage(spark, sf):
    return E.agent_usage(E.route_agents(page_paths(spark, sf), "path", _RULES))


def review_agents(spark, sf):
    p = page_paths(spark, sf).withColumn("review", F.col("page_id") % 20)
    cover = E.agents_of_review(p, "review", "path", _RULES)
    return cover.select("review", F.size("agents").alias("issues"), F.least(F.lit(1.0), F.size("agents") / 5).alias("coverage"))


_DOC_RULES = (("a", "critical", r"the \w+ing", "x"), ("b", "critical", r"password\s*==", "y"), ("c", "warning", r"any", "z"), ("d", "warning", r"\bthat\b", "w"))


def rule_scan(spark, sf):
    return E.rule_counts(table(spark, sf, "documents"), "text", _DOC_RULES).select("doc_id", "critical", "warning")


def issue_coverage(spark, sf):
    return E.issue_coverage(review_agents(spark, sf)).select(F.round("issue_coverage", 4).alias("issue_coverage"))


def layout_means(spark, sf):
    e = table(spark, sf, "events")
    old = F.when(F.col("event_id") % 3 == 0, F.struct(F.col("value").alias("mrr")))
    new = F.when(F.col("event_id") % 3 != 1, F.struct(F.struct((F.col("value") * 2).alias("mrr")).alias("retrieval")))
    rows = e.select(F.col("event_type").alias("scenario"), old.alias("retrieval_metrics"), new.alias("metrics"))
    return E.layout_means(rows, ["scenario"], ["mrr"]).select("scenario", "n", F.round(F.col("mrr").cast("decimal(18,8)"), 4).cast("double").alias("mrr"))  # a tie of decimals, not of doubles


def scenarios(spark, sf):
    e = table(spark, sf, "events").withColumn("latency", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    p = E.performance_means(e, ["event_type"], ["latency"])
    m = E.scenario_means(e, ["event_type"], ["value"]).drop("n")
    return p.join(m, "event_type").select("event_type", "n", F.round("avg_latency", 4).alias("avg_latency"), F.round("avg_value", 4).alias("avg_value"))


def scenario_types(spark, sf):
    return E.evaluation_counts(table(spark, sf, "events").select(F.col("event_type").alias("scenario"), (F.col("user_id") % 3).alias("test_type")))


def _arms(spark, sf):
    t = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "with").otherwise("without").alias("arm"), (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.col("value").alias("cost"), (F.col("value") * 2).alias("duration"), (F.col("event_id") % 9).alias("messages"),
    )
    return E.arm_summary(t)


def ab(spark, sf):
    a = _arms(spark, sf)
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
    return a.select(rounded)


def ab_difference(spark, sf):
    a = _arms(spark, sf)
    one = a.where("arm = 'with'").select(F.col("avg_tokens").alias("w"), F.col("avg_duration").alias("wd")).crossJoin(a.where("arm = 'without'").select(F.col("avg_tokens").alias("o"), F.col("avg_duration").alias("od")))  # one row each
    return one.select(
        F.round(E.percent_difference(F.col("o"), F.col("w")), 4).alias("token_saving"), F.round(E.improvement(F.col("w"), F.col("o")), 4).alias("improvement"), F.round(E.speed_ratio(F.col("wd"), F.col("od")), 4).alias("speed_ratio")
    )


def token_usage(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", F.length("text").alias("input"), (F.length("text") % 7).alias("output"), F.col("turn").alias("cache_read"), (F.col("turn") * 2).alias("cache_write"), (F.length("text") + F.col("turn")).alias("total"), (F.col("turn") * 0.5).alias("cost"))
    u = E.token_usage(c, ["conv_id"])
    return u.select("conv_id", *(F.col(x).cast("long").alias(x) for x in ("input", "output", "cache_read", "cache_write", "total")), F.col("cost").cast("double").alias("cost"))


def tool_calls(spark, sf):
    item = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("text").alias("type")), F.struct(F.lit("tool_use").alias("type")))).otherwise(F.array(F.struct(F.lit("text").alias("type"))))
    c = table(spark, sf, "conversations").select("conv_id", item.alias("content"))
    return E.tool_calls(c, ["conv_id"])


_h = HITS_SQL.format(where=WHOLE, k=10)
_j = f"""{_h}, j AS (SELECT h.query_id, rank, h.vec_id, h.score, h.label = e.label AS rel, 1.0::DOUBLE / (1 + abs(e.label - h.label)) AS g FROM hits h JOIN embeddings e ON e.vec_id = h.query_id)"""
_p = lambda k: f"round(count(*) FILTER (WHERE rel AND rank <= {k}) / {k}.0::DOUBLE, 4) AS precision_at_{k}"
_r = lambda k: f"round(CASE WHEN count(*) FILTER (WHERE rel) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE rel AND rank <= {k}) / count(*) FILTER (WHERE rel)::DOUBLE END, 4) AS recall_at_{k}"
_dcg = lambda r, k: f"sum(g / log2({r} + 1)) FILTER (WHERE {r} <= {k})"
_f = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN "
_agents = "(CASE WHEN contains(path, '{p}') THEN ['{a}'] ELSE [] END)"
_routed = f"{PATHS_SQL}, ra AS (SELECT page_id, list_sort(list_distinct({' || '.join(_agents.format(p=p, a=a) for p, a in _RULES.items())})) AS agents FROM paths)"
_share = lambda part, whole, other: f"CASE WHEN {whole} > 0 THEN {part} / {whole}::DOUBLE WHEN {other} = 0 THEN 1.0 ELSE 0.0 END"
_arm = """ev AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'with' ELSE 'without' END AS arm, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value, event_id % 9 AS messages FROM events),
arms AS (SELECT arm, count(*) AS num_tasks, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, CAST(coalesce(sum(tokens) FILTER (WHERE ok), 0) AS BIGINT) AS total_tokens, coalesce(sum(value) FILTER (WHERE ok), 0) AS total_cost,
  coalesce(avg(tokens) FILTER (WHERE ok), 0) AS avg_tokens, coalesce(avg(value) FILTER (WHERE ok), 0) AS avg_cost, coalesce(avg(value * 2) FILTER (WHERE ok), 0) AS avg_duration, coalesce(avg(messages) FILTER (WHERE ok), 0) AS avg_messages FROM ev GROUP BY arm)"""

QUERIES = {
    "retrieval_metrics": (
        retrieval,
        f"WITH {_j} SELECT query_id, {_p(1)}, {_p(3)}, {_p(5)}, {_r(3)}, {_r(5)}, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0), 4) AS mrr, round(avg(score), 4) AS avg_score FROM j GROUP BY query_id",
    ),
    "ndcg": (
        ndcg,
        f"""WITH {_j}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS best FROM j)
SELECT query_id, round({_dcg('rank', 3)} / {_dcg('best', 3)}, 4) AS ndcg_at_3, round({_dcg('rank', 5)} / {_dcg('best', 5)}, 4) AS ndcg_at_5 FROM o GROUP BY query_id""",
    ),
    "scope_prf1": (
        scope_prf1,
        f"""WITH {_h}, s AS (SELECT query_id, list(DISTINCT label) FILTER (WHERE rank <= 5) AS p, list(DISTINCT label) FILTER (WHERE rank % 2 = 0) AS t FROM hits GROUP BY query_id),
m AS (SELECT query_id, len(list_intersect(p, t)) / len(p)::DOUBLE AS a, len(list_intersect(p, t)) / len(t)::DOUBLE AS b FROM s)
SELECT query_id, round(a, 4) AS services_precision, round(b, 4) AS services_recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 4) AS services_f1 FROM m""",
    ),
    "review_quality": (
        review_quality,
        f"""WITH s AS (SELECT doc_id % 50 AS review, count(DISTINCT doc_id) FILTER (WHERE toxic = 1) AS ec, count(DISTINCT doc_id) FILTER (WHERE toxic = 1 AND quality = 1) AS fc,
  count(DISTINCT doc_id) FILTER (WHERE quality = 0) AS ew, count(DISTINCT doc_id) FILTER (WHERE doc_id % 7 = 0) AS fw, count(DISTINCT doc_id) FILTER (WHERE quality = 0 AND doc_id % 7 = 0) AS w FROM labels GROUP BY 1)
SELECT review, round(0.4 * ({_share('fc', 'ec', 'fc')}) + 0.3 * ({_share('fc', 'fc', 'ec')}) + 0.2 * ({_share('w', 'ew', 'fw')}) + 0.1 * ({_share('w', 'fw', 'ew')}), 4) AS quality FROM s""",
    ),
    "agent_routing": (agents, f"WITH {_routed} SELECT page_id, array_to_string(agents, ',') AS agents FROM ra"),
    "agent_usage": (agent_usage, f"WITH {_routed} SELECT agent, count(*) AS uses FROM (SELECT unnest(agents) AS agent FROM ra) GROUP BY 1"),
    "review_agents": (
        review_agents,
        f"""WITH {_routed}, u AS (SELECT page_id % 20 AS review, agents FROM ra), x AS (SELECT review, count(DISTINCT a) AS n FROM (SELECT review, unnest(agents) AS a FROM u) GROUP BY 1)
SELECT DISTINCT u.review, CAST(coalesce(n, 0) AS INTEGER) AS issues, least(1.0::DOUBLE, coalesce(n, 0) / 5.0::DOUBLE) AS coverage FROM u LEFT JOIN x USING (review)""",
    ),
    "rule_scan": (
        rule_scan,
        r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?im)the \w+ing')) + len(regexp_extract_all(text, '(?im)password\s*==')) AS INTEGER) AS critical, CAST(len(regexp_extract_all(text, '(?im)any')) + len(regexp_extract_all(text, '(?im)\bthat\b')) AS INTEGER) AS warning FROM documents""",
    ),
    "issue_coverage": (issue_coverage, f"""WITH {_routed}, u AS (SELECT page_id % 20 AS review, agents FROM ra), x AS (SELECT review, count(DISTINCT a) AS n FROM (SELECT review, unnest(agents) AS a FROM u) GROUP BY 1),
y AS (SELECT DISTINCT u.review, coalesce(n, 0) AS n FROM u LEFT JOIN x USING (review)) SELECT round(avg(least(1.0::DOUBLE, n / 5.0::DOUBLE)), 4) AS issue_coverage FROM y"""),
    "layout_means": (layout_means, "SELECT event_type AS scenario, count(*) AS n, CAST(round(CAST(avg(CASE event_id % 3 WHEN 0 THEN value WHEN 2 THEN value * 2 END) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS mrr FROM events GROUP BY 1"),
    "scenario_summary": (
        scenarios,
        "SELECT event_type, count(*) AS n, round(coalesce(avg(CASE WHEN event_id % 4 <> 0 AND value <> 0 THEN value END), 0), 4) AS avg_latency, round(avg(value), 4) AS avg_value FROM events GROUP BY 1",
    ),
    "scenario_types": (scenario_types, "SELECT event_type AS scenario, user_id % 3 AS test_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "ab_summary": (ab, f"WITH {_arm} SELECT arm, num_tasks, successful, failed, total_tokens, round(total_cost, 4) AS total_cost, round(avg_tokens, 4) AS avg_tokens, round(avg_cost, 4) AS avg_cost, round(avg_duration, 4) AS avg_duration, round(avg_messages, 4) AS avg_messages FROM arms"),
    "ab_difference": (
        ab_difference,
        f"""WITH {_arm}, x AS (SELECT w.avg_tokens AS w, o.avg_tokens AS o, w.avg_duration AS wd, o.avg_duration AS od FROM arms w, arms o WHERE w.arm = 'with' AND o.arm = 'without')
SELECT round(CASE WHEN o > 0 THEN (o - w) / o * 100 ELSE 0 END, 4) AS token_saving, round((w - o) / greatest(o, 0.001) * 100, 4) AS improvement, round(wd / greatest(od, 1.0), 4) AS speed_ratio FROM x""",
    ),
    "token_usage": (
        token_usage,
        "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS input, CAST(sum(length(text) % 7) AS BIGINT) AS output, CAST(sum(turn) AS BIGINT) AS cache_read, CAST(sum(turn * 2) AS BIGINT) AS cache_write, CAST(sum(length(text) + turn) AS BIGINT) AS total, CAST(sum(turn * 0.5) AS DOUBLE) AS cost FROM conversations WHERE role = 'assistant' GROUP BY 1",
    ),
    "tool_calls": (tool_calls, "SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS tool_calls FROM conversations GROUP BY 1"),
}
