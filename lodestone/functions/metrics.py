"""Retrieval, set-overlap and review metrics as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k over k; repeated hits count each time."""
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda d: F.array_contains(relevant, d))) / F.lit(k)


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct relevant ones among the first k over all relevant ones; 0 without any."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / n)


def mrr(retrieved: Column, relevant: Column) -> Column:
    """One over the rank of the first relevant one; 0 without any."""
    ranks = F.filter(F.transform(retrieved, lambda d, i: F.when(F.array_contains(relevant, d), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def ndcg_at(retrieved: Column, gains: Column, k: int) -> Column:
    """Discounted gain of the first k over the best possible; gains: map from document to relevance. Repeats count, so it can exceed 1."""
    gained = F.transform(F.slice(retrieved, 1, k), lambda d, i: F.coalesce(F.try_element_at(gains, d), F.lit(0.0)) / F.log2(i + 2))
    best = F.transform(F.slice(F.sort_array(F.map_values(gains), asc=False), 1, k), lambda g, i: g / F.log2(i + 2))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return F.when(total(best) > 0, total(gained) / total(best)).otherwise(0.0)


def overlap(predicted: Column, truth: Column) -> dict[str, Column]:
    """precision, recall, f1 of two arrays as sets; all 0 if either is empty."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    both = F.size(F.array_intersect(p, t))
    some = (F.size(p) > 0) & (F.size(t) > 0)
    precision, recall = F.when(some, both / F.size(p)).otherwise(0.0), F.when(some, both / F.size(t)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)}


def _found_share(part: Column, whole: Column, other: Column) -> Column:
    """Shared elements over those of whole; without any, 1 if the other is empty too, else 0."""
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).when(F.size(other) == 0, 1.0).otherwise(0.0)


def review_quality(found_critical: Column, expected_critical: Column, found_warnings: Column, expected_warnings: Column) -> Column:
    """0.4 critical recall + 0.3 critical precision + 0.2 warning recall + 0.1 warning precision."""
    fc, ec, fw, ew = (F.array_distinct(c) for c in (found_critical, expected_critical, found_warnings, expected_warnings))
    c, w = F.array_intersect(fc, ec), F.array_intersect(fw, ew)
    return 0.4 * _found_share(c, ec, fc) + 0.3 * _found_share(c, fc, ec) + 0.2 * _found_share(w, ew, fw) + 0.1 * _found_share(w, fw, ew)
