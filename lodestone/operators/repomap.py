"""Repository map: file scores, service coverage, group caps, budgeted output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P

#: Limits of the map.
MAX_PER_GROUP, MAX_FILES, CHAR_BUDGET, MAX_SYMBOLS, MAX_METHODS = 5, 80, 24_000, 10, 5
#: The heading of the map.
HEADER = ["# Repository Map", "", "Structural overview of key files (classes, functions, signatures).", "Use this to understand what exists and where before reading files.", ""]


def file_score(path: Column, classes: Column, functions: Column, types: Column, methods: Column, boost: Column | None = None) -> Column:
    """log2(symbols + 1), 1.5 a kind, 0.3 a method up to 3, entry and graph boost, 0.2 off a level past three; at least 0.1; 0 without symbols."""
    n = classes + functions + types
    kinds = (classes > 0).cast("int") + (functions > 0).cast("int") + (types > 0).cast("int")
    deep = F.greatest(F.lit(0.0), (F.size(F.split(path, "/")) - 3) * 0.2)
    score = F.log2(n + 1) + kinds * 1.5 + F.least(methods * 0.3, F.lit(3.0)) + P.entry_boost(path) + (boost if boost is not None else F.lit(0.0)) - deep
    return F.when(n == 0, 0.0).otherwise(F.greatest(score, F.lit(0.1)))


def worth_showing(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Without tests and low-value files."""
    return files.where(~P.is_test(F.col(path)) & ~P.is_low_value(F.col(path)))


def best_per_service(files: DataFrame, services: DataFrame) -> DataFrame:
    """rel_path, service of the best file of each service (name, path), by score and the bonus of its name.

    Files match a service by containment of its path. A file that is best for several
    nested services goes to the first by seq, and the later one takes its next best that
    no earlier service wants: at most one file a service and one service a file.
    """
    hit = files.join(services.select(F.col("name").alias("service"), F.col("path").alias("__path"), "seq").where("path <> ''"), F.contains(F.col("rel_path"), F.col("__path")))
    total = F.col("score") + P.service_file_bonus(F.col("rel_path"))
    ranked = hit.withColumn("__total", total).withColumn("__rn", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("__total"), "rel_path")))
    first = ranked.withColumn("__taken", F.min("seq").over(Window.partitionBy("rel_path", "__rn")))
    free = first.where((F.col("__rn") > 1) | (F.col("seq") == F.col("__taken")))
    again = free.withColumn("__rn2", F.row_number().over(Window.partitionBy("service").orderBy("__rn")))
    return again.where("__rn2 = 1").select("rel_path", "service", "score", "seq")


def group_cap(files: DataFrame, most: int = MAX_PER_GROUP, group: Column | None = None, order: list | None = None) -> DataFrame:
    """At most `most` files of each top-level group, best score first."""
    group = P.group_key(F.col("rel_path")) if group is None else group
    w = Window.partitionBy("__group").orderBy(*(order or [F.desc("score"), F.col("rel_path")]))
    return files.withColumn("__group", group).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__group", "__rn")


def rank_files(files: DataFrame, services: DataFrame | None = None, most: int = MAX_FILES) -> DataFrame:
    """files (rel_path, score, ...) in map order with position: one file a service, then capped groups; cut at `most`."""
    shown = worth_showing(files)
    if services is None:
        phases = group_cap(shown).withColumn("__phase", F.lit(1)).withColumn("__order", -F.col("score"))
    else:
        chosen = best_per_service(shown, services)
        covered = shown.join(chosen.select("rel_path", F.col("seq").alias("__order")), "rel_path").withColumn("__phase", F.lit(0))
        rest = group_cap(shown.join(chosen.select("rel_path"), "rel_path", "left_anti")).withColumn("__phase", F.lit(1)).withColumn("__order", -F.col("score"))
        phases = covered.withColumn("__order", F.col("__order").cast("double")).unionByName(rest)
    cut = phases.orderBy("__phase", "__order", "rel_path").limit(most)
    return cut.withColumn("position", F.row_number().over(Window.orderBy("__phase", "__order", "rel_path"))).drop("__phase", "__order")  # at most `most` rows


def block(path: Column, symbols: Column) -> Column:
    """The text of a file's entry: its path and the signatures of up to MAX_SYMBOLS symbols with up to MAX_METHODS children."""
    member = lambda c: F.concat(F.lit("    "), c["signature"])
    one = lambda s: F.concat_ws("\n", F.concat(F.lit("  "), s["signature"]), F.nullif(F.array_join(F.transform(F.slice(s["children"], 1, MAX_METHODS), member), "\n"), F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("## "), path), F.nullif(F.array_join(F.transform(F.slice(symbols, 1, MAX_SYMBOLS), one), "\n"), F.lit("")), F.lit(""))


def within_budget(blocks: DataFrame, order: list, chars: str = "chars", budget: int = CHAR_BUDGET, spent: int = 0, part: list[str] | None = None) -> DataFrame:
    """The prefix of blocks whose running size stays in the budget; stops at the first overflow. chars must be positive.

    A running sum over one total order is inherently sequential. Any prefix within the
    budget has at most budget - spent rows, so without `part` only that many leading rows
    are ranked (a top-n), never the whole table.
    """
    if part:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return blocks.withColumn("running", F.sum(chars).over(w) + spent).where(F.col("running") <= budget)
    head = blocks.orderBy(*order).limit(max(0, budget - spent) + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("running", F.sum(chars).over(w) + spent).where(F.col("running") <= budget)


def repo_map(ranked: DataFrame, budget: int = CHAR_BUDGET) -> DataFrame:
    """One row: the map's text; ranked: rel_path, symbols, position (at most MAX_FILES rows)."""
    head = "\n".join(HEADER)
    blocks = ranked.select("position", block(F.col("rel_path"), F.col("symbols")).alias("block"))
    kept = within_budget(blocks.withColumn("chars", F.length("block") + 1), [F.col("position")], budget=budget, spent=len(head) + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda b: b["block"]), "\n")
    return kept.agg(F.concat_ws("\n", F.lit(head), F.nullif(body, F.lit(""))).alias("map"))
