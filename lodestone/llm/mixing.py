"""Mixing sources to target weights by entropy balancing.

Among all document rates of at most CAP that meet the constraints, entropy balancing
takes those closest in relative entropy to equal rates. The constraints: each source's
taken words are its target, and the mix keeps the corpus's profile of document lengths,
the mean and the mean square of the logarithm of a document's words (weighted by words,
met up to a small ridge, since no rates may meet them exactly). The convex dual has a
multiplier per source and one per length moment, and a document's rate is
exp(source's multiplier + length multipliers * its moments), cut at CAP: exponentially
tilted, different for each length. Newton's method with a line search solves the dual;
every iteration is one distributed aggregation over the words of each length and source
that returns value, gradient and curvature, a row per source. The matrix is diagonal but
for the few rows of the moments, which a Schur complement removes. A last search, a
bracket a source, brings every source to its target or raises.

Rates are rounded into copies by error diffusion: inside a bucket of a source,
from the longest document to the shortest, a document gets its whole copies and
one more when the tokens owed so far reach half its size. Documents with more than
1 / GIANT of their source's words, at most GIANT a source, are one bucket of their own
and rounded first; the rest of the source gets a multiplier of its own for what they leave. In the
other buckets small documents come last, so what is left over is below the size of a
small document. Buckets are made by a hash of doc_id and size and hold about BUCKET_ROWS
rows, so a source with a third of all rows is spread over many tasks, and every run agrees.
Rows that agree in both share a bucket and are read as a stream.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, keeps_columns, materialise

#: A source's words are taken at most this often.
CAP = 3.0
WEIGHTS = (1, 2, 3)
#: Rows of a source that are rounded together.
BUCKET_ROWS = 500
#: A document with more than one part in GIANT of its source's words is rounded before the others.
GIANT = 512
TOLERANCE = 1e-9
#: Passes that Newton's method may take for the length moments, and those of the search for each source's level.
ROUNDS, LEVEL_ROUNDS = 60, 200
#: Part of a capped document's curvature that Newton's matrix keeps.
CREEP = 1e-3
#: Weight of the ridge on the length multipliers, and most that a step changes the logarithm of a rate.
RIDGE, REACH = 0.02, 2.0


def sized(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name, the words of the whole text (null text: 0)."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            sizes = [len((t or b"").split()) for t in each(b.column(at).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialise(sized(rows, "size").drop("text"), "sizes")


def weighted_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Targets that share the sum of all sizes by weight; none above cap times its source's size, the excess shared anew.

    Sources are taken by code point, null last; the weights repeat.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: dict[str | None, float] = {}
    total = float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = max(0.0, total - sum(capped.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: cap * sizes[s] for s in above}


def newton_step(found: dict, slopes: np.ndarray, targets: dict, moments: np.ndarray) -> tuple[dict, np.ndarray, float, float]:
    """The step of the multipliers of sources and lengths, the dual's slope along it, and the largest relative gap of a source now.

    found: by source the sums over its documents of tokens; of tokens weighted by curvature
    (free), of these the first and second moments (m, mm), and of all m (all_m).
    """
    total = sum(targets.values())
    gap_m = sum((f["all_m"] for f in found.values()), np.zeros(len(slopes))) - moments + RIDGE * total * slopes
    square = RIDGE * total * np.eye(len(slopes)) + sum((f["mm"] for f in found.values()), np.zeros((len(slopes), len(slopes))))
    gap, worst = {}, 0.0
    right = -gap_m
    for s, f in found.items():
        gap[s] = f["tokens"] - targets[s]
        worst = max(worst, abs(gap[s]) / targets[s])
        square = square - np.outer(f["m"], f["m"]) / f["free"]
        right = right + f["m"] * gap[s] / f["free"]
    move = np.linalg.solve(square, right)
    steps = {s: -(gap[s] + float(f["m"] @ move)) / f["free"] for s, f in found.items()}
    scale = min(1.0, REACH / max([*map(abs, steps.values()), 4 * float(np.abs(move).max(initial=0.0)), 1e-12]))
    steps, move = {s: scale * x for s, x in steps.items()}, scale * move
    return steps, move, float(gap_m @ move) + sum(gap[s] * steps[s] for s in found), worst


class Plan:
    """Sizes, rows, targets and multipliers: what the driver holds, one entry a source.

    rows: doc_id, source, size. A rate is a function of a document's source and size.
    """

    def __init__(self, rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP):
        self.rows, self.cap, self.spark = rows, cap, rows.sparkSession
        log = F.log1p(F.col("size"))
        each = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum(F.col("size") * log).alias("a"), F.sum(F.col("size") * log * log).alias("b")).collect()  # one row per source
        self.sizes = {r["source"]: r["size"] for r in each}
        self.counts = {r["source"]: r["n"] for r in each}
        self.targets = weighted_targets(self.sizes, weights, cap)
        words = sum(self.sizes.values())
        mean, second = (sum(r[c] for r in each) / words if words else 0.0 for c in ("a", "b"))
        self.centre, self.spread = round(mean, 9), round(max(second - mean * mean, 1e-6) ** 0.5, 9)
        #: What no rate changes: sources without words take nothing, those at the cap take all documents that often.
        self.fixed = {s: 0.0 if not self.sizes[s] or not t else cap for s, t in self.targets.items() if not self.sizes[s] or not t or t >= cap * self.sizes[s] * (1 - 1e-12)}
        self.tilts = {s: float(np.log(t / self.sizes[s])) for s, t in self.targets.items() if s not in self.fixed}
        self.slopes = np.zeros(2)
        #: Words of every length in every source: rates depend on nothing else, so no iteration reads documents.
        self.lengths = materialise(rows.where("size > 0").groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("words")), "lengths") if self.tilts else None
        #: By source the multipliers of documents that are no giants, and what of these no rate changes.
        self.rest: dict[str | None, float] = {}
        self.rest_fixed: dict[str | None, float] = {}
        if self.tilts:
            self.balance()
            self.settle_giants()

    def moments(self) -> tuple[F.Column, F.Column]:
        """A document's length moments: the standardised logarithm of its words, and its square."""
        f = (F.log1p(F.col("size")) - F.lit(self.centre)) / F.lit(self.spread)
        return f, f * f

    def table(self, tilts: dict) -> DataFrame:
        return self.spark.createDataFrame(list(tilts.items()), "of string, tilt double")

    def tilted(self, lengths: DataFrame, tilts: dict, slopes: np.ndarray) -> tuple[DataFrame, F.Column, F.Column, F.Column]:
        """lengths with their source's multiplier; words taken, their curvature in the multiplier, and the words' part of the dual.

        At the cap a rate does not move; CREEP of the curvature is kept there, so that Newton's matrix never loses a source.
        """
        f, g = self.moments()
        top = float(np.log(self.cap))
        at = F.col("tilt") + F.lit(float(slopes[0])) * f + F.lit(float(slopes[1])) * g
        taken = F.col("words") * F.exp(F.least(at, F.lit(top)))
        curved = F.when(at < top, taken).otherwise(taken * CREEP)
        cost = taken + F.when(at < top, 0.0).otherwise(F.col("words") * F.lit(float(self.cap)) * (at - top))
        return lengths.join(self.table(tilts), F.col("source").eqNullSafe(F.col("of"))), taken, curved, cost

    def measured(self, tilts: dict, slopes: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """One distributed pass: the sums by source that a Newton step needs, the words' part of the dual, and the corpus's mean moments."""
        joined, t, c, cost = self.tilted(self.lengths, tilts, slopes)
        f, g = self.moments()
        sums = {"tokens": t, "free": c, "f": t * f, "g": t * g, "m0": c * f, "m1": c * g, "m00": c * f * f, "m01": c * f * g, "m11": c * g * g, "cost": cost, "s": F.col("words") * 1.0, "sf": F.col("words") * f, "sg": F.col("words") * g}
        rows = joined.groupBy("of").agg(*(F.sum(x).alias(n) for n, x in sums.items())).collect()  # one row per source
        found = {r["of"]: {"tokens": r["tokens"], "free": r["free"], "all_m": np.array([r["f"], r["g"]]), "m": np.array([r["m0"], r["m1"]]), "mm": np.array([[r["m00"], r["m01"]], [r["m01"], r["m11"]]])} for r in rows}
        held = sum(r["s"] for r in rows)
        return found, sum(r["cost"] for r in rows), np.array([sum(r[x] for r in rows) / held for x in ("sf", "sg")])

    def balance(self) -> None:
        """Distributed Newton iterations on the dual with a line search; multipliers are rounded, so that the order of sums does not matter.

        The dual is convex and smooth but for the kinks at the cap, so a step that lowers it enough is always found. The
        length moments are met softly: should ROUNDS passes not bring them to rest, the last slopes serve, with a warning.
        The sources' targets are met in every case, by levels().
        """
        free = {s: t for s, t in self.targets.items() if s not in self.fixed}
        tilts, slopes, total = dict(self.tilts), self.slopes, sum(free.values())
        found, cost, mean = self.measured(tilts, slopes)
        goal = mean * total  # the corpus's moments, for as many words as these sources give

        def dual(cost, tilts, slopes):
            return cost - sum(free[s] * tilts[s] for s in free) - float(goal @ slopes) + RIDGE * total / 2 * float(slopes @ slopes)

        value, settled = dual(cost, tilts, slopes), False
        passes = 1
        while not settled and passes < ROUNDS:
            steps, move, slope, worst = newton_step(found, slopes, free, goal)
            if worst < TOLERANCE and float(np.abs(move).max()) < TOLERANCE:
                settled = True
                break
            scale = 1.0
            while passes < ROUNDS:
                tried = {s: tilts[s] + scale * steps[s] for s in tilts}, slopes + scale * move
                found, cost, _ = self.measured(*tried)
                passes += 1
                now = dual(cost, *tried)
                if now <= value + 1e-4 * scale * slope + 1e-12 * total:
                    (tilts, slopes), value = tried, now
                    break
                scale /= 2
        if not settled:
            warnings.warn(f"mixing: length moments not at rest after {passes} passes; targets of sources are met all the same", stacklevel=2)
        self.slopes = np.round(slopes, 7)
        self.tilts = self.levels(self.lengths, free, tilts)

    def levels(self, lengths: DataFrame, targets: dict, start: dict) -> dict:
        """By source the multiplier at which its words of `lengths` come to its target, the slopes as they are.

        Words taken grow with the multiplier, so each source is a search of its own inside a bracket: Newton's step where
        it stays inside, else the middle. All sources move in one distributed pass a round. Every target must lie between
        0 and the cap times the words; a source that does not come to its target raises.
        """
        open_, done = {s: (start[s], -np.inf, np.inf) for s in targets}, {}
        for _ in range(LEVEL_ROUNDS):
            if not open_:
                break
            joined, t, c, _ = self.tilted(lengths, {s: x[0] for s, x in open_.items()}, self.slopes)
            for r in joined.groupBy("of").agg(F.sum(t).alias("tokens"), F.sum(c).alias("free")).collect():  # one row per source
                s, gap = r["of"], r["tokens"] - targets[r["of"]]
                at, low, high = open_[s]
                if abs(gap) <= TOLERANCE * targets[s] or high - low < 1e-12:
                    done[s] = at
                    del open_[s]
                    continue
                low, high = (low, at) if gap > 0 else (at, high)
                to = at + float(np.clip(-gap / r["free"], -REACH, REACH))
                if not low < to < high:  # both ends are finite here: towards an open end every step stays inside
                    to = (low + high) / 2
                open_[s] = (to, low, high)
        if open_:
            raise ValueError(f"mixing: {len(open_)} sources do not come to their targets, {sorted(map(str, open_))[:5]} among them")
        return {s: round(t, 9) for s, t in done.items()}

    def rate(self, size: int, source: str | None) -> float:
        """A document's rate on the driver, for giants; the same numbers as rates() gives."""
        if source in self.fixed:
            return self.fixed[source]
        return float(rates(np.array([size]), np.array([self.tilts[source]]), self)[0])

    def settle_giants(self) -> None:
        """Rounds the longest documents of every source here, and has the rest of the source make up for what they leave.

        The rest gets a multiplier of its own, for the target less the giants' words; where that is out of its reach it takes
        nothing, or everything at the cap.
        """
        sizes = self.spark.createDataFrame(list(self.sizes.items()), "of string, whole long")
        joined = self.rows.join(sizes, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") * GIANT > F.col("whole"))
        giants: dict[str | None, list] = {}
        for r in joined.select("source", "doc_id", "size").collect():  # fewer than GIANT a source
            giants.setdefault(r["source"], []).append((r["size"], r["doc_id"]))
        due: dict[str | None, float] = {}
        for s, rows in giants.items():
            if s in self.fixed:
                continue
            order = sorted(rows, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
            taken, _ = diffuse([x[0] for x in order], [self.rate(x[0], s) for x in order], 0.0, self.cap)
            left = self.targets[s] - sum(x[0] * n for x, n in zip(order, taken, strict=True))
            words = self.sizes[s] - sum(x[0] for x in order)
            if left <= 0 or left >= self.cap * words:
                self.rest_fixed[s] = 0.0 if left <= 0 else self.cap
            else:
                due[s] = left
        if due:
            small = self.lengths.join(sizes, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") * GIANT <= F.col("whole")).drop("of", "whole")
            self.rest = self.levels(small, due, {s: self.tilts[s] for s in due})

    def by_source(self) -> DataFrame:
        """of; tilt and fixed of giants, then of the others; whole, buckets: one row a source."""
        cells = []
        for s, words in self.sizes.items():
            tilt, fixed = self.tilts.get(s, 0.0), self.fixed.get(s, -1.0)
            cells.append((s, tilt, fixed, self.rest.get(s, tilt), self.rest_fixed.get(s, fixed), words, max(1, -(-self.counts[s] // BUCKET_ROWS))))
        return self.spark.createDataFrame(cells, "of string, tilt double, fixed double, rest double, rest_fixed double, whole long, buckets long")


def rates(size: np.ndarray, tilt: np.ndarray, plan: Plan | tuple) -> np.ndarray:
    """Tilted rates, cut at the cap and rounded; plan: a Plan or its (centre, spread, slopes, cap)."""
    centre, spread, slopes, cap = plan if isinstance(plan, tuple) else (plan.centre, plan.spread, plan.slopes, plan.cap)
    f = (np.log1p(size) - centre) / spread
    return np.round(np.minimum(cap, np.exp(tilt + slopes[0] * f + slopes[1] * f * f)), 8)


def diffuse(sizes: list[int], rates_: list[float], owed: float, cap: float = CAP) -> tuple[list[int], float]:
    """Copies of documents in this order; owed: tokens still due, carried on. No document exceeds the cap."""
    copies_ = []
    for size, rate in zip(sizes, rates_, strict=True):
        whole = int(rate + 1e-9)
        owed += size * max(0.0, rate - whole)
        more = int(size > 0 and owed * 2 >= size and whole + 1 <= cap)
        owed -= size * more
        copies_.append(whole + more)
    return copies_, owed


def copies(rows: DataFrame, plan: Plan, size: str, name: str) -> DataFrame:
    """Adds a column `name` to rows (doc_id, source, the column `size`, others): rates rounded by error diffusion within buckets of a source."""
    held = [f"mix_{n}" for n in ("of", "tilt", "fixed", "rest", "rest_fixed", "whole", "buckets", "bucket")]
    of, tilt, fixed, rest, rest_fixed, whole, buckets, bucket = held
    table = plan.by_source().toDF(*held[:-1])
    doc_id = rows["doc_id"].cast("long")
    known = rows.join(table, rows["source"].cast("string").eqNullSafe(table[of]))
    giant = F.col(size) * GIANT > F.col(whole)
    known = known.withColumn(bucket, F.when(giant, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(doc_id, F.col(size)), F.col(buckets))))
    for own, other in ((tilt, rest), (fixed, rest_fixed)):
        known = known.withColumn(own, F.when(giant, F.col(own)).otherwise(F.col(other)))
    known = known.select(*rows.columns, of, tilt, fixed, bucket)
    ordered = known.repartition(of, bucket).sortWithinPartitions(of, bucket, F.desc(size), doc_id)
    at = [known.columns.index(c) for c in (of, bucket, size, tilt, fixed)]
    width, numbers = len(rows.columns), (plan.centre, plan.spread, plan.slopes, plan.cap)

    def run(batches):
        current, owed = None, 0.0
        for b in batches:
            sources, places, sizes = (b.column(i).to_pylist() for i in at[:3])
            tilts, fixed_ = (b.column(i).to_numpy() for i in at[3:])
            own = np.minimum(numbers[3], np.where(fixed_ >= 0, fixed_, rates(np.array(sizes, dtype=np.int64), tilts, numbers))).tolist()
            out: list[int] = []
            i = 0
            while i < len(sizes):
                j = i
                while j < len(sizes) and sources[j] == sources[i] and places[j] == places[i]:
                    j += 1
                if current != (sources[i], places[i]):
                    current, owed = (sources[i], places[i]), 0.0
                some, owed = diffuse(sizes[i:j], own[i:j], owed, numbers[3])
                out += some
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, pa.int64())], [*b.schema.names[:width], name])

    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    Null texts have size 0 and take 0 words; a null source is a source of its own, last in
    order; a null doc_id is a value like any other; repeated rows are documents of their
    own; whole texts count, of any length; a source without words has target 0; an empty
    table gives no rows; other columns of docs are ignored.
    """
    rows = narrow(docs)
    plan = Plan(rows, weights, cap)
    rounded = copies(rows, plan, "size", "copies")
    table = docs.sparkSession.createDataFrame([(s, plan.sizes[s], plan.targets[s]) for s in plan.sizes], "of string, source_size long, target double")
    joined = rounded.join(table, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@keeps_columns("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix copies it, all columns kept whatever their names; rows move once, with their source and bucket."""
    plan = Plan(narrow(docs), weights, cap)
    taken = copies(sized(docs, "mix_size"), plan, "mix_size", "mix_copies").where("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of each document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
