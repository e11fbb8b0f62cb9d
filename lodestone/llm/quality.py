"""Quality rules: base counts and a line sequence labeller.

A linear-chain conditional random field labels each line of a text as content or
boilerplate; Viterbi decoding gives the best sequence, and the share of the
text's words that stand in content lines decides retention.

Labels are known for documents, not for lines, so line labels are estimated first: a
line model fitted on the documents' labels says which lines look like the other kind,
and they change sides as long as the larger part of a document's words agrees with its
label; the model is fitted again on the outcome (ROUNDS times). Repeated lines of good
documents start as boilerplate. The field is then trained by gradient ascent on the
log-likelihood of these mixed sequences, so that it learns where texts change. The
sample is bounded (SAMPLE documents, chosen by a hash of doc_id, one row and at most
SAMPLE_LINES lines each, runs chosen by hash over the whole text); only line features of the sample travel to the driver.
Documents are judged whole, map-side, without any shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, keeps_columns

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
#: Bound on the labelled rows that the field is fitted on.
SAMPLE = 1500
#: Bound on the lines of a sampled document, lines of a run of such lines, and rounds of estimating line labels.
SAMPLE_LINES, SAMPLE_RUN, ROUNDS = 2000, 200, 4
#: Longer line sequences are cut into segments of so many lines for training; decoding takes the whole sequence.
SEGMENT = 64
#: Least share of words in content lines.
SHARE = 0.5
MIN_WORDS = 50
FEATURES = 12
#: The feature that tells a line the text had before.
REPEATED = 9


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    inside = bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def base_counts(text: str, data: bytes, words: list[bytes], lines: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    written = [x for x in lines if x.strip()]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(written) - len(set(written)), repeated_words(words)


def line_features(lines: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """A row of FEATURES numbers and the word count for each line with a word."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        rows.append(
            (
                1.0,
                min(1.0, (size - len(line.translate(None, SYMBOLS))) / n),
                min(1.0, line.count(b"!") / n),
                (size - len(line.translate(None, UPPER))) / size,
                (size - len(line.translate(None, DIGITS))) / size,
                1.0 - len(set(words)) / n,
                min(1.0, line.count(b"|") / n),
                log1p(n) / 6.0,
                1.0 if line.rstrip()[-1:] in (b".", b"!", b"?", b":", b";") else 0.0,
                1.0 if line in seen else 0.0,
                1.0 if n < 3 else 0.0,
                1.0 if b"http" in line or b"</" in line else 0.0,
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), sizes


class Field:
    """Linear-chain field over the labels 0 (boilerplate) and 1 (content).

    emit: weights of the features for label 1 against 0; move[a, b]: score of label b after a.
    """

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, features: np.ndarray) -> list[int]:
        """Viterbi: the best label for each line; ties go to content."""
        if not len(features):
            return []
        (stay0, to1), (to0, stay1) = self.move.tolist()
        best0, best1, back = 0.0, 0.0, []
        for i, e in enumerate((features @ self.emit).tolist()):
            if i == 0:
                best1 = e
                continue
            from0, from1 = best0 + stay0, best1 + to0
            into0, into1 = best0 + to1, best1 + stay1
            back.append((int(from1 >= from0), int(into1 >= into0)))
            best0, best1 = max(from0, from1), max(into0, into1) + e
        label = int(best1 >= best0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def line_model(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression of line labels, both labels counting alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-3 * beta), -4, 4)
    return beta


def line_labels(documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> list[np.ndarray]:
    """A label for each line of (features, words, label of the document) with a line; the larger part of its words agrees with the document."""
    if not documents:
        return []
    x = np.concatenate([d[0] for d in documents])
    ends = np.cumsum([0, *(len(d[0]) for d in documents)])
    labels = [np.where(rows[:, REPEATED] > 0, 0, 1) if y else np.zeros(len(rows), dtype=int) for rows, _, y in documents]
    for _ in range(rounds):
        known = np.concatenate(labels)
        if known.min() == known.max():
            break
        margin = x @ line_model(x, known)
        for i, (rows, words, y) in enumerate(documents):
            own = margin[ends[i] : ends[i + 1]]
            other = np.maximum(rows[:, REPEATED] > 0, own < 0) if y else own > 0
            order = np.argsort(own if y else -own, kind="stable")
            order = order[other[order]]  # lines of the other kind, the surest first
            moved = order[np.cumsum(words[order]) * 2 < words.sum()]
            labels[i] = np.full(len(rows), y)
            labels[i][moved] = 1 - y
    return labels


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Fits the field to (features, label of each line); labels of one kind only: a field that keeps every line."""
    parts = [(x[i : i + SEGMENT], y[i : i + SEGMENT]) for x, y in sequences for i in range(0, len(x), SEGMENT)]
    if not parts or len({int(v) for _, y in parts for v in np.unique(y)}) < 2:
        return Field(np.eye(1, FEATURES).ravel(), np.zeros((2, 2)))
    parts.sort(key=lambda p: -len(p[0]))
    size = np.array([len(x) for x, _ in parts])
    steps, n = int(size[0]), len(parts)
    x, y = np.zeros((n, steps, FEATURES)), np.zeros((n, steps), dtype=int)
    for i, (rows, labels) in enumerate(parts):
        x[i, : len(rows)], y[i, : len(rows)] = rows, labels
    here = np.arange(steps)[None, :] < size[:, None]
    content = (y * here).sum() / size.sum()
    mean_label = (y * here).sum(axis=1) / size
    weight = mean_label * 0.5 / content + (1 - mean_label) * 0.5 / (1 - content)  # both labels count alike
    alive = [int((size > t).sum()) for t in range(steps)]
    theta, mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    total = (size * weight).sum()
    for k in range(1, rounds + 1):
        emit, move = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        score = np.zeros((n, steps, 2))
        score[:, :, 1] = x @ emit
        forward, backward = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, steps):
            a = alive[t]
            forward[:a, t] = np.logaddexp.reduce(forward[:a, t - 1, :, None] + move, axis=1) + score[:a, t]
        for t in range(steps - 2, -1, -1):
            a = alive[t + 1]
            backward[:a, t] = np.logaddexp.reduce(move + (score[:a, t + 1] + backward[:a, t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(forward[:, 0] + backward[:, 0], axis=1)
        p1 = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - z[:, None])) * here
        gap = (y - p1) * here * weight[:, None]
        grad_emit = np.einsum("nt,ntf->f", gap, x)
        grad_move = np.zeros((2, 2))
        for t in range(1, steps):
            a = alive[t]
            pair = np.exp(np.minimum(0, forward[:a, t - 1, :, None] + move + (score[:a, t] + backward[:a, t])[:, None, :] - z[:a, None, None]))
            true = np.zeros((a, 2, 2))
            true[np.arange(a), y[:a, t - 1], y[:a, t]] = 1
            grad_move += ((true - pair) * weight[:a, None, None]).sum(axis=0)
        grad = np.concatenate([grad_emit, grad_move.ravel()]) / total - ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta + 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def learn(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """The field of (features, words of each line, label) of documents."""
    some = [d for d in documents if len(d[0])]
    return train(list(zip([d[0] for d in some], line_labels(some), strict=True)))


def sampled_lines(doc_id: int, n: int) -> np.ndarray:
    """Which of a sampled document's n lines the field is trained on, in order: all, or beyond SAMPLE_LINES runs of SAMPLE_RUN lines chosen by hash from the whole text."""
    if n <= SAMPLE_LINES:
        return np.arange(n)
    runs = sorted(range(-(-n // SAMPLE_RUN)), key=lambda k: (zlib.crc32(f"{doc_id}:{k}".encode()), k))[: SAMPLE_LINES // SAMPLE_RUN]
    return np.concatenate([np.arange(k * SAMPLE_RUN, min(n, (k + 1) * SAMPLE_RUN)) for k in sorted(runs)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Trains on at most `sample` labelled rows of docs; rows without a label are not used."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            found = [line_features((t or b"").split(b"\n")) for t in b.column(1).cast(pa.binary()).to_pylist()]
            kept = [sampled_lines(doc_id, len(sizes)) for doc_id, (_, sizes) in zip(b.column(0).to_pylist(), found, strict=True)]
            cells = [rows[k].astype(np.float32).tobytes() for k, (rows, _) in zip(kept, found, strict=True)]
            words = [np.asarray(sizes, dtype=np.int64)[k] for k, (_, sizes) in zip(kept, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells, pa.binary()), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "quality", "cells", "words"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row a doc_id
    rows = one.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, cells binary, words array<long>").collect()  # at most `sample` documents
    rows = sorted(rows, key=lambda r: r["doc_id"])
    features = lambda r: np.frombuffer(r["cells"], dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)
    return learn([(features(r), np.array(r["words"], dtype=np.int64), r["quality"]) for r in rows])


def judge(text: str | None, field: Field, share: float = SHARE) -> tuple:
    """The counts of base_counts, then base_failed, kept, content words."""
    text = text or ""
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    counts = base_counts(text, data, words, lines)
    n, repeats = counts[0], counts[4]
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    features, sizes = line_features(lines)
    content = sum(s for s, y in zip(sizes, field.decode(features), strict=True) if y)
    return (*counts, failed, not failed and content >= share * n, content)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, content_words.

    A null text has no words and fails the base rules, as an empty one does; a text of any
    length is judged whole; repeated rows stay; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            found = [judge(t, field, share) for t in each(b.column(1))]
            cols = list(zip(*found, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *COLUMNS, "base_failed", "kept", "content_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, content_words long")


@keeps_columns("doc_id", "text")
def keep_good(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([judge(t, field, share)[6] for t in each(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: base counts and verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
