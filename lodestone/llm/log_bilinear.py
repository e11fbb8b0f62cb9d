"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

The model predicts a token from the two before it: the context's vector is the sum of
their word vectors, each weighted by its position, and a word's score is the product with
its target vector plus a bias. NEURAL frequent words have vectors of their own; all other
words share one more, the rare class, inside which a word has its smoothed share of the
training tokens. So the probabilities of the V known words and of one unknown word sum to 1
in every context.

What the corpus gives, Spark gathers: token counts and the counts of (two tokens before,
token) over all training documents. These trigrams, weighted by their counts, are dealt to
tasks by hash, frequent ones in equal shares to many; each task trains a copy of the model
by minibatches against noise from the unigram distribution, the copies are averaged, and
the next round starts from the average. Scores come from batched matrix products: one table
of products a context position, and for each pair of context words the logarithm of the
exact sum over the vocabulary. The driver holds the model, its tables and HEAD words, all
of fixed size; words beyond HEAD meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, each, materialise

#: Words with vectors, words whose counts tasks hold, size of the vectors.
NEURAL, HEAD, DIMS = 1024, 65536, 32
#: Noise words a minibatch, rows of a minibatch, rounds of averaging, rows of a task in a round.
NOISE, BATCH, ROUNDS, SHARD = 128, 1024, 4, 1 << 18
#: Longer words are never held by tasks.
LONGEST_HEAD = 256
FOLDS, HELD = 5, 1
#: The end of a text as a token; no word holds white space.
END = b"\n"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK = 4096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def folded(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, text, held_out; a null doc_id is hashed as an empty text, and learned from."""
    own = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (own % folds == held).alias("held_out"))


# What the corpus gives


def token_counts(texts: DataFrame, most: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """word, c over a column of texts, an END for each text; tasks add up as many words as their bounds hold."""

    def run(batches):
        seen, size = Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in each(b.column(0)):
                words = words_of(text)
                seen.update(words)
                seen[END] += 1
                size += len(text or "")
                if len(seen) > most or size > most_bytes and sum(map(len, seen)) > most_bytes:
                    yield out()
                    seen, size = Counter(), 0
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The head's words with their counts, END first, then by count; the first `neural` have vectors."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, kinds: int, neural: int = NEURAL):
        head = sorted(head, key=lambda x: (x[0] != END, -x[1], x[0]))
        self.words = [w for w, _ in head]
        self.counts = np.array([c for _, c in head], dtype=np.int64)
        self.tokens, self.kinds = tokens, kinds
        self.neural = min(neural, len(head))
        self.total = tokens + 0.5 * (kinds + 1)
        own = self.counts[: self.neural]
        self.rare = float(tokens - own.sum() + 0.5 * (kinds - self.neural) + 0.5)

    @property
    def start(self) -> int:
        """What stands before a text; the rare class is the number before."""
        return self.neural + 1

    def unigram(self) -> np.ndarray:
        """Probabilities of the words with vectors, then of the rare class."""
        return np.append(self.counts[: self.neural] + 0.5, self.rare) / self.total

    def base(self) -> np.ndarray:
        return np.log10((self.counts + 0.5) / self.total)

    def share(self) -> np.ndarray:
        """log10 of each head word's share of the rare class, 0 for words with vectors."""
        own = np.log10((self.counts + 0.5) / self.rare)
        own[: self.neural] = 0
        return own


def vocabulary(counts: DataFrame, head: int = HEAD, neural: int = NEURAL) -> Vocabulary:
    """The most frequent words: those at least as frequent as the least count that at most `head` words reach, and END.

    Counts are compared by eighths of their binary logarithm, so one histogram of some
    hundred rows finds that count, and no task sends more than its part of the head.
    """
    n, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    short = (F.length("word") <= LONGEST_HEAD) & (F.col("word") != F.lit(END))
    least, seen = None, 0
    for r in counts.where(short).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 63 rows
        seen += r["count"]
        if seen >= head:
            break
        least = r["level"]
    top = counts.where((short & (level >= least)) | (F.col("word") == F.lit(END)) if least is not None else F.col("word") == F.lit(END))
    return Vocabulary([(bytes(r["word"]), r["c"]) for r in top.collect()], n, kinds, neural)  # at most `head` words


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """__key, doc_id, held_out, ids (two bytes a token, END included), n_tokens, known, base, share, tail: words outside the head.

    known, base and share are over the head's tokens alone; __key tells rows apart once written.
    """
    index = {w: i for i, w in enumerate(vocab.words)}
    base, share, neural = vocab.base(), vocab.share(), vocab.neural
    end = index.get(END, -1)

    def run(batches):
        get = index.get
        for b in batches:
            ids, sizes, known, bases, shares, tails = [], [], [], [], [], []
            for text in each(b.column(1)):
                words = words_of(text)
                own = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
                own = np.append(own, np.int32(end))
                head = own[own >= 0]
                tails.append([words[i] for i in np.flatnonzero(own[:-1] < 0).tolist()] + ([END] if end < 0 else []))
                ids.append(np.where((own < 0) | (own >= neural), neural, own).astype("<u2").tobytes())
                sizes.append(len(own))
                known.append(len(head))
                bases.append(float(base[head].sum()))
                shares.append(float(share[head].sum()))
            cols = [pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, known)), *(pa.array(x, pa.float64()) for x in (bases, shares)), pa.array(tails, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["doc_id", "held_out", "ids", "n_tokens", "known", "base", "share", "tail"])

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, ids binary, n_tokens long, known long, base double, share double, tail array<binary>")
    return rows.withColumn("__key", F.monotonically_increasing_id())


def contexts(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token two before and the one before each token of a text."""
    padded = np.concatenate([[start, start], ids])
    return padded[:-2], padded[1:-1]


def trigram_counts(rows: DataFrame, vocab: Vocabulary, most: int = 1 << 20) -> DataFrame:
    """code, n: how often (two before, one before, token) stands in the texts; tasks add up `most` tokens at a time."""
    start, m = vocab.start, vocab.neural + 2

    def run(batches):
        held, size = [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for b in batches:
            for data in each(b.column(0)):
                ids = np.frombuffer(data, dtype="<u2").astype(np.int64)
                two, one = contexts(ids, start)
                held.append((two * m + one) * m + ids)
                size += len(ids)
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select("ids").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


# The model


class Model:
    """words: vectors of context words (start last); places: weights of the positions, nearest first; targets, bias: of the vocabulary."""

    PARTS = ("words", "places", "targets", "bias")

    def __init__(self, words, places, targets, bias):
        self.words, self.places, self.targets, self.bias = words, places, targets, bias

    @classmethod
    def fresh(cls, vocab: Vocabulary, dims: int = DIMS, seed: int = 7) -> Model:
        """Small random vectors; the bias starts at the unigram distribution."""
        rng, n = np.random.default_rng(seed), vocab.neural + 1
        draw = lambda rows: rng.normal(0, 0.1, (rows, dims)).astype(np.float32)
        return cls(draw(n + 1), np.ones((2, dims), np.float32), draw(n), np.log(vocab.unigram()).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def like(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for p in self.PARTS:
            own = getattr(self, p)
            parts.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Model(*parts)

    def step_grads(self, two, one, target, weight, noise, log_noise) -> list[np.ndarray]:
        """Gradients of the noise-contrastive loss of a minibatch; noise words serve all its rows. log_noise: log(k * p) of the vocabulary."""
        a, b = self.words[one], self.words[two]
        q = a * self.places[0] + b * self.places[1]
        t, z = self.targets[target], self.targets[noise]
        hit = (q * t).sum(axis=1) + self.bias[target] - log_noise[target]
        miss = q @ z.T + (self.bias[noise] - log_noise[noise])
        g = -weight / (1 + np.exp(np.clip(hit, -30, 30)))
        h = weight[:, None] / (1 + np.exp(-np.clip(miss, -30, 30)))
        into = g[:, None] * t + h @ z
        n = len(self.targets)
        targets = scatter(np.concatenate([target, noise]), np.concatenate([g[:, None] * q, h.T @ q]), n)
        bias = np.bincount(target, g, n) + np.bincount(noise, h.sum(axis=0), n)
        words = scatter(np.concatenate([one, two]), np.concatenate([into * self.places[0], into * self.places[1]]), n + 1)
        places = np.stack([(into * a).sum(axis=0), (into * b).sum(axis=0)])
        return [words, places, targets, bias]

    def train(self, codes: np.ndarray, weights: np.ndarray, unigram: np.ndarray, rate: float, seed: int, batch: int = BATCH, noise: int = NOISE) -> Model:
        """One pass over weighted trigrams in the given order, by minibatches with AdaGrad steps."""
        own, m = self.like(self.flat()), len(unigram) + 1
        rng, edges = np.random.default_rng(seed), np.cumsum(unigram)
        log_noise = np.log(noise * unigram)
        sums = [np.full(getattr(own, p).shape, 1e-4) for p in self.PARTS]
        mean = weights.mean() if len(weights) else 1.0
        for i in range(0, len(codes), batch):
            code, w = codes[i : i + batch], weights[i : i + batch] / mean / batch
            drawn = np.minimum(np.searchsorted(edges, rng.random(noise) * edges[-1], side="right"), len(unigram) - 1)
            grads = own.step_grads(code // m // m, code // m % m, code % m, w, drawn, log_noise)
            for p, s, g in zip(self.PARTS, sums, grads, strict=True):
                s += g * g
                getattr(own, p)[...] -= rate * g / np.sqrt(s)
        return own

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every word after each nearest token (bias included) and after each token two before."""
        t = self.targets.astype(np.float64).T
        w = self.words.astype(np.float64)
        return (w * self.places[0]) @ t + self.bias, (w * self.places[1]) @ t


def scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by number."""
    d = rows.shape[1]
    flat = (at[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, rows.ravel(), n * d).reshape(n, d)


# Training and scoring on Spark


def fit(trigrams: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, shard: int = SHARD, rate: float = 0.1, dims: int = DIMS) -> Model:
    """The model after `rounds` passes over the trigrams (code, n), each task's copy averaged by its rows.

    A trigram that stands for many tokens is dealt in shares of at most the mean count, or
    64, so none outweighs a task's others. Rows are dealt and ordered by hash; every round deals anew.
    """
    model, unigram = Model.fresh(vocab, dims), vocab.unigram()
    kinds, tokens = trigrams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not kinds:
        return model
    most = max(64, -(-tokens // kinds))
    parts = F.ceil(F.col("n") / F.lit(most))
    shares = trigrams.select("code", (F.col("n") / parts).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), parts.cast("long"))).alias("share"))
    tasks = max(1, round((kinds + tokens / most) / shard))
    spark = trigrams.sparkSession
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model, unigram))  # of fixed size

        def run(batches, sent=sent, r=r):
            start, unigram = sent.value
            codes, weights = [], []
            for b in batches:
                codes.append(b.column(0).to_numpy())
                weights.append(b.column(1).to_numpy())
            codes, weights = np.concatenate(codes or [np.zeros(0, np.int64)]), np.concatenate(weights or [np.zeros(0)])
            if not len(codes):
                return
            seed = int(codes[0]) * 64 + r
            own = start.train(codes, weights, unigram, rate / (1 + r), seed).flat()
            blocks = range(0, len(own), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(blocks)), pa.int32()), pa.array(np.full(len(blocks), float(len(codes)))), pa.array([own[i : i + BLOCK].astype("<f4").tobytes() for i in blocks], pa.binary())], ["block", "rows", "values"]
            )

        dealt = shares.withColumn("h", F.xxhash64("code", "share", F.lit(r))).repartition(tasks, "h").sortWithinPartitions("h", "code", "share")
        copies = dealt.select("code", "weight").mapInArrow(run, "block int, rows double, values binary")
        merged = copies.repartition("block").mapInArrow(average, "block int, values binary").collect()  # one model
        flat = np.concatenate([np.frombuffer(x["values"], dtype="<f4") for x in sorted(merged, key=lambda x: x["block"])])
        model = model.like(flat)
        sent.unpersist()
    return model


def average(batches):
    """Blocks' means weighted by rows, in running sums."""
    sums: dict[int, list] = {}
    for b in batches:
        for block, rows, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each(b.column(2)), strict=True):
            own = sums.setdefault(block, [0.0, 0.0])
            own[0] += rows
            own[1] = own[1] + rows * np.frombuffer(values, dtype="<f4").astype(np.float64)
    found = [(k, (s / n).astype("<f4").tobytes()) for k, (n, s) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.binary())], ["block", "values"])


def normalisers(spark, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """log of the sum over the vocabulary of exp(score), a row for each token two before, a column for each token before."""
    m = len(near)
    sent = spark.sparkContext.broadcast((near, far))

    def run(batches):
        near, far = sent.value
        for b in batches:
            out = []
            for two in b.column(0).to_pylist():
                s = near + far[two]
                top = s.max(axis=1)
                out.append((top + np.log(np.exp(s - top[:, None]).sum(axis=1))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["two", "z"])

    rows = spark.range(0, m, 1, min(m, 64)).mapInArrow(run, "two long, z binary").collect()  # a square of the vocabulary's fixed size
    return np.stack([np.frombuffer(r["z"]) for r in sorted(rows, key=lambda r: r["two"])])


def text_score(ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], start: int) -> float:
    """log10 of the model's probability of the tokens' classes."""
    near, far, z = tables
    two, one = contexts(ids, start)
    return float((near[one, ids] + far[two, ids] - z[two, one]).sum() / np.log(10))


def scored(rows: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """__key, doc_id, held_out, n_tokens, known, base, neural of encoded rows; neural: the model's part of the score and the head words' shares."""
    spark, start = rows.sparkSession, vocab.start
    near, far = model.tables()
    sent = spark.sparkContext.broadcast((near, far, normalisers(spark, near, far)))  # three squares of the vocabulary's fixed size

    def run(batches):
        for b in batches:
            found = [text_score(np.frombuffer(data, dtype="<u2").astype(np.int64), sent.value, start) for data in each(b.column(6))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(np.array(found) + b.column(7).to_numpy(), pa.float64())], ["__key", "doc_id", "held_out", "n_tokens", "known", "base", "neural"])

    own = rows.select("__key", "doc_id", "held_out", "n_tokens", "known", "base", "ids", "share")
    return own.mapInArrow(run, "__key long, doc_id long, held_out boolean, n_tokens long, known long, base double, neural double")


def tail_sums(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """__key, tail_known, tail_base, tail_share: sums over the words outside the head, joined with their counts."""
    words = rows.select("__key", F.explode("tail").alias("word")).join(counts, "word", "left")
    smooth = F.coalesce("c", F.lit(0)) + F.lit(0.5)
    return words.groupBy("__key").agg(
        F.count("c").alias("tail_known"), F.sum(F.log10(smooth / F.lit(vocab.total))).alias("tail_base"), F.sum(F.log10(smooth / F.lit(vocab.rare))).alias("tail_share")
    )


def score(docs: DataFrame, head: int = HEAD, neural: int = NEURAL, dims: int = DIMS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone; a text of any length is read whole; repeated
    rows and doc_ids each count and come back; a null doc_id is learned from and stays
    null; without training rows every score is 0; an empty table gives no rows; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = folded(docs)
    counts = materialise(token_counts(known.where(~F.col("held_out")).select("text")), "token-counts")
    vocab = vocabulary(counts, head, neural)
    rows = materialise(encoded(known, vocab), "encoded")
    trigrams = materialise(trigram_counts(rows.where(~F.col("held_out")), vocab), "trigrams")
    model = fit(trigrams, vocab, rounds, dims=dims)
    found = scored(rows, model, vocab).join(tail_sums(rows, counts, vocab), "__key", "left")
    plus = lambda c, tail: (F.col(c) + F.coalesce(tail, F.lit(0))).alias({"known": "n_known", "base": "base_score", "neural": "score"}[c])
    return found.select("doc_id", "held_out", "n_tokens", plus("known", "tail_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), plus("base", "tail_base"), plus("neural", "tail_share"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: base score and model score of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
