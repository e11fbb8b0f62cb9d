"""Token counts, base scores and model scores against plain computations; the model against the unigram base."""

import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("lodestone.llm")

import numpy as np  # noqa: E402

from lodestone.llm import log_bilinear as L  # noqa: E402


def plain(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by the formula."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    one = lambda w: math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(i, held(i), len(words(t)), sum(w in count for w in words(t)), n, sum(map(one, words(t)))) for i, t in rows]


def near(a, b):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    a, b = sorted(a, key=order), sorted(b, key=order)
    return len(a) == len(b) and all(x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))


TEXTS = [
    (1, "The cat saw the dog"), (2, "the dog\tsaw THE cat\nthe end"), (3, None), (4, ""), (5, " \n\x0b"), (5, "The cat saw the dog"), (None, "a null id"), (6, "É é z"),
    (7, "x" * 300 + " " + "x" * 300 + " y"), (8, "the cat " * 9000), (9, "unseen words here"), (10, "sets the cat on a dog"), (16, "the dog"), (11, "\x00 nul"),
]


@pytest.mark.parametrize("head,neural", [(L.HEAD, L.NEURAL), (12, 3), (5, 3), (1, 1)])
def test_base_counts_equal_plain(spark, head, neural):
    """Odd texts, with heads so small that most words meet their counts in the join."""
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in TEXTS], "doc_id long, text string, ids string, word int, __key int")
    got = L.score(df, head=head, neural=neural, dims=4, rounds=1).collect()
    assert near([tuple(r)[:6] for r in got], plain(TEXTS))
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert L.score(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = L.score(spark.createDataFrame([(held, "no training row")], schema)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in only] == [(4, 0, 0, 0.0, 0.0)]


def test_probabilities_sum_to_one_and_scores_add_up(spark):
    """Over all known words and one unknown word, in every context; a text's score is the sum over its tokens."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    counts = L.token_counts(L.folded(df).where("not held_out").select("text"))
    vocab = L.vocabulary(counts, neural=4)
    known = {bytes(r["word"]): r["c"] for r in counts.collect()}
    rows = L.encoded(L.folded(df), vocab).collect()
    model = L.Model.fresh(vocab, 6)
    rng = np.random.default_rng(1)
    model = model.like(rng.normal(0, 1, len(model.flat())))
    near_, far = model.tables()
    z = L.normalisers(spark, near_, far)
    q = lambda two, one: model.words[one] * model.places[0].astype(float) + model.words[two] * model.places[1]
    place = {w: i for i, w in enumerate(vocab.words[: vocab.neural])}

    def log_p(two, one, word):
        s = model.targets.astype(float) @ q(two, one) + model.bias
        c = place.get(word, vocab.neural)
        own = math.log10((known.get(word, 0) + 0.5) / vocab.rare) if c == vocab.neural else 0.0
        return (s[c] - np.log(np.exp(s).sum())) / math.log(10) + own

    for two, one in [(vocab.start, vocab.start), (vocab.start, 0), (2, vocab.neural), (1, 3)]:
        assert math.isclose(sum(10 ** log_p(two, one, w) for w in [*known, b"never seen"]), 1.0, rel_tol=1e-6)
    for (_, text), r in zip(TEXTS, rows, strict=True):
        if len(text or "") < 100:
            words = [*L.words_of(text), L.END]
            ids = [place.get(w, vocab.neural) for w in words]
            assert np.frombuffer(r["ids"], "<u2").tolist() == ids
            two, one = L.contexts(np.array(ids), vocab.start)
            total = sum(log_p(a, b, w) for a, b, w in zip(two, one, words, strict=True))
            unseen = sum(math.log10(0.5 / vocab.rare) for w in words if w not in known)
            got = L.text_score(np.array(ids), (near_, far, z), vocab.start) + r["share"] + unseen
            assert math.isclose(got, total, rel_tol=1e-6, abs_tol=1e-6)


def test_head_holds_the_most_frequent_words(spark):
    counts = spark.createDataFrame([(L.END, 3), *((f"w{i}".encode(), 1000 // (i + 1)) for i in range(100)), (b"x" * 300, 5000)], "word binary, c long")
    for head in (1, 8, 50, 1000):
        vocab = L.vocabulary(counts, head, 4)
        assert vocab.words == [L.END, *(f"w{i}".encode() for i in range(len(vocab.words) - 1))] and len(vocab.words) <= head
        assert (vocab.tokens, vocab.kinds) == (counts.agg({"c": "sum"}).first()[0], 102)
        assert len(vocab.words) > head / 2 or head == 1000


def test_trigrams_and_gradients():
    """Counts by hand; the gradient against differences of the loss."""
    vocab = L.Vocabulary([(b"\n", 9), (b"a", 7), (b"b", 5)], 40, 12, 3)
    model = L.Model.fresh(vocab, 3)
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.5, len(model.flat()))
    two, one, target, noise = np.array([4, 4, 1]), np.array([4, 0, 2]), np.array([0, 1, 3]), np.array([0, 3, 3, 2])
    weight, log_noise = np.array([1.0, 0.5, 2.0]), np.log(4 * vocab.unigram())

    def loss(flat):
        m = L.Model(*[x.astype(float) for x in (model.words, model.places, model.targets, model.bias)])
        at = 0
        for p in L.Model.PARTS:
            own = getattr(m, p)
            setattr(m, p, flat[at : at + own.size].reshape(own.shape))
            at += own.size
        q = m.words[one] * m.places[0] + m.words[two] * m.places[1]
        hit = (q * m.targets[target]).sum(axis=1) + m.bias[target] - log_noise[target]
        miss = q @ m.targets[noise].T + m.bias[noise] - log_noise[noise]
        return float((weight * (np.log1p(np.exp(-hit)) + np.log1p(np.exp(miss)).sum(axis=1))).sum())

    grads = np.concatenate([g.ravel() for g in model.like(flat).step_grads(two, one, target, weight, noise, log_noise)])
    for i in range(len(flat)):
        e = np.eye(1, len(flat), i).ravel() * 1e-5
        assert math.isclose((loss(flat + e) - loss(flat - e)) / 2e-5, grads[i], rel_tol=1e-3, abs_tol=1e-4)


def test_trigram_counts_equal_plain(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = L.vocabulary(L.token_counts(L.folded(df).select("text")), neural=5)
    rows = L.encoded(L.folded(df), vocab)
    m, want = vocab.neural + 2, Counter()
    place = {w: i for i, w in enumerate(vocab.words[:5])}
    for _, text in TEXTS:
        ids = [vocab.start, vocab.start, *(place.get(w, 5) for w in [*L.words_of(text), L.END])]
        want.update(zip(ids, ids[1:], ids[2:], strict=False))
    for most in (1, 1 << 20):
        got = {(r["code"] // m // m, r["code"] // m % m, r["code"] % m): r["n"] for r in L.trigram_counts(rows, vocab, most).collect()}
        assert got == dict(want)


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = L.query(spark, sf).where("held_out").agg({"score": "sum", "base_score": "sum"}).first().asDict()
    assert rows["sum(score)"] > rows["sum(base_score)"]
