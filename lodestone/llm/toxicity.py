"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from a bounded sample of labelled rows: word beginnings (stems)
that occur far more often in toxic than in other documents. The stems form a trie, and
the trie is intersected with the Levenshtein automaton of distance one, a swap of
neighbours counting as one edit: a state of the product is a set of trie nodes with the
edits spent, made the first time a word needs it and remembered, so a further word costs
a lookup a character and most leave after a few. All stems of FUZZY_MIN letters or more
take part.

A hit is of one of three kinds: the stem begins the word as it is, the whole word is
within one edit of the stem, or a beginning of the word is. Each stem carries a weight
for each kind, a log rate ratio measured on the sample and shrunk towards the exact one.
Words that clean documents of the sample use are no misspellings, however close: half of
the clean sample gives these known words, the other half the rate of misspellings that
are none, then all of it gives the known words.

Hits are then read in context: a hit inside quotation marks or after a
reporting word within the window counts as quotation and keeps only a share of
its weight, a hit with other hits in its window counts in full. A document's
features are its rate-corrected sum, its densest window, its quoted sum and its
density; a logistic model fitted on the same sample turns them into a score. Of the
sample, words that begin as several toxic documents' words do, then hits, travel to the
driver, of texts of any length.
Labels, language, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections import Counter
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bounds on the labelled rows the model is fitted on, for each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
STEM_MIN, STEM_MAX = 4, 12
#: Shorter stems must match exactly; longer ones may have one edit.
FUZZY_MIN = 5
#: Most stems a lexicon holds, the most telling first: a bound on what the model learns and sends to the tasks.
MAX_STEMS = 256
#: Least evidence for a stem: twice the log likelihood ratio of its rate in toxic documents against that in others; chance among 100,000 beginnings gives 30 about once in 200 lexicons.
EVIDENCE = 30.0
#: A stem that is not a whole word of toxic documents needs so many different words that begin with it.
CONTINUATIONS = 3
#: Kinds of hits.
EXACT, WHOLE, PREFIX = 0, 1, 2
WINDOW = 6
QUOTED_SHARE = 0.3
#: Bytes of words a task remembers, words too long to be remembered, and transitions of the automaton it keeps.
MEMO_BYTES, MEMO_WORD, MEMO_STEPS = 48 << 20, 64, 400_000
#: Words that report speech.
REPORTING = frozenset("said says quote quoted quotes wrote writes called word term phrase dijo dice escribió sagte sagt schrieb wort dit écrit mot".split())
OPENERS, CLOSERS = "\"“«‘„'", "\"”»’“'"
EDGES = "".join(chr(c) for c in range(33, 48)) + ":;<=>?@[\\]^_`{|}~“”«»‘’„…"
LEVELS = 30.0


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return [w.decode() for w in (text or "").lower().encode().split()]


class Lexicon:
    """Stems in a trie; find() runs the trie's product with the Levenshtein automaton of distance one.

    weights: a weight for each kind of hit of each stem; a kind of weight 0 is not looked for.
    known: words that are no misspellings.
    """

    def __init__(self, weights: dict[str, tuple[float, float, float]], known: frozenset[str] = frozenset()):
        self.weights, self.known = weights, known
        self.sizes = sorted({len(stem) for stem in weights}, reverse=True)
        self.below: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for stem in sorted(s for s, w in weights.items() if len(s) >= FUZZY_MIN and (w[WHOLE] > 0 or w[PREFIX] > 0)):
            at = 0
            for c in stem:
                following = self.below[at].get(c)
                if following is None:
                    following = self.below[at][c] = len(self.below)
                    self.below.append({})
                    self.ends.append(None)
                at = following
            self.ends[at] = stem
        self._forget()

    def __getstate__(self):
        return self.weights, self.known

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.ended: list[tuple[str, ...]] = []
        self.steps: list[dict[str, int]] = []
        self.made = 0
        self.start = self._state({(0, 0, "")})

    def _state(self, members: set[tuple[int, int, str]]) -> int:
        """The number of a set of (node, edits, character a swap still needs), completed by characters left out of the word."""
        for node, edits, pending in list(members):
            if not edits and not pending:
                members.update((m, 1, "") for m in self.below[node].values())
        key = frozenset(x for x in members if not x[1] or x[2] or (x[0], 0, "") not in members)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.ended.append(tuple(sorted({self.ends[n] for n, _, pending in key if not pending and self.ends[n]})))
            self.steps.append({})
        return found

    def _step(self, state: int, c: str) -> int:
        """The state after one more character; it is remembered."""
        below, out = self.below, set()
        for node, edits, pending in self.sets[state]:
            if pending:
                if c == pending:
                    out.add((node, 1, ""))
                continue
            nodes = below[node]
            if c in nodes:
                out.add((nodes[c], edits, ""))
            if not edits:
                out.add((node, 1, ""))  # c is one too many
                for x, m in nodes.items():
                    if x != c:
                        out.add((m, 1, ""))  # c in place of x
                        if c in below[m]:
                            out.add((below[m][c], 1, x))  # c and x have changed places
        following = self.steps[state][c] = self._state(out) if out else -1
        self.made += 1
        return following

    def find(self, word: str) -> tuple[str, int] | None:
        """The stem and kind of a word's hit: exact before whole before prefix, then the heaviest stem; None without a hit.

        No stem begins another, so an exact one is found by its length.
        """
        weights = self.weights
        for k in self.sizes:
            if word[:k] in weights:
                return word[:k], EXACT
        if len(self.ends) == 1 or len(word) < FUZZY_MIN - 1 or word in self.known:
            return None
        if self.made > MEMO_STEPS:
            self._forget()
        state, steps, begun = self.start, self.steps, ()
        for c in word:
            following = steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                break
            begun = self.ended[state] or begun
        whole = self._best(self.ended[state], WHOLE) if state >= 0 else None
        return whole or self._best(begun, PREFIX)

    def _best(self, stems: tuple[str, ...], kind: int) -> tuple[str, int] | None:
        found = min(((-self.weights[s][kind], s) for s in stems if self.weights[s][kind] > 0), default=None)
        return (found[1], kind) if found else None


class Matcher:
    """find() for the words of texts, each distinct word walked once while the bounded memo holds it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.memo, self.held = lexicon, {}, 0

    def hits(self, words: list[str]) -> list[tuple[int, str, int]]:
        """(position, stem, kind) of the words that match."""
        memo = self.memo
        found = list(map(memo.get, words))
        if None in found:
            if self.held > MEMO_BYTES:
                memo.clear()
                self.held = 0
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                w = words[at]
                value = memo.get(w)
                if value is None:
                    value = self.lexicon.find(w.strip(EDGES)) or ()
                    if len(w) <= MEMO_WORD:
                        memo[w] = value
                        self.held += 2 * len(w) + 180
                found[at] = value
        return [(i, *f) for i, f in enumerate(found) if f]

    def marks(self, words: list[str]) -> list[tuple[int, str, int, bool]]:
        """hits() with whether each is quoted."""
        return [(at, stem, kind, quoted(words, at)) for at, stem, kind in self.hits(words)]


def quoted(words: list[str], at: int) -> bool:
    """Whether quotation marks enclose the word within the window, or a reporting word stands before it."""
    before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
    opened = any(w[0] in OPENERS for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in tuple(CLOSERS) for w in after)
    if opened and closed:
        return True
    return any(w.strip(EDGES) in REPORTING for w in before[:-1])


class Model:
    """The lexicon, its rate corrections and the logistic weights; small and independent of the corpus size."""

    def __init__(self, lexicon: Lexicon, drift: float, beta: np.ndarray, shift: float):
        self.lexicon, self.drift, self.beta, self.shift = lexicon, drift, beta, shift

    def features(self, n_words: int, marks: list[tuple[int, str, int, bool]]) -> list[float]:
        weights = self.lexicon.weights
        plain = told = dense = 0.0
        weighed = []
        for at, stem, kind, is_quoted in marks:
            w = weights[stem][kind]
            if is_quoted:
                told += w
                w *= QUOTED_SHARE
            plain += w
            weighed.append((at, w))
        start, inside = 0, 0.0
        for at, w in weighed:
            inside += w
            while weighed[start][0] < at - 2 * WINDOW:
                inside -= weighed[start][1]
                start += 1
            dense = max(dense, inside)
        n = max(1, n_words)
        total = plain - self.drift * n
        return [1.0, max(-1.0, min(1.0, total / LEVELS)), min(1.0, dense / LEVELS), min(1.0, told / LEVELS), min(1.0, max(0.0, plain) * 10 / n)]

    def score(self, n_words: int, marks: list[tuple[int, str, int, bool]]) -> float:
        z = float(np.dot(self.features(n_words, marks), self.beta)) + self.shift
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, z))))


def bare_words(text: str | None) -> list[str]:
    """The distinct words of a text without punctuation at their edges."""
    return sorted({w.strip(EDGES) for w in set(words_of(text))} - {""})


def beginnings(word: str) -> list[str]:
    """What may become a stem."""
    return [word[:k] for k in range(STEM_MIN, min(len(word), STEM_MAX) + 1)]


def least_toxic(n: int) -> int:
    """Toxic documents, of n, that a stem must be found in."""
    return max(3, n // 60)


def learn_stems(toxic: list[list[str]], clean: list[list[str]]) -> list[str]:
    """Stems over-represented in toxic documents, each given by its bare words; none begins another.

    A stem is a word of at least two toxic documents or the beginning of CONTINUATIONS different words of theirs,
    so no mere fragment of a word is one.
    """

    prefixes: dict[str, list[str]] = {}

    def stems(doc: list[str]) -> set[str]:
        out: set[str] = set()
        for w in doc:
            known = prefixes.get(w)
            if known is None:
                known = prefixes[w] = beginnings(w)
            out.update(known)
        return out

    if not toxic or not clean:
        return []
    in_toxic = Counter()
    for doc in toxic:
        in_toxic.update(stems(doc))
    least = least_toxic(len(toxic))
    held = {s for s, n in in_toxic.items() if n >= least}
    spoken = Counter(w for doc in toxic for w in doc)
    begun: dict[str, set[str]] = {}
    for w in spoken:
        for s in beginnings(w):
            if s in held:
                begun.setdefault(s, set()).add(w)
    held = {s for s in held if spoken[s] > 1 or len(begun[s]) >= CONTINUATIONS}
    in_clean, prefixes = Counter(), {}
    for doc in clean:
        found: set[str] = set()
        for w in doc:
            known = prefixes.get(w)
            if known is None:
                known = prefixes[w] = [p for p in beginnings(w) if p in held]
            found.update(known)
        in_clean.update(found)
    ranked = []
    for s in held:
        p, q = in_toxic[s] / len(toxic), (in_clean[s] + 0.5) / (len(clean) + 1)
        if p >= 4 * q:
            gain = p * log(p / q) + (1 - p) * log((1 - p + 1e-9) / (1 - q))
            if 2 * len(toxic) * gain >= EVIDENCE:
                ranked.append((-round(gain, 3), -len(s), s))
    chosen: list[str] = []
    for _, _, s in sorted(ranked):
        if len(chosen) < MAX_STEMS and not any(s.startswith(t) or t.startswith(s) for t in chosen):
            chosen.append(s)
    return chosen


def close_words(lexicon: Lexicon, bare: list[list[str]]) -> frozenset[str]:
    """Words of documents that the automaton takes for misspellings."""
    return frozenset(w for w in {w for doc in bare for w in doc} if (lexicon.find(w) or (None, EXACT))[1] != EXACT)


def unweighted(stems: list[str], known: frozenset[str] = frozenset()) -> Lexicon:
    """A lexicon that finds all kinds of hits of the stems."""
    return Lexicon(dict.fromkeys(stems, (1.0, 1.0, 1.0)), known)


def weigh(stems: list[str], known: tuple[frozenset[str], frozenset[str]], rows: list[tuple[int, int, int, list]], prior: float) -> Model:
    """Weights of the stems and the logistic model from rows (fold, label, words, marks (at, stem, kind, quoted, word)).

    known: words near a stem in the clean documents of fold 0 and of fold 1. A clean
    document's misspellings count as such only if the other fold does not know the word.
    prior: share of toxic among all labelled rows.
    """
    if not stems or not rows:
        return Model(Lexicon({}), 0.0, np.zeros(5), log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    counts, both = Counter(), known[0] | known[1]
    n = {y: max(1, sum(w for _, label, w, _ in rows if label == y)) for y in (0, 1)}
    for fold, y, _, marks in rows:
        heard = both if y else known[1 - fold]
        for (stem, kind), k in Counter((s, e) for _, s, e, _, word in marks if e == EXACT or word not in heard).items():
            counts[y, stem, kind] += min(k, 5)
    weights, drift = {}, 0.0
    for s in stems:
        exact = log((counts[1, s, EXACT] + 0.5) / n[1]) - log((counts[0, s, EXACT] + 0.5) / n[0])
        pull = exp(max(0.0, min(exact, 8.0)) / 2)
        bent = [log((counts[1, s, e] + 0.5) / n[1]) - log((counts[0, s, e] + 0.5 / pull) / n[0]) for e in (WHOLE, PREFIX)]
        weights[s] = (max(0.0, min(exact, 8.0)), *(max(0.0, min(x, exact, 8.0)) for x in bent))
        for e in (EXACT, WHOLE, PREFIX):
            if weights[s][e]:
                drift += max(0.0, counts[1, s, e] / n[1] - counts[0, s, e] / n[0]) * 0.1
    rows = [(y, w, [(at, s, e, q) for at, s, e, q, word in marks if e == EXACT or word not in both]) for _, y, w, marks in rows]
    model = Model(Lexicon(weights, both), drift, np.zeros(5), 0.0)
    x = np.array([model.features(w, marks) for _, w, marks in rows])
    y = np.array([label for label, _, _ in rows], dtype=float)
    beta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.02 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 0.02 * beta), -4, 4)
    sampled = y.sum() / max(1, len(y) - y.sum())
    wanted = max(prior, 1e-3) / max(1 - prior, 1e-3)
    return Model(model.lexicon, drift, beta, log(wanted / max(sampled, 1e-3)))


def fold_of(place: int) -> int:
    """Which half of the sample, in its order, a document is in."""
    return place % 2


def detailed(matcher: Matcher, words: list[str]) -> list[tuple[int, str, int, bool, str]]:
    """marks() with the bare word of each hit."""
    return [(*m, words[m[0]].strip(EDGES)) for m in matcher.marks(words)]


def learn(rows: list[tuple[int, str | None]], prior: float) -> Model:
    """The steps of fit() over (label, text) at hand."""
    stems, known = vocabulary([(y, bare_words(t)) for y, t in rows])
    matcher = Matcher(unweighted(stems))
    return weigh(stems, known, [(fold_of(i), y, len(words_of(t)), detailed(matcher, words_of(t))) for i, (y, t) in enumerate(rows)], prior)


def vocabulary(bare: list[tuple[int, list[str]]]) -> tuple[list[str], tuple[frozenset[str], frozenset[str]]]:
    """Stems, and by fold the words of clean documents that are close to one, from (label, bare words)."""
    stems = learn_stems([w for y, w in bare if y], [w for y, w in bare if not y])
    lexicon = unweighted(stems)
    halves = [[w for i, (y, w) in enumerate(bare) if not y and fold_of(i) == f] for f in (0, 1)]
    return stems, (close_words(lexicon, halves[0]), close_words(lexicon, halves[1]))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Learns from at most toxic + clean labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(toxic).unionByName(known.where("label = 0").orderBy(*order).limit(clean))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row a doc_id
    sample = materialise(one.select("doc_id", "label", "text"), "toxic-sample")  # at most toxic + clean documents

    def listed(batches, keep):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([keep(t) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "label", "words"])

    kind = "doc_id long, label int, words array<string>"
    words = materialise(sample.mapInArrow(lambda batches: listed(batches, bare_words), kind), "toxic-words")
    least = least_toxic(words.where("label = 1").count())
    long_enough = F.filter("words", lambda w: F.length(w) >= STEM_MIN)
    begun = F.flatten(F.transform(long_enough, lambda w: F.transform(F.sequence(F.lit(STEM_MIN), F.least(F.length(w), F.lit(STEM_MAX))), lambda k: F.substring(w, F.lit(1), k))))
    often = words.where("label = 1").select(F.explode(F.array_distinct(begun)).alias("stem")).groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = frozenset(r["stem"] for r in often.collect())  # no other word can tell a stem

    def useful(found: list[str]) -> list[str]:
        return [w for w in found if not held.isdisjoint(beginnings(w))]

    found = sorted((r["doc_id"], r["label"], r["words"]) for r in words.mapInArrow(lambda batches: listed(batches, useful), kind).collect())
    place = {doc_id: i for i, (doc_id, _, _) in enumerate(found)}
    stems = learn_stems([w for _, y, w in found if y], [w for _, y, w in found if not y])
    lexicon = unweighted(stems)
    near = words.where("label = 0").mapInArrow(lambda batches: listed(batches, lambda w: sorted(close_words(lexicon, [w]))), kind).collect()
    known = tuple(frozenset(w for r in near if fold_of(place[r["doc_id"]]) == f for w in r["words"]) for f in (0, 1))
    mark = pa.struct([("at", pa.int64()), ("stem", pa.string()), ("kind", pa.int32()), ("quoted", pa.bool_()), ("word", pa.string())])

    def marked(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            words = [words_of(t) for t in b.column(2).to_pylist()]
            marks = [[dict(zip(("at", "stem", "kind", "quoted", "word"), m, strict=True)) for m in detailed(matcher, w)] for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(marks, pa.list_(mark))], ["doc_id", "label", "n", "marks"])

    rows = sample.mapInArrow(marked, "doc_id long, label int, n long, marks array<struct<at:long,stem:string,kind:int,quoted:boolean,word:string>>").collect()
    rows = sorted((r["doc_id"], r["label"], r["n"], [tuple(m) for m in r["marks"]]) for r in rows)
    return weigh(stems, known, [(fold_of(place[d]), y, n, marks) for d, y, n, marks in rows], totals.get(1, 0) / max(1, sum(totals.values())))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_hits.

    Null and empty texts get the score of a text without hits; a text of any length is read
    whole; repeated rows stay; a null
    doc_id stays null and counts as the empty string in held_out; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches):
        matcher = Matcher(model.lexicon)
        for b in batches:
            s, k = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                marks = matcher.marks(words)
                s.append(model.score(len(words), marks))
                k.append(len(marks))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(k, pa.int64())], ["doc_id", "score", "n_hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double, n_hits long")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: toxicity scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
