"""The pipeline's near-copy stage against all pairs of whole five-word sets."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import common, hamming, near_copies, simhash  # noqa: E402


def edited(words, at):
    return [f"{w}x{i}" if i in at else w for i, w in enumerate(words)]


def family_texts():
    """120 words each: copies with one, two and three words changed (similarity 0.92, 0.84, 0.77), a chain, a large family, odd texts."""
    r = random.Random(3)
    out = ["", "  ", "one", "ONE", "one two", "a b c d e", "A  b c D e"]
    for i in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(120)]
        out.append(" ".join(base))
        out += [" ".join(edited(base, set(range(10 + k, 110, 100 // k)[:k]))) for k in (1 + i % 3, 2, 3)]
    base = [f"c{i}" for i in range(120)]
    for i in range(6):  # each 0.84 or more to the next, far from the first
        out.append(" ".join(base := edited(base, {15 * i + 10, 15 * i + 17})))
    hub = [f"h{i}" for i in range(120)]
    out += [" ".join(edited(hub, {5 + 2 * i % 100, 60 + i})) for i in range(40)] + [" ".join(hub)]
    r.shuffle(out)
    return out


def brute(texts):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return dict(enumerate(root))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("tile, shingles", [(2048, 1 << 20), (8, 1 << 20), (2048, 700)])
def test_classes_are_exact(spark, monkeypatch, tile, shingles):
    """No pair at 0.8 is missed and no document goes for a link below it."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "TILE_SHINGLES", shingles)
    monkeypatch.setattr(near_copies, "CHUNK", 2 if tile == 8 else 64)
    texts = family_texts()
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_classes(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_stage_keeps_one_of_each_class(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = family_texts()
    docs, classes = frame(spark, texts), brute(texts)
    kept = pipeline.near(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in classes.items() if i == c]


def test_candidates_hold_pairs_beyond_the_fingerprint_radius():
    """Pairs just above 0.8: many fingerprints are more than 9 bits apart, all are candidates."""
    r = random.Random(5)
    far = 0
    for _ in range(60):
        base = [b"w%d" % r.randrange(10**6) for _ in range(120)]
        other = [b"z%d" % i if i in (30, 80) else w for i, w in enumerate(base)]
        far += ((simhash.fingerprint(b" ".join(base), 5) ^ simhash.fingerprint(b" ".join(other), 5)) & ((1 << 64) - 1)).bit_count() > 9
        one, two = (near_copies.sketch(near_copies.shingles(w)) for w in (base, other))
        assert near_copies.alike(near_copies.shingles(base), near_copies.shingles(other))
        assert set(near_copies.band_keys(one)) & set(near_copies.band_keys(two))
        assert (one.astype(np.uint8) == two.astype(np.uint8)).sum() >= near_copies.LEAST
    assert far > 5


def test_no_rows_and_nulls(spark):
    docs = frame(spark, ["a b c d e f", "q r s t u v"])
    assert near_copies.keep_one(docs.where("false")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (None, "x")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in near_copies.keep_one(nulls).collect()), key=str) == sorted([(1, None), (None, "a b c d e f"), (3, "a b c d e f"), (None, "x")], key=str)


def far_apart_in_every_fingerprint():
    """Two texts above 0.8 that have no fingerprint in common, but some within two bits."""
    for seed in range(2000):
        r = random.Random(seed)
        base = [b"w%d" % r.randrange(10**6) for _ in range(120)]
        pair = base, [b"z%d" % i if i in (30, 80) else w for i, w in enumerate(base)]
        sets = [near_copies.shingles(w) for w in pair]
        one, two = (np.array(near_copies.fingerprints(s, near_copies.sketch(s))) for s in sets)
        if near_copies.alike(*sets) and 0 < np.bitwise_count((one ^ two).view(np.uint64)).min() <= near_copies.MAX_BITS:
            return [b" ".join(w).decode() for w in pair]
    raise AssertionError("no such pair")


def test_links_come_from_hamming_links(spark, monkeypatch):
    """The classes rest on links_within: a pair with no equal fingerprint is one class, and none is without its rows."""
    texts = far_apart_in_every_fingerprint()
    docs = frame(spark, [*texts, texts[0] + " more"])
    assert {r["component_id"] for r in near_copies.near_classes(docs).collect()} == {0}
    monkeypatch.setattr(near_copies, "links_within", lambda *args, **kwargs: hamming.links_within(*args, **kwargs).where("false"))
    assert sorted(r["component_id"] for r in near_copies.near_classes(docs).collect()) == [0, 1, 2]


def test_fingerprints_of_pairs_at_the_threshold():
    """Sets at 0.8: all pairs have a fingerprint within MAX_BITS, unrelated sets none; long sets are summed in steps."""
    r = np.random.default_rng(1)
    for n in (5, 10, 30, 120, 330, 10_000):
        for _ in range(20 if n > 1000 else 100):
            union = r.integers(0, 1 << 64, n, dtype=np.uint64)
            common, half = -(-n * 4 // 5), (n + -(-n * 4 // 5)) // 2
            sets = [np.sort(x) for x in (union[:half], np.concatenate([union[:common], union[half:]]), r.integers(0, 1 << 64, n, dtype=np.uint64))]
            one, two, other = (np.array(near_copies.fingerprints(s, near_copies.sketch(s))).view(np.uint64) for s in sets)
            assert near_copies.alike(*sets[:2])
            assert np.bitwise_count(one ^ two).min() <= near_copies.MAX_BITS
            if n > 5:
                assert np.bitwise_count(one ^ other).min() > near_copies.MAX_BITS


def test_links_by_column_and_of_equal_fingerprints(spark):
    rows = [(1, 0b1, "x"), (1, 0b1, "y"), (1, 0b10, "x"), (2, 0b100, "x"), (2, 0b100, "x"), (2, 0xFF00, "z")]
    prints = spark.createDataFrame(rows, "band int, fp long, node string")
    got = sorted(tuple(r) for r in hamming.links_within(prints, 2, 1, by=("band",), equal="node").collect())
    assert got == [(0b1, 0b1), (0b1, 0b10)]


def test_unrelated_fingerprints_seldom_share_a_key():
    """Rows whose key another row has: unrelated fingerprints must not meet more often, the more there are of them."""
    prints = np.random.default_rng(2).integers(0, 1 << 64, 200_000, dtype=np.uint64)
    for m in hamming.masks(near_copies.MAX_BITS + near_copies.SHARED, near_copies.SHARED):
        _, n = np.unique(prints & np.uint64(m % (1 << 64)), return_counts=True)
        assert n[n > 1].sum() < len(prints) / 1000


def test_links_are_the_same_for_keys_of_any_length(spark):
    r = random.Random(9)
    base = [r.getrandbits(63) for _ in range(30)]
    rows = sorted({(i % 2, x ^ sum(1 << b for b in r.sample(range(63), r.randrange(3)))) for i in range(400) for x in [r.choice(base)]})
    prints = spark.createDataFrame(rows, "band int, fp long")
    classes = []
    for shared in (1, near_copies.SHARED):
        stars = simhash.components(hamming.links_within(prints, near_copies.MAX_BITS, shared, by=("band",)))
        classes.append(sorted(tuple(x) for x in stars.collect()))
    assert len(classes[0]) > 100 and classes[0] == classes[1]


def test_shuffle_files_go_with_their_query(spark):
    """No shuffle file of materialise() or components() is left to the driver's garbage collection; the session's setting stays."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common._CLEANUP_KEY)
    counts = common.materialise(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    stars = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common._CLEANUP_KEY) == setting
    assert counts.count() == 7 and {r["root"] for r in stars.collect()} == {0}
