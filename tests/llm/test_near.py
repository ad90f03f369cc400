"""Near duplicates at several thresholds and weights against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkfeed.llm import probminhash

WEIGH = {"one": lambda n: 1.0, "count": float, "log": lambda n: 1 + math.log(n)}


def similarity(a, b, weights):
    """The probability Jaccard similarity by its definition."""
    f = WEIGH[weights]
    a, b = {x: f(n) for x, n in a.items()}, {x: f(n) for x, n in b.items()}
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in every) for x in a.keys() & b.keys())


def shingled(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def texts_of(seed, count=90):
    """Texts, changed copies of them, and copies some of whose lines are there many times."""
    rng = random.Random(seed)
    out = []
    for k in range(count // 3):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 200))]
        changed = [w if rng.random() > 0.06 * rng.random() else "new" for w in words]
        line = words[5 : 5 + rng.randrange(8, 20)]
        out += [words, changed, words + line * rng.randrange(0, 6)]
    return {k: " ".join(w) for k, w in enumerate(out)}


def classes(texts, threshold, weights):
    sets = {k: shingled(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and sets[a].keys() & sets[b].keys():
                s = similarity(sets[a], sets[b], weights)
                if s >= threshold - 1e-9:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: find(k) for k in texts}


@pytest.mark.parametrize("weights", ["one", "count", "log"])
@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.9])
def test_classes_at_default_arguments(spark, threshold, weights):
    texts = texts_of(int(threshold * 10))
    got = probminhash.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), threshold=threshold, weights=weights)
    want = classes(texts, threshold, weights)
    assert {r.doc_id: r.class_id for r in got.collect()} == want and len(set(want.values())) < len(texts)


def test_weights_tell_other_pairs_than_sets():
    line, rest = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(30))
    once, often = shingled(f"{line} {rest}"), shingled(" ".join([line] * 9) + f" {rest}")
    assert similarity(once, often, "count") < 0.6 < similarity(once, often, "one")


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ({int(x): int(rng.integers(1, 9)) for x in rng.choice(30, rng.integers(1, 20), replace=False)} for _ in range(2))
        for weights in WEIGH:
            sides = [(np.array(sorted(s), np.uint64), probminhash.WEIGHTS[weights](np.array([s[x] for x in sorted(s)], float))) for s in (a, b)]
            assert probminhash.probability_jaccard(*sides[0], *sides[1]) == pytest.approx(similarity(a, b, weights), abs=1e-9)


def test_signatures_estimate_the_weighted_similarity():
    a, b = {k: 1 + k % 7 for k in range(60)}, {k: 1 + (k * k) % 5 for k in range(20, 80)}
    e, w, o = (np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()], float), np.repeat([0, 1], [len(a), len(b)]))
    e = probminhash._mix(e + np.uint64(99))
    sig = probminhash.signatures(e, w, o, 2, 6000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(similarity(a, b, "count"), abs=0.02)


def test_bounds_by_shares_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = ({int(x): int(rng.integers(1, 9)) for x in rng.choice(12, rng.integers(1, 12), replace=False)} for _ in range(2))
        p, q = sum(a.values()), sum(b.values())
        assert similarity(a, b, "count") <= sum(min(a.get(x, 0) / p, b.get(x, 0) / q) for x in a) + 1e-12


def test_bands_follow_from_the_threshold():
    assert probminhash.bands_for(0.8) == (32, 6)
    for t in (0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0):
        bands, rows = probminhash.bands_for(t)
        assert bands * rows <= 192 and (1 - t**rows) ** bands <= 1e-3
    for bad in (0, 1.1, 0.01):
        with pytest.raises(ValueError):
            probminhash.bands_for(bad)


def test_arguments_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="weights"):
        probminhash.near_duplicates(df, weights="two")
    with pytest.raises(ValueError, match="neither"):
        probminhash.near_duplicates(df, bands=5)
