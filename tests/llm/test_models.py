"""The language mixture against all sets of languages, and toxicity scores against plain counting and descent."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import language, toxicity


def climb(likely, rounds=4000):
    """Shares by very many rounds of expectation maximisation, and their log likelihood."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(rounds):
        part = likely * share
        share = (part / part.sum(1, keepdims=True)).mean(0)
    return share, float(np.log(likely @ share).sum())


@pytest.mark.parametrize("seed", range(25))
def test_mixture_is_the_best_of_all_sets(seed):
    rng = np.random.default_rng(seed)
    k, n = 4, int(rng.integers(40, 160))
    spoken = rng.choice(k, rng.integers(1, 4), replace=False)
    own = rng.choice(spoken, n)
    # Words are far likelier in their own language, some in two.
    likely = np.exp(-rng.gamma(6, 1, (n, k)))
    likely[np.arange(n), own] = 1
    both = rng.random(n) < 0.1
    likely[both, rng.integers(0, k, both.sum())] = 0.8
    penalty = 0.5 * math.log(n) + 2.0
    scored = []
    for size in range(1, k + 1):
        for chosen in itertools.combinations(range(k), size):
            share, value = climb(likely[:, chosen])
            if share.min() >= language.LEAST_SHARE or size == 1:
                scored.append((value - penalty * (size - 1), chosen, share))
    best = max(scored, key=lambda s: s[0])
    got = language.mixture(likely)
    assert set(np.flatnonzero(got)) == set(best[1]) and abs(got.sum() - 1) < 1e-9
    assert np.abs(got[list(best[1])] - best[2]).max() < 0.01


def test_mixture_of_one_word_and_of_ties():
    assert language.mixture(np.array([[0.2, 0.7, 0.1]])).tolist() == [0, 1, 0]
    assert language.mixture(np.full((9, 3), 0.5)).tolist() == [1, 0, 0]


def test_a_very_long_text_is_one_document():
    model = language.Model(["aa"], np.ones((1 << language.TABLE_BITS, 1)))
    slot, first = language.trigrams("word " * 200_000 + "x" * 50_000)
    assert len(first) == 200_001 and len(slot) == 4 * 200_000 + 50_000 and model.shares("word " * 50_000).tolist() == [1.0]


def test_scores_equal_plain_counting(spark):
    rng = random.Random(12)
    plain = ["table", "window", "garden", "little", "number", "station", "motion", "letter", "harbour"]
    bad = ["blockhead", "nitwit", "scoundrel"]
    rows = []
    for i in range(240):
        toxic = i % 4 == 0
        text = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic or rng.random() < 0.04:
            text.insert(rng.randrange(len(text)), rng.choice([*bad, "bl0ckhead", "n i t w i t"]))
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    scorer = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["id"]: r["score"] for r in toxicity.score_documents(df, scorer).collect()}

    # The character model, counted text by text.
    counts = sum(toxicity.trigram_counts(t) for _, t, _ in rows)
    assert np.array_equal(sum(toxicity.trigram_counts(t) for _, t, _ in rows[::-1]), counts)
    reader = toxicity.Reader(scorer.model)
    words = {i: reader.words(t) for i, t, _ in rows}
    held = {0: Counter(), 1: Counter()}
    for i, _, y in rows:
        held[y].update({f for w in words[i][0] for f in toxicity.features(w)})
    n = Counter(y for _, _, y in rows)
    odds = lambda c, m: math.log((c + 0.5) / (m - c + 0.5))
    weights = {f: w for f, c in held[1].items() if c >= toxicity.LEAST_TOXIC and (w := odds(c, n[1]) - odds(held[0][f], n[0])) >= toxicity.LEAST_WEIGHT}
    assert weights.keys() == scorer.weights.keys() and all(math.isclose(w, scorer.weights[f], rel_tol=1e-9) for f, w in weights.items())

    def told(found):
        return sum(max([weights.get(w, 0.0), *(weights.get(w[:k] + "*", 0.0) for k in toxicity.PREFIXES if len(w) > k)]) for w in found)

    x = np.array([[1.0, math.log1p(s := told(words[i][0])), math.log1p(100 * s / max(words[i][1], 20))] for i, _, _ in rows])
    y = np.array([y for _, _, y in rows], float)
    w = np.zeros(3)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ w))
        w += 0.02 * (x.T @ (y - p) - 1e-2 * w)
    want = 1 / (1 + np.exp(-x @ w))
    assert max(abs(got[i] - p) for (i, _, _), p in zip(rows, want, strict=True)) < 1e-4
