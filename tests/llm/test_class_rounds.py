"""The exchange clustering covers all words of MIN_COUNT, not only the most frequent ones."""

import numpy as np
from pyspark.sql import functions as F

from contrail.llm import class_lm


def test_gains_are_exact():
    rng = np.random.default_rng(1)
    pairs, kind, classes = rng.integers(0, 6, (14, 14)).astype(float), np.r_[0, 1 + np.arange(10) % 3, 4, 5, 6], 3

    def table(kind):
        one = np.eye(7)[kind]
        return one.T @ pairs @ one

    def worth(t):
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    one, at = np.eye(7)[kind], np.arange(1, 12)
    found = class_lm.gains(table(kind), (pairs @ one)[at], (pairs.T @ one)[at], np.diag(pairs)[at], kind[at], classes)
    for i, w in enumerate(at):
        for k in range(1, classes + 1):
            moved = kind.copy()
            moved[w] = k
            assert np.isclose(found[i, k - 1], worth(table(moved)) - worth(table(kind)))


def test_words_beyond_the_frequent_are_clustered(spark):
    rng = np.random.default_rng(2)
    odd, even = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(i, " ".join(w for _ in range(20) for w in (rng.choice(odd), rng.choice(even)))) for i in range(150)]
    corpus = class_lm.count(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), exchange_words=8)
    model = class_lm.fit(corpus, classes=2)
    scores = {r["doc_id"]: r["score"] - r["base_score"] for r in class_lm.scored(corpus, model).collect()}
    assert len(scores) == 150
    assert min(scores.values()) > 40 * 0.25  # taking turns saves a bit a word: log10(2) = 0.30
    assert sorted(model.kind_types[1:3]) == [60, 60]
