"""Near-duplicates among texts that share a template, against all pairs."""

import random

import pytest

from contrail.llm import neardup


def components(texts, shingle=4):
    sets = {i: {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} for i, t in texts.items() if (w := t.split())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}, links


def family(rng, name, n, words, own, cuts):
    """n texts of a template with words of their own at the end, and beginnings of the template."""
    base = [f"{name}{k}" for k in range(words)]
    texts = [" ".join([*base[: words - rng.choice((0, 0, 1, 3))], *[f"{name}o{i}w{k}" for k in range(rng.choice(own))]]) for i in range(n)]
    return texts + [" ".join(base[: words - c]) for c in cuts]


@pytest.mark.parametrize("own", [13, 14, 16])
def test_members_linked_to_another_text_alone(spark, own):
    base = [f"b{k}" for k in range(103)]
    texts = {i: " ".join([*base, *[f"o{i}w{k}" for k in range(own)]]) for i in range(30)} | {30: " ".join(base[:102])}
    want, _ = components(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and set(want.values()) == {0}


def test_families_of_templates(spark):
    rng = random.Random(11)
    texts = []
    for f in range(6):
        texts += family(rng, f"f{f}t", 40, rng.choice((60, 103, 150)), rng.choice(((14,), (6, 12, 20), (25, 30))), rng.sample(range(1, 12), 4))
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    want, links = components(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4, percent=80).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert links > 500 and 6 < len(set(want.values())) < 150
    assert got == want
