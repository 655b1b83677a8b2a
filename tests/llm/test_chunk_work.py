"""What a chunk counts of its words' neighbours, and that it takes no table far larger than that."""

import tracemalloc
import types

import numpy as np
import zstandard

from contrail.llm import class_lm


def test_contexts_count_only_what_moves():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 2**63, 40_000, dtype=np.uint64)[rng.integers(0, 40_000, 300_000)]
    tokens[::100] = class_lm.END
    tokens[-1] = class_lm.END
    codes, words, _ = class_lm.distinct(tokens)
    lengths = np.diff(np.r_[0, 1 + np.flatnonzero(tokens == class_lm.END)]).astype(np.int32)
    train = rng.random(len(lengths)) < 0.8
    train[0] = True
    counts, buckets, classes = np.bincount(codes), 64, 32
    n = classes + 1 + class_lm.BANDS
    row = {"chunk": 5, "train": train.tolist(), "lengths": lengths.tobytes(), "codes": codes.astype(np.int32).tobytes(), "vocabulary": words.tobytes()}
    order = np.argsort(class_lm._bucket(words, buckets), kind="stable")
    held = order[(counts[order] >= class_lm.MIN_COUNT) & (words[order] != class_lm.END)]
    kinds = 1 + (words[held] % np.uint64(classes)).astype(np.uint8)
    said = [(0, 0, zstandard.ZstdCompressor().compress(counts[order].astype(np.int64).tobytes())), (0, 1, kinds.tobytes())]
    kind = np.r_[0, classes + 1 + np.arange(class_lm.BANDS)]
    run = class_lm._contexts(types.SimpleNamespace(buckets=buckets), np.empty(0, np.uint64), kind, n, classes, 3)
    tracemalloc.start()
    rows = list(run(row, said))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()

    of = kind[class_lm._units(words, counts, np.empty(0, np.uint64))]
    of[held] = kinds
    turn = dict(zip(words[held].tolist(), class_lm._takes_turn(words[held], kinds.astype(np.int64), classes, 3).tolist(), strict=True))
    want, own, before = {}, {}, -1
    for i, (c, taught) in enumerate(zip(codes.tolist(), np.repeat(train, lengths).tolist(), strict=True)):
        if taught:
            w = int(words[c])
            if turn.get(w):
                want[w, n + (int(of[before]) if i else 0)] = want.get((w, n + (int(of[before]) if i else 0)), 0) + 1
                own[w] = own.get(w, 0) + (before == c)
            if i and turn.get(v := int(words[before])):
                want[v, int(of[c])] = want.get((v, int(of[c])), 0) + 1
        before = c
    got, selves = {}, {}
    for r in rows:
        w, size = np.frombuffer(r["words"], np.uint64).tolist(), np.frombuffer(r["size"], np.uint16)
        got |= dict(zip(zip(np.repeat(np.array(w, np.uint64), size).tolist(), np.frombuffer(r["cell"], np.uint16).tolist(), strict=True), np.frombuffer(r["times"], np.uint32).tolist(), strict=True))
        selves |= {x: k for x, k in zip(w, np.frombuffer(r["own"], np.uint32).tolist(), strict=True) if k}
    assert got == want and selves == {k: v for k, v in own.items() if v}
    assert peak < 45e6, peak
