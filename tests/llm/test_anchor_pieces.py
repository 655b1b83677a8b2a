"""Anchors of a chunk are found piece by piece, and are those of each text alone."""

import numpy as np

from contrail.llm import _text, suffix_dedup


def test_anchors_need_no_long_tables(monkeypatch):
    """Tables of powers longer than a step are made anew each time; a chunk of over a step must not ask for them."""
    asked, powers = [], _text.powers
    spy = lambda n, inverse=False: asked.append(n) or powers(n, inverse)
    monkeypatch.setattr(_text, "powers", spy)
    monkeypatch.setattr(suffix_dedup, "powers", spy, raising=False)
    texts = [b"".join(np.random.default_rng(i).choice([b"ab ", b"cde ", b"f ", b"ghij "], 12_000)) for i in range(90)]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts])
    anchors = suffix_dedup.Anchors(data, lengths, np.arange(len(texts)), 50)
    items = suffix_dedup.Items(anchors, np.ones(len(anchors.key), np.uint8), 8)
    assert len(data) > _text.STEP_BYTES and max(asked) <= _text.STEP_BYTES + 1024
    alone = suffix_dedup.Anchors(np.frombuffer(texts[40], np.uint8), lengths[40:41], np.array([40]), 50)
    at = anchors.doc == 40
    assert (anchors.key[at] == alone.key).all() and (anchors.first[at] - lengths[:40].sum() == alone.first).all()
    prefix = _text.prefix_hash(data)
    assert (items.content == _text.range_hash(prefix, items.at, items.at + items.size)).all()
