"""Scores keep the labels' shares where a class is cut to the sample's bound."""

import numpy as np

from contrail.llm import quality_compression, toxicity
from contrail.llm._labels import Logistic


def test_weights_stand_for_rows():
    x, y = np.array([0.1, 0.4, 0.5, 0.9, 0.3, 0.8]), np.array([0.0, 0, 1, 1, 1, 0])
    w = np.where(y == 1, 6, 1)
    often = Logistic(np.repeat(x, w), np.repeat(y, w), ridge=0.0)
    assert np.allclose(Logistic(x, y, ridge=0.0, weight=w)(x), often(x), atol=1e-6)


def test_cut_classes_keep_the_share(spark):
    rows = [(i, "same words in each text", int(i % 10 != 0), int(i % 10 == 0)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    model = quality_compression.fit(docs, labels, per_class=40)
    assert abs(model.score([b"same words in each text"])[0] - 0.9) < 0.03
    assert abs(toxicity.fit(docs, labels, per_class=40).prior - 0.1) < 0.03
