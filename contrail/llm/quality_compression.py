"""Quality classifier by compression (operator 1).

Two Zstandard dictionaries are built, from good and from bad labelled texts. A text is cut into pieces of PIECE bytes, so
that no piece learns from the one before it, and every piece is compressed with either dictionary; the difference of the
two sums of sizes over the larger one says which kind the whole text resembles. A logistic fit of this difference alone, on
labelled texts that built no dictionary, turns it into a probability of "good".

Very long texts are compressed whole, piece by piece. There are no ties: every text has its own score.
Null and empty texts compress to the same size with either dictionary and get the calibrated score of a difference of 0.
Without labels of both kinds there is no dictionary: every score is then the smoothed share of good labels. Repeated rows
get equal scores. Extra columns pass through; a column that has the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import Logistic, class_weights, training_sample
from ._text import text_udf

PER_CLASS, MAX_TEXT_BYTES, DICTIONARY_BYTES, LEVEL, PIECE, TRAINING_PIECE = 2000, 65_536, 262_144, 3, 256, 2048
_COMPRESSORS: dict[bytes, tuple] = {}


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    calibration: Logistic

    def columns(self, texts: list[bytes]) -> np.ndarray:
        """Normalised size difference (bad - good)."""
        key = self.good + self.bad
        if key not in _COMPRESSORS:
            _COMPRESSORS.clear()
            _COMPRESSORS[key] = tuple(_compressor(x) for x in (self.good, self.bad))
        good, bad = _COMPRESSORS[key]
        sizes = np.array([[sum(len(c.compress(x)) for x in pieces(text, PIECE)) for c in (good, bad)] for text in texts], float).reshape(-1, 2)
        return (sizes[:, 1] - sizes[:, 0]) / sizes.max(axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.calibration.prior)
        return self.calibration(self.columns(texts))


class Constant:
    def __init__(self, prior: float) -> None:
        self.prior = prior


def pieces(text: bytes, size: int) -> list[bytes]:
    return [text[k : k + size] for k in range(0, max(len(text), 1), size)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [x for text in texts for x in pieces(text, TRAINING_PIECE)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size].ljust(8, b" ")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_text_bytes: int = MAX_TEXT_BYTES) -> CompressionModel:
    """Learn from a bounded sample of labelled documents outside of fold 0."""
    found = training_sample(docs, labels, label, per_class, max_text_bytes).collect()
    mixed = lambda r: hashlib.md5(str(r["doc_id"]).encode()).digest()  # noqa: E731  an order without neighbours that are alike
    rows = [(r["doc_id"], r["y"], r["text"].encode()) for r in sorted(found, key=mixed)]
    side = {y: [t for _, k, t in rows if k == y] for y in (0, 1)}
    weight = class_weights(labels, label, per_class)
    if min(map(len, side.values())) < 4:
        bad, good = weight * [len(side[0]), len(side[1])]
        return CompressionModel(b"", b"", Constant((good + 1) / (bad + good + 2)))
    build, rest = ({y: x[k::2] for y, x in side.items()} for k in (0, 1))
    model = CompressionModel(dictionary(build[1]), dictionary(build[0]), Constant(0.5))
    y = np.r_[np.zeros(len(rest[0])), np.ones(len(rest[1]))]
    return CompressionModel(model.good, model.bad, Logistic(model.columns(rest[0] + rest[1]), y, weight=weight[y.astype(int)]))


def scored(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that the text is good."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()))

    return docs.withColumn(name, text_udf(score, "double")(F.col(text)))
