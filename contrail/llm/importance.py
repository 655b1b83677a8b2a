"""Importance resampling towards a target distribution: hashed n-grams, log-ratio weights, Gumbel top-k.

A text is lower-cased (A-Z alone), every run of separators becomes one space, and an overlapped regular expression with
lookarounds at word boundaries gives the spans of its n-grams; the CRC of a span's bytes names its bucket. One scan of the
corpus keeps the buckets of each text, two bytes a feature; counts, weights and the draw work on those.

Nulls and odd rows: a null text has no word; a null id takes part with the noise of an empty id and comes last among equal
scores; repeated rows are documents of their own (equal scores, places one after the other); texts of any length are
scanned whole, one at a time; without rows the result is empty, and without target texts every gain tells only how rare a
bucket is. Columns besides the key and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import numbered
from ._store import materialise
from ._text import steps

SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Features:
    """Runs of least to most words, dealt to buckets by CRC-32."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000

    def patterns(self) -> list[regex.Pattern]:
        """For each length: a run that begins after a space or at the start, and ends before a space or at the end."""
        return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(self.least, self.most + 1)]

    @property
    def kind(self) -> type:
        return np.uint16 if self.buckets <= 1 << 16 else np.uint32


def scan(docs: DataFrame, features: Features = Features(), key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, held): held has the bucket of each feature as little-endian whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, crc = features.patterns(), zlib.crc32
        for batch in steps(batches):
            words, sizes, held = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                plain = SEPARATORS.sub(b" ", (text.as_py() or b"").lower()).strip(b" ")
                found = [np.fromiter((crc(m[0]) for m in p.finditer(plain, overlapped=True)), np.uint32) for p in patterns]
                codes = np.concatenate(found) % np.uint32(features.buckets)
                words.append(plain.count(b" ") + 1 if plain else 0)
                sizes.append(len(codes))
                held.append(codes.astype(features.kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=[key, "n_words", "n_features", "held"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, held binary")


def bucket_counts(scanned: DataFrame, features: Features = Features()) -> DataFrame:
    """(bucket, n): each task counts its rows first and sends a row for each bucket it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for held in batch.column("held"):
                total += np.bincount(np.frombuffer(held.as_py(), features.kind), minlength=features.buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    return scanned.select("held").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, raw: DataFrame, features: Features = Features()) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 * ln) of the ratio of its smoothed shares in target and raw."""
    every = target.sparkSession.range(features.buckets).withColumnRenamed("id", "bucket")
    found = every.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").fillna(0, ["t", "s"])
    whole = found.crossJoin(F.broadcast(found.agg(F.sum("t").alias("all_t"), F.sum("s").alias("all_s"))))  # one row
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + features.buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + features.buckets))
    return whole.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(scanned: DataFrame, gain: np.ndarray, features: Features = Features()) -> DataFrame:
    """scanned with weight, the sum of its features' gains; gain has one whole number a bucket."""

    def weight(held: pa.Array) -> pa.Array:
        return pa.array([int(gain[np.frombuffer(x.as_py(), features.kind)].sum()) for x in held], pa.int64())

    weight.__annotations__ = {"held": pa.Array, "return": pa.Array}
    return scanned.withColumn("weight", F.arrow_udf(weight, "long")("held")).drop("held")


def noise(key: Column, seed: int) -> Column:
    """Keyed Gumbel noise in thousandths, which any engine can repeat."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weights: DataFrame, percent: int, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """weights (with n_words, score) with rank: 1, 2, 3... of the percent highest scores of texts of least_words; else null."""
    fits = F.col("n_words") >= least_words
    placed = numbered(weights, [fits.desc(), F.col("score").desc(), F.col(key).asc_nulls_last()], "draw")
    drawn = placed.filter(fits).count() * percent // 100
    return placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, features: Features = Features(), least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs; target is a table with a column text.

    Only the gains reach the driver: one number for each of the parameter's buckets.
    """
    scanned = materialise(scan(docs, features, key), "importance")
    other = scan(target.select(F.lit(0).alias("item"), "text"), features, "item")
    rows = gains(bucket_counts(other, features), bucket_counts(scanned, features), features).collect()
    gain = np.zeros(features.buckets, np.int64)
    for r in rows:
        gain[r["bucket"]] = r["gain"]
    scored = weighed(scanned, gain, features).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return draw(scored, percent, least_words, key)


def drawn(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, as they are."""
    return docs.join(ranks.filter("rank is not null").select(key), key, "left_semi")
