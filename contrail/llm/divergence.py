"""How the sources of a language differ in their words: chi-square-like sums over all terms, exact to the unit.

The terms that a language keeps are numbered by falling frequency and cut into blocks of 512. Within a block each source
has a bitset of terms for each count that occurs; the AND of two bitsets and its popcount give the number of terms that two
sources have with these two counts, and one evaluation of f for such a cell stands for all of them. Terms that a source
does not have are the complement of all its bitsets. Frequent terms, which differ in their counts, share few blocks, so
nearly all blocks have few counts.

Null text, lang and source are empty strings; every row is a document of its own, repeated rows too; texts of any length
are read whole; groups without terms and languages without kept terms have pairs of value 0; equal values are ordered by
item; without rows the result is empty. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._order import laid_out
from ._store import materialise
from ._text import Words, owners, steps

STEP_BYTES = 8 << 20
BLOCK = 512
WORDS_OF_BLOCK = BLOCK // 64
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text's number, term's number) of each word, and the terms: runs of letters and of bytes from 0x80, A-Z lower-cased."""
    words = Words(texts, between=_BETWEEN)
    data = words.data[~_BETWEEN[words.data]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = flat.dictionary_encode()
    return owners(words.offsets), np.asarray(coded.indices).astype(np.int64), coded.dictionary


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP_BYTES):
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
            of_text = np.array([number[g] for g in groups], np.int64)
            owner, code, terms = terms_of(batch.column("text"))
            size = max(len(terms), 1)
            pair, n = np.unique(of_text[owner] * size + code, return_counts=True)
            once = np.unique(owner * size + code)
            holders = np.unique(of_text[once // size] * size + once % size, return_counts=True)[1]
            names = list(number)
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(pair // size)) for k in (0, 1))
            term = terms.take(pa.array(pair % size)).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(holders, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, size: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (size + smoothing * terms)), in decimals of 38 digits."""
    over = (n + smoothing).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", over, (size + terms * smoothing).cast("decimal(20,0)")) + 1


def _cells(left: tuple, right: tuple) -> tuple[int, int]:
    """Sums of f over the terms of a block, for (left against right, right against left).

    A side is (shares, bitsets), a row for each count; sums stay within 64 bits as f <= max(p, q)**2 and shares add up to
    the scale and the number of terms.
    """
    p, a = left
    q, b = right
    cells = np.zeros((len(p), len(q)), np.int64)
    for k in range(WORDS_OF_BLOCK):
        cells += np.bitwise_count(a[:, None, k] & b[None, :, k])
    i, j = np.nonzero(cells)
    n, square = cells[i, j], (p[i] - q[j]) ** 2
    return int((n * (square // q[j])).sum()), int((n * (square // p[i])).sum())


def _block_sums(levels: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """(lang, source, item, value) from a row a block: levels array<struct<source, n, bits>>, sources, terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str], int] = defaultdict(int)
            for row in batch.to_pylist():
                known = {s["source"]: (s["size"] + smoothing * row["terms"], [], []) for s in row["sources"]}
                for level in row["levels"]:
                    total, shares, bits = known[level["source"]]
                    shares.append(1 + scale * (level["n"] + smoothing) // total)
                    bits.append(level["bits"])
                every = np.bitwise_or.reduce(np.array([level["bits"] for level in row["levels"]], np.int64).view(np.uint64), axis=0)
                sides = {}
                for source, (total, shares, bits) in known.items():
                    held = np.array(bits, np.int64).reshape(-1, WORDS_OF_BLOCK).view(np.uint64)
                    rest = every & ~np.bitwise_or.reduce(held, axis=0) if len(held) else every
                    sides[source] = np.array([*shares, 1 + scale * smoothing // total], np.int64), np.vstack([held, rest[None]])
                names = sorted(sides)
                for i, one in enumerate(names):
                    for other in names[i + 1 :]:
                        there, back = _cells(sides[one], sides[other])
                        sums[row["lang"], one, other] += there
                        sums[row["lang"], other, one] += back
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([*[pa.array([k[x] for k in keys], pa.string()) for x in range(3)], pa.array([sums[k] for k in keys], pa.int64())], names=["lang", "source", "item", "value"])

    return levels.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, smoothing: int = 1, scale: int = 10**9, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one, and its most telling terms.

    The sources of a language are listed in a row of their own: the result has their number squared anyway.
    """
    counts = materialise(term_counts(docs), "term-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    placed = laid_out(totals, [F.col("lang"), F.col("all_n").desc(), F.col("term")], "terms", "at")
    langs = placed.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_size"))
    kept = materialise(counts.drop("docs").join(placed, ["lang", "term"]), "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.fillna(0, ["size", "terms", "lang_size"]), "groups")

    bit = F.pmod("at", F.lit(BLOCK))
    mine = [F.bit_or(F.when(F.floor(bit / 64) == k, F.expr(f"shiftleft(1L, int(pmod(at, 64)))")).otherwise(F.lit(0).cast("long"))) for k in range(WORDS_OF_BLOCK)]
    levels = kept.groupBy("lang", F.floor(F.col("at") / BLOCK).alias("block"), "source", "n").agg(F.array(*mine).alias("bits"))
    blocks = levels.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "n", "bits")).alias("levels"))
    listed = groups.groupBy("lang", "terms").agg(F.collect_list(F.struct("source", "size")).alias("sources"))
    sums = _block_sums(blocks.join(listed, "lang").select("lang", "levels", "sources", "terms"), smoothing, scale)

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))

    terms = kept.join(groups, ["lang", "source"])
    terms = terms.withColumn("p", share(F.col("n"), F.col("size"), F.col("terms"), smoothing, scale)).withColumn("q", share(F.col("all_n"), F.col("lang_size"), F.col("terms"), smoothing, scale))
    terms = terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(out).unionByName(terms.select(out))
