"""Lines that repeat across documents, found with two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen again. Both are cut into shards by the upper
bits of the hash: each shard is filled by the one task that gets its hashes (eight bytes a line, lines of a step of
texts counted first), so filling them takes the same memory at every size. Lines in the second filter are suspects; they
alone go through a shuffle, as whole texts, where exact counts and the choice of the document that keeps the line are made.

A key is a line without white space (0x20, 0x09-0x0D) at its ends and with A-Z lower-cased. Every row is a document of its
own; rows that share the id that keeps a line all keep it. Rows without an id are left as they are and do not count. A null
or empty text is one empty line and comes back empty. All lines with a repeated key go, however often one document has
them. A text is worked on whole, with about thirty bytes of memory a byte of the longest. Columns other than the text are
passed on; n_lines, n_dropped and kept_sha256 are replaced if docs has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import materialise
from ._text import _WHITE, owners, prefix_hash, range_hash, steps, text_bytes

SHARD_BITS = 1 << 16
PROBES = 6
BITS_PER_KEY = 12
LEAST_SHARDS = 256
#: Of the second filter, which every task gets. Beyond the keys that this serves well, more lines are suspects, none fewer.
FILTER_BYTES = 64 << 20
#: Of the repeated lines that every task gets at the end; where there are more, they are joined by document.
BROADCAST_BYTES = 32 << 20


class Lines:
    """The lines of some texts: line k has the key data[start[k]:end[k]]; offsets[i] to offsets[i + 1] are text i's."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, bounds = text_bytes(texts)
        breaks = np.flatnonzero(self.data == 10)
        self.offsets = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, bounds)) + 1)])
        self.first = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        self.last = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
        solid = np.flatnonzero(~_WHITE[self.data])
        lo, hi = np.searchsorted(solid, self.first), np.searchsorted(solid, self.last)
        solid, some = np.append(solid, 0), hi > lo
        self.start = np.where(some, solid[np.where(some, lo, 0)], self.first)
        self.end = np.where(some, solid[np.where(some, hi - 1, 0)] + 1, self.first)

    def long_ones(self, least: int) -> np.ndarray:
        """Numbers of the lines whose keys have so many code points."""
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return np.flatnonzero(points[self.end] - points[self.start] >= least)

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return range_hash(prefix_hash(self.data, fold=True), self.start[which], self.end[which])

    def key(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes().lower()

    def whole(self, k: int) -> bytes:
        return self.data[self.first[k] : self.last[k]].tobytes()


def probes(hashes: np.ndarray) -> np.ndarray:
    """PROBES places within a shard for each hash, from its lower bits."""
    at, by = hashes & np.uint64(0xFFFF), (hashes >> np.uint64(16)) | np.uint64(1)
    return np.stack([(at + np.uint64(k) * by) % np.uint64(SHARD_BITS) for k in range(PROBES)]).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the upper bits; shards is a power of two and at most 2**32."""
    return (hashes >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)


class Pair:
    """The two filters of one shard while it is filled."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        at = probes(values)
        self.twice[at[:, self.once[at].all(axis=0) | (counts > 1)]] = True
        self.once[at] = True


def line_hashes(docs: DataFrame, least_chars: int, key: str) -> DataFrame:
    """(hash): of each key once for every step of texts, twice where several documents of the step have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lines = Lines(batch.column("text"))
            which = lines.long_ones(least_chars)
            hashes, owner = lines.hashes(which), owners(lines.offsets)[which]
            by = np.lexsort((owner, hashes))
            hashes, owner = hashes[by], owner[by]
            new = np.ones(len(by), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            values, counts = np.unique(hashes[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(values, np.minimum(counts, 2)).view(np.int64))], names=["hash"])

    return docs.filter(F.col(key).isNotNull()).select("text").mapInArrow(run, "hash long")


def seen_again(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, bits): the second filter of each shard that has hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, Pair] = {}
        for batch in batches:
            values = np.sort(np.asarray(batch.column("hash")).view(np.uint64))
            shard = shard_of(values, shards)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for part in np.split(values, cuts) if len(values) else []:
                pairs.setdefault(int(shard_of(part[:1], shards)[0]), Pair()).add(part)
        for k, pair in pairs.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(pair.twice, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

    bits = (shards - 1).bit_length()
    dealt = hashes.repartition(F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0))
    return dealt.mapInArrow(run, "shard long, bits binary")


def second_filter(hashes: DataFrame) -> np.ndarray:
    """Bytes of the second filter, a row for each shard: as many shards as the lines ask for, at most FILTER_BYTES."""
    wanted = max(LEAST_SHARDS, hashes.count() * BITS_PER_KEY // SHARD_BITS)
    shards = min(1 << (wanted - 1).bit_length(), FILTER_BYTES * 8 // SHARD_BITS)
    out = np.zeros((shards, SHARD_BITS // 8), np.uint8)
    for r in seen_again(hashes, shards).toLocalIterator():
        out[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspected(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the second filter has."""
    shard, out = shard_of(hashes, len(bits)), np.ones(len(hashes), bool)
    for at in probes(hashes):
        out &= (bits[shard, at >> 3] >> (at & 7)) & 1 == 1
    return out


def suspects(docs: DataFrame, bits: np.ndarray, least_chars: int, key: str) -> DataFrame:
    """(line, key): each suspected line's key once for every document."""
    filters = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lines = Lines(batch.column("text"))
            which = lines.long_ones(least_chars)
            which = which[suspected(lines.hashes(which), filters.value)]
            found = dict.fromkeys(zip(owners(lines.offsets)[which].tolist(), map(lines.key, which.tolist()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.binary()).cast(pa.string()), batch.column(key).take(pa.array([i for i, _ in found], pa.int64()))], names=["line", key])

    kind = docs.schema[key].dataType.simpleString()
    return docs.filter(F.col(key).isNotNull()).select(key, "text").mapInArrow(run, f"line string, `{key}` {kind}")


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id") -> DataFrame:
    """(line, keeper): keys that least_docs documents hold (two or more), and the largest id among them."""
    if least_docs < 2:
        raise ValueError("a line repeats in two documents at least")
    hashes = materialise(line_hashes(docs, least_chars, key), "line-hashes")
    found = suspects(docs, second_filter(hashes), least_chars, key)
    counted = found.groupBy("line").agg(F.count("*").alias("docs"), F.max(key).alias("keeper"))
    return materialise(counted.filter(F.col("docs") >= least_docs).select("line", "keeper"), "repeated-lines")


def without(texts: pa.Array, goes, least_chars: int, known: np.ndarray | None = None) -> tuple[list[bytes], list[int], list[int]]:
    """(text that is left, lines, lines dropped) of each text; goes(text's number, key) tells what to drop.

    known: sorted hashes of all keys that may go, if there is such a list.
    """
    lines = Lines(texts)
    which = lines.long_ones(least_chars)
    if known is not None:
        hashes = lines.hashes(which)
        at = np.searchsorted(known, hashes)
        which = which[known[np.minimum(at, len(known) - 1)] == hashes] if len(known) else which[:0]
    owner, gone = owners(lines.offsets), {}
    for k in which.tolist():
        if goes(int(owner[k]), lines.key(k)):
            gone.setdefault(int(owner[k]), set()).add(k)
    left = []
    for i, (a, b) in enumerate(zip(lines.offsets[:-1].tolist(), lines.offsets[1:].tolist(), strict=True)):
        if i in gone:
            left.append(b"\n".join(lines.whole(k) for k in range(a, b) if k not in gone[i]))
        else:
            left.append(lines.data[lines.first[a] : lines.last[b - 1]].tobytes())
    return left, np.diff(lines.offsets).tolist(), [len(gone.get(i, ())) for i in range(len(left))]


OUT = ("n_lines", "n_dropped", "kept_sha256")


def _swept(docs: DataFrame, make, least_chars: int, more: str | None = None) -> DataFrame:
    """docs with what is left of each text; make(batch) gives goes and known for without(). more: a column to leave out."""
    kept = [f for f in docs.schema.fields if f.name not in (*OUT, more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            goes, known = make(batch)
            left, lines, dropped = without(batch.column("text"), goes, least_chars, known)
            columns = {f.name: batch.column(f.name) for f in kept} | {"text": pa.array(left, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    schema = StructType([*kept]).add("n_lines", "long").add("n_dropped", "long")
    return docs.select(*[f"`{f.name}`" for f in kept], *([more] if more else [])).mapInArrow(run, schema).withColumn("kept_sha256", F.sha2("text", 256))


def drop_repeated(docs: DataFrame, repeated: DataFrame, least_chars: int = 20, key: str = "doc_id") -> DataFrame:
    """docs with the lines of repeated (line, keeper) taken out of all documents but the keeper's.

    Where the lines are few enough they go to every task; else the lines of each document are joined to it.
    """
    size = repeated.agg(F.coalesce(F.sum(F.octet_length("line") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        rows = repeated.toArrow()
        table = pa.concat_arrays([*rows["line"].chunks, pa.array([], rows["line"].type)])
        data, bounds = text_bytes(table)
        hashes = np.sort(range_hash(prefix_hash(data), bounds[:-1], bounds[1:]))
        keepers = dict(zip((x.encode() for x in table.to_pylist()), rows["keeper"].to_pylist(), strict=True))
        shared = docs.sparkSession.sparkContext.broadcast((keepers, hashes))

        def from_all(batch: pa.RecordBatch):
            ids, (keeper_of, known) = batch.column(key).to_pylist(), shared.value
            return (lambda i, line: ids[i] is not None and keeper_of.get(line, ids[i]) != ids[i]), known

        return _swept(docs, from_all, least_chars)
    here = _lines_of(docs, key, least_chars).join(repeated, "line").filter(F.col(key) != F.col("keeper"))
    more = next(c for c in ("_lines" + "_" * n for n in range(len(docs.columns) + 1)) if c not in docs.columns)
    lists = here.groupBy(key).agg(F.collect_set("line").alias(more))
    joined = docs.join(lists, key, "left")

    def from_row(batch: pa.RecordBatch):
        lists = [{x.encode() for x in row or ()} for row in batch.column(more).to_pylist()]
        return (lambda i, line: line in lists[i]), None

    return _swept(joined, from_row, least_chars, more)


def _lines_of(docs: DataFrame, key: str, least_chars: int) -> DataFrame:
    """(line, key) of all long lines; for corpora whose repeated lines do not fit into every task."""
    every = np.full((1, SHARD_BITS // 8), 255, np.uint8)
    return suspects(docs, every, least_chars, key)


def deduplicated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id") -> DataFrame:
    """docs with text = the lines that stay, n_lines, n_dropped and kept_sha256."""
    return drop_repeated(docs, repeated_lines(docs, least_chars, least_docs, key), least_chars, key)
