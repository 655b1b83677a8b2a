"""Mixture-controlled packing (operator 3).

Every source is a queue of tokens. Deficit round-robin fills windows of WINDOW sequences: per window, each source earns its
share of the window in tokens, what it could not serve carries over as a deficit, and it serves whole quanta (MIN_RUN
tokens) of what it has earned. With weights, a source that runs dry leaves its share to the others: the run falls into
phases, one for each source that ends, with fixed shares in each. Without weights the shares are the sources' own sizes,
so all queues end together and every window has the corpus's proportions.

Served amounts are a closed form of the window's number, so no partition waits for another: a document's first token has a
place in its source's queue (a prefix sum over partitions), the place says in which window and where in the stream each of
its tokens falls, and the stream is cut every SEQUENCE tokens. Deficits thereby carry across windows and partitions. The
last, incomplete sequence is cut into powers of two, which need no padding.

Null texts are empty: one end id. Null sources are one queue, the last one. Repeated rows are documents of their own. An
empty table packs to no sequence. Extra columns are dropped, but for the id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise
from ._text import Words, distinct, steps

SEQUENCE, WINDOW, MIN_RUN, END_ID = 2048, 32, 64, 1
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
TOKENS = "doc_id bigint, source string, part string, place bigint, n bigint, ids binary"
#: Words whose ids a Python worker remembers over all of its tasks; beyond it, those not met again are dropped.
REMEMBERED, STEP = 400_000, 2 << 20
#: Control characters; the first that is a token of its own tells the words of a block apart.
SEPARATORS = "\x01\x02\x03\x04\x05\x06\x07\x0e\x0f"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so each word is encoded once.

    Memory is bounded: the ids of at most REMEMBERED words, sorted by hash, and one step of text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.tokenizer, self.remembered = _tokenizer(path), remembered
        self.mark, self.mark_id = None, -1
        plain = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for c in SEPARATORS:
            ids = plain(c)
            if len(ids) == 1 and plain(f"a {c} b") == [*plain("a"), *ids, *plain("b")]:
                self.mark, self.mark_id = f" {c} ", ids[0]
                break
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        tokens = self.tokenizer.get_vocab() if suffix else {}
        self.last = np.zeros(max(tokens.values(), default=-1) + 1, bool)  # ids that end a piece
        self.last[[k for t, k in tokens.items() if t.endswith(suffix)] if suffix else []] = True
        self.hashes, self.starts, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.again, self.flat = np.empty(0, bool), np.empty(0, np.uint32)

    def _encode(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, ids).

        Words of letters are one piece each; where the model marks the last id of a piece, the marks tell them apart.
        Other words have the separator between them.
        """
        plain = np.array([x.isalpha() for x in names], bool) if len(self.last) else np.zeros(len(names), bool)
        counts, flat = np.zeros(len(names), np.int32), []
        for which, mark in ((plain, " "), (~plain, self.mark)):
            place = np.flatnonzero(which)
            blocks = [place[k : k + 200] for k in range(0, len(place), 200)]
            texts = [[names[k] for k in block] for block in blocks]
            joined = self.tokenizer.encode_batch_fast([mark.join(x) for x in texts], add_special_tokens=False) if mark else [None] * len(blocks)
            for block, text, found in zip(blocks, texts, joined, strict=True):
                ids = np.array(found.ids if found else [], np.uint32)
                if mark == " ":
                    cut = np.flatnonzero(self.last[ids])
                    good, size = len(cut) == len(block) and cut[-1] == len(ids) - 1, np.diff(cut, prepend=-1)
                else:
                    cut = np.flatnonzero(ids == self.mark_id) if found else np.empty(0, np.int64)
                    good, size = found and len(cut) == len(block) - 1, np.diff(np.r_[-1, cut, len(ids)]) - 1
                    ids = ids[ids != self.mark_id] if good else ids
                if not good:  # no separator, or one of the words holds it
                    each = [x.ids for x in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
                    size, ids = np.array([len(x) for x in each]), np.fromiter((y for x in each for y in x), np.uint32)
                counts[block] = size
                flat.append(ids)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        out, starts = np.concatenate([np.empty(0, np.uint32), *flat]), np.empty(len(names), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return counts, out[_ranges(starts, counts)]

    def _learn(self, names: list[str], hashes: np.ndarray) -> None:
        order = np.argsort(hashes)
        counts, flat = self._encode([names[k] for k in order])
        starts = len(self.flat) + np.cumsum(counts) - counts
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.again = np.insert(self.hashes, at, hashes[order]), np.insert(self.again, at, False)
        self.starts, self.counts = np.insert(self.starts, at, starts.astype(np.int32)), np.insert(self.counts, at, counts)
        self.flat = np.concatenate([self.flat, flat])

    def _drop(self) -> None:
        """Keep the words that were met again since they were last kept, or none where these are too many."""
        keep = self.again if self.again.sum() <= self.remembered // 2 else np.zeros(len(self.again), bool)
        self.hashes, starts, self.counts = self.hashes[keep], self.starts[keep], self.counts[keep]
        self.flat = self.flat[_ranges(starts, self.counts)]
        self.starts, self.again = (np.cumsum(self.counts) - self.counts).astype(np.int32), np.zeros(len(self.hashes), bool)

    def _known(self, seen: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.hashes, seen)
        place[place == len(self.hashes)] = 0
        return np.where(self.hashes[place] == seen, place, -1) if len(self.hashes) else np.full(len(seen), -1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, ids of all texts in a row), END_ID after each text's own."""
        words = Words(texts)
        codes, seen, first = distinct(words.hashes())
        place = self._known(seen)
        if (place < 0).sum() + len(self.hashes) > self.remembered:
            self.again[place[place >= 0]] = True
            self._drop()
            place = self._known(seen)
        self.again[place[place >= 0]] = True
        new = place < 0
        if new.any():
            self._learn(_names(words, first[new]), seen[new])
            place = self._known(seen)
        size = self.counts[place][codes]
        start = self.starts[place][codes]
        of_text = np.diff(np.r_[0, np.cumsum(size, dtype=np.int64)][words.offsets]) + 1
        out = np.full(int(of_text.sum()), END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(of_text) - 1] = False
        out[body] = self.flat[_ranges(start, size)]
        return of_text, out


def _names(words: Words, places: np.ndarray) -> list[str]:
    """The words at places, by one split of their bytes; no word holds a line end."""
    size = words.end[places] - words.start[places] + 1
    out = np.full(int(size.sum()), 10, np.uint8)
    at = np.cumsum(size) - size
    inner = _ranges(np.zeros(len(size), np.int64), size - 1)
    out[np.repeat(at, size - 1) + inner] = words.data[np.repeat(words.start[places], size - 1) + inner]
    return out.tobytes().decode("utf-8", "replace").split("\n")[:-1]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(counts, dtype=np.int64)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - counts), counts)
    return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, queues = _encoder(path), {}
        for batch in steps(batches, limit=STEP):
            counts, ids = encoder(batch.column("text"))
            ids = ids.astype(np.uint16) if len(ids) and ids.max() < 65536 else ids
            cuts, width = np.r_[0, np.cumsum(counts)], ids.dtype.itemsize
            place, parts = np.empty(len(counts), np.int64), batch.column("part").to_pylist()
            for i, queue in enumerate(zip(parts, batch.column("source").to_pylist(), strict=True)):
                place[i] = queues.get(queue, 0)
                queues[queue] = int(place[i] + counts[i])
            data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((cuts * width).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
            columns = [batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(place), pa.array(counts.astype(np.int64)), data.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "place", "n", "ids"])

    return run


def tokenised(docs: DataFrame, tokenizer: str, part: Column | None = None) -> DataFrame:
    """(doc_id, source, part, place, n, ids): ids of each document, and its place in its source's queue of the part.

    part: text that orders the queues; rows of one part stand in one task, in the order in which they are served (None:
    the tasks' numbers). Rows of one file split are such a part.
    """
    part = F.lpad(F.spark_partition_id().cast("string"), 10, "0") if part is None else part
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", part.alias("part"))
    return rows.mapInArrow(_encode(tokenizer), TOKENS)


@dataclass(frozen=True, eq=False)
class Schedule:
    """How the queues are served. sizes: tokens by source; phases: (start in stream, windows, first token and tokens by source)."""

    sizes: tuple[int, ...]
    phases: tuple[tuple[int, int, tuple[int, ...], tuple[int, ...]], ...]
    window: int
    quantum: int

    @staticmethod
    def of(sizes: list[int], weights: list[float] | None = None, window: int = WINDOW * SEQUENCE, quantum: int = MIN_RUN) -> Schedule:
        weights = [float(w) for w in (weights or sizes)]
        left, done, start, phases = list(sizes), [0] * len(sizes), 0, []
        while any(left):
            live = [k for k, x in enumerate(left) if x]
            if weights == [float(x) for x in sizes]:
                take = list(left)
            else:
                pace = {k: max(weights[k], 1e-12) for k in live}
                ends = min(live, key=lambda k: left[k] / pace[k])
                take = [min(left[k], round(left[ends] * pace[k] / pace[ends])) if k in pace else 0 for k in range(len(sizes))]
                take[ends] = left[ends]
            n = sum(take)
            phases.append((start, max(1, -(-n // window)), tuple(done), tuple(take)))
            start, done, left = start + n, [a + b for a, b in zip(done, take, strict=True)], [a - b for a, b in zip(left, take, strict=True)]
        return Schedule(tuple(sizes), tuple(phases), window, quantum)

    @staticmethod
    def along(sizes: list[int], courses: list[Sequence[float]], window: int = WINDOW * SEQUENCE, quantum: int = MIN_RUN) -> Schedule:
        """Shares that change: courses[k] has the part of source k that is served after each of equal steps of the run, from 0 to 1.

        A step is a phase: in it, windows hold the sources in the proportions of what the courses serve there.
        """
        start, done, phases = 0, tuple(0 for _ in sizes), []
        for step in range(1, len(courses[0]) if courses else 0):
            last = step == len(courses[0]) - 1
            upto = tuple(n if last else min(n, max(d, round(n * course[step]))) for n, d, course in zip(sizes, done, courses, strict=True))
            take = tuple(b - a for a, b in zip(done, upto, strict=True))
            if sum(take):
                phases.append((start, max(1, -(-sum(take) // window)), done, take))
                start, done = start + sum(take), upto
        return Schedule(tuple(sizes), tuple(phases), window, quantum)

    def served(self, phase: int, source: int, window: int) -> int:
        """Tokens that the source has served in the phase when the window (0 to windows - 1) is full; 0 before window 0."""
        _, windows, _, take = self.phases[phase]
        if window < 0:
            return 0
        if window >= windows - 1:
            return take[source]
        earned = take[source] * (window + 1) * self.window // sum(take)
        return min(take[source], earned // self.quantum * self.quantum)

    def first_window(self, phase: int, source: int, token: int) -> int:
        """The window that serves the source's token of the phase."""
        _, windows, _, take = self.phases[phase]
        need = (token // self.quantum + 1) * self.quantum
        if need > take[source]:
            return windows - 1
        return min(windows - 1, -(-need * sum(take) // (take[source] * self.window)) - 1)

    def runs(self, source: int, start: int, length: int) -> Iterator[tuple[int, int]]:
        """(stream place, tokens) of the runs that hold tokens start to start + length of the source's queue."""
        end = start + length
        for k, (at, _, done, take) in enumerate(self.phases):
            token, stop = max(start, done[source]) - done[source], min(end, done[source] + take[source]) - done[source]
            while token < stop:
                window = self.first_window(k, source, token)
                before, after = self._bounds(k, window)
                upto = min(stop, after[source])
                place = at + sum(before) + sum(after[:source]) - sum(before[:source]) + token - before[source]
                yield place, upto - token
                token = upto

    @lru_cache(maxsize=64)  # noqa: B019
    def _bounds(self, phase: int, window: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        every = range(len(self.sizes))
        return tuple(self.served(phase, s, window - 1) for s in every), tuple(self.served(phase, s, window) for s in every)


def sequence_of(place: int, total: int, size: int = SEQUENCE) -> tuple[int, int, int]:
    """(sequence, offset in it, tokens to its end) of a place in a stream of total tokens."""
    full = total // size
    if place < full * size:
        return place // size, place % size, size - place % size
    number, at, rest = full, full * size, total - full * size
    while True:
        piece = 1 << (rest.bit_length() - 1)
        if place < at + piece:
            return number, place - at, at + piece - place
        number, at, rest = number + 1, at + piece, rest - piece


def _cut(schedule: Schedule, number: Mapping, size: int):
    total = sum(schedule.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc, source, start, n, ids in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source", "queued", "n", "ids")), strict=True):
                width, at = len(ids) // n, 0
                data = np.frombuffer(ids, np.uint16 if width == 2 else np.uint32).astype("<u4").tobytes()
                for place, run_length in schedule.runs(number[source], start, n):
                    while run_length:
                        sequence, offset, room = sequence_of(place, total, size)
                        k = min(room, run_length)
                        found.append((doc, at, k, zlib.crc32(data[4 * at : 4 * (at + k)]), n, sequence, offset))
                        at, place, run_length = at + k, place + k, run_length - k
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, weights: Mapping[str | None, float] | None = None, size: int = SEQUENCE, window: int = WINDOW, quantum: int = MIN_RUN, part: Column | None = None, repeating: Sequence[float] = (), courses: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Pieces of all documents (doc_id, source, text) in sequences of at most size tokens.

    weights: the sources' shares while they last (None: their own sizes); repeating: shares for the sources in code-point
    order, null last, over and over; courses: in that order, over and over, what part of a source is served as the run goes
    on (Schedule.along). The driver holds one number for each source.
    """
    tokens = materialise(tokenised(docs, tokenizer, part), "packing-tokens")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals, key=lambda x: (x is None, (x or "").encode()))
    if repeating:
        weights = {x: repeating[k % len(repeating)] for k, x in enumerate(names)}
    sizes = [totals[x] for x in names]
    schedule = Schedule.along(sizes, [courses[k % len(courses)] for k in range(len(names))], window * size, quantum) if courses else None
    schedule = schedule or Schedule.of([totals[x] for x in names], [weights.get(x, 0.0) for x in names] if weights else None, window * size, quantum)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), before.alias("_before"))
    placed = tokens.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    placed = placed.select("doc_id", "source", (F.col("_before") + F.col("place")).alias("queued"), "n", "ids")
    return placed.mapInArrow(_cut(schedule, {x: k for k, x in enumerate(names)}, size), PIECE)
