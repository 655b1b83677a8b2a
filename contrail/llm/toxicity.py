"""Toxicity by nearest labelled examples (operator 5).

Texts are TF-IDF vectors over all words of the labelled examples; document frequencies come from the whole corpus, and a
word that one label has more often than the other weighs more, by the logarithm of the ratio. Words of the examples are
never dropped. The labelled examples, at most per_class of each label, lie in an inverted index whose lists are cut into
blocks of BLOCK examples, with each block's largest weight. Short lists are added up whole. For long ones the block maxima
bound the cosines of a block; only blocks whose bound can beat a text's k-th cosine so far are scored, so the neighbours
are exact. Their votes, weighted by cosine and smoothed by the prior, are calibrated by a logistic fit on the examples
themselves, each without its own vote.

A text without any word of the index (null and empty ones too) has no neighbours: its vote is the prior's. Very long
texts are scored whole. Without labels of both kinds every score is the smoothed share of toxic labels. Cosines are
compared to six digits; ties go to the smaller example id. Repeated rows get equal scores. An empty table gives an empty
result. Extra columns pass through; a column that has the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import Logistic, class_weights, training_sample
from ._store import materialise
from ._text import Words, owners, prefix_hash, range_hash, steps, text_udf

PER_CLASS, MAX_TEXT_BYTES, NEIGHBOURS, BLOCK = 2000, 65_536, 15, 64
#: Examples that must have a word before its labels count; share of the examples from which on a list is a long one;
#: texts that are scored at once.
MIN_EXAMPLES, LONG_LIST, TEXTS, PRIOR_WEIGHT = 3, 0.05, 256, 0.5
DIGITS, ROOM = 1_000_000, 1 << 20
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the words of texts, in lower case and without punctuation at their ends."""
    words = Words(texts, fold=True)
    start, end, of = words.start.copy(), words.end.copy(), owners(words.offsets)
    open_ = np.arange(len(start))
    while len(open_):
        left = _MARK[words.data[start[open_]]]
        start[open_[left]] += 1
        open_ = open_[left]
        open_ = open_[start[open_] < end[open_]]
    open_ = np.flatnonzero(start < end)
    while len(open_):
        right = _MARK[words.data[end[open_] - 1]]
        end[open_[right]] -= 1
        open_ = open_[right]
    keep = start < end
    return of[keep], range_hash(prefix_hash(words.data, True), start[keep], end[keep])


def _counted(owner: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, times) of each pair, sorted."""
    pair, times = np.unique(owner * codes + code, return_counts=True)
    return pair // codes, pair % codes, times


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        owner, hashes = terms(batch.column("text"))
        seen, code = np.unique(hashes, return_inverse=True)
        owner, code, times = _counted(owner, code, max(len(seen), 1))
        cut = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int64))) for x in (seen[code].view(np.int64), times)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int64()), *lists], ["doc_id", "y", "terms", "times"])


def _known_terms(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner, hashes = terms(texts)
    code = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[code] == hashes
    return owner[hit], code[hit]


def _frequencies(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(len(known), np.int64), 0
        for batch in steps(batches):
            _, code, _ = _counted(*_known_terms(batch.column("text"), known), len(known))
            count += np.bincount(code, minlength=len(known))
            rows += batch.num_rows
        place = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"place": np.r_[-1, place].astype(np.int64), "n": np.r_[rows, count[place]].astype(np.int64)})

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Index:
    """Inverted lists of the examples: short ones as postings, long ones as rows of a table with the maxima of its blocks."""

    starts: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # of each term in the table of long lists, or -1
    table: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, examples: int, terms: int) -> Index:
        length = np.bincount(cols, minlength=terms)
        long = length >= LONG_LIST * examples
        row = np.where(long, np.cumsum(long) - 1, -1)
        width = -(-examples // BLOCK) * BLOCK
        table = np.zeros((int(long.sum()), width), np.float32)
        of_long = long[cols]
        table[row[cols[of_long]], rows[of_long]] = weights[of_long]
        rest = np.flatnonzero(~of_long)
        rest = rest[np.argsort(cols[rest], kind="stable")]
        starts = np.r_[0, np.cumsum(np.where(long, 0, length))]
        return Index(starts, rows[rest].astype(np.int32), weights[rest].astype(np.float32), row, table, table.reshape(len(table), -1, BLOCK).max(axis=2))


@dataclass
class ToxicityModel:
    """known: sorted term hashes; factor: their weight; examples: ids, labels and unit vectors as (example, term, weight)."""

    known: np.ndarray
    factor: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    weights: np.ndarray
    calibration: Logistic | None = None
    neighbours: int = NEIGHBOURS
    stands_for: np.ndarray = field(default_factory=lambda: np.ones(2))  # labelled rows for each example of label 0 and 1
    index: Index | None = field(default=None, repr=False, compare=False)

    @property
    def prior(self) -> float:
        clean, toxic = self.stands_for * [(self.labels == 0).sum(), (self.labels == 1).sum()]
        return (toxic + 1) / (clean + toxic + 2)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}

    def lists(self) -> Index:
        if self.index is None:
            self.index = Index.of(self.rows, self.cols, self.weights, len(self.ids), len(self.known))
        return self.index

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, term, weight) of unit vectors, sorted by owner."""
        owner, code, times = _counted(*_known_terms(texts, self.known), len(self.known))
        return owner, code, unit(owner, times, self.factor[code], len(texts))

    def nearest(self, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples), n rows of at most neighbours columns, best first; -1 for no example.

        Scores of one text are keys: its cosine in DIGITS, then the example's place, the smaller the better.
        """
        lists, width, k = self.lists(), self.lists().table.shape[1], self.neighbours
        row = lists.row[code]
        long = row >= 0
        start, size = lists.starts[code[~long]], np.diff(lists.starts)[code[~long]]
        at = _spread(start, size)
        cell = np.repeat(owner[~long], size) * width + lists.example[at]
        short = np.bincount(cell, weights=lists.weight[at] * np.repeat(weight[~long], size), minlength=n * width).reshape(n, -1, BLOCK).astype(np.float32)
        dense = np.zeros((n, len(lists.table)), np.float32)
        dense[owner[long], row[long]] = weight[long]
        bound = short.max(axis=2) + dense @ lists.most
        best = np.zeros((n, k), np.int64)
        done = np.zeros(bound.shape, bool)

        def score(b: int, who: np.ndarray) -> None:
            done[who, b] = True
            cosine = short[who, b] + dense[who] @ lists.table[:, b * BLOCK : (b + 1) * BLOCK]
            keys = np.rint(cosine * DIGITS).astype(np.int64) * ROOM + (ROOM - 1 - np.arange(b * BLOCK, (b + 1) * BLOCK))
            if without is not None:
                mine = without[who] - b * BLOCK
                inside = np.flatnonzero((mine >= 0) & (mine < BLOCK))
                keys[inside, mine[inside]] = 0
            keys[keys < ROOM] = 0
            best[who] = np.partition(np.hstack([best[who], keys]), BLOCK, axis=1)[:, BLOCK:]

        first = bound.argmax(axis=1)
        for b in range(bound.shape[1]):
            who = np.flatnonzero(first == b)
            if len(who):
                score(b, who)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            least = best.min(axis=1)
            who = np.flatnonzero(~done[:, b] & (bound[:, b] > 0) & ((bound[:, b] + 1e-5) * DIGITS >= least // ROOM))
            if len(who):
                score(b, who)
        best = -np.sort(-best, axis=1)
        return best // ROOM / DIGITS, np.where(best > 0, ROOM - 1 - best % ROOM, -1)

    def votes(self, cosine: np.ndarray, who: np.ndarray) -> np.ndarray:
        toxic = np.where(who >= 0, self.labels[who] if len(self.labels) else 0, 0)
        return ((cosine * toxic).sum(axis=1) + PRIOR_WEIGHT * self.prior) / (cosine.sum(axis=1) + PRIOR_WEIGHT)

    def look_up(self, texts: pa.Array, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(votes, neighbours, cosines) of texts; without: an example for each text that is none of its neighbours."""
        found = []
        for a in range(0, len(texts) if len(self.known) else 0, TEXTS):
            part = texts.slice(a, TEXTS)
            cosine, who = self.nearest(*self.vectors(part), len(part), None if without is None else without[a : a + TEXTS])
            found.append((self.votes(cosine, who), who, cosine))
        if not found:
            return np.full(len(texts), self.prior), np.full((len(texts), 1), -1), np.zeros((len(texts), 1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def score(self, votes: np.ndarray) -> np.ndarray:
        return self.calibration(votes) if self.calibration else votes


def unit(owner: np.ndarray, times: np.ndarray, factor: np.ndarray, n: int) -> np.ndarray:
    weight = (1 + np.log(times)) * factor
    return weight / np.maximum(np.sqrt(np.bincount(owner, weights=weight**2, minlength=n)), 1e-12)[owner]


def _alike(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Order of the examples by their main direction over the long lists, so that a block holds examples that are alike."""
    index = Index.of(rows, cols, weights, n, int(cols.max()) + 1 if len(cols) else 1)
    table = index.table[:, :n] - index.table[:, :n].mean(axis=1, keepdims=True)
    side = np.cos(np.arange(len(table)))
    for _ in range(20):
        side = table @ (side @ table)
        side /= np.abs(side).max() + 1e-12 if len(side) else 1
    return np.argsort(np.round(side @ table, 6), kind="stable")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_text_bytes: int = MAX_TEXT_BYTES, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Learn from a bounded sample of labelled documents outside of fold 0; document frequencies count all of docs.

    The driver holds the sample's words: at most 2 * per_class * max_text_bytes bytes of text whatever the corpus.
    """
    sample = materialise(training_sample(docs, labels, label, per_class, max_text_bytes), "toxicity-sample")
    found = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "y").mapInArrow(_example_terms, "doc_id bigint, y bigint, terms array<bigint>, times array<bigint>")
    found = found.toArrow().sort_by("doc_id").combine_chunks()
    ids, y = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "y"))
    n, none, weight = len(ids), np.empty(0, np.int64), class_weights(labels, label, per_class)
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in found.column(c).chunks] or [none]).astype(np.int64)
    rows = np.repeat(np.arange(n), found.column("terms").combine_chunks().value_lengths().to_numpy().astype(np.int64)) if n else none
    known, cols = np.unique(flat("terms").view(np.uint64), return_inverse=True)
    if not 0 < y.sum() < n or not len(known):
        return ToxicityModel(none.astype(np.uint64), none, none, y.astype(float), none, none, none, stands_for=weight)
    seen = docs.select("text").mapInArrow(_frequencies(known), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, count = seen.column("place").to_numpy(), seen.column("n").to_numpy()
    df, total = np.zeros(len(known)), count[place < 0].sum()
    df[place[place >= 0]] = count[place >= 0]
    has = np.stack([np.bincount(cols[y[rows] == k], minlength=len(known)) for k in (0, 1)])
    share = (has + 0.5) / (np.array([(y == 0).sum(), y.sum()]) + 1)[:, None]
    told = np.where(has.sum(axis=0) >= MIN_EXAMPLES, np.abs(np.log(share[1] / share[0])), 0)
    factor = (np.log((1 + total) / (1 + df)) + 1) * (1 + told)
    weights = unit(rows, flat("times"), factor[cols], n)

    order = _alike(rows, cols, weights, n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    again = np.argsort(place[rows], kind="stable")
    model = ToxicityModel(known, factor, ids[order], y[order].astype(float), place[rows][again].astype(np.int32), cols[again].astype(np.int32), weights[again].astype(np.float32), neighbours=neighbours, stands_for=weight)
    place = {int(x): k for k, x in enumerate(model.ids)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            own = np.array([place[x] for x in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"place": own, "vote": model.look_up(batch.column("text"), own)[0]})

    told = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(vote, "place bigint, vote double").toArrow()
    votes = np.empty(n)
    votes[told.column("place").to_numpy()] = told.column("vote").to_numpy()
    model.calibration = Logistic(votes, model.labels, weight=weight[model.labels.astype(int)])
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score and evidence, the nearest examples with their labels and cosines."""

    def run(texts: pa.Array) -> pa.Array:
        votes, who, cosines = model.look_up(texts)
        held = who >= 0
        cut, flat = np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32), who[held]
        pairs = pa.StructArray.from_arrays([pa.array(model.ids[flat].astype(np.int64)), pa.array(model.labels[flat].astype(np.int32)), pa.array(cosines[held])], ["doc_id", "label", "cosine"])
        return pa.StructArray.from_arrays([pa.array(model.score(votes)), pa.ListArray.from_arrays(pa.array(cut), pairs)], ["score", "evidence"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "evidence")]
    column = text_udf(run, "struct<score:double,evidence:array<struct<doc_id:bigint,label:int,cosine:double>>>")
    return docs.select(*kept, column(F.col(text)).alias("_found")).select(*kept, "_found.*")
