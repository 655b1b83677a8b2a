"""Language-model scoring by a class-based n-gram model (operator 9).

Tokens are words in lower case and one end token a text. All words that occur MIN_COUNT times or more in the training
texts are grouped into classes by exchange clustering: each word moves to the class that raises the likelihood of the
class bigrams most. Words seen once or twice are one class of their own. P(word | word before) is
P(class | class before) * P(word | class), both smoothed; the sum of its logarithms scores a text.

How it runs: texts become chunks of word codes with the chunk's own vocabulary. Vocabularies are dealt out by hash, so
that counts of all words are added up in buckets and return to the chunks; no task and no driver holds the corpus
vocabulary. The exchange of the EXCHANGE_WORDS most frequent words on the driver is only the start; then, round by round,
chunks send each clustered word's neighbours by class to its bucket, which picks the word's best class by the table of
class pairs and answers the chunks. The driver sees tables of classes alone.

Null and empty texts are one end token. Without training texts all counts are 0 and scores come from smoothing alone.
Repeated rows count and score as often as they stand. Rows with a null id are rows like others. Extra columns are not
returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise
from ._text import Words, distinct, steps

EXCHANGE_WORDS, CLASSES, BANDS, CHUNK_BYTES, BUCKET_WORDS = 512, 32, 48, 6 << 20, 1_000_000
MIN_COUNT, LEAST_RISE, FEW = 3, 0.005, 16
END = np.uint64(0x656E642D6F662D74)
CHUNK = "chunk bigint, ids array<bigint>, train array<boolean>, lengths binary, codes binary, vocabulary binary, counts binary, n_words bigint"
PAIRS = pa.schema([("part", pa.int64()), ("pairs", pa.binary())])
CONTEXTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(k, pa.binary()) for k in ("words", "kinds", "own", "size", "cell", "times")]])
SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, size = 0, [], 0
    for batch in steps(batches):
        words = Words(batch.column("text"), fold=True)
        n = np.diff(words.offsets)
        tokens = np.full(n.sum() + len(n), END, np.uint64)
        tokens[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)] = words.hashes()
        held.append((batch.column("doc_id"), batch.column("train"), n + 1, tokens))
        size += len(words.data) + 64 * len(n)
        if size >= CHUNK_BYTES:
            yield _chunk(held, number)
            number, held, size = number + 1, [], 0
    if held:
        yield _chunk(held, number)


def _chunk(held: list, number: int) -> pa.RecordBatch:
    ids, train = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
    lengths, tokens = (np.concatenate([x[k] for x in held]) for k in (2, 3))
    codes, vocabulary, _ = distinct(tokens)
    taught = np.repeat(np.asarray(train.fill_null(False)), lengths)
    counts = np.bincount(codes[taught], minlength=len(vocabulary))
    chunk = (TaskContext.get().partitionId() << 24) | number
    row = {"chunk": [chunk], "ids": [ids.to_pylist()], "train": [train.to_pylist()], "lengths": [lengths.astype(np.int32).tobytes()], "codes": [codes.astype(np.int32).tobytes()]}
    row |= {"vocabulary": [vocabulary.tobytes()], "counts": [counts.astype(np.int64).tobytes()], "n_words": [len(vocabulary)]}
    return pa.RecordBatch.from_pydict(row, schema=pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), *[(k, pa.binary()) for k in ("lengths", "codes", "vocabulary", "counts")], ("n_words", pa.int64())]))


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocabulary, counts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "vocabulary", "counts")), strict=True):
                words, counts = np.frombuffer(vocabulary, np.uint64), np.frombuffer(counts, np.int64)
                bucket = _bucket(words, buckets)
                order = _by_bucket(words, buckets)
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                pieces = [order[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"bucket": list(range(buckets)), "chunk": [chunk] * buckets, "words": [words[x].tobytes() for x in pieces], "counts": [counts[x].astype(np.uint32).tobytes() for x in pieces]}, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    return run


def _add_up(top: int):
    """Add up a bucket's counts; a row with chunk -1 sums the bucket up, the others answer the chunks in their own order."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        size = [len(x) // 8 for x in rows["words"]]
        words = np.frombuffer(b"".join(rows["words"]), np.uint64)
        codes, seen, _ = distinct(words)
        total = np.bincount(codes, weights=np.frombuffer(b"".join(rows["counts"]), np.uint32), minlength=len(seen)).astype(np.int64)
        known = total[total > 0]
        order = np.lexsort((seen, -total))[:top]
        bands = _band(known)
        summary = np.concatenate([[len(known), known.sum()], np.bincount(bands, minlength=BANDS), np.bincount(bands, weights=known, minlength=BANDS).astype(np.int64), total[order]]).astype(np.int64)
        ends = np.cumsum(size)
        pack = zstandard.ZstdCompressor(level=1)  # most counts are small
        answers = [pack.compress(total[codes[b - n : b]].tobytes()) for n, b in zip(size, ends, strict=True)]
        bucket = rows["bucket"][0] if rows["bucket"] else 0
        return pa.table({"chunk": pa.array([*rows["chunk"], -1], pa.int64()), "bucket": pa.array([bucket] * (len(size) + 1), pa.int64()), "answer": pa.array([*answers, summary.tobytes()], pa.binary()), "frequent": pa.array([*[None] * len(size), seen[order].tobytes()], pa.binary())})

    return run


def _band(counts: np.ndarray) -> np.ndarray:
    """1 for counts up to 2 (0 as well), then one more for each doubling."""
    return np.clip(np.floor(np.log2(counts + 1.0)).astype(np.int64), 1, BANDS - 1)


def _counts(row: dict, said: list, buckets: int) -> np.ndarray:
    """The corpus's counts of a chunk's vocabulary, from the buckets' answers (bucket, what, answer)."""
    words = np.frombuffer(row["vocabulary"], np.uint64)
    counts = np.empty(len(words), np.int64)
    unpack = zstandard.ZstdDecompressor()
    counts[_by_bucket(words, buckets)] = np.frombuffer(b"".join(unpack.decompress(x) for _, what, x in said if what == 0), np.int64)
    return counts


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.int64) % buckets


def _by_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Places of words in the order of their buckets; numbers of 16 bits are sorted by radix."""
    bucket = _bucket(words, buckets)
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


@dataclass
class Corpus:
    """Chunks, the buckets' answers to them (the corpus's counts), and sums over the vocabulary."""

    chunks: DataFrame
    answers: DataFrame
    buckets: int
    tokens: int
    types: int
    band_types: np.ndarray
    band_tokens: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray


def count(docs: DataFrame, train: Column, exchange_words: int = EXCHANGE_WORDS) -> Corpus:
    """Count all tokens of the rows of docs (doc_id, text) where train holds."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept as they are dealt out, so that no round shuffles the texts' codes
    chunks = rows.mapInArrow(_chunks, CHUNK).repartition(parts, "chunk").persist(StorageLevel.DISK_ONLY)
    buckets = max(64, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    dealt = chunks.select("chunk", "vocabulary", "counts").mapInArrow(_deal(buckets), "bucket bigint, chunk bigint, words binary, counts binary")
    answers = materialise(dealt.groupBy("bucket").applyInArrow(_add_up(exchange_words), "chunk bigint, bucket bigint, answer binary, frequent binary"), "lm-counts")
    sums, words, counts = np.zeros(2 + 2 * BANDS, np.int64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in answers.filter("chunk < 0").select("answer", "frequent").toLocalIterator():
        data = np.frombuffer(r["answer"], np.int64)
        sums = sums + data[: len(sums)]
        words.append(np.frombuffer(r["frequent"], np.uint64))
        counts.append(data[len(sums) :])
        w, c = np.concatenate(words), np.concatenate(counts)
        best = np.lexsort((w, -c))[:exchange_words]
        words, counts = [w[best]], [c[best]]
    w, c = np.concatenate(words), np.concatenate(counts)
    w, c = w[(c > 0) & (w != END)], c[(c > 0) & (w != END)]
    order = np.argsort(w)
    return Corpus(chunks, answers.filter("chunk >= 0").select("chunk", "bucket", F.lit(0).alias("what"), "answer"), buckets, int(sums[1]), int(sums[0]), sums[2 : 2 + BANDS], sums[2 + BANDS :], w[order], c[order])


def _units(words: np.ndarray, counts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 for the end token, 1 + k for frequent word k, then the count bands."""
    unit = 1 + len(frequent) + _band(counts)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        unit = np.where(frequent[place] == words, 1 + place, unit)
    return np.where(words == END, 0, unit)


def _pairs(frequent: np.ndarray, buckets: int, parts: int = 16):
    """Counts of unit pairs in training texts, a band of rows of the table for each part."""
    units = 1 + len(frequent) + BANDS

    def run(row: dict, said: list) -> Iterator[dict]:
        unit = _units(np.frombuffer(row["vocabulary"], np.uint64), _counts(row, said, buckets), frequent)
        for part, x in enumerate(np.array_split(_table(row, unit, units).ravel(), parts)):
            yield {"part": part, "pairs": x.astype(np.uint32).tobytes()}

    return run


def _table(row: dict, unit: np.ndarray, units: int) -> np.ndarray:
    """Counts of pairs of units in a chunk's training texts; unit holds the vocabulary's."""
    pair = unit[np.frombuffer(row["codes"], np.int32)]
    pair[1:] += pair[:-1] * units  # the end of the text before (unit 0) stands before each text
    return np.bincount(pair[_taught(row)], minlength=units * units).reshape(units, units)


def _taught(row: dict) -> np.ndarray:
    """Whether each token of a chunk is of a training text."""
    return np.repeat(np.array(row["train"], bool), np.frombuffer(row["lengths"], np.int32))


def _told(corpus: Corpus, kinds: DataFrame | None, run, schema: pa.Schema, columns: str) -> DataFrame:
    """run(chunk, its answers) over all chunks; an answer is (bucket, what, bytes): what is 0 for counts, 1 for classes."""
    answers = corpus.answers if kinds is None else corpus.answers.unionByName(kinds)

    def both(chunk: pa.Table, said: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        found = sorted(zip(*(said.column(k).to_pylist() for k in ("bucket", "what", "answer")), strict=True), key=lambda x: x[:2])
        return pa.Table.from_pylist(list(run(chunk.to_pylist()[0], found)), schema=schema)

    return corpus.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, columns)


def _sum_pairs(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("pairs").to_pylist())
    return pa.table({"part": [table.column("part")[0].as_py()], "pairs": [total.tobytes()]})


def exchange(pairs: np.ndarray, words: int, classes: int, rounds: int = 10) -> np.ndarray:
    """Class of each unit by exchange clustering; pairs counts units, of which 1 to words may move, the rest stay alone.

    The words start by frequency rank. Each in turn moves to the class with the highest sum of
    N(class, class) log N(class, class) - 2 N(class) log N(class).
    """
    units = len(pairs)
    kind = np.r_[0, np.empty(words, np.int64), classes + 1 + np.arange(units - words - 1)].astype(np.int64)
    rank = np.argsort(-pairs[1 : words + 1].sum(axis=1), kind="stable")
    kind[1 + rank] = 1 + np.arange(words) % classes
    n = classes + units - words
    one = np.zeros((units, n))
    one[np.arange(units), kind] = 1
    table = one.T @ pairs @ one
    xlogx = lambda x: x * np.log(np.maximum(x, 1))

    def change(row: np.ndarray, column: np.ndarray, own: float, sign: int) -> np.ndarray:
        """Gain of adding (sign 1) or taking away (-1) a word with these class contexts, for each class that takes words."""
        k = np.arange(1, classes + 1)
        gain = np.zeros(len(k))
        new_row, new_column = table[k] + sign * row, table[:, k].T + sign * column
        gain += (xlogx(new_row) - xlogx(table[k])).sum(axis=1) + (xlogx(new_column) - xlogx(table[:, k].T)).sum(axis=1)
        old = table[k, k]
        gain += xlogx(old + sign * (row[k] + column[k]) + own) - xlogx(old)
        gain -= xlogx(old + sign * row[k]) + xlogx(old + sign * column[k]) - 2 * xlogx(old)
        for total, add in ((table[k].sum(axis=1), row.sum() + own * (sign > 0)), (table[:, k].sum(axis=0), column.sum() + own * (sign > 0))):
            gain -= xlogx(np.maximum(total + sign * add, 0)) - xlogx(total)
        return gain

    for _ in range(rounds):
        moved = 0
        for word in 1 + rank:
            was = kind[word]
            row, column, own = pairs[word] @ one, pairs[:, word] @ one, pairs[word, word]
            table[was] -= row
            table[:, was] -= column
            table[was, was] += own
            one[word, was] = 0
            row, column = pairs[word] @ one, pairs[:, word] @ one
            best = 1 + int(np.argmax(change(row, column, own, 1)))
            one[word, best] = 1
            table[best] += row
            table[:, best] += column
            table[best, best] += own
            kind[word], moved = best, moved + (best != was)
        if not moved:
            break
    return kind


def _kinds(row: dict, said: list, buckets: int, frequent: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, classes, places of the words that are clustered, by bucket) of a chunk's vocabulary."""
    words, order, unpack = np.frombuffer(row["vocabulary"], np.uint64), _by_bucket(np.frombuffer(row["vocabulary"], np.uint64), buckets), zstandard.ZstdDecompressor()
    counts = np.empty(len(words), np.int64)
    counts[order] = np.frombuffer(b"".join(unpack.decompress(x) for _, what, x in said if what == 0), np.int64)
    clustered = (counts >= MIN_COUNT) & (words != END)
    held = order[clustered[order]]
    told = [x for _, what, x in said if what == 1]
    if not told:
        return counts, kind[_units(words, counts, frequent)], held
    kinds, rest = np.empty(len(words), np.int64), np.flatnonzero(~clustered)
    kinds[rest] = kind[_units(words[rest], counts[rest], frequent)]
    kinds[held] = np.frombuffer(b"".join(told), np.uint8)
    return counts, kinds, held


def _takes_turn(words: np.ndarray, kinds: np.ndarray, classes: int, turn: int) -> np.ndarray:
    """Half of the words, so that no two groups swap for ever, and those without a class."""
    return (kinds > classes) | ((words >> np.uint64(turn % 32)) & np.uint64(1) == turn // 32 % 2)


def _contexts(corpus: Corpus, frequent: np.ndarray, kind: np.ndarray, n: int, classes: int, turn: int):
    """For each bucket a chunk's clustered words with their class; of those whose turn it is also how often they follow
    themselves, and their neighbours' classes."""
    buckets = corpus.buckets

    def run(row: dict, said: list) -> Iterator[dict]:
        _, kinds, held = _kinds(row, said, buckets, frequent, kind)
        words, codes = np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["codes"], np.int32)
        who = np.flatnonzero(_takes_turn(words[held], kinds[held], classes, turn))
        used = np.bincount(kinds, minlength=n) > 0  # cells are counted for the classes that the chunk has
        near, used = (np.cumsum(used) - 1)[kinds], np.flatnonzero(used)
        wide = 2 * len(used)
        line = np.full(len(words), -wide, np.int64)
        line[held[who]] = np.arange(len(who)) * wide
        taught = _taught(row)[1:]
        before, word = codes[:-1][taught], codes[1:][taught]
        place = line[word]
        own = np.bincount(place[(before == word) & (place >= 0)] // wide, minlength=len(who))
        places = [line[before] + near[word], place + near[before] + len(used)]
        if len(codes) and _taught_first(row):
            places.append(line[codes[:1]] + len(used))
        found = np.bincount(np.concatenate([x[x >= 0] for x in places]), minlength=len(who) * wide)
        place = np.flatnonzero(found)
        line, cell = np.divmod(place, wide)
        owner, cell, times = who[line], np.r_[used, used + n][cell].astype(np.uint16), found[place].astype(np.uint32)
        own = np.bincount(who, weights=own, minlength=len(held))
        cut = np.searchsorted(_bucket(words[held], buckets), np.arange(buckets + 1))
        edge, size = np.searchsorted(owner, cut), np.bincount(owner, minlength=len(held)).astype(np.uint16)
        for k, (a, b, c, d) in enumerate(zip(cut, cut[1:], edge, edge[1:], strict=False)):
            yield {"bucket": k, "chunk": row["chunk"], "words": words[held[a:b]].tobytes(), "kinds": kinds[held[a:b]].astype(np.uint8).tobytes(), "own": own[a:b].astype(np.uint32).tobytes(), "size": size[a:b].tobytes(), "cell": cell[c:d].tobytes(), "times": times[c:d].tobytes()}

    return run


def _taught_first(row: dict) -> bool:
    """Whether a chunk's first token is of a training text; the end token stands before it."""
    return bool(np.repeat(np.array(row["train"], bool), np.frombuffer(row["lengths"], np.int32))[0])


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, was: np.ndarray, classes: int) -> np.ndarray:
    """How much the likelihood of the class bigrams table gains by moving each word from was to each of 1 to classes.

    right and left count a word's neighbours by class, own how often it follows itself (counted in both as well).
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    k, each = np.arange(1, classes + 1), np.arange(len(was))
    right, left, own = right.astype(float), left.astype(float), own.astype(float)
    right[each, was] -= own
    left[each, was] -= own
    r, l, own = right[:, k], left[:, k], own[:, None]
    rw, lw = right[each, was][:, None], left[each, was][:, None]
    stay, gain = np.zeros(len(was)), np.zeros((len(was), classes))
    few = np.arange(1, FEW + 1)[:, None, None]
    for near, t, total in ((right, table, table.sum(axis=1)), (left, table.T, table.sum(axis=0))):
        i, j = np.nonzero(near)
        to, c = t[k].T, near[i, j]
        rise = f(to + few) - f(to)  # by count, class beside, class: most counts are small
        part, many = rise[np.minimum(c, FEW).astype(np.int64) - 1, j], np.flatnonzero(c > FEW)
        part[many] = f(to[j[many]] + c[many, None]) - f(to)[j[many]]
        lost = f(t[was[i], j]) - f(t[was[i], j] - c)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        if len(first):
            gain[i[first]] += np.add.reduceat(part, first)
        stay += np.bincount(i, weights=np.where(j == was[i], 0, lost), minlength=len(was))
        n = near.sum(axis=1) + own[:, 0]
        gain -= f(total[k] + n[:, None]) - f(total[k])
        stay -= f(total[was]) - f(total[was] - n)
    same, kk = table[was, was], table[k, k]
    stay += f(same) - f(same - (rw + lw + own)[:, 0])
    gain += f(kk + r + l + own) - f(kk + r) - f(kk + l) + f(kk)
    a, b = table[k][:, was].T, table[was][:, k]  # cells between the class that the word leaves and the one it comes to
    gain += f(a - l + rw) - f(a - l) - f(a + rw) + f(a) + f(b - r + lw) - f(b - r) - f(b + lw) + f(b)
    return np.where(k == was[:, None], 0, gain - stay[:, None])


def _moved(table: np.ndarray, classes: int, turn: int, slice_words: int = 8192):
    """New classes of a bucket's words, answered to the chunks; the row of chunk -1 counts the words of each class."""
    n = len(table)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pydict()
        data = {k: np.frombuffer(b"".join(rows.pop(k)) if k != "words" else b"".join(rows[k]), t) for k, t in (("words", np.uint64), ("kinds", np.uint8), ("own", np.uint32), ("size", np.uint16), ("cell", np.uint16), ("times", np.uint32))}
        codes, seen, first = distinct(data["words"])
        was, own = data["kinds"][first].astype(np.int64), np.bincount(codes, weights=data["own"], minlength=len(seen))
        owner = np.repeat(codes.astype(np.int32), data["size"])
        part = owner // slice_words
        order = np.argsort(part.astype(np.uint16) if len(seen) <= slice_words << 16 else part, kind="stable")
        part, owner, cell, times = part[order], owner[order], data["cell"][order], data["times"][order]
        kind = was.copy()
        for a in range(0, len(seen), slice_words):
            b = min(a + slice_words, len(seen))
            turns = _takes_turn(seen[a:b], was[a:b], classes, turn)
            who = np.flatnonzero(turns)
            if not len(who):
                continue
            line = np.cumsum(turns) - 1
            c, d = np.searchsorted(part, (a // slice_words, a // slice_words + 1))
            of = owner[c:d].astype(np.int64) - a
            held = turns[of]
            near = np.bincount(line[of[held]] * 2 * n + cell[c:d][held], weights=times[c:d][held], minlength=len(who) * 2 * n).reshape(len(who), 2 * n)
            gain = gains(table, near[:, :n], near[:, n:], own[a:b][who], was[a:b][who], classes)
            best = gain.argmax(axis=1)
            go = (was[a:b][who] > classes) | (gain[np.arange(len(who)), best] > 1e-9)
            kind[a + who] = np.where(go, 1 + best, was[a:b][who])
        ends = np.cumsum([len(x) // 8 for x in rows["words"]])
        answers = [kind[codes[b - len(x) // 8 : b]].astype(np.uint8).tobytes() for x, b in zip(rows["words"], ends, strict=True)]
        sums = np.bincount(kind, minlength=n).astype(np.int64).tobytes()
        return pa.table({"chunk": pa.array([*rows["chunk"], -1], pa.int64()), "bucket": pa.array([*rows["bucket"], rows["bucket"][0]], pa.int64()), "what": pa.array([1] * (len(ends) + 1), pa.int32()), "answer": pa.array([*answers, sums], pa.binary())})

    return run


def _class_pairs(corpus: Corpus, kinds: DataFrame | None, frequent: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """Counts of pairs of classes over all training texts."""
    buckets = corpus.buckets

    def run(row: dict, said: list) -> Iterator[dict]:
        yield {"part": row["chunk"] % 64, "pairs": _table(row, _kinds(row, said, buckets, frequent, kind)[1], n).astype(np.uint32).tobytes()}

    parts = _told(corpus, kinds, run, PAIRS, "part bigint, pairs binary").groupBy("part").applyInArrow(_sum_pairs, "part bigint, pairs binary").collect()
    return sum((np.frombuffer(r["pairs"], np.int64) for r in parts), np.zeros(n * n, np.int64)).reshape(n, n).astype(float)


def cluster(corpus: Corpus, kind: np.ndarray, classes: int) -> tuple[DataFrame | None, np.ndarray, np.ndarray]:
    """(classes of the clustered words, pairs of classes, words of each class): the exchange over all words of MIN_COUNT.

    kind is the start: frequent words have classes, the others come to the best one in the first round. In each round
    the tasks move half of the words by the table of the round before; it ends where the table's mutual information
    rises by less than LEAST_RISE of it.
    """
    n = classes + 1 + BANDS
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    worth = lambda t: f(t) + f(t.sum()) - f(t.sum(axis=1)) - f(t.sum(axis=0))
    kinds, table, types = None, _class_pairs(corpus, None, corpus.frequent, kind, n), np.zeros(n)
    if corpus.types == 0:
        return kinds, table, types
    for turn in itertools.count():
        near = _told(corpus, kinds, _contexts(corpus, corpus.frequent, kind, n, classes, turn), CONTEXTS, "bucket bigint, chunk bigint, words binary, kinds binary, own binary, size binary, cell binary, times binary")
        new = materialise(near.groupBy("bucket").applyInArrow(_moved(table, classes, turn), "chunk bigint, bucket bigint, what int, answer binary"), "lm-classes")
        sums = sum((np.frombuffer(r["answer"], np.int64) for r in new.filter("chunk < 0").select("answer").collect()), np.zeros(n, np.int64))
        new = new.filter("chunk >= 0")
        then = _class_pairs(corpus, new, corpus.frequent, kind, n)
        rise = worth(then) - worth(table)
        if turn == 0 or rise > 0:
            kinds, table, types = new, then, sums.astype(float)
        if turn and rise <= LEAST_RISE * worth(table):
            break
    return kinds, table, types


@dataclass
class ClassModel:
    frequent: np.ndarray
    kind: np.ndarray  # class of each unit at the start
    kinds: DataFrame | None  # classes of the clustered words, as answers to the chunks
    transition: np.ndarray  # log10 P(class | class before)
    kind_tokens: np.ndarray
    kind_types: np.ndarray
    tokens: int
    types: int

    def score_chunk(self, row: dict, counts: np.ndarray, kind: np.ndarray) -> dict:
        """Base and model scores of a chunk's texts."""
        codes, lengths = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        emission = np.log10((counts + 0.5) / (self.kind_tokens[kind] + 0.5 * (self.kind_types[kind] + 1)))
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        at = kind[codes]
        score = emission[codes] + self.transition[np.r_[self.kind[0], at[:-1]], at]
        first = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        return {"doc_id": row["ids"], "n_tokens": lengths, "n_known": add((counts > 0)[codes].astype(np.int64)), "base_score": add(base[codes]), "score": add(score)}


def fit(corpus: Corpus, classes: int = CLASSES, inertia: float = 50.0) -> ClassModel:
    """Cluster the frequent words and estimate transitions; inertia: how many tokens the classes' own shares weigh."""
    words = len(corpus.frequent)
    units = 1 + words + BANDS
    parts = _told(corpus, None, _pairs(corpus.frequent, corpus.buckets), PAIRS, "part bigint, pairs binary")
    found = sorted((r["part"], r["pairs"]) for r in parts.groupBy("part").applyInArrow(_sum_pairs, "part bigint, pairs binary").collect())
    pairs = np.frombuffer(b"".join(x for _, x in found), np.int64).reshape(units, units).astype(float) if found else np.zeros((units, units))
    classes = max(1, min(classes, words))
    kind = exchange(pairs, words, classes)
    kinds, table, types = cluster(corpus, kind, classes)
    n = len(table)
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * n)
    transition = np.log10((table + inertia * share) / (table.sum(axis=1, keepdims=True) + inertia))
    types[0] = 1
    rare = kind[1 + words + 1]  # the band of counts under MIN_COUNT
    types[rare] += max(corpus.band_types[1] - (0 < table[:, 0].sum() < MIN_COUNT), 0)
    return ClassModel(corpus.frequent, kind, kinds, transition, table.sum(axis=0), types, corpus.tokens, corpus.types)


def scored(corpus: Corpus, model: ClassModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row counted."""
    kinds, model, buckets = model.kinds, replace(model, kinds=None), corpus.buckets
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(row: dict, said: list) -> Iterator[dict]:
        counts, kind, _ = _kinds(row, said, buckets, model.frequent, model.kind)
        found = model.score_chunk(row, counts, kind)
        yield from (dict(zip(found, x, strict=True)) for x in zip(*found.values(), strict=True))

    return _told(corpus, kinds, run, schema, SCORED)
