"""Removal of repeated passages by suffix arrays (operator 10).

A byte goes if it lies in a string of SPAN bytes that also starts in a document with a smaller id. Sorting every suffix of
a corpus would move the corpus many times over, so the sort sees only what can repeat:

1. Each string of SPAN bytes has an anchor, the smallest hashed GRAM in it, which depends on its bytes alone. Chunks of
   documents send their distinct anchors, dealt out by hash; those of two documents or more are candidates.
2. For each candidate a chunk sends the bytes around it (a context), once however often it has them, with its smallest
   document id. An anchor of very many documents is sent string by string, each dealt out by its own hash, so that no
   task gets all that surrounds a frequent line.
3. A bucket puts the contexts of anchors with differing contexts into one text and builds its suffix array in two stages:
   suffixes smaller than their successors are sorted directly, the others are induced by scanning the buckets of first
   bytes in order. Neighbours with a common prefix of SPAN bytes form a group, which has a smallest document id.
4. The chunks learn which of their strings start in a smaller document, and cut.

Null and empty texts have no bytes. Texts under SPAN bytes lose nothing. Rows with the same id never remove one another's
bytes; null ids count as larger than all others. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise
from ._text import distinct, mix, powers, prefix_hash, steps, text_bytes

SPAN, GRAM, CHUNK_BYTES, BUCKET_BYTES, MIN_BUCKETS, FREQUENT = 50, 24, 4 << 20, 16 << 20, 128, 1000
#: Bytes of contexts that a bucket sorts at once; buckets of more go slice by slice, each with all contexts of its anchors.
SLICE_BYTES = 2 << 20
#: Bytes of a chunk whose anchors are sought at once, up to the end of a document.
PIECE_BYTES = 1 << 19
#: Answers of at most so many bytes are broadcast to the scan of chunks; more are joined.
BROADCAST_BYTES = 64 << 20
LAST = np.iinfo(np.int64).max
#: In place of an anchor's place in its context: a single string of a frequent anchor, which goes by all its bytes.
WHOLE = 255
CHUNK = "chunk bigint, ids array<bigint>, lengths binary, data binary, size bigint"
CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,length:bigint>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor()
    for number, batch in enumerate(steps(batches, limit=CHUNK_BYTES)):
        data, bounds = text_bytes(batch.column("text"))
        arrays = [pa.array([x]) for x in ((part << 24) | number,)] + [pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
        arrays += [pa.array([np.diff(bounds).tobytes()], pa.binary()), pa.array([pack.compress(data.tobytes())], pa.binary()), pa.array([len(data)], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "lengths", "data", "size"])


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for each i."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Anchors:
    """Anchors of the documents of a chunk, with the strings of SPAN bytes that each stands for."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, span: int) -> None:
        self.data, self.span = data, span
        bounds = np.r_[0, np.cumsum(lengths)]
        cuts = np.unique(np.searchsorted(bounds, np.r_[np.arange(0, len(data), PIECE_BYTES), len(data)]))
        self.lows = bounds[cuts[:-1]]
        self.sums = np.empty(len(data) + len(self.lows), np.uint64)
        found = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            # sums of a piece alone, so that the tables of powers are short ones that are kept
            own = self.sums[bounds[a] + k : bounds[b] + k + 1]
            own[:] = prefix_hash(data[bounds[a] : bounds[b]])
            found.append(self._found(own, bounds[a : b + 1], ids[a:b]))
        empty = [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64)]
        self.first, self.last, self.key, self.doc, self.gram = (np.concatenate(x) for x in zip(empty, *found, strict=True))

    def content(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """range_hash of ranges that lie in one document each."""
        if not len(start):
            return np.empty(0, np.uint64)
        piece = np.searchsorted(self.lows, start, side="right") - 1  # piece k has k sums more before it than bytes
        local = start - self.lows[piece]
        shift = powers(local.max() + 1, inverse=True)[local]
        return mix((self.sums[end + piece] - self.sums[start + piece]) * shift + (end - start).astype(np.uint64))

    def _found(self, sums: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first string, last string, key, document, place) of each anchor of the documents between bounds."""
        lengths, low = np.diff(bounds), bounds[0]
        count = np.maximum(lengths - self.span + 1, 0)
        if not count.sum():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(sums) - GRAM
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n, inverse=True) + np.uint64(GRAM))
        packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        chosen = (_slide_min(packed, self.span - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.cumsum(count)
        starts = np.arange(ends[-1]) + np.repeat(bounds[:-1] - low - (ends - count), count)
        owner = np.repeat(np.arange(len(lengths)), count)
        anchor = chosen[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return starts[at] + low, starts[np.r_[at[1:], len(starts)] - 1] + low, hashes[anchor[at]], ids[owner[at]], anchor[at] + low

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code of each anchor, distinct keys, their documents, their buckets); keys in the order of bucket and value."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= doc[1:] != doc[:-1]
        group = np.cumsum(new_key) - 1
        keys, docs = key[new_key], np.bincount(group[new], minlength=new_key.sum())
        bucket = bucket_of(keys, buckets)
        again = np.argsort(bucket, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[again] = np.arange(len(keys))
        code = np.empty(len(key), np.int64)
        code[order] = place[group]
        return code, keys[again], docs[again], bucket[again]


class Items:
    """What a chunk sends of its candidate anchors: distinct contexts, or the distinct strings of very frequent anchors."""

    def __init__(self, anchors: Anchors, level: np.ndarray, buckets: int) -> None:
        """level: 0 no candidate, 1 candidate, 2 frequent, for each anchor."""
        one, many = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        count = anchors.last[many] - anchors.first[many] + 1
        each = np.arange(count.sum()) + np.repeat(anchors.first[many] - (np.cumsum(count) - count), count)
        self.start = np.r_[anchors.first[one], each]
        self.count = np.r_[anchors.last[one] - anchors.first[one] + 1, np.ones(len(each), np.int64)]
        self.doc = np.r_[anchors.doc[one], np.repeat(anchors.doc[many], count)]
        end = self.start + self.count + anchors.span - 1
        content = anchors.content(self.start, end)
        key = np.r_[anchors.key[one], content[len(one) :]]
        self.code, _, first = distinct(mix(content + key))
        least = np.full(len(first), LAST)
        np.minimum.at(least, self.code, self.doc)
        bucket = bucket_of(key[first], buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code = place[self.code]
        first = first[order]
        self.least, self.bucket, self.key, self.content = least[order], bucket[order], key[first], content[first]
        self.at, self.size = self.start[first], (end - self.start)[first]
        self.gram = np.r_[anchors.gram[one] - anchors.first[one], np.full(len(each), WHOLE)][first]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _row_anchors(row: dict, span: int) -> Anchors:
    ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
    return Anchors(np.frombuffer(row["data"], np.uint8), np.frombuffer(row["lengths"], np.int64), ids, span)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: only one chunk's bytes are unpacked out of a batch at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row | {"data": unpack.decompress(row["data"])}


def _send_anchors(span: int, buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, keys, docs, bucket = _row_anchors(row, span).distinct(buckets)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            pieces = list(zip(cut, cut[1:], strict=False))
            docs = np.minimum(docs, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"bucket": list(range(buckets)), "chunk": [row["chunk"]] * buckets, "keys": [keys[a:b].view(np.uint8).reshape(-1, 8)[:, :width].tobytes() for a, b in pieces], "docs": [docs[a:b].tobytes() for a, b in pieces]}, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]))

    return run


def _judge_anchors(width: int):
    """Keys that collide in the bytes sent become candidates too: they cost work, not exactness."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        sent = np.frombuffer(b"".join(rows["keys"]), np.uint8).reshape(-1, width)
        keys = np.zeros((len(sent), 8), np.uint8)
        keys[:, :width] = sent
        codes, seen, _ = distinct(keys.view(np.uint64).ravel())
        docs = np.bincount(codes, weights=np.frombuffer(b"".join(rows["docs"]), np.uint16), minlength=len(seen))
        level = ((docs > 1).astype(np.uint8) + (docs > FREQUENT).astype(np.uint8))[codes]
        return _answers(rows, level, [len(x) // width for x in rows["keys"]])

    return run


def _answers(rows: dict, values: np.ndarray, sizes: list[int]) -> pa.Table:
    """One compressed answer for each chunk that asked a bucket."""
    pack, ends = zstandard.ZstdCompressor(level=1), np.cumsum(sizes)
    return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int64()), "answer": pa.array([pack.compress(values[b - n : b].tobytes()) for n, b in zip(sizes, ends, strict=True)], pa.binary())})


def _unpacked(blob: bytes) -> bytes:
    """The answers of all buckets in a row; each stands behind its length."""
    unpack, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(unpack.decompress(blob[at + 4 : at + 4 + n]))
        at += 4 + n
    return b"".join(out)


def _items(row: dict, span: int, buckets: int) -> Items:
    anchors = _row_anchors(row, span)
    code, *_ = anchors.distinct(buckets)
    level = np.frombuffer(_unpacked(row["levels"]), np.uint8)[code]
    return Items(anchors, level, buckets)


def _narrow(docs: np.ndarray) -> tuple[int, np.ndarray]:
    """(base, differences of documents from it in as few bytes as hold them); all bits are set for LAST."""
    known = docs != LAST
    base = int(docs[known].min()) if known.any() else 0
    far = (docs - base).view(np.uint64)
    top = int(far[known].max()) if known.any() else 0
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if top < np.iinfo(t).max)
    return base, np.where(known, far, np.iinfo(kind).max).astype(kind)


def _wide(base: int, n: int, sent: np.ndarray) -> np.ndarray:
    """The n documents of _narrow from the bytes sent."""
    far = sent.view(f"u{len(sent) // max(n, 1) or 2}")
    return np.where(far == np.iinfo(far.dtype).max, LAST, far.astype(np.int64) + base)


def _send_items(span: int, buckets: int):
    """Hashes are not sent: buckets make them from the contexts (_widened)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            items = _items(row, span, buckets)
            cut = np.searchsorted(items.bucket, np.arange(buckets + 1))
            pieces = list(zip(cut, cut[1:], strict=False))
            base, least = _narrow(items.least)
            columns = {"bucket": list(range(buckets)), "chunk": [row["chunk"]] * buckets, "base": [base] * buckets}
            columns |= {k: [x[a:b].tobytes() for a, b in pieces] for k, x in (("grams", items.gram.astype(np.uint8)), ("least", least), ("sizes", items.size.astype(np.uint8)))}
            start, end = items.at.tolist(), (items.at + items.size).tolist()
            columns["data"] = [b"".join([row["data"][i:j] for i, j in zip(start[a:b], end[a:b], strict=True)]) for a, b in pieces]
            del items
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([*[(k, pa.int64()) for k in ("bucket", "chunk", "base")], *[(k, pa.binary()) for k in ("grams", "least", "sizes", "data")]]))

    return run


def _widened(table: pa.Table) -> pa.Table:
    """What was sent with the hashes that it leaves out: of each context, and of its anchor."""
    out = []
    for batch in table.to_batches():
        (data, _), (sizes, bounds), (grams, _), (least, cuts) = (text_bytes(batch.column(k)) for k in ("data", "sizes", "grams", "least"))
        start, size = np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int64)
        key, content = _hashed(data, start + np.where(grams == WHOLE, 0, grams), np.full(len(size), GRAM)), _hashed(data, start, size)
        key = np.where(grams == WHOLE, content, key)
        least = [_wide(b, n, least[i:j]) for b, n, i, j in zip(batch.column("base").to_pylist(), np.diff(bounds), cuts, cuts[1:], strict=False)]
        found = {"keys": key, "contents": content, "least": np.concatenate([np.empty(0, np.int64), *least]), "sizes": sizes.astype(np.uint16)}
        binary = lambda x: pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * x.itemsize), pa.py_buffer(x)])
        out.append(pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("bucket", "chunk", "data")} | {k: binary(x) for k, x in found.items()}))
    return pa.Table.from_batches(out)


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of data of 8 bytes at least."""
    if not len(start):
        return np.empty(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # a number at each byte, over the same bytes
    out = mix(words[start + size - 8] + size.astype(np.uint64))
    for k in range(0, int(size.max()) - 8, 8):
        out = np.where(size - 8 > k, mix(out + words[np.minimum(start + k, len(words) - 1)]), out)
    return out


def two_stage(text: np.ndarray) -> np.ndarray:
    """Suffix array of text (uint8; 0 ends each part of it), exact to the first 56 bytes of each suffix.

    Suffixes smaller than their successor are sorted by their bytes; the rest are induced: scanning the sorted suffixes
    bucket by bucket, the predecessor of a suffix, if larger than it, is the next in its own first byte's bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    change = np.flatnonzero(step)
    following = np.searchsorted(change, np.arange(n - 1))
    larger = np.ones(n, bool)  # than the successor; the last suffix is larger than the empty one
    inside = following < len(change)
    larger[:-1][inside] = step[change[following[inside]]] < 0
    direct = np.flatnonzero(~larger)
    direct = direct[np.lexsort(tuple(_words(text, direct, k) for k in range(6, -1, -1)))]
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        run = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(run):
            out.append(run)
            _induce(text, larger, run, c, waiting)
            before = run[run > 0] - 1
            run = before[larger[before] & (text[before] == c)]
        own = direct[cut[c] : cut[c + 1]]
        out.append(own)
        _induce(text, larger, own, c, waiting)
    return np.concatenate(out)


def _induce(text: np.ndarray, larger: np.ndarray, scanned: np.ndarray, c: int, waiting: list[list[np.ndarray]]) -> None:
    before = scanned[scanned > 0] - 1
    before = before[larger[before] & (text[before] > c)]
    if len(before):
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        first = text[before]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            waiting[text[part[0]]].append(part)


def _words(text: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of the suffixes at places as big-endian numbers; beyond the end is 0."""
    every = np.ndarray((len(text) + 56,), ">u8", _padded(text), strides=(1,))  # a number at each byte, over the same bytes
    return every[places + 8 * k].astype(np.uint64)


def _padded(text: np.ndarray) -> bytes:
    if _PADDED.get("of") is not text:
        _PADDED.update(of=text, bytes=text.tobytes() + bytes(64))
    return _PADDED["bytes"]


_PADDED: dict = {}


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to 56."""
    out, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(7):
        a, b = _words(text, order[open_ - 1], k), _words(text, order[open_], k)
        same = a == b
        x = a[~same] ^ b[~same]
        lead = np.zeros(len(x), np.int64)
        for shift in (32, 16, 8):
            top = x >> np.uint64(64 - shift) == 0
            lead[top] += shift
            x = np.where(top, x << np.uint64(shift), x)
        out[open_[~same]] += lead // 8
        out[open_[same]] += 8
        open_ = open_[same]
    return out


def least_documents(keys: np.ndarray, contents: np.ndarray, least: np.ndarray, sizes: np.ndarray, data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, documents): documents[firsts[i] + k] is the smallest document with the k-th string of context i."""
    codes, seen, first = distinct(mix(contents + keys))
    doc = np.full(len(seen), LAST)
    np.minimum.at(doc, codes, least)
    groups, _, _ = distinct(keys[first])
    mixed = np.bincount(groups)[groups] > 1 if len(groups) else np.empty(0, bool)
    count = sizes[first] - span + 1
    starts = np.r_[0, np.cumsum(count)]
    found = np.repeat(doc, count)
    part = np.flatnonzero(mixed)
    if len(part):
        place = np.r_[0, np.cumsum(sizes)][first[part]]
        size = sizes[first[part]]
        at = np.r_[0, np.cumsum(size + 1)]
        text = np.zeros(at[-1], np.uint8)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(at[:-1], size) + inner] = data[np.repeat(place, size) + inner] + 1  # UTF-8 has no byte over 0xF7
        slot = np.full(len(text), -1, np.int64)
        offset = np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        slot[np.repeat(at[:-1], count[part]) + offset] = np.repeat(starts[part], count[part]) + offset
        order = two_stage(text)
        order = order[slot[order] >= 0]
        group = np.cumsum(common_prefixes(text, order) < span) - 1
        low = np.full(group[-1] + 1, LAST)
        np.minimum.at(low, group, found[slot[order]])
        found[slot[order]] = low[group]
    return starts[:-1][codes], found


def _masks(keys: np.ndarray, contents: np.ndarray, least: np.ndarray, sizes: np.ndarray, data: np.ndarray, span: int) -> np.ndarray:
    """For each context the strings of it, as bits, that start in a document smaller than its own. Equal strings have one anchor."""
    first, found = least_documents(keys, contents, least, sizes, data, span)
    count = sizes - span + 1
    ends = np.cumsum(count)
    flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
    bits = (found[flat] < np.repeat(least, count)).astype(np.uint64) << (np.arange(len(flat)) - np.repeat(ends - count, count)).astype(np.uint64)
    return np.add.reduceat(bits, ends - count) if len(ends) else np.empty(0, np.uint64)


def _judge_items(span: int):
    """Slice by slice; contexts stay where Arrow has them until their slice takes its own."""

    def run(table: pa.Table) -> pa.Table:
        keys, contents, least, sizes = (_column(table, k, t) for k, t in (("keys", np.uint64), ("contents", np.uint64), ("least", np.int64), ("sizes", np.uint16)))
        masks, of, parts, done = np.empty(len(keys), np.uint64), mix(keys), [], 0
        for batch in table.to_batches():
            data, _ = text_bytes(batch.column("data"))
            n = len(text_bytes(batch.column("sizes"))[0]) // sizes.itemsize
            places = np.r_[0, np.cumsum(sizes[done : done + n], dtype=np.int64)]
            parts.append((done, pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(data)])))
            done += n
        slices = max(1, -(-int(sizes.sum(dtype=np.int64)) // SLICE_BYTES))
        of %= np.uint64(slices)
        for k in range(slices):
            at = np.flatnonzero(of == k)
            own = [text_bytes(x.take(pa.array(at[np.searchsorted(at, low) : np.searchsorted(at, low + len(x))] - low)))[0] for low, x in parts]
            masks[at] = _masks(keys[at], contents[at], least[at], sizes[at].astype(np.int64), np.concatenate([np.empty(0, np.uint8), *own]), span)
        rows = {k: table.column(k).to_pylist() for k in ("chunk", "bucket")}
        return _answers(rows, masks, (np.asarray(pc.binary_length(table.column("keys"))) // 8).tolist())

    return run


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all rows in a row; copied only if they lie in several batches."""
    parts = [text_bytes(x)[0] for x in table.column(name).chunks]
    return (parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint8), *parts])).view(kind)


def _gather(name: str):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table.column("chunk")[:1], name: pa.array([b"".join(len(x).to_bytes(4, "little") + x for x in table.sort_by("bucket").column("answer").to_pylist())], pa.binary())})

    return run


def _cut(span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            items, data = _items(row, span, buckets), np.frombuffer(row["data"], np.uint8)
            lengths = np.frombuffer(row["lengths"], np.int64)
            masks = np.frombuffer(_unpacked(row["masks"]), np.uint64)[items.code]
            masks = np.where(items.doc > items.least[items.code], np.uint64(2**64 - 1), masks)
            covered = np.zeros(len(data) + 1, np.int8)  # no byte lies in over 56 strings, and no two start at one place
            for k in range(int(items.count.max()) if len(items.count) else 0):
                hit = items.start[(items.count > k) & (masks >> np.uint64(k) & np.uint64(1) == 1)] + k
                covered[hit] += 1
                covered[hit + span] -= 1
            gone = np.cumsum(covered, dtype=np.int8)[:-1] > 0
            bounds = np.r_[0, np.cumsum(lengths)]
            found = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for i, doc in enumerate(row["ids"]):
                part, own = data[bounds[i] : bounds[i + 1]], gone[bounds[i] : bounds[i + 1]]
                edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0]))
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = part[~own] if spans else part
                for k, x in (("doc_id", doc), ("n_bytes", len(part)), ("n_removed", len(part) - len(kept)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(kept.tobytes()).hexdigest()), ("spans", spans)):
                    found[k].append(x)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([*[(k, pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]))

    return run


def _release(spark: SparkSession) -> None:
    """Shuffle files of what has been written go when the driver collects all its garbage; else a round's lie there in the next."""
    spark.sparkContext._jvm.System.gc()


def _tell(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """chunks with the answers of all buckets in a row as one column."""
    told = materialise(answers.groupBy("chunk").applyInArrow(_gather(name), f"chunk bigint, {name} binary"), f"suffix-{name}")
    size = told.agg(F.sum(F.octet_length(name))).first()[0] or 0
    _release(chunks.sparkSession)
    return chunks.join(F.broadcast(told) if size <= BROADCAST_BYTES else told, "chunk")


def repeated_passages(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of docs (doc_id, text)."""
    if not GRAM < span <= 56:
        raise ValueError("span must be over GRAM and at most 56 bytes")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks, CHUNK), "suffix-chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    width = min(8, 2 + (total.bit_length() + 7) // 8)  # bytes of a key that tell the corpus's anchors apart, but for one in thousands
    sent = chunks.mapInArrow(_send_anchors(span, buckets, width), "bucket bigint, chunk bigint, keys binary, docs binary")
    chunks = _tell(chunks, sent.groupBy("bucket").applyInArrow(_judge_anchors(width), "chunk bigint, bucket bigint, answer binary"), "levels")
    sent = chunks.mapInArrow(_send_items(span, buckets), "bucket bigint, chunk bigint, base bigint, grams binary, least binary, sizes binary, data binary")
    judge = _judge_items(span)
    chunks = _tell(chunks, sent.groupBy("bucket").applyInArrow(lambda table: judge(_widened(table)), "chunk bigint, bucket bigint, answer binary"), "masks")
    return chunks.mapInArrow(_cut(span, buckets), CUT)
