"""Words of whole texts, batch by batch, in NumPy over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Null texts count as empty here; operators that treat
them otherwise look at the validity of the column themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step works on; a single longer text is a step of its own.
STEP_BYTES = 2 << 20

MIX1, MIX2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
RADIX = 0x5851F42D4C957F2D
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_POWERS: dict[bool, np.ndarray] = {}


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about limit bytes of the column."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        step = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends): the UTF-8 bytes of all texts in a row, and bounds: text i is data[bounds[i]:bounds[i + 1]]."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, places, data = texts.buffers()
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """RADIX (or its inverse modulo 2**64) to the powers 0 to n - 1."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1024), pow(RADIX, -1, 2**64) if inverse else RADIX, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= STEP_BYTES + 1024:  # tables for one very long text are not kept
            _POWERS[inverse] = have
    return have[:n]


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Sums from which range_hash makes the hash of any range of bytes; fold: A-Z count as a-z."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of some texts: bytes data[start[k]:end[k]] for word k, words offsets[i] to offsets[i + 1] for text i.

    between: for each byte whether it stands between words.
    """

    def __init__(self, texts: pa.Array, fold: bool = False, between: np.ndarray = _WHITE) -> None:
        self.data, self.bounds = text_bytes(texts)
        self.fold, n = fold, len(self.data)
        white = np.ones(n + 1, bool)
        white[:n] = between[self.data]
        first = np.zeros(n + 1, bool)
        first[self.bounds] = True
        inside = ~white
        opens = inside.copy()
        opens[1:] &= white[:-1] | first[1:]
        self.start = np.flatnonzero(opens)
        shuts = np.zeros(n + 1, bool)
        shuts[1:] = inside[:-1] & (white[1:] | first[1:])
        self.end = np.flatnonzero(shuts)
        self.offsets = np.searchsorted(self.start, self.bounds)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data, self.fold), self.start, self.end)

    def word(self, k: int) -> bytes:
        x = self.data[self.start[k] : self.end[k]].tobytes()
        return x.lower() if self.fold else x


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distinct values, first place of each), in order of first place."""
    coded = pa.array(values).dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    seen = np.asarray(coded.dictionary)
    first = np.full(len(seen), len(codes), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, seen, first


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of values[i:i + n] for each i; windows that cross texts are for the caller to leave out."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * BASE + values[k : len(values) - n + 1 + k])
    return out


def gram_places(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, owners) of the windows of n values that lie within one text."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(owner)) - first[owner] + offsets[:-1][owner], owner


def text_udf(function, returns: str):
    """A column function of whole texts from function(texts: pa.Array) -> pa.Array, called on slices of STEP_BYTES."""
    from pyspark.sql import functions as F

    def run(texts: pa.Array) -> pa.Array:
        if len(texts) == 0:
            return function(texts)
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.concat_arrays([function(x.column("text")) for x in steps(iter([batch]))])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text's number for each of its items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags[bounds[i]:bounds[i + 1]] for each i."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])
