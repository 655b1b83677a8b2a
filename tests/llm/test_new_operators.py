"""Importance resampling, line dedup and source divergence against plain computations, on odd tables and in their parts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contrail.llm import divergence, importance, line_dedup
from contrail.llm import queries as Q

GOOD = "the quick brown fox jumps over the lazy dog while some other words of a longer text follow it and end here today maybe never again"
LINE = "A line that several documents hold"
ROWS = [
    (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", "", "b"), (5, " ".join(f"word{k % 977}x{k}" for k in range(60_000)), "en", "b"),
    (None, GOOD + " more", "en", "a"), (None, None, None, None), (7, "é" * 50 + " Éa \x00İ ǅ x y", "de", None), (8, f"{LINE}\nown\n\n  {LINE.upper()}\t\nend", "en", "c"), (9, f"{LINE} \r\n{LINE}", "de", "c"), (10, f"x\n{LINE}", "de", "d"),
    (11, f"{LINE}\n" * 3, "fr", "d"), (12, LINE, "fr", "a"), (12, LINE, "fr", "a"), (13, "short\nshort\nshort", "fr", "a"), (14, "short", "fr", "b"), (15, "short", "fr", "c"), (None, LINE, "fr", "a"),
    (16, "ééééééééééééééééééé1\n" + "é" * 20, "xx", "z"), (17, "é" * 20, "xx", "y"), (18, "  " + "é" * 20 + "  ", "xx", "y"), (19, "the fox " * 400 + GOOD, "en", "c"),
]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, rows in (("odd", ROWS), ("empty", [])):
        at = str(tmp_path_factory.mktemp(name))
        full = [(i, t, g, s, 7, "own", 1.5, 0, [1], "b") for i, t, g, s in rows]
        spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_lines int, kept_sha256 string, score double, rank int, held array<int>, _lines string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([("1", GOOD), ("2", None), ("3", "")] if rows else [], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        out[name] = at
    return out


def plain(rows):
    return sorted((tuple(r[c] for c in sorted(r.asDict())) for r in rows), key=repr)


def importance_by_hand(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in docs for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    whole = lambda c: sum(c.values()) + 10000
    out = []
    for i, x in docs:
        w = words(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * whole(s) / ((s[b] + 1) * whole(t)))) for b in map(bucket, w))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: len(fit) * 10 // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def lines_by_hand(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = defaultdict(list)
    for i, t in docs:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                held[k].append(i)
    keeper = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, hashlib.sha256("\n".join(left).encode()).hexdigest(), len(lines) - len(left), len(lines)))
    return sorted(out, key=repr)


def divergence_by_hand(docs):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for t, g, s in docs]
    docs = [(g, s, [w.translate(FOLD) for w in words]) for g, s, words in docs]
    out = []
    for lang in {g for g, _, _ in docs}:
        df = Counter(w for g, _, words in docs if g == lang for w in set(words))
        kept = {w for w, n in df.items() if n >= 3}
        count = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                count[s].update(w for w in words if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        shares, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pairs = [(sum(f(p[w], other[w]) for w in kept), o) for o, other in shares.items() if o != s]
            terms = [(f(p[w], q[w]), w) for w in kept if count[s][w] and p[w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[: 200 if part == "term" else None]):
                    out.append((item, lang, part, k + 1, s, value))
    return sorted(out, key=repr)


def test_importance(spark, tables, sf):
    for at in (tables["odd"], sf):
        docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
        target = [r[0] for r in spark.read.parquet(f"{at}/benchmark.parquet").select("text").collect()]
        rows = Q.op11_importance(spark, at).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, rows), key=repr) == importance_by_hand(docs, target)
    assert Q.op11_importance(spark, tables["empty"]).collect() == []


def test_grams_of_two_lengths(spark):
    features = importance.Features(1, 3, 1 << 20)
    row = importance.scan(spark.createDataFrame([(1, "B-a,  a b\n")], "doc_id long, text string"), features).first()
    grams = "b|a|a|b|b a|a a|a b|b a a|a a b".split("|")
    assert row["n_words"] == 4 and np.frombuffer(row["held"], np.uint32).tolist() == [zlib.crc32(g.encode()) % (1 << 20) for g in grams]


def test_drawn_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranks = importance.resample(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), percent=20).cache()
    n = ranks.filter("n_words >= 20").count() * 20 // 100
    taken = importance.drawn(docs, ranks)
    assert taken.count() == n and taken.columns == docs.columns
    assert sorted(r["rank"] for r in ranks.filter("rank is not null").collect()) == list(range(1, n + 1))


def test_lines(spark, tables, sf):
    for at in (tables["odd"], sf):
        docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
        assert plain(Q.op12_lines(spark, at).collect()) == lines_by_hand(docs)
    assert Q.op12_lines(spark, tables["empty"]).collect() == []


def test_lines_joined_by_document(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    few = line_dedup.deduplicated(docs)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    many = line_dedup.deduplicated(docs)
    assert sorted(few.columns) == sorted(many.columns) == sorted([*docs.columns, "n_dropped"])
    key = lambda df: sorted(map(repr, df.select(*sorted(few.columns)).collect()))
    assert key(few) == key(many) and few.filter("n_dropped > 0").count() > 3


@pytest.mark.parametrize("per_key", [12, 1])
def test_no_repeat_is_lost_by_the_filters(monkeypatch, per_key):
    rng = np.random.default_rng(3)
    once, again = rng.integers(0, 2**64, 20_000, np.uint64), rng.integers(0, 2**64, 3_000, np.uint64)
    shards = 4
    bits = np.zeros((shards, line_dedup.SHARD_BITS // 8), np.uint8)
    arrivals = rng.permutation(np.concatenate([once, again, again]))[: None if per_key == 12 else 26_000]
    pairs = [line_dedup.Pair() for _ in range(shards)]
    for part in np.array_split(arrivals, 7):
        shard = line_dedup.shard_of(part, shards)
        for k in range(shards):
            pairs[k].add(part[shard == k])
    for k in range(shards):
        bits[k] = np.packbits(pairs[k].twice, bitorder="little")
    values, counts = np.unique(arrivals, return_counts=True)
    said = line_dedup.suspected(values, bits)
    assert said[counts > 1].all() and said[counts == 1].mean() < 0.2


def test_lines_of_texts():
    lines = line_dedup.Lines(pa.array(["a\n\n b \n", None, "", "\nx"]))
    assert lines.offsets.tolist() == [0, 4, 5, 6, 8]
    assert [lines.whole(k) for k in range(8)] == [b"a", b"", b" b ", b"", b"", b"", b"", b"x"]
    assert [lines.key(k) for k in range(8)] == [b"a", b"", b"b", b"", b"", b"", b"", b"x"]


def test_divergence(spark, tables, sf):
    for at in (tables["odd"], sf):
        docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("text", "lang", "source").collect()]
        assert plain(Q.op13_divergence(spark, at).collect()) == divergence_by_hand(docs)
    assert Q.op13_divergence(spark, tables["empty"]).collect() == []


def test_cells_of_large_counts():
    """Counts whose shares need more than 64 bits, and cells of both sides."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 512), rng.integers(0, 3, 512)
    side = lambda x, shares: (np.array(shares, np.int64), np.array([np.packbits(x == k, bitorder="little").view(np.uint64) for k in range(len(shares))]))
    p, q = [1, 500, 10**9, 77], [3, 10**9, 12]
    f = lambda x, y: (x - y) ** 2 // y
    want = sum(f(p[i], q[j]) for i, j in zip(a, b, strict=True)), sum(f(q[j], p[i]) for i, j in zip(a, b, strict=True))
    if max(want) < 2**63:
        assert divergence._cells(side(a, p), side(b, q)) == want
    few = [1, 500, 900, 77], [3, 450, 12]
    assert divergence._cells(side(a, few[0]), side(b, few[1])) == (sum(f(few[0][i], few[1][j]) for i, j in zip(a, b, strict=True)), sum(f(few[1][j], few[0][i]) for i, j in zip(a, b, strict=True)))


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.share(F.lit(10**12), F.lit(3 * 10**12), F.lit(10**6), 1, 10**9)).first()[0]
    assert row == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 10**6)
