"""What chunks send and keep of the passages (operator 10), and what a bucket takes beside its contexts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from contrail.llm import suffix_dedup


def _rows(words, texts, first=0, ids=None):
    """Three chunks of texts of these words, all of whose anchors are candidates, the rarest ones frequent."""
    rng = random.Random(texts)
    for part in range(3):
        data = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))).encode() for _ in range(texts)]
        row = {"chunk": part, "ids": ids or [first + part * texts + i for i in range(texts)], "lengths": np.array([len(x) for x in data], np.int64).tobytes(), "data": b"".join(data)}
        _, keys, *_ = suffix_dedup._row_anchors(row, 50).distinct(1)
        level = zstandard.ZstdCompressor().compress((1 + (keys % np.uint64(9) == 0)).astype(np.uint8).tobytes())
        yield row | {"levels": len(level).to_bytes(4, "little") + level}


def _both(monkeypatch, rows):
    """(as sent, with all hashes of the chunks) for one bucket."""
    monkeypatch.setattr(suffix_dedup, "_rows", lambda batches: iter(batches))
    rows = list(rows)
    sent = pa.Table.from_batches(list(suffix_dedup._send_items(50, 1)(rows)))
    wide = []
    for row, data in zip(rows, sent.column("data").to_pylist(), strict=True):
        items = suffix_dedup._items(row, 50, 1)
        items = items[-1] if isinstance(items, tuple) else items
        wide.append({"bucket": 0, "chunk": row["chunk"], "keys": items.key.tobytes(), "contents": items.content.tobytes(), "least": items.least.tobytes(), "sizes": items.size.astype(np.uint16).tobytes(), "data": data})
    return sent, pa.Table.from_pylist(wide)


def test_buckets_make_the_hashes_that_are_not_sent(monkeypatch):
    words = [f"{x} some words that often come back {x}" for x in "abcdef"]
    for ids in (None, [None, -(2**63), 2**63 - 2, *range(57)], [None] * 60, [10**12 + 70_000 * i for i in range(60)]):
        sent, wide = _both(monkeypatch, _rows(words, 60, 5, ids))
        got = suffix_dedup._judge_items(50)(suffix_dedup._widened(sent))
        assert got.to_pylist() == suffix_dedup._judge_items(50)(wide).to_pylist()
        assert suffix_dedup._widened(sent).column("least").to_pylist() == wide.column("least").to_pylist()
        assert any(set(suffix_dedup._unpacked(len(x).to_bytes(4, "little") + x)) != {0} for x in got.column("answer").to_pylist()) or ids == [None] * 60
    split = pa.concat_tables([sent.slice(i, 1) for i in range(3)])  # a bucket may come in several batches
    assert suffix_dedup._judge_items(50)(suffix_dedup._widened(split)).to_pylist() == got.to_pylist()


def test_a_context_is_sent_with_few_bytes(monkeypatch):
    sent, _ = _both(monkeypatch, _rows([f"{x} words {x}" for x in range(500)], 300))
    size = {k: sum(len(x) for x in sent.column(k).to_pylist()) for k in sent.schema.names if sent.schema.field(k).type == pa.binary()}
    assert sum(size.values()) - size["data"] <= 4 * size["sizes"], size


def test_a_bucket_holds_its_contexts_once(monkeypatch):
    rng = random.Random(7)
    sent, wide = _both(monkeypatch, _rows(["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)], 2500))
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1 << 18)
    data = sum(len(x) for x in wide.column("data").to_pylist())
    tracemalloc.start()
    suffix_dedup._judge_items(50)(wide)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data > 8e6 and peak < 1.5 * data + 64 * suffix_dedup.SLICE_BYTES, (data, peak)


def test_chunks_move_as_packed_bytes(spark):
    texts = [(i, f"some words that often come back {i} " * 200) for i in range(40)] + [(None, None), (41, "")]
    chunks = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).mapInArrow(suffix_dedup._chunks, suffix_dedup.CHUNK)
    batches = chunks.toArrow().to_batches()
    rows = [x for b in batches for x in b.to_pylist()]
    assert sum(len(r["data"]) for r in rows) < sum(r["size"] for r in rows) / 4
    assert b"".join(r["data"] for r in suffix_dedup._rows(iter(batches))) == "".join(t or "" for _, t in texts).encode()


def test_each_round_lets_go_of_its_shuffles(spark, monkeypatch):
    """Whether files have gone hangs on the heap; that the driver is asked to let go after both rounds' answers does not."""
    done, release, tell = [], suffix_dedup._release, suffix_dedup._tell
    monkeypatch.setattr(suffix_dedup, "_release", lambda session: done.append("let go") or release(session))
    monkeypatch.setattr(suffix_dedup, "_tell", lambda chunks, answers, name: (tell(chunks, answers, name), done.append(name))[0])
    docs = spark.createDataFrame([(i, f"some words that often come back {i % 7} " * 20) for i in range(60)], "doc_id long, text string")
    assert suffix_dedup.repeated_passages(docs).count() == 60
    assert done == ["let go", "levels", "let go", "masks"]
