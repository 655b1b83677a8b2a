"""Registered queries of the training-data operators and the pipeline: thin views of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, divergence, importance, line_dedup, mixing, neardup, packing, pii, quality_compression, quality_rules, suffix_dedup, topk_search, toxicity
from ._labels import fold_of
from ._store import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs).select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"), "pii_kinds")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(quality_rules.with_counts(docs).drop("text"), "op8-counts")
    judged = quality_rules.judged(counted, quality_rules.learn(counted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_compression.fit(docs, table(spark, sf_dir, "labels"))
    return quality_compression.scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), repeating=(5, 2, 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = materialise(mixing.sized(docs).drop("text"), "op2-sizes")
    return mixing.in_order(mixing.plan(sizes).select("doc_id", "size", "source_size", "target", "taken", "position"), "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS full_size FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY full_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, full_size / weight) AS open_level FROM l WHERE level * weight <= full_size),
t AS (SELECT source, source_size, place, least(full_size, coalesce((SELECT open_level FROM o), 'inf'::DOUBLE) * weight) AS target FROM l),
p AS (SELECT doc_id, d.source, size, source_size, place, target,
      CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, served / target) END AS u FROM p)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - served)) + greatest(0, least(size, floor(target) - served - source_size))
     + greatest(0, least(size, floor(target) - served - 2 * source_size)) AS BIGINT) AS taken,
  coalesce(CASE place % 3 WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + -2.0::DOUBLE * u)) - 1.5::DOUBLE) / -1.0::DOUBLE
     WHEN 1 THEN u / 1.0::DOUBLE ELSE (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * u)) - 0.5::DOUBLE) / 1.0::DOUBLE END, 0.0::DOUBLE) AS position
FROM u
"""


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"))
    corpus = class_lm.count(docs, fold != 1)
    scored = class_lm.scored(corpus, class_lm.fit(corpus))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT row, unnest(words) AS word FROM d),
v AS (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM b)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(word)) + 1, 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY bucket),
z AS (SELECT (SELECT count(*) FROM w) AS ss, (SELECT count(*) FROM b) AS tt),
g AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
x AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN h USING (word) JOIN g USING (bucket) GROUP BY row),
r AS (SELECT row, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (row)),
p AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS fit FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= fit * 10 // 100 THEN place END AS rank FROM r LEFT JOIN p USING (row)
"""


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, least_chars=20, least_docs=3).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT row) >= 3),
o AS (SELECT row, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id IS NULL OR keeper = doc_id), '') AS kept
  FROM k LEFT JOIN r USING (key) GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (row)
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, smoothing=1, scale=10**9, top=200)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT row, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT lang, count(*) AS v, sum(n) AS big FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS size FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (size + v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // CAST(big + v AS HUGEINT) AS q
  FROM s JOIN k USING (lang) JOIN z USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
a AS (SELECT g.lang, g.source, o.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN p x ON x.lang = g.lang AND x.source = g.source LEFT JOIN p y ON y.lang = o.lang AND y.source = o.source AND y.term = x.term GROUP BY ALL),
t AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM a UNION ALL SELECT lang, source, 'term' AS part, item, value FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_packing, op4_near_duplicates, op5_toxicity, op6_topk, op7_pii, op8_quality_rules, op9_class_lm, op10_suffix_dedup, op11_importance, op12_lines, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op6_topk": OP6_SQL, "op11_importance": OP11_SQL, "op12_lines": OP12_SQL, "op13_divergence": OP13_SQL}
