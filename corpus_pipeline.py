"""A corpus pipeline: quality rules, near-dedup, personal data, mixing, packing.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last one returns pieces
of packed sequences. Rows need no unique ids: stages that bring decisions back to texts number the rows first.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import mixing, neardup, packing, pii, quality_rules
from contrail.llm._store import materialise
from contrail.llm._text import Words
from contrail.llm.queries import tokenizer_file

#: Rows that a scan may learn to leave out by broadcast; more are joined.
BROADCAST_ROWS = 1_000_000
#: Steps of the curriculum that packing follows.
STEPS = 64


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs as a written table with a row number: all columns as _doc, the ones that operators read beside it."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return materialise(rows, name)


def _with_text(docs: DataFrame, columns: list[str], text: str) -> list:
    """The columns of documents with another text and its length."""
    return [F.col(text).alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_doc.`{c}`").alias(c) for c in columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules' posterior finds good. Texts are counted once, whole; null, empty and too short ones go.

    Equal texts have equal verdicts; all columns are carried in one struct, so none can clash; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = materialise(quality_rules.with_counts(rows, "_doc.text"), "pipeline-counts")
    return quality_rules.judged(rows, quality_rules.learn(rows)).filter("kept").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null ids come before others; equal ids, as of repeated rows, are told apart by a row number, and one row stays. Texts
    without words are linked with nothing and stay. Columns are carried in one struct; an empty table stays empty.
    """
    rows = _numbered(docs, "pipeline-rows")
    found = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")))
    groups = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    several = groups.join(groups.filter("_row <> group").select("group").distinct(), "group", "left_semi")
    several = several.join(rows.select("_row", F.struct("_doc.doc_id", "_row").alias("rank")), "_row")
    stays = several.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank._row").alias("_row"))
    gone = materialise(several.select("_row").join(stays, "_row", "left_anti"), "pipeline-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; null texts stay null, equal texts get equal surrogates, no row goes.

    Texts are read whole; columns are carried in one struct, and n_chars follows the text; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return pii.replace(rows, text="_doc.text").select(*_with_text(docs, docs.columns, "`_doc.text`"))


def _squeezed(texts: pa.Array) -> pa.Array:
    """Texts as Zstandard frames: what two shuffles carry."""
    packer = zstandard.ZstdCompressor(level=3)
    return pa.array([packer.compress(x.as_py().encode()) if x.is_valid else None for x in texts], pa.binary())


def _first_words(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Frames as texts again, cut after so many words; null words leave them whole."""
    out, unpacker = [], zstandard.ZstdDecompressor()
    for frame, k in zip(texts, words.to_pylist(), strict=True):
        text = unpacker.decompress(frame.as_py()) if frame.is_valid else None
        if text is not None and k is not None:
            text = text[: Words(pa.array([text], pa.binary())).end[k - 1]]
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string())


_squeezed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
_first_words.__annotations__ = {"texts": pa.Array, "words": pa.Array, "return": pa.Array}


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix serves them, the last one of a source cut at its target, in training order.

    Texts without words are never served. Null sources are one source, the last. Equal ids are ordered by a row number, so
    repeated rows are served each. Columns are carried in one struct; an empty table stays empty.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc")
    named = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "text", F.arrow_udf(_squeezed, "binary")("text").alias("_frame"), others)
    rows = materialise(mixing.sized(named).drop("text"), "pipeline-sized")
    planned = mixing.plan(rows.select("_row", "doc_id", "source", "size"), ties=["_row"])
    served = mixing.occurrences(planned).select("_row", "position", "epoch", "words")
    whole = rows.select("_row", "size", "_frame", "_doc").join(served, "_row")
    ordered = mixing.in_order(whole.select("_frame", "_doc", "size", "words", "position", "epoch", "_row"), "_row", "epoch")
    text = F.arrow_udf(_first_words, "string")("_frame", F.when(F.col("words") < F.col("size"), F.col("words")))
    return ordered.select(text.alias("_text"), "_doc").select(*_with_text(docs, docs.columns, "_text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences whose windows hold the sources as the curriculum wants them then, each source in training order.

    The run is cut into STEPS; in each, a source's tokens are its schedule's part of all it has. Sources take the schedules
    in code-point order, as in the mix. Training order is the one of the rows in the files of the stage before; Spark may
    deal the files out to tasks as it likes. Null and empty texts are one end token, repeated rows are packed each, very
    long texts are cut over sequences, equal file names do not occur, an empty table packs to none; other columns are dropped.
    """
    at = docs.metadataColumn("_metadata") if docs.inputFiles() else None
    part = None if at is None else F.concat(at["file_name"], F.lit("#"), F.lpad(at["file_block_start"].cast("string"), 20, "0"))
    return packing.pack(docs, tokenizer_file(), part=part, courses=mixing.courses(STEPS))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The posterior of the rules, sketches and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
