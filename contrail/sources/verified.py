"""Tables that are verified before they are read (S8), and JSON lines whose first bad line is named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_json
from ..functions.places import numbered
from ..storage import written

#: Digests below one digest of the tree.
LEAF = 1000


def _level(nodes: DataFrame, level: int, leaf: int) -> DataFrame:
    """Nodes above (place, rows, digest): every leaf of them in order are one."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "\n")
    up = nodes.groupBy(F.floor(F.col("place") / leaf).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
    return written(up.select(F.lit(level).alias("level"), "node", "rows", "digest"), "merkle")


def merkle(rows: DataFrame, key: str, leaf: int = LEAF) -> DataFrame:
    """(level, node, rows, digest): a tree over the canonical JSON of the rows in the order of their keys.

    Level 0 has a node for every leaf rows, each level above one for every leaf nodes, the last one a single root: no task
    takes more than leaf digests. Equal keys are in the order of their digests, so the tree depends on the rows alone.
    """
    digests = rows.select(F.col(key).alias("key"), F.sha2(canonical_json(*rows.columns), 256).alias("digest"))
    placed = numbered(digests, [F.col("key"), F.col("digest")]).select("place", F.lit(1).cast("long").alias("rows"), "digest")
    out = nodes = _level(placed, 0, leaf)
    level = 0
    while nodes.count() > 1:
        level += 1
        nodes = _level(nodes.select(F.col("node").alias("place"), "rows", "digest"), level, leaf)
        out = out.unionByName(nodes)
    return out


def root(tree: DataFrame) -> DataFrame:
    """One row (content_sha256, rows) of a tree; a table without rows has none."""
    return tree.orderBy(F.desc("level")).limit(1).select(F.col("digest").alias("content_sha256"), "rows")


def write_verified(rows: DataFrame, path: str, key: str, leaf: int = LEAF) -> None:
    """Rows sorted by key as Parquet, and their tree beside them."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(f"{path}/rows")
    merkle(rows, key, leaf).withColumns({"key": F.lit(key), "leaf": F.lit(leaf)}).write.mode("errorifexists").parquet(f"{path}/tree")


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_verified, if their tree is the one written with them; else ValueError names the first leaf that differs."""
    rows, tree = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/tree")
    said = tree.select("key", "leaf").first()
    if said is None:
        if rows.isEmpty():
            return rows
        raise ValueError(f"{path}: rows where the manifest has none")
    now = merkle(rows, said["key"], said["leaf"])
    both = tree.select("level", "node", "rows", "digest").exceptAll(now).unionByName(now.exceptAll(tree.select("level", "node", "rows", "digest")))
    wrong = both.filter("level = 0").orderBy("node").first()
    if wrong is not None:
        at = wrong["node"] * said["leaf"]
        raise ValueError(f"{path}: rows {at} to {at + said['leaf'] - 1} by {said['key']} are not those of the manifest")
    return rows


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line): the first line of each file that is no JSON object of the schema; lines count from 1, blank ones too.

    Files are split as any text: lines are numbered within their split, and splits add up what stands before them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = (F.trim("value") != "") & (parsed.isNull() | parsed["_corrupt_record"].isNotNull())
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min(F.when(bad, F.col("at"))).alias("bad"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("bad is not null")
    return placed.groupBy("file").agg(F.min(F.col("before") + F.col("bad") - F.col("first") + 1).alias("line"))


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; a malformed line fails the read with its file and line."""
    wrong = bad_lines(spark, path, schema).orderBy("file").first()
    if wrong is not None:
        raise ValueError(f"{wrong['file']}:{wrong['line']}: not a JSON object of the schema")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
