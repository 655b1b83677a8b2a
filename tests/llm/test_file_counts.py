"""Tables that loops write have as many files as their rows need, however many partitions the session has."""

import glob
import os

from contrail.llm import neardup
from contrail.llm._store import shared_dir


def test_near_duplicates_write_few_files(spark):
    rows = [(i, " ".join([*[f"g{i // 4}w{k}" for k in range(60)], f"own{i}"])) for i in range(400)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 4).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {i: i // 4 * 4 for i, _ in rows}
    most = {}
    for folder in set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*")) - before:
        name = os.path.basename(folder).rsplit("-", 1)[0]
        most[name] = max(most.get(name, 0), len(glob.glob(f"{folder}/part-*")))
    kinds = ("cc", "neardup-ids", "neardup-texts", "neardup-links", "neardup-components")
    assert all(most[k] <= spark.sparkContext.defaultParallelism for k in kinds), most
