"""Blast radius with sets, to the fixpoint, and callers on condensed graphs.

Sets of seeds and changes are bitsets of numbered ids, cut into blocks: a row a (symbol, block) where a table of pairs has
a row a (symbol, seed). Cycles are condensed to one node before callers are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import rank_of, state_of
from ..storage import written
from .graph import distances

#: Ids of a block, and its bytes.
BLOCK = 4096
WIDTH = BLOCK // 8
STATES = ("exact", "partial", "unresolved")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], begin: Callable, add: Callable, end: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by keys: begin(row), add(state, row), end(key, state) -> a row or None. One state lives at a time."""
    out: list[dict] = []
    key = state = None
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[k] for k in keys)
            if at != key:
                if key is not None and (done := end(key, state)):
                    out.append(done)
                key, state = at, begin(row)
            add(state, row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None and (done := end(key, state)):
        out.append(done)
    yield pa.RecordBatch.from_pylist(out, schema)


def _number(raw: bytes | None) -> int:
    return int.from_bytes(raw, "little") if raw else 0


def _arrow(fields: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def _packed(members: DataFrame) -> DataFrame:
    """(symbol_id, kind, block, the three bitsets, score) from (symbol_id, kind, at, rank, score)."""
    fields = StructType([members.schema["symbol_id"], members.schema["kind"]]).add("block", "long")
    for name in STATES:
        fields = fields.add(name, "binary")
    fields = fields.add("score", "double")
    arrow, keys = _arrow(fields), ["symbol_id", "kind", "block"]

    def add(state: dict, row: dict) -> None:
        state["bits"][row["rank"]] |= 1 << row["bit"]
        if row["score"] is not None:
            state["score"] = max(row["score"], state["score"] if state["score"] is not None else row["score"])

    def end(key: tuple, state: dict) -> dict:
        return dict(zip(keys, key, strict=True)) | {n: b.to_bytes(WIDTH, "little") for n, b in zip(STATES, state["bits"], strict=True)} | {"score": state["score"]}

    rows = members.withColumns({"block": F.expr(f"at div {BLOCK}"), "bit": F.expr(f"int(at % {BLOCK})")}).drop("at")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda batches: _runs(batches, keys, lambda _: {"bits": [0, 0, 0], "score": None}, add, end, arrow), fields)


def _first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, in order: each id goes to the first row that has it, and so does its state.

    rows: keys, order, edge_rank, the three bitsets, score. An edge moves the ids of its row to its own state if that is
    worse. Rows without an edge_rank stand first: their ids are known and never new. Comes back with one row a key: known,
    what is new in each state, the largest score.
    """
    fields = StructType([rows.schema[k] for k in keys]).add("known", "binary")
    for name in STATES:
        fields = fields.add(name, "binary")
    fields = fields.add("score", "double")
    arrow = _arrow(fields)

    def add(state: dict, row: dict) -> None:
        bits, rank = [_number(row[name]) for name in STATES], row["edge_rank"]
        state["known"] |= _number(row["known"])
        if rank is None:
            state["known"] |= bits[0] | bits[1] | bits[2]
            return
        for k in range(rank):
            bits[k + 1] |= bits[k]
            bits[k] = 0
        new = state["new"]
        free = ~(state["known"] | new[0] | new[1] | new[2])
        for k in range(3):
            new[k] |= bits[k] & free
        if row["score"] is not None:
            state["score"] = max(row["score"], state["score"] if state["score"] is not None else row["score"])

    def end(key: tuple, state: dict) -> dict:
        bits = {"known": state["known"]} | dict(zip(STATES, state["new"], strict=True))
        return dict(zip(keys, key, strict=True)) | {n: b.to_bytes(WIDTH, "little") if b else None for n, b in bits.items()} | {"score": state["score"]}

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(lambda batches: _runs(batches, keys, lambda _: {"known": 0, "new": [0, 0, 0], "score": None}, add, end, arrow), fields)


def _joined_bits(bits: pa.ListArray) -> pa.Array:
    out = []
    for sets in bits.to_pylist():
        n = 0
        for x in sets or ():
            n |= _number(x)
        out.append(n.to_bytes(WIDTH, "little") if n else None)
    return pa.array(out, pa.binary())


_joined_bits.__annotations__ = {"bits": pa.Array, "return": pa.Array}


def spread(impacts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reach, ids). impacts: impact_id, symbol_id, change_id, score, certainty; edges: caller_id, callee_id, edge_id, state.

    ids: (kind, id, at) numbers impacts (kind seed) and changes. reach: (symbol_id, kind, block, distance, the bitsets of
    ids first reached at that distance by the state of their path, score). Of the paths of the smallest length, the one
    with the smallest callee, then edge id, at each step decides the state. Each round joins the rows that the last one
    added with the edges to their callers; rows of one caller are folded in slices of the edges' order first, so a caller
    of a third of all symbols is several tasks' work.
    """
    ranks = F.coalesce(rank_of(F.col("certainty")), F.lit(0))
    members = impacts.select("symbol_id", F.lit("seed").alias("kind"), F.col("impact_id").cast("string").alias("id"), ranks.alias("rank"), F.col("score").cast("double").alias("score"))
    members = members.unionByName(impacts.select("symbol_id", F.lit("change").alias("kind"), F.col("change_id").cast("string").alias("id"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("score")))
    members = members.filter("symbol_id is not null and id is not null").groupBy("symbol_id", "kind", "id").agg(F.max("rank").alias("rank"), F.max("score").alias("score"))
    ids = written(members.select("kind", "id").distinct().withColumn("at", F.monotonically_increasing_id()), "ids")
    steps = edges.filter("caller_id is not null and callee_id is not null").select("caller_id", "callee_id", F.col("edge_id").cast("string").alias("edge_id"), F.coalesce(rank_of(F.col("state")), F.lit(0)).alias("edge_rank"))
    steps = written(steps.repartitionByRange("caller_id", "callee_id", "edge_id").withColumn("slice", F.spark_partition_id()), "steps")
    front = written(_packed(members.join(ids, ["kind", "id"]).drop("id")).withColumn("distance", F.lit(0)), "reach")
    reach, level = front, 0
    keys, none = ["symbol_id", "kind", "block"], F.lit(None).cast("binary").alias("known")
    while not front.isEmpty():
        level += 1
        hit = front.withColumnRenamed("symbol_id", "callee_id").join(steps, "callee_id")
        hit = hit.select(F.col("caller_id").alias("symbol_id"), "kind", "block", "slice", "callee_id", "edge_id", "edge_rank", none, *STATES, "score")
        parts = _first_wins(hit, [*keys, "slice"], ["callee_id", "edge_id"]).drop("known").withColumns({"edge_rank": F.lit(0), "known": none})
        parts = written(parts, "slices")
        before = reach.join(parts.select(*keys).distinct(), keys, "left_semi").withColumns({"slice": F.lit(-1), "edge_rank": F.lit(None).cast("int"), "known": none})
        new = _first_wins(parts.unionByName(before.select(parts.columns)), keys, ["slice"]).drop("known")
        front = written(new.filter("exact is not null or partial is not null or unresolved is not null").withColumn("distance", F.lit(level)), "reach")
        reach = reach.unionByName(front)
    return reach, ids


def sets(reach: DataFrame) -> DataFrame:
    """(symbol_id, kind, block, bits): all ids that reach each symbol."""
    return reach.groupBy("symbol_id", "kind", "block").agg(F.flatten(F.collect_list(F.array_compact(F.array(*STATES)))).alias("all")).select("symbol_id", "kind", "block", F.arrow_udf(_joined_bits, "binary")("all").alias("bits"))


def _places(bits: pa.Array) -> pa.Array:
    found = []
    for raw in bits.to_pylist():
        n, out = _number(raw), []
        while n:
            low = n & -n
            out.append(low.bit_length() - 1)
            n ^= low
        found.append(out)
    return pa.array(found, pa.list_(pa.int64()))


_places.__annotations__ = {"bits": pa.Array, "return": pa.Array}


def listed(held: DataFrame, ids: DataFrame) -> DataFrame:
    """(kind, block, bits, id): the ids of each distinct bitset of held; symbols on a cycle share theirs."""
    each = held.select("kind", "block", "bits").distinct()
    each = each.withColumn("at", F.explode(F.arrow_udf(_places, "array<bigint>")("bits"))).withColumn("at", F.col("at") + F.col("block") * BLOCK)
    return each.join(ids, ["kind", "at"]).drop("at")


def impacted(reach: DataFrame) -> DataFrame:
    """(symbol_id, distance, impact_type, state, score, seeds, changes): score is the largest of the symbol's own impacts, seeds and changes are counts."""
    seed = F.col("kind") == "seed"
    rank = F.when(_count("unresolved") > 0, 2).when(_count("partial") > 0, 1).otherwise(0)
    rows = reach.select("symbol_id", "kind", "distance", rank.alias("rank"), sum(_count(x) for x in STATES).alias("n"), F.when(F.col("distance") == 0, F.col("score")).alias("own"))
    out = rows.groupBy("symbol_id").agg(
        F.min("distance").alias("distance"), F.max(F.when(seed, F.col("rank"))).alias("rank"), F.max("own").alias("score"),
        F.sum(F.when(seed, F.col("n"))).alias("seeds"), F.sum(F.when(~seed, F.col("n"))).alias("changes"),
    )
    kind = F.when(F.col("distance") == 0, "DIRECT").otherwise("INDIRECT").alias("impact_type")
    return out.select("symbol_id", "distance", kind, state_of(F.col("rank")).alias("state"), "score", "seeds", F.coalesce("changes", F.lit(0)).alias("changes"))


def _count(name: str):
    """Ids of a bitset, none where it is null."""
    return F.coalesce(F.bitmap_count(name), F.lit(0))


def _edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of which both ends are among nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


#: Rounds of trimming before nodes are coloured; what is left of long chains falls apart by colours.
TRIMS = 2


#: Nodes of a label that a turn starts from at once, a bit each.
STARTS = 62


def _both_ways(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, key, fw, bw): of start's bits, those whose rows reach each node along edges (a, b), and those that it reaches."""
    ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(True).alias("down"))
    ways = written(ways.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"), F.lit(False).alias("down"))), "ways")
    held = front = written(start, "masks")
    while not front.isEmpty():
        told = front.join(ways, "node").select(F.col("to").alias("node"), "key", F.expr("if(down, fw, 0L)").alias("fw"), F.expr("if(down, 0L, bw)").alias("bw"), F.lit(0).cast("long").alias("wf"), F.lit(0).cast("long").alias("wb"))
        both = held.withColumns({"wf": F.col("fw"), "wb": F.col("bw")}).unionByName(told.filter("fw <> 0 or bw <> 0"))
        both = written(both.groupBy("node", "key").agg(*[F.bit_or(c).alias(c) for c in ("fw", "bw", "wf", "wb")]), "masks")
        held, front = both.drop("wf", "wb"), both.filter("fw <> wf or bw <> wb").drop("wf", "wb")
    return held


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of a directed graph (a, b): two nodes share a component if each reaches the other.

    Turns, until no node is left. Nodes without an edge in or out are components of their own. Every label (one at first)
    then draws up to STARTS nodes anew and learns at once which of them reach each node and which it reaches: a node with
    one of both is in that one's component. All others are labelled by the two sets, which nodes of a component share; so
    edges between labels join no component and go, and what is left falls into many labels that go on side by side.
    """
    edges = written(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "scc-edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("key", F.lit(0).cast("long")), "scc-nodes")
    live, turn = edges.filter("a <> b"), 0
    done = nodes.limit(0).select("node", F.col("node").alias("component"))
    left = nodes.count()
    while left:
        turn += 1
        for _ in range(TRIMS):
            inner = nodes.join(live.select(F.col("a").alias("node")).distinct(), "node", "left_semi").join(live.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
            inner = written(inner, "scc-nodes")
            done = done.unionByName(nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")))
            was, left = left, inner.count()
            if left < was:
                nodes, live = inner, written(_edges_within(live, inner), "scc-edges")
            if left in (0, was):
                break
        if not left:
            break
        drawn = F.xxhash64(F.lit(turn), "node")
        begun = nodes.groupBy("key", F.pmod(drawn, F.lit(STARTS)).cast("int").alias("slot")).agg(F.min_by("node", F.struct(drawn.alias("h"), "node")).alias("node"))
        begun = written(begun.withColumn("fw", F.expr("shiftleft(1L, slot)")), "scc-starts")
        masks = _both_ways(begun.select("node", "key", "fw", F.col("fw").alias("bw")), live)
        masks = nodes.join(masks.drop("key"), "node", "left").withColumn("own", F.expr("fw & bw"))
        masks = written(masks.withColumn("least", F.expr("own & -own")), "scc-masks")
        found = masks.filter("own <> 0").select("node", "key", F.col("least").alias("fw"))
        done = done.unionByName(written(found.join(begun.select("key", "fw", F.col("node").alias("component")), ["key", "fw"]).select("node", "component"), "scc-found"))
        nodes = written(masks.filter("coalesce(own, 0) = 0").select("node", F.xxhash64("key", F.coalesce("fw", F.lit(0).cast("long")), F.coalesce("bw", F.lit(0).cast("long"))).alias("key")), "scc-nodes")
        same = live.join(nodes.withColumnsRenamed({"node": "a", "key": "ka"}), "a").join(nodes.withColumnsRenamed({"node": "b", "key": "kb"}), "b").filter("ka = kb")
        live, left = written(same.select("a", "b"), "scc-edges"), nodes.count()
    return written(done, "scc")


#: Components that stand for all that flows through them: at most so many, the largest ones of over LEAST nodes.
HUBS, LEAST = 2016, 64
#: Hubs of a mask's word.
WORD = 63


def _meet(a: str, b: str):
    """Whether two masks share a hub."""
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) != 0), lambda z: z)


def gathered(of: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(component, kind, n, total): how many items flow along edges (a, b) to each component, its own included, and the sum of their values.

    of: (node, component); edges join nodes; items: (node, kind, id, value), an id counts once wherever it is. What flows
    through one of the largest components, the hubs, is the same for all that lies behind it, so it is counted once for
    each set of hubs. Only items that reach a component past all hubs that it lies behind go on as bits, 64 to a row, by
    the hubs that they flow into.
    """
    spark = of.sparkSession
    between = edges.join(of.withColumnsRenamed({"node": "a", "component": "up"}), "a").join(of.withColumnsRenamed({"node": "b", "component": "down"}), "b")
    dag = written(between.filter("up <> down").select(F.col("up").alias("a"), F.col("down").alias("b")).distinct(), "condensed")
    largest = of.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > LEAST).orderBy(F.desc("size"), "component").limit(HUBS).collect()
    words = range(max(1, -(-len(largest) // WORD)))
    hubs = [(r["component"], k // WORD, 1 << k % WORD, 1 << k % WORD) for k, r in enumerate(largest)]
    masks = _both_ways(spark.createDataFrame(hubs, StructType([of.schema["component"]]).add("key", "integer").add("fw", "long").add("bw", "long")).withColumnRenamed("component", "node"), dag)
    word = lambda c, w: F.coalesce(F.max(F.when(F.col("key") == w, F.col(c))), F.lit(0).cast("long"))
    parts = of.select("component").distinct().join(masks.withColumnRenamed("node", "component"), "component", "left")
    parts = written(parts.groupBy("component").agg(F.array(*[word("fw", w) for w in words]).alias("behind"), F.array(*[word("bw", w) for w in words]).alias("ahead")), "parts")
    held = written(items.join(of, "node").groupBy("component", "kind", "id").agg(F.max("value").alias("value")).join(parts, "component"), "items")
    each = held.groupBy("kind", "id").agg(F.array(*[F.bit_or(F.col("ahead")[w]) for w in words]).alias("ahead"), F.min("component").alias("first"), F.max("value").alias("value"))
    each = written(each.repartitionByRange("kind", "ahead", "first").sortWithinPartitions("kind", "ahead", "first").withColumn("at", F.monotonically_increasing_id()), "numbers")
    by_mask = written(each.groupBy("kind", "ahead").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "by-mask")
    common = parts.select("behind").distinct().join(by_mask, _meet("behind", "ahead")).groupBy("behind", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    common = parts.join(written(common, "common"), "behind").select("component", "kind", "n", "total")
    keys = ["component", "kind", "ahead", "block"]
    own = held.drop("ahead", "value").join(each.select("kind", "id", "ahead", "at"), ["kind", "id"]).filter(~_meet("behind", "ahead"))
    own = own.groupBy("component", "kind", "ahead", F.expr("at >> 6").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    steps = written(dag.join(parts.select(F.col("component").alias("b"), "behind"), "b"), "steps")
    rest = front = written(own, "rest")
    while not front.isEmpty():
        told = front.withColumnRenamed("component", "a").join(steps, "a").filter(~_meet("behind", "ahead")).select(F.col("b").alias("component"), *keys[1:], "bits", F.lit(0).cast("long").alias("was"))
        both = rest.withColumn("was", F.col("bits")).unionByName(told).groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("was").alias("was"))
        both = written(both, "rest")
        rest, front = both.drop("was"), both.filter("bits <> was").drop("was")
    sets = rest.select("kind", "block", "bits").distinct()
    places = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1))
    sums = sets.withColumn("k", places).withColumn("at", F.expr("block * 64 + k")).join(each.select("kind", "at", "value"), ["kind", "at"]).groupBy("kind", "block", "bits").agg(F.sum("value").alias("total"))
    past = rest.join(sums, ["kind", "block", "bits"]).groupBy("component", "kind").agg(F.sum(F.bit_count("bits")).alias("n"), F.sum("total").alias("total"))
    return common.unionByName(past).groupBy("component", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def impacts_of(impacts: DataFrame, edges: DataFrame) -> DataFrame:
    """impacted's columns, and seeds_sum and changes_sum, the sums of ids that are numbers. Takes what spread takes.

    Symbols on a cycle share their seeds and changes. A symbol that reaches an UNRESOLVED seed is UNRESOLVED whatever its
    paths are; the paths of all others, which lead past none of the symbols that are settled so, are walked by spread.
    """
    impacts = written(impacts.filter("symbol_id is not null"), "impacts")
    edges = written(edges.filter("caller_id is not null and callee_id is not null").select("caller_id", "callee_id", "edge_id", "state"), "edges")
    flow = written(edges.select(F.col("callee_id").alias("a"), F.col("caller_id").alias("b")).distinct(), "flow")
    seeds = impacts.filter("impact_id is not null")
    listed = lambda kind, column: impacts.filter(F.col(column).isNotNull()).select(F.col("symbol_id").alias("node"), F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"), F.expr(f"try_cast({column} as bigint)").alias("value"))
    items = listed("seed", "impact_id").unionByName(listed("change", "change_id"))
    of = strong_components(flow)
    alone = items.select("node").distinct().join(of, "node", "left_anti").withColumn("component", F.col("node"))
    of = written(of.unionByName(alone.select(of.columns)), "scc")
    held = gathered(of, flow, items).groupBy("component").agg(*[F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name) for kind, c, name in (("seed", "n", "seeds"), ("change", "n", "changes"), ("seed", "total", "seeds_sum"), ("change", "total", "changes_sum"))])
    far = distances(items.select(F.col("node").alias("symbol_id")), edges)
    worst = distances(seeds.filter("certainty = 'UNRESOLVED'").select("symbol_id"), edges).select("symbol_id")
    open_ = written(far.join(worst, "symbol_id", "left_anti").select("symbol_id"), "open")
    own = impacts.join(open_, "symbol_id", "left_semi")
    walked = impacted(spread(own, edges.join(open_.withColumnRenamed("symbol_id", "caller_id"), "caller_id", "left_semi"))[0]).select("symbol_id", "state")
    states = worst.withColumn("state", F.lit("UNRESOLVED")).unionByName(walked)
    scores = seeds.groupBy("symbol_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    out = far.join(states, "symbol_id", "left").join(scores, "symbol_id", "left").join(of.withColumnRenamed("node", "symbol_id"), "symbol_id").join(held, "component")
    kind = F.when(F.col("distance") == 0, "DIRECT").otherwise("INDIRECT").alias("impact_type")
    return out.select("symbol_id", "distance", kind, "state", "score", "seeds", F.coalesce("changes", F.lit(0)).alias("changes"), "seeds_sum", "changes_sum")


def upstream_counts(edges: DataFrame) -> DataFrame:
    """(symbol_id, direct_callers, upstream_callers) of every called symbol; one on a cycle counts itself.

    Cycles are condensed, and callers are gathered down the calls: members of a cycle share one number, and no table of
    pairs is made of what flows through the largest cycles.
    """
    pairs = written(edges.filter("caller_id is not null and callee_id is not null").select(F.col("caller_id").alias("a"), F.col("callee_id").alias("b")).distinct(), "callers")
    direct = pairs.groupBy(F.col("b").alias("symbol_id")).agg(F.count("*").alias("direct_callers"))
    of = strong_components(pairs)
    n = gathered(of, pairs, of.select("node", F.lit("caller").alias("kind"), F.col("node").alias("id"), F.lit(None).cast("bigint").alias("value")))
    rows = direct.join(of.withColumnRenamed("node", "symbol_id"), "symbol_id").join(n.select("component", "n"), "component")
    selves = pairs.filter("a = b").select(F.col("a").alias("symbol_id"), F.lit(1).alias("self"))
    cyclic = of.groupBy("component").agg((F.count("*") > 1).alias("cyclic"))
    rows = rows.join(cyclic, "component").join(selves, "symbol_id", "left")
    return rows.select("symbol_id", "direct_callers", (F.col("n") - F.when(F.col("cyclic") | F.col("self").isNotNull(), 0).otherwise(1)).alias("upstream_callers"))
