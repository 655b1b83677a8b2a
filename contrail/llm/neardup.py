"""Near-duplicates by bottom-k sketches (operator 4).

A text's set are its distinct shingles; one hash function orders them, and the SKETCH smallest values are kept. Equal sets
are one node. Inverted lists of the INDEX smallest values generate candidates; the estimate from the union of two sketches
filters them; the Jaccard similarity of the full sets decides.

No list is expanded into all of its pairs, and none is capped:
1. stars: in each list, every member against the first one. Most copies are linked here.
2. rare lists (at most RARE members): pairs that are not yet in one component. Members of frequent lists get further
   rare values from their whole sketch, so that a shared line or passage does not crowd out the rest of a text.
3. frequent lists: only texts that consist mostly of frequent values can be similar without sharing rare ones. Where such
   a list still holds several components, the full sets of its members are cut into frequent shingles and others. Members
   that share one of the others are compared. Of members with equal frequent shingles, the one with the fewest others
   stands for them; a star around it links those that are near to it. Between such representatives, a star around the
   one with the fewest others comes first; what is then still outside of its list's largest component is held against the
   list's representatives, pair by pair only where the frequent shingles that both have, counted in full, allow a link.
   At last, members that are not in the component of their own representative are held against the other
   representatives of that component. That is all: texts m and x that share none of the other shingles and are linked
   have representatives r and s with no more other shingles, so r and s are linked, m and s are, and x and r are. The
   pair (r, s) was found before; (m, s) is tested now, unless m and r, so s, share a component; likewise (x, r).

Two sets of similarity 0.8 share none of 12 values with a probability of about 0.2 ** 12, and fall below the estimate's
bound (5.5 standard deviations) with one of about 2e-8; all else is exact.

Null ids are linked like others; rows with a null id are kept only if no row that they reach has an id. Ties have no part.
Very long texts are read whole, one a step. Null texts and texts without words have an empty set and are linked with nothing. Texts with fewer words than a shingle
have one shingle, all their words. Repeated rows, of one id or several, fall into one component. An empty table gives an
empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise
from ._text import Words, gram_hashes, gram_places, mix, steps
from .components import components

SHINGLE, SKETCH, INDEX, RARE, PERCENT = 5, 48, 12, 16, 80
MOSTLY_FREQUENT, SIGMAS, SALTS = 0.5, 5.5, 32
#: Ids up to this number are broadcast to the scan of texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Sketches, texts and pairs of texts that one file or task holds, some MB.
SKETCHES_A_FILE, TEXTS_A_FILE, PAIRS_A_TASK = 20_000, 5_000, 1_000


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): text i has the sorted distinct shingle hashes values[bounds[i]:bounds[i + 1]] (int64)."""
    words = Words(texts, fold=True)
    hashes = words.hashes()
    start, owner = gram_places(words.offsets, shingle)
    values = gram_hashes(hashes, shingle)[start] if len(start) else np.empty(0, np.uint64)
    n = np.diff(words.offsets)
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            places = words.offsets[:-1][short]
            whole = np.full(len(short), k, np.uint64)
            for j in range(k):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[places + j])
            owner, values = np.r_[owner, short], np.r_[values, whole]
    values = values.view(np.int64)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.searchsorted(owner[keep], np.arange(len(texts) + 1)), values[keep]


def node_of(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketch(shingle: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            bounds, values = shingle_sets(batch.column("text"), shingle)
            n = np.diff(bounds)
            nodes = [node_of(values[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            held = np.minimum(n, size)
            cut = np.r_[0, np.cumsum(held)]
            flat = values[np.arange(cut[-1]) + np.repeat(bounds[:-1] - cut[:-1], held)]
            sketch = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), sketch], ["doc_id", "n", "node", "sketch"])

    return run


def _same_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Search:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, sketch: int, index: int, rare: int) -> None:
        self.docs, self.shingle, self.percent, self.index, self.rare = docs, shingle, percent, index, rare
        self.sketch_size = sketch
        self.spark = docs.sparkSession
        rows = docs.mapInArrow(_sketch(shingle, sketch), "doc_id bigint, n bigint, node binary, sketch array<bigint>")
        self.base = materialise(rows, "neardup-sketches")
        nodes = self.base.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.rows = self.base.count()
        self.nodes = materialise(nodes, "neardup-nodes", rows=self.rows, per_file=SKETCHES_A_FILE)
        self.found, self.most_found = None, 0

    def _rows_of(self, ids: DataFrame) -> DataFrame:
        """Texts of the rows with these ids; a null id stands for all rows without one, which their nodes tell apart."""
        ids = ids.select(F.col("doc_id").alias("_wanted"))
        return self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")

    def _lists(self, values: DataFrame) -> DataFrame:
        """(value, node, n) -> lists of two members or more, with their length and first member."""
        heads = values.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("head")).filter("members > 1")
        return materialise(values.join(heads, "value"), "neardup-lists")

    def _with_components(self, lists: DataFrame) -> DataFrame:
        return lists.join(self.found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _with_largest(self, lists: DataFrame) -> DataFrame:
        """Members of the lists that hold several components, with their own and the list's largest component."""
        lists = self._with_components(lists)
        by = lists.groupBy("value", "component").agg(F.count("*").alias("k")).groupBy("value").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
        return lists.join(by.select("value", F.col("most.component").alias("largest")), "value")

    def _test(self, pairs: DataFrame) -> None:
        """Filter candidate pairs (a, b) by sketch, verify the rest, and add what is linked."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sketches = self.nodes.select("node", "n", "sketch", "rep")
        both = pairs
        for side in ("a", "b"):
            both = both.join(sketches.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch", "rep")]), side)
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, F.greatest(F.lit(1), F.least(F.lit(self.sketch_size), F.greatest("n_a", "n_b"))).cast("int"))
        common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
        share = self.percent / 100
        bound = share - SIGMAS * (share * (1 - share) / self.sketch_size) ** 0.5
        likely = materialise(both.filter(common >= bound * F.size(union)).select("a", "b", "rep_a", "rep_b"), "neardup-likely")
        n = likely.count()
        if self.found is not None and not n:
            return
        ids = materialise(likely.select(F.col("rep_a").alias("doc_id")).unionByName(likely.select(F.col("rep_b").alias("doc_id"))).distinct(), "neardup-ids", rows=2 * n)
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        shingle, percent = self.shingle, self.percent

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                bounds, values = shingle_sets(batch.column("text"), shingle)
                nodes = [node_of(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], ["node", "text"])

        held = self._rows_of(wanted).mapInArrow(texts, "node binary, text string")
        held = materialise(held.dropDuplicates(["node"]), "neardup-texts", rows=2 * n, per_file=TEXTS_A_FILE)

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text_a"):
                for part in steps(iter([batch]), "text_b"):
                    (ba, va), (bb, vb) = (shingle_sets(part.column(c), shingle) for c in ("text_a", "text_b"))
                    common = np.array([len(np.intersect1d(va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]], assume_unique=True)) for i in range(part.num_rows)], np.int64)
                    linked = 100 * common >= percent * (np.diff(ba) + np.diff(bb) - common)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(linked))

        full = likely.select("a", "b")
        for side in ("a", "b"):
            full = full.join(held.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        links = materialise(full.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary"), "neardup-links", rows=n, per_file=PAIRS_A_TASK)
        self._add(links)

    def _add(self, links: DataFrame) -> None:
        """Join the components that links connect; only these links take part, not those of the steps before."""
        n = links.count()
        self.most_found += 2 * n
        if self.found is None:
            self.found = materialise(components(links, n), "neardup-components", rows=self.most_found)
            return
        known = self.found
        for side in ("a", "b"):
            of = self.found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
            links = links.join(of, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
        links = materialise(links, "neardup-links", rows=n)
        alone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(known, "node", "left_anti")
        known = known.unionByName(alone.select("node", F.col("node").alias("component")))
        met = components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), n).select(F.col("node").alias("component"), F.col("component").alias("_met"))
        joined = known.join(met, "component", "left").select("node", F.coalesce("_met", "component").alias("component"))
        self.found = materialise(joined, "neardup-components", rows=self.most_found)

    def run(self) -> DataFrame:
        """Stars, rare lists, frequent lists; gives (node, component)."""
        values = self.nodes.select("node", "n", F.explode(F.slice("sketch", 1, self.index)).alias("value"))
        lists = self._lists(values)
        close = lambda a, b: _same_size(F.col(a), F.col(b), self.percent)
        star = lists.filter((F.col("node") != F.col("head.node")) & close("n", "head.n"))
        self._test(star.select(F.col("head.node").alias("a"), F.col("node").alias("b")))

        frequent = lists.filter(F.col("members") > self.rare)
        touched = materialise(frequent.select("node").distinct(), "neardup-touched", rows=self.rows)
        wide = self.nodes.join(touched, "node", "left_semi").select("node", "n", F.explode("sketch").alias("value"))
        wide = self._lists(wide)
        rare_lists = lists.filter(F.col("members") <= self.rare).select("value", "node", "n").unionByName(wide.filter(F.col("members") <= self.rare).select("value", "node", "n")).distinct()
        self._test(self._pairs_in(rare_lists))

        counted = wide.filter(F.col("members") > self.rare).groupBy("node").agg(F.count("*").alias("k"))
        mostly = counted.join(self.nodes.select("node", F.size("sketch").alias("size")), "node").filter(F.col("k") >= MOSTLY_FREQUENT * F.col("size")).select("node")
        hot = materialise(self._with_largest(frequent.select("value", "node", "n").join(mostly, "node", "left_semi")), "neardup-frequent")
        if hot.isEmpty():
            return self.found
        sets, rare = self._frequent_parts(hot.select("node").distinct())
        hot = hot.select("value", "node").join(sets, "node")
        admitted = 100 * F.least("common", "common_a") >= self.percent * (F.greatest("common", "common_a") + F.col("own") + F.col("own_a"))
        mine = lambda *more: [F.col(c).alias(f"{c}_a") for c in ("node", "common", "own", *more)]
        heads = hot.groupBy("digest").agg(F.min(F.struct("own", "node", "common")).alias("h")).select("digest", "h.*")
        alike = sets.join(heads.select("digest", *mine()), "digest").filter((F.col("node") != F.col("node_a")) & admitted)
        reps = materialise(hot.join(heads.select("node"), "node", "left_semi"), "neardup-frequent")
        heads = reps.groupBy("value").agg(F.min(F.struct("own", "common", "node")).alias("h")).select("value", "h.*")
        star = reps.join(heads.select("value", *mine()), "value").filter((F.col("node") != F.col("node_a")) & admitted)
        pairs = alike.unionByName(star, allowMissingColumns=True).select(F.col("node_a").alias("a"), F.col("node").alias("b"))
        self._test(self._pairs_in(rare).unionByName(pairs))

        every = reps
        reps = materialise(self._with_largest(reps), "neardup-frequent")
        apart = reps.filter((F.col("component") != F.col("largest")) & (100 * F.col("common") >= self.percent * (F.col("common") + F.col("own"))))
        apart = apart.select("value", *mine("component", "index", "part", "lost"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = reps.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        first = F.col("value") == F.array_min(F.array_intersect("index", "index_a"))  # each pair once, in its first list
        shared = F.size(F.array_intersect("part", "part_a")) + F.least("lost", "lost_a")  # at most that many
        close = 100 * shared >= self.percent * (F.col("common") + F.col("common_a") - shared + F.col("own") + F.col("own_a"))
        pairs = salted.join(apart, ["value", "salt"]).filter((F.col("component") != F.col("component_a")) & admitted & first & close)
        self._test(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")))

        every = self._with_components(every)
        homes = every.groupBy("digest").agg(F.first("component").alias("home"))
        apart = self._with_components(sets).join(homes, "digest").filter((F.col("component") != F.col("home")) & (100 * F.col("common") >= self.percent * (F.col("common") + F.col("own"))))
        apart = materialise(apart.join(hot.select("value", "node"), "node").select("value", F.col("home").alias("component"), *mine("index", "part", "lost")), "neardup-apart")
        if apart.isEmpty():
            return self.found
        apart = apart.withColumn("salt", F.pmod(F.xxhash64("node_a"), F.lit(SALTS)).cast("int"))
        copied = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = copied.join(apart, ["value", "component", "salt"]).filter((F.col("node") != F.col("node_a")) & admitted & first & close)
        self._test(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")))
        return self.found

    def _frequent_parts(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Full sets of some nodes, cut at the shingles that over rare of them have.

        (node, common, own, digest, index, part, lost): how many frequent and other shingles a set has, a digest of the
        frequent ones, the sketch's index values, the frequent ones in 16 bits, and how many of them these bits confuse.
        (value, node, n): the lists of the other shingles that two sets or more have.
        """
        full = self._full_sets(nodes)
        lists = materialise(full.groupBy("value").agg(F.count("*").alias("members")), "neardup-values").filter("members > 1")
        held = full.join(lists.filter(F.col("members") > self.rare), "value").groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("set"))
        bits = F.array_distinct(F.transform("set", lambda x: (F.pmod(x, F.lit(65536)) - 32768).cast("smallint")))
        held = held.join(self.nodes.select("node", "n", F.slice("sketch", 1, self.index).alias("index")), "node")
        held = held.select("node", F.size("set").cast("long").alias("common"), F.md5(F.to_json("set")).alias("digest"), "n", "index", bits.alias("part"))
        held = held.select("node", "common", (F.col("n") - F.col("common")).alias("own"), "digest", "index", "part", (F.col("common") - F.size("part")).alias("lost"))
        rare = full.join(lists.filter(F.col("members") <= self.rare), "value").select("value", "node").join(self.nodes.select("node", "n"), "node")
        return materialise(held, "neardup-parts", rows=self.rows, per_file=SKETCHES_A_FILE), rare

    def _pairs_in(self, rare_lists: DataFrame) -> DataFrame:
        """(a, b): pairs of different components and like sizes within lists (value, node, n) of at most rare members."""
        groups = self._with_components(rare_lists).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("node", "n", "component"))).alias("x"), F.count_distinct("component").alias("k")).filter("k > 1")
        pairs = groups.select(F.posexplode("x").alias("i", "p"), "x").select("p", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("q"))
        pairs = pairs.filter((F.col("p.component") != F.col("q.component")) & _same_size(F.col("p.n"), F.col("q.n"), self.percent))
        return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))

    def _full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, value): the full sets of some nodes."""
        ids = materialise(self.nodes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "neardup-ids", rows=self.rows)
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        shingle = self.shingle

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                bounds, values = shingle_sets(batch.column("text"), shingle)
                held = [node_of(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))], ["node", "values"])

        rows = self._rows_of(wanted).mapInArrow(sets, "node binary, values array<bigint>").dropDuplicates(["node"])
        return materialise(rows.join(nodes, "node", "left_semi").select("node", F.explode("values").alias("value")), "neardup-full")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, sketch: int = SKETCH, index: int = INDEX, rare: int = RARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    component_id is the smallest id that links reach, the row's own included; kept marks the row that carries it.
    """
    search = _Search(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle, percent, sketch, index, rare)
    found = search.run()
    smallest = search.nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    smallest = materialise(smallest, "neardup-nodes")
    least = smallest.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = smallest.join(least, "component").select("node", "component_id")
    rows = search.base.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    out = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
