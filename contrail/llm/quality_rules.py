"""Quality rules by weak supervision (operator 8).

Each rule looks at counts of a whole text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates how each rule votes on good texts and on each kind of bad text: rules that look at the
same fault are a family and share a kind, so that rules of one family correct one another and a fault of another family
is not outvoted. A text is kept when its posterior probability of being good reaches a threshold; a bad vote that the
rest of its family denies does not reject it. Spark counts the patterns, so that the driver sees at most 3 ** rules rows
whatever the corpus.

Very long texts are counted whole. Ties (a posterior equal to the threshold) are kept.
Null and empty texts have zero counts, fail the base test and are not kept. Repeated rows get equal results each. An empty
table gives an empty result (the model is then the prior one). Extra columns pass through; a column that has the name of
a result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, distinct, gram_hashes, gram_places, mix, owners, prefix_hash, range_hash, sums, text_udf

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_twins", "n_distinct", "n_upper", "n_letters", "n_lines")
_SYMBOL, _UPPER, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])))


def _repeats(keys: np.ndarray) -> np.ndarray:
    codes, _, first = distinct(keys)
    return first[codes] != np.arange(len(codes))


def count_texts(texts: pa.Array) -> pa.Array:
    """The COUNTS of each text as a struct array."""
    words = Words(texts)
    data, bounds, offsets, n = words.data, words.bounds, words.offsets, len(texts)
    hashes, of = words.hashes(), owners(words.offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside)[:-1] > 0

    edge = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
    begin, end = edge[:-1], edge[1:]
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if len(data) else end
    wordy = np.diff(np.searchsorted(words.start, np.append(begin, len(data)))) > 0
    begin, end = begin[wordy], end[wordy]
    line_of = np.searchsorted(bounds, begin, side="right") - 1
    lines = mix(range_hash(prefix_hash(data), begin, end) + mix(line_of.astype(np.uint64)))

    starts, owner = gram_places(offsets, WINDOW)
    grams = mix(gram_hashes(hashes, WINDOW)[starts] + mix(owner.astype(np.uint64))) if len(starts) else np.empty(0, np.uint64)
    codes, seen, _ = distinct(grams)
    again = starts[np.bincount(codes, minlength=len(seen))[codes] > 1] if len(starts) else starts
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    twins = np.zeros(len(hashes), bool)
    twins[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    found = {
        "n_words": np.diff(offsets),
        "word_chars": sums(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": sums(_SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(line_of[_repeats(lines)], minlength=n),
        "n_repeat_words": sums(np.cumsum(cover)[:-1] > 0, offsets),
        "n_twins": sums(twins, offsets),
        "n_distinct": sums(~_repeats(mix(hashes + mix(of.astype(np.uint64)))), offsets),
        "n_upper": sums(_UPPER[data], bounds),
        "n_letters": sums(_LETTER[data], bounds),
        "n_lines": np.bincount(line_of, minlength=n),
    }
    return pa.StructArray.from_arrays([pa.array(found[k].astype(np.int64)) for k in COUNTS], list(COUNTS))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column of COUNTS, spread out."""
    counted = text_udf(count_texts, "struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ">")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    return docs.select(*kept, counted(F.col(text)).alias("_counts")).select(*kept, "_counts.*")


@dataclass(frozen=True)
class Rule:
    """Votes good below (or above, if good > bad) one bound of a ratio of counts, bad beyond the other, else abstains."""

    name: str
    over: str
    under: str | None
    good: float
    bad: float
    family: str

    def vote(self) -> Column:
        x = F.col(self.over) / F.greatest(F.col(self.under), F.lit(1)) if self.under else F.col(self.over).cast("double")
        if self.good > self.bad:
            return F.when(x >= self.good, 1).when(x < self.bad, -1).otherwise(0)
        return F.when(x <= self.good, 1).when(x > self.bad, -1).otherwise(0)


RULES = (
    Rule("long_enough", "n_words", None, 40, 20, "short"),
    Rule("word_length", "word_chars", "n_words", 10, 14, "words"),
    Rule("word_not_tiny", "word_chars", "n_words", 3, 2, "words"),
    Rule("few_symbols", "n_symbols", "n_words", 0.05, 0.1, "symbols"),
    Rule("few_dup_lines", "n_dup_lines", "n_lines", 0.1, 0.3, "repetition"),
    Rule("few_repeats", "n_repeat_words", "n_words", 0.1, 0.25, "repetition"),
    Rule("few_twins", "n_twins", "n_words", 0.05, 0.15, "repetition"),
    Rule("rich_words", "n_distinct", "n_words", 0.3, 0.12, "repetition"),
    Rule("lower_case", "n_upper", "n_letters", 0.2, 0.5, "case"),
)


@dataclass(frozen=True)
class RuleModel:
    """P(kind) and P(vote | kind) for each rule over the votes -1, 0, 1; kind 0 is good, the others are bad, one a family."""

    prior: np.ndarray
    votes: np.ndarray = field(repr=False)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes."""
        logs = np.log(self.prior) + sum(np.log(self.votes)[j][:, votes[:, j] + 1].T for j in range(votes.shape[1]))
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        return share[:, 0] / share.sum(axis=1)

    def table(self, spark: SparkSession) -> DataFrame:
        """(pattern, quality) for each of the 3 ** rules patterns: that many rows whatever the corpus."""
        n = len(self.votes)
        votes = np.stack(np.meshgrid(*[[-1, 0, 1]] * n, indexing="ij"), axis=-1).reshape(-1, n)
        return spark.createDataFrame(pa.table({"pattern": np.arange(len(votes)), "quality": self.posterior(votes)}))

    def accuracy(self) -> np.ndarray:
        """For each rule, the share of its votes that are right: good votes on good texts, bad votes on bad ones."""
        right = self.prior[0] * self.votes[:, 0, 2] + self.votes[:, 1:, 0] @ self.prior[1:]
        return right / (right + self.prior[0] * self.votes[:, 0, 0] + self.votes[:, 1:, 2] @ self.prior[1:])


#: How a rule votes (bad, abstain, good) before anything is seen: on good texts, on bad texts of its own family, on other bad texts.
ON_GOOD, ON_OWN, ON_BAD = (0.002, 0.018, 0.98), (0.9, 0.05, 0.05), (0.02, 0.02, 0.96)
START_GOOD = 0.85


def start(families: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    kinds = list(dict.fromkeys(families))
    table = np.tile(np.array(ON_BAD), (len(families), len(kinds) + 1, 1))
    table[:, 0] = ON_GOOD
    table[np.arange(len(families)), [kinds.index(f) + 1 for f in families]] = ON_OWN
    return np.array([START_GOOD, *[(1 - START_GOOD) / len(kinds)] * len(kinds)]), table


def fit(patterns: list[tuple[tuple[int, ...], int]], families: Sequence[str], rounds: int = 200, strength: float = 0.05) -> RuleModel:
    """Expectation-maximisation over (votes, count). The start weighs as strength of all rows (1 row at least).

    No vote can tell the false alarms of a rule without family from the faults that it alone sees: its votes on good
    texts stay at ON_GOOD. All other tables are estimated.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), len(families)) + 1
    count = np.array([n for _, n in patterns], float)
    pseudo = max(1.0, strength * count.sum())
    first, begin = start(families)
    prior, table = first, begin
    alone = [list(families).count(f) == 1 for f in families]
    hot = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        logs = np.log(prior) + np.einsum("prv,rkv->pk", hot, np.log(table))
        share = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(count) else logs
        share = count[:, None] * share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        fresh = np.einsum("pk,prv->rkv", share, hot) + pseudo * begin
        fresh /= fresh.sum(axis=2, keepdims=True)
        fresh[alone, 0] = begin[alone, 0]
        known = share.sum(axis=0) + pseudo * first
        known /= known.sum()
        moved = max(np.abs(fresh - table).max(), np.abs(known - prior).max())
        prior, table = known, fresh
        if moved < 1e-9:
            break
    return RuleModel(prior, table)


def votes_of(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[r.vote().cast("int") for r in rules])


def learn(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> RuleModel:
    """Fit on the vote patterns of all rows; Spark counts them, 3 ** len(rules) rows at most."""
    rows = counted.groupBy(votes_of(rules).alias("votes")).agg(F.count("*").alias("n")).collect()
    return fit(sorted((tuple(r["votes"]), r["n"]) for r in rows), [r.family for r in rules])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(counted: DataFrame, model: RuleModel, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """counted rows with votes, quality (posterior), base_failed and kept."""
    kept = [F.col(f"`{c}`") for c in counted.columns if c not in ("votes", "quality", "base_failed", "kept")]
    code = sum((r.vote().cast("long") + 1) * 3 ** (len(rules) - 1 - k) for k, r in enumerate(rules))
    out = counted.select(*kept, votes_of(rules).alias("votes"), base_failed().alias("base_failed"), code.alias("_pattern"))
    known = model.table(counted.sparkSession).withColumnsRenamed({"pattern": "_pattern"})
    out = out.join(F.broadcast(known), "_pattern").drop("_pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
