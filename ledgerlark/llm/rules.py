"""Learned decision lists over text statistics.

Sequential covering: a rule grows one threshold condition at a time on two thirds of the labelled
rows, is cut back on the other third, and the rows it covers leave before the next rule is grown.
Every step is one Spark aggregation over the labelled rows: counts of both labels by statistic and
threshold step, which is a table of bounded size (statistics x steps) whatever the number of rows.
The result is an ordered list that turns into one Spark conditional expression.

Defined cases: without labelled rows, or without rows of the rejected label, the list is empty and
nothing is rejected by it; rows with a null label teach nothing; several labels of one id count as
the smallest; an empty or null text has only zeros and fails the base rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.statistics import shares, text_statistics
from ledgerlark.llm.tables import id_crc, stored
from ledgerlark.session import pin

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Steps:
    """Thresholds ``low + k * step`` for k from 1 to ``count`` that may be tried for a statistic."""

    low: float
    step: float
    count: int = 40

    def place(self, value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.count), F.floor((value - self.low) / self.step))).cast("int")

    def at(self, k: int) -> float:
        return round(self.low + k * self.step, 6)


#: Shares in steps of 1/40, sizes in steps that span ordinary prose.
STEPS = {name: Steps(0.0, 0.025) for name in (
    "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share",
    "top_word_share", "same_share", "short_share", "long_share", "line_end_share",
)} | {"word_length": Steps(0.0, 0.5), "line_words": Steps(0.0, 5.0), "log_words": Steps(0.0, 0.25)}


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        met = F.lit(True)
        for c in self.conditions:
            met = met & c.column()
        return met

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def decision(rules: Sequence[Rule]) -> Column:
    """Text of the first rule that holds, null if none does."""
    found: Column | None = None
    for rule in rules:
        found = F.when(rule.column(), F.lit(str(rule))) if found is None else found.when(rule.column(), F.lit(str(rule)))
    return F.lit(None).cast("string") if found is None else found


def _counts(rows: DataFrame) -> dict[tuple[str, bool, int], tuple[int, int]]:
    """(statistic, is a pruning row, step) to counts of (rejected, kept) labels."""
    names = list(STEPS)
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), STEPS[n].place(F.col(n)).alias("k")) for i, n in enumerate(names)]))
    found = rows.select("pruning", "reject", places.alias("p")).groupBy("p.s", "pruning", "p.k").agg(
        F.sum("reject").alias("bad"), F.sum(1 - F.col("reject")).alias("good")
    )
    return {(names[r["s"]], r["pruning"], r["k"]): (r["bad"], r["good"]) for r in found.collect()}


def _totals(counts: dict, pruning: bool) -> tuple[int, int]:
    first = next(iter(STEPS))
    own = [v for (s, p, _), v in counts.items() if s == first and p == pruning]
    return sum(v[0] for v in own), sum(v[1] for v in own)


def _best(counts: dict) -> tuple[float, Condition] | None:
    """The condition with the highest information gain on the growing rows; ties go to the first tried."""
    bad, good = _totals(counts, False)
    if not bad:
        return None
    prior, best = math.log2(bad / (bad + good)), None
    for name, steps in STEPS.items():
        own = [counts.get((name, False, k), (0, 0)) for k in range(steps.count + 1)]
        below = [0, 0]
        for k in range(1, steps.count + 1):
            below[0] += own[k - 1][0]
            below[1] += own[k - 1][1]
            for at_least, (b, g) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                gain = b * (math.log2(b / (b + g)) - prior) if b else 0.0
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, Condition(name, at_least, steps.at(k))
    return best


def learn_rules(
    labelled: DataFrame, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.8, min_rows: int = 3,
) -> list[Rule]:
    """Rules that find ``reject`` = 1 among rows with the statistics of ``STEPS``, ``pruning`` and ``reject``.

    A rule is kept if at least ``min_rows`` growing rows back it and its smoothed precision,
    (rejected + 1) / (rows + 2), reaches ``min_precision`` on the pruning rows.
    """
    rules: list[Rule] = []
    left = labelled
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        stages: list[tuple[float, int]] = []  # smoothed precision on pruning rows, growing rows found, by length
        covered = left
        while True:
            counts = _counts(covered)
            if conditions:
                (b, g), own = _totals(counts, True), _totals(counts, False)
                stages.append(((b + 1) / (b + g + 2), own[0]))
                if not own[1]:
                    break
            if len(conditions) == max_conditions or (found := _best(counts)) is None:
                break
            conditions.append(found[1])
            covered = covered.where(found[1].column())
        if not stages:
            break
        size = max(range(len(stages)), key=lambda i: (round(stages[i][0], 9), -i))
        if stages[size][0] < min_precision or stages[size][1] < min_rows:
            break
        rules.append(Rule(tuple(conditions[: size + 1])))
        left = left.where(~rules[-1].column())
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """The smallest label of each id; null ids and labels go."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(name).cast("int").alias("label"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base rule and learned verdict of each document, and the list that was learned.

    Learns from labelled documents that pass the base rule and whose id has a CRC-32 that is no
    multiple of 5, so a fifth of the labels stays unseen for measuring.
    """
    counted = stored(text_statistics(docs), "statistics").withColumn("base_failed", base_failed())
    derived = counted.select("*", *[c.alias(n) for n, c in shares().items()])
    known = derived.where(~F.col("base_failed") & (id_crc() % 5 != 0)).join(one_label(labels, "quality"), "doc_id")
    known = pin(known.select(*STEPS, (id_crc() % 3 == 0).alias("pruning"), (F.col("label") == 0).cast("int").alias("reject")))
    rules = learn_rules(known)
    return derived.withColumn("rule", F.when(~F.col("base_failed"), decision(rules))).select(
        "doc_id", *BASE_COLUMNS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", "text_key",
    ), rules
