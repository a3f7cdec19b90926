"""Learned decision lists over text statistics, as ordered Spark conditions.

``learn`` grows rules that reject documents by sequential covering: a rule is a
conjunction of thresholds on statistics, grown on two thirds of the labelled
rows for FOIL gain, pruned on the other third, and accepted while it is precise
enough there; rows that it covers are then set aside and the next rule is
grown.  ``verdict`` turns the ordered rules into one conditional expression.

Only DataFrame operations touch rows: each growth step is one aggregation whose
answer has a row per statistic and bin, whatever the number of labelled rows.

Defined results: a null or empty text has no words and all counts 0; rows
without a label teach nothing; contradictory labels of one document count as
bad when any of them is 0; without labels no rule is learned and only the base
rules decide; repeated rows are judged alike; other columns are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.llm.common import let, words_of
from seedweave.session import broadcast_if_small, write_stage

BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# How an expression finds a statistic: a column, or a field of a struct.
At = Callable[[str], Column]


@dataclass(frozen=True)
class Condition:
    """``feature > bound`` when ``above``, else ``feature <= bound``."""

    feature: str
    above: bool
    bound: float

    def column(self, at: At = F.col) -> Column:
        return at(self.feature) > self.bound if self.above else at(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


@dataclass(frozen=True)
class Rule:
    """Rejects a document for which all conditions hold."""

    conditions: tuple[Condition, ...]

    def column(self, at: At = F.col) -> Column:
        return reduce(lambda a, b: a & b, (c.column(at) for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _count(text: Column, pattern: str) -> Column:
    """How many single characters match ``pattern``."""
    return F.size(F.split(text, pattern, -1)) - 1


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the array."""

    def of_windows(windows: Column) -> Column:
        # Equal windows stand side by side once sorted by (hash, position).
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(a: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def covered(s: Column) -> Column:
            step = F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3))))
            return F.aggregate(step, F.lit(0), lambda total, x: total + x)

        repeats = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(repeats, let(let(ordered, starts), covered)).otherwise(F.lit(0))

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashed, of_windows))


def _word_stats(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def _line_stats(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus one struct column ``{prefix}stats`` of counts and ratios."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    w, ln = F.col("__words"), F.col("__lines")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_words = w["n_words"]
    # The symbol class is a fixed value of the base rules.
    counted = docs.withColumns(
        {
            "__words": let(words_of(F.col(text)), _word_stats),
            "__lines": let(lines, _line_stats),
            "__symbols": _count(body, "[#*$%&|<>]").cast("long"),
            "__capitals": _count(body, "[A-Z]").cast("long"),
            "__marks": _count(body, "[!?]").cast("long"),
        }
    )
    stats = F.struct(
        n_words,
        w["word_chars"].alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        ln["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
        ratio(w["word_chars"], n_words).alias("word_length"),
        ratio(F.col("__symbols"), n_words).alias("symbols_per_word"),
        ratio(ln["n_dup_lines"], ln["n_lines"]).alias("dup_line_share"),
        ratio(w["n_repeat_words"], n_words).alias("repeat_share"),
        ratio(F.col("__capitals"), w["word_chars"]).alias("capital_share"),
        ratio(F.col("__marks"), n_words).alias("marks_per_word"),
    )
    return counted.withColumn(f"{prefix}stats", stats).drop("__words", "__lines", "__symbols", "__capitals", "__marks")


FEATURES = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "marks_per_word")


def base_failed(at: At = F.col) -> Column:
    """Too short, or mostly repetition."""
    n_words, repeats = at("n_words"), at("n_repeat_words")
    return (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)


def verdict(rules: list[Rule], at: At = F.col) -> Column:
    """The number of the first rule that rejects the row, from 1; 0 keeps it."""
    first = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(rule.column(at), F.lit(number)).otherwise(first)
    return first


def learn(
    labelled: DataFrame,
    label: str = "quality",
    max_rules: int | None = None,
    max_conditions: int = 3,
    min_precision: float = 0.8,
    min_covered: int = 5,
    n_bins: int = 32,
) -> list[Rule]:
    """Ordered rejection rules from rows of ``FEATURES`` and ``label`` (0 is bad).

    ``n_bins`` quantiles per statistic are the thresholds tried; statistics
    that are mostly one value also get a threshold just at that value.  Rules
    are added until the next one is not precise enough or covers too few rows;
    each takes rows away, so this ends without ``max_rules``.
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    rows = labelled.where(F.col(label).isNotNull())
    quantiles = rows.groupBy((F.col(label) == 0).alias("bad")).agg(
        *[F.percentile_approx(F.col(f).cast("double"), probs, 10_000).alias(f) for f in FEATURES]
    )
    found = quantiles.collect()  # two rows at most
    if not any(r["bad"] for r in found):
        return []
    bounds = {f: _with_middles(sorted({0.0, *(float(x) for r in found for x in r[f])})) for f in FEATURES}
    bins = F.array(
        *[
            reduce(lambda a, b: a + b, [(F.col(f) > x).cast("int") for x in bounds[f]])
            for f in FEATURES
        ]
    )
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rest = write_stage(rows.select(bins.alias("bins"), fold.alias("prune"), (F.col(label) == 0).alias("bad")), "rule-bins")
    held = lambda c: F.col("bins")[c[0]] > c[2] if c[1] else F.col("bins")[c[0]] <= c[2]
    rules: list[Rule] = []
    while max_rules is None or len(rules) < max_rules:
        grown = _grow(rest.where(~F.col("prune")), held, max_conditions, bounds)
        if not grown:
            break
        kept, bad, good = _prune(rest.where(F.col("prune")), held, grown)
        if bad + good < min_covered or bad < min_precision * (bad + good):
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], above, bounds[FEATURES[f]][b]) for f, above, b in kept)))
        rest = rest.where(~reduce(lambda a, b: a & b, map(held, kept)))
    return rules


def _with_middles(values: list[float]) -> list[float]:
    """The values and the middles between neighbours, where a gap between two kinds is best cut."""
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def _middle_of_widest(ties: list[tuple[int, bool, int]], bounds) -> tuple[int, bool, int]:
    """Of conditions that are equally good, the middle one of the statistic that leaves most room for it."""

    def gap(f: int) -> tuple[float, float]:
        """Between which values the threshold may lie without a difference."""
        own, of = [b for g, _, b in ties if g == f], bounds[FEATURES[f]]
        return of[min(own)], of[min(max(own) + 1, len(of) - 1)]

    def room(f: int) -> float:
        of = bounds[FEATURES[f]]
        return (gap(f)[1] - gap(f)[0]) / ((of[-1] - of[0]) or 1.0)

    best = max(sorted({f for f, _, _ in ties}), key=room)
    side = [t for t in ties if t[0] == best]
    side = [t for t in side if t[1] == side[0][1]]
    return min(side, key=lambda t: abs(bounds[FEATURES[best]][t[2]] - sum(gap(best)) / 2))


def _histogram(rows: DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    """Per statistic the (bin, bad, good) counts: bounded by statistics times bins."""
    counts = (
        rows.select("bad", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good"))
    )
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in counts.collect():
        out.setdefault(r["feature"], []).append((r["bin"], r["bad"], r["good"]))
    return {f: sorted(v) for f, v in out.items()}


def _grow(rows, held, max_conditions, bounds) -> list[tuple[int, bool, int]]:
    """Conditions (statistic, above, bin) added one by one for the best FOIL gain."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < max_conditions:
        counts = _histogram(rows)
        if not counts:
            break
        bad, good = (sum(x[i] for x in next(iter(counts.values()))) for i in (1, 2))
        if not bad or not good:
            break
        base = math.log2(bad / (bad + good))
        best, ties = 1e-9, []
        for f in sorted(counts):
            for b in range(len(bounds[FEATURES[f]])):
                low = [sum(x[i] for x in counts[f] if x[0] <= b) for i in (1, 2)]
                for above, (p, n) in ((False, low), (True, (bad - low[0], good - low[1]))):
                    # Bin numbers count the bounds a value exceeds: "above" bound b is bin > b.
                    gain = p * (math.log2(p / (p + n)) - base) if p else 0.0
                    if gain > best + 1e-9:
                        best, ties = gain, []
                    if gain > 1e-9 and gain >= best - 1e-9:
                        ties.append((f, above, b))
        if not ties:
            break
        rule.append(_middle_of_widest(ties, bounds))
        rows = rows.where(held(rule[-1]))
    return rule


def _prune(rows, held, grown) -> tuple[list[tuple[int, bool, int]], int, int]:
    """The prefix of the rule with the best (bad - good) / (bad + good) on held-out rows."""
    prefixes = [grown[: i + 1] for i in range(len(grown))]
    tests = [reduce(lambda a, b: a & b, map(held, p)) for p in prefixes]
    got = rows.agg(
        *[F.coalesce(F.sum((t & F.col("bad")).cast("long")), F.lit(0)).alias(f"b{i}") for i, t in enumerate(tests)],
        *[F.coalesce(F.sum((t & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"g{i}") for i, t in enumerate(tests)],
    ).first()
    worth = lambda i: (got[f"b{i}"] - got[f"g{i}"]) / (got[f"b{i}"] + got[f"g{i}"]) if got[f"b{i}"] + got[f"g{i}"] else -1.0
    i = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
    return prefixes[i], got[f"b{i}"], got[f"g{i}"]


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics rows that have a label; a document labelled twice counts as its worst label."""
    worst = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__label"))
    # Of rows with one doc_id that with the smallest statistics, whichever task is first.
    narrow = stats.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("least")).select("doc_id", "least.*")
    return narrow.join(worst, "doc_id").withColumnRenamed("__label", "quality")


def rules_for(stats: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules for documents that pass the base rules, from the labels of those."""
    return learn(labelled_stats(stats.where(~base_failed()), labels), **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: its statistics, base_failed, rule (0: none) and kept."""
    stats = write_stage(with_stats(docs.select("doc_id", "text")).select("doc_id", "stats.*"), "text-stats")
    rules = rules_for(stats, labels, **options)
    judged = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that neither the base rules nor a learned rule rejects, with their own columns.

    The text is read twice: once for the statistics of labelled rows, which
    teach the rules, once to apply them in place.  While the labelled ids are
    few enough to be broadcast, no text is shuffled.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    labelled = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    learned = with_stats(labelled).select("doc_id", "stats.*")
    rules = rules_for(write_stage(learned, "text-stats"), labels, **options)
    judged = with_stats(docs, prefix="__")
    of = lambda name: F.col("__stats")[name]
    return judged.where(~base_failed(of) & (verdict(rules, of) == 0)).select(*docs.columns)
