"""Mixing sources to target weights by Poisson replication.

A document of a source is repeated k times, where k is drawn from a Poisson
distribution whose mean is the source's repetition rate: target weight times
the size of the mixture over the source's documents.  The draw inverts the
distribution at a number hashed from seed and document, so it is the same on
every run and every executor, and needs no state.  Copies are then ordered by
another hash: a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.llm.common import hash_fraction, let
from seedweave.session import broadcast_if_small, write_stage

# Up to this mean exp(-mean) is a normal number and terms are summed from 0.
SUM_FROM_ZERO = 700.0


def most_copies(mean: Column | float) -> Column:
    """A count beyond which the distribution's tail is below 2**-53 (Bernstein's bound)."""
    mean = F.lit(mean)
    return F.ceil(mean + 12.34 + F.sqrt(74 * mean + 153)).cast("int")


def _first_term(mean: Column) -> tuple[Column, Column]:
    """(k, P(X = k)) where summing starts: 0, or 9 deviations below a large mean, with less than 2**-53 before it."""
    k = F.floor(mean - 9 * F.sqrt(mean)).cast("double")
    # Stirling's series for k!, written so that no large numbers cancel.
    log_term = (k - mean) - k * F.log1p((k - mean) / mean) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    near = mean <= SUM_FROM_ZERO
    return F.when(near, F.lit(0)).otherwise(k.cast("int")), F.when(near, F.exp(-mean)).otherwise(F.exp(log_term))


def poisson_inverse(u: Column, mean: Column, top: Column | int) -> Column:
    """The smallest k with P(X <= k) > u for a Poisson X, at most ``top``.

    Terms are summed upwards as term(k) = term(k - 1) * mean / k, at any mean;
    a large mean only skips terms that together are below the steps of ``u``.
    """
    first, term = _first_term(mean)

    def inverse(given: Column) -> Column:
        start = F.struct(given["term"].alias("term"), given["term"].alias("total"), given["first"].alias("k"))

        def step(s: Column, i: Column) -> Column:
            term = s["term"] * given["mean"] / i
            more = F.struct(term.alias("term"), (s["total"] + term).alias("total"), (s["k"] + 1).alias("k"))
            return F.when(given["u"] < s["total"], s).otherwise(more)

        ks = F.transform(F.sequence(given["first"] + 1, F.greatest(given["top"], given["first"] + 1)), lambda i: i.cast("double"))
        return F.aggregate(ks, start, step, lambda s: s["k"])

    return let(F.struct(u.alias("u"), mean.alias("mean"), F.lit(top).alias("top"), first.alias("first"), term.alias("term")), inverse)


def repetition_rates(docs: DataFrame, weights: dict[str, float], other: float, epoch: float = 1.0) -> DataFrame:
    """(source, mean): one row per source of ``docs``; null is a source of its own.

    A source's share of the mixture is its weight over the weights of all
    sources present; ``other`` is the weight of those not named.  ``epoch``
    scales the size of the mixture, 1 being the number of documents.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(other))
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    row = total.first()
    all_n, all_w = (row["all_n"] or 0), (row["all_w"] or 0.0)
    size = F.lit(float(epoch) * all_n)
    share = F.col("w") / F.lit(all_w) if all_w else F.lit(0.0)
    return weighed.select("source", (share * size / F.col("n")).alias("mean"))


def mixed(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epoch: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` with ``copies`` and ``copy_no`` (from 1): one row per copy, not yet shuffled.

    Rates are found per source and brought to the documents by a join on the
    source; their table has a row per source and is broadcast while its counted
    size is small, so that a source with any share of the documents stays
    where it is; beyond that the join splits it.  A document
    drawn 0 times is left out: that is what a rate below 1 means.  A row's
    draw depends on doc_id alone (null is hashed as an empty string), so
    repeated rows are drawn alike.  An empty table gives an empty table.
    """
    rates = repetition_rates(docs, weights, other, epoch)
    mean = F.col("__mean")
    u = hash_fraction(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = rates.select(F.col("source").alias("__source"), F.col("mean").alias("__mean"))
    named = broadcast_if_small(write_stage(named, "rates"), width=256)
    drawn = docs.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "copies", poisson_inverse(u, mean, most_copies(mean))
    )
    shown = drawn.drop("__source", "__mean").where(F.col("copies") > 0)
    return shown.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def shuffle_key(seed: int = 17) -> Column:
    """Position of a copy in the global order: a hash of seed, document and copy."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(f"order{seed}"), doc, F.col("copy_no").cast("string")).cast("binary"))


def shuffled(copies: DataFrame, seed: int = 17) -> DataFrame:
    """All copies in the order of their hashed position, which stays as ``shuffle_key``."""
    return copies.withColumn("shuffle_key", shuffle_key(seed)).orderBy("shuffle_key")
