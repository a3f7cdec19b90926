"""Longest streaks of consecutive hit seeds, from bitmaps.

A pair's hit seeds are kept as words of 64 bits, built by an aggregation that
combines before its shuffle.  The words of all pairs of a read, or-ed together,
are the seeds that hit anything; only those count, so a pair's word is squeezed
to their bits, a text of at most 64 characters in which streaks are rows of
ones.  Streaks that cross words touch a rim, and a word has two of those: no
window sees more than two rows per 64 seeds of one read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def seed_words(hits: DataFrame, pair: list[str], step: int, *extra: Column) -> DataFrame:
    """(pair, word, bits): the hit seeds of a pair, 64 seeds of the read a row, with further aggregates."""
    number = F.expr(f"qpos div {int(step)}")
    bit = F.expr("shiftleft(1L, cast(__no & 63 as int))")
    return (
        hits.withColumn("__no", number)
        .groupBy(*pair, F.expr(f"__no div {WORD}").alias("word"))
        .agg(F.bit_or(bit).alias("bits"), *extra)
    )


def _characters(word: str) -> Column:
    """The bits of a word as a text, lowest first."""
    return F.reverse(F.lpad(F.bin(word), WORD, "0"))


def _squeezed(bits: str, counted: str) -> Column:
    """The bits of ``bits`` at the places that ``counted`` has set, as a text of 0 and 1."""
    chosen = F.zip_with(
        F.split(_characters(counted), ""), F.split(_characters(bits), ""), lambda on, own: F.when(on == "1", own).otherwise("")
    )
    return F.when(F.col(bits) == F.col(counted), F.repeat(F.lit("1"), F.bit_count(counted))).otherwise(F.array_join(chosen, ""))


def longest_streaks(
    words: DataFrame, pair: list[str], scope: list[str], carry: str | None = None, all_words: DataFrame | None = None
) -> DataFrame:
    """(pair, streak) of seed words: the most seeds in a row that hit the pair.

    Seeds that hit no pair of the scope do not interrupt a streak.  ``carry``
    names a column of ``words`` whose maximum per pair is kept along.  Where ``words``
    leaves pairs out, ``all_words`` has the seeds (scope, word, bits) of all of them.
    """
    before = Window.partitionBy(*scope).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    counted = (words if all_words is None else all_words).groupBy(*scope, "word").agg(F.bit_or("bits").alias("counted"))
    counted = counted.withColumn("offset", F.coalesce(F.sum(F.bit_count("counted").cast("bigint")).over(before), F.lit(0)))
    text = words.join(counted, [*scope, "word"]).withColumn("own", _squeezed("bits", "counted"))
    n = F.length("own")
    lead = n - F.length(F.expr("trim(LEADING '1' FROM own)"))
    trail = n - F.length(F.expr("trim(TRAILING '1' FROM own)"))
    inside = F.array_max(F.transform(F.split("own", "0+"), F.length))
    measured = text.select(
        *pair, *([carry] if carry else []), "offset", n.alias("n"), lead.alias("lead"), trail.alias("trail"), inside.alias("inside")
    )
    # Streaks as (first, end, size); those at a rim may go on in the next word.
    first, end = F.col("offset"), F.col("offset") + F.col("n")
    piece = lambda a, b, size, rim: F.struct(a.alias("first"), b.alias("end"), size.cast("bigint").alias("size"), F.lit(rim).alias("rim"))
    pieces = F.array(
        F.when(F.col("lead") > 0, piece(first, first + F.col("lead"), F.col("lead"), True)),
        F.when((F.col("trail") > 0) & (F.col("lead") < F.col("n")), piece(end - F.col("trail"), end, F.col("trail"), True)),
        piece(first, end, F.col("inside"), False),
    )
    rows = measured.select(*pair, *([carry] if carry else []), F.explode(F.array_compact(pieces)).alias("p"))
    rows = rows.select(*pair, *([carry] if carry else []), "p.*")
    along = Window.partitionBy(*pair, "rim").orderBy("first")
    goes_on = F.col("rim") & F.coalesce(F.lag("end").over(along) == F.col("first"), F.lit(False))
    carried = [F.max(carry).alias(carry)] if carry else []
    return (
        rows.withColumn("breaks", F.when(goes_on, 0).otherwise(1))
        .withColumn("island", F.sum("breaks").over(along))
        .groupBy(*pair, "rim", "island")
        .agg(F.sum("size").alias("streak"), *carried)
        .groupBy(*pair)
        .agg(F.max("streak").alias("streak"), *carried)
    )
