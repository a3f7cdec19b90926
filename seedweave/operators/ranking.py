"""Better strand and score groups.

A read may be scored against any number of references, so the best score is
aggregated per read (combined before the shuffle) and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions.score import printed
from seedweave.operators.sequences import FORWARD, REVERSE


def best_strand(scores: DataFrame) -> DataFrame:
    """All scores of each read's better strand; the forward strand wins ties."""
    shown = printed(F.col("score"))
    forward = F.max(F.when(F.col("strand") == FORWARD, shown))
    reverse = F.max(F.when(F.col("strand") != FORWARD, shown))
    best = (
        scores.groupBy("q")
        .agg(forward.alias("f"), reverse.alias("r"))
        .select("q", F.when(F.col("r").isNull() | (F.col("f") >= F.col("r")), FORWARD).otherwise(REVERSE).alias("strand"))
    )
    return scores.join(best, ["q", "strand"])


def score_groups(scores: DataFrame, top_only: bool = True) -> DataFrame:
    """Adds ``confident`` (the printed score) and ``grp``: 1 for the best score.

    The ranking window sees a read's distinct printed scores, of which there
    are at most a million.  Ranks grow with the reads and are never broadcast.
    """
    rounded = scores.withColumn("confident", printed(F.col("score")))
    if top_only:
        ranks = rounded.groupBy("q").agg(F.max("confident").alias("confident")).withColumn("grp", F.lit(1))
    else:
        w = Window.partitionBy("q").orderBy(F.col("confident").desc())
        ranks = rounded.select("q", "confident").distinct().withColumn("grp", F.row_number().over(w))
    return rounded.join(ranks.hint("merge"), ["q", "confident"])


def top_group_only(grouped: DataFrame) -> DataFrame:
    return grouped.where("grp = 1")
