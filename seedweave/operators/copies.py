"""Equal sequences under one leader, so that each text is classified once.

A group of copies may hold any share of the rows.  Groups are aggregations,
combined before their shuffle, and both joins back are salted: a leader with
more than ``rows_per_salt`` copies is repeated once per salt, and its copies
spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.operators.sequences import FORWARD, REVERSE
from seedweave.session import broadcast_if_small, write_stage

ROWS_PER_SALT = 100_000


def _digest(column: Column | str) -> Column:
    return F.unhex(F.sha2(column, 256))


def find_copies(df: DataFrame, id_col: str = "seq_id", strands: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(id, leader, head, n_salts, salt): who stands for each sequence.

    ``leader`` is the smallest id with the same text.  With ``strands``, a text
    and its reverse complement also share a ``head``, the smallest id of both;
    otherwise it is the leader.  A text that two reversals do not give back
    (they turn U into T) shares its head with equal texts only.  Only digests move.
    """
    own = _digest("seq")
    if strands:
        turned = text.reverse_complement("seq")
        both_ways = text.reverse_complement(turned, strict=False) == F.col("seq")
        key = F.when(both_ways, F.least(own, _digest(turned))).otherwise(own)
    else:
        key = own
    digests = write_stage(df.select(id_col, key.alias("key"), own.alias("own")), "digests")
    groups = digests.groupBy("key", "own").agg(F.min(id_col).alias("leader"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("n_salts", F.ceil(F.col("n") / rows_per_salt).cast("int"))
    # At most two texts have one key.
    heads = groups.groupBy("key").agg(F.min("leader").alias("head"))
    groups = write_stage(groups.join(heads, "key").select("own", "leader", "head", "n_salts"), "copy-groups")
    hot = groups.where("n_salts > 1").select("own", F.col("n_salts").alias("hot_salts"))
    salted = digests.drop("key").join(broadcast_if_small(hot), "own", "left").select(
        id_col, "own", F.pmod(F.xxhash64(id_col), F.coalesce("hot_salts", F.lit(1))).cast("int").alias("salt")
    )
    return salted.join(over_salts(groups), ["own", "salt"]).select(id_col, "leader", "head", "n_salts", "salt")


def over_salts(df: DataFrame) -> DataFrame:
    """Each row once for every salt from 0 to ``n_salts`` - 1."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))


def heads_only(df: DataFrame, copies: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """The rows that stand for all others."""
    heads = copies.where(F.col(id_col) == F.col("head")).select(id_col)
    return df.join(heads, id_col, "left_semi")


def turned_scores(scores: DataFrame, copies: DataFrame) -> DataFrame:
    """Scores of the heads, and of the leaders whose text is a head's reverse complement.

    Strand '-' of a text is strand '+' of the turned text, so only the names
    of the strands change.
    """
    turned = copies.where("seq_id = leader AND leader <> head").select(F.col("head").alias("q"), "leader")
    swapped = scores.join(turned, "q").withColumns(
        {"q": F.col("leader"), "strand": F.when(F.col("strand") == FORWARD, REVERSE).otherwise(FORWARD)}
    )
    return scores.unionByName(swapped.drop("leader"))


def fan_back(answers: DataFrame, copies: DataFrame, key: str = "q", id_col: str = "seq_id") -> DataFrame:
    """The leaders' rows, by ``key``, once for each of their copies."""
    sizes = copies.where(F.col(id_col) == F.col("leader")).select(F.col("leader").alias(key), "n_salts")
    spread = over_salts(answers.join(sizes, key)).drop("n_salts")
    members = copies.select(F.col("leader").alias(key), "salt", F.col(id_col).alias("_copy"))
    return spread.join(members, [key, "salt"]).withColumn(key, F.col("_copy")).drop("_copy", "salt")
