"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row.

    Without this the optimizer may copy ``value`` into a lambda of ``body``
    and evaluate it again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and 0x09-0x0D (null: empty)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))


def hash_fraction(*columns: Column) -> Column:
    """Uniform number in [0, 1) from the md5 of the columns' text, alike in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
