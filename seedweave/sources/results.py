"""Result tables as ``;``-separated text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.operators import report

# The column names of the result files, in order.
RESULT_COLUMNS = ["InputID", "InputSequence", "Confident", "TaxIDs", "Occurence_Per_TaxID", "Headers"]
RESULT_SCHEMA = (
    "InputID BIGINT, InputSequence STRING, Confident STRING, TaxIDs STRING, Occurence_Per_TaxID STRING, Headers STRING"
)


def result_columns(results: DataFrame) -> DataFrame:
    """Results under the names of the result file."""
    sources = ["q", "query_header", "confident_text", "tax_ids", "occurrences", "headers"]
    extra = [c for c in results.columns if c == "tier"]
    return results.select(*extra, *[F.col(s).alias(n) for s, n in zip(sources, RESULT_COLUMNS)])


def write_results_tiered(
    results: DataFrame, path: str, hs: float = 0.4, bal: float = 0.7, hp: float = 1.0, sampled: bool = False
) -> None:
    """One folder per tier, ``;``-separated with a header line per file."""
    named = result_columns(report.tiers(results, hs, bal, hp, sampled))
    named.write.partitionBy("tier").option("sep", ";").option("header", True).csv(path)


def combine_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files of separately run jobs as one table."""
    if not paths:
        raise ValueError("no result paths to combine")
    reader = spark.read.schema(RESULT_SCHEMA).options(sep=";", header=True, enforceSchema=True)
    return reduce(DataFrame.unionByName, [reader.csv(p) for p in paths])
