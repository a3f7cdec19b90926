"""Tab-separated lookup files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_accession_taxid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(accession, tax_id) from an accession map with a header line.

    Fields: accession, accession.version (the key), taxid, gi.  A malformed
    row stops the read.
    """
    # The parser only reads the two columns asked for, so a short row shows as null.
    missing = F.raise_error(F.concat(F.lit("no tax id for accession "), F.coalesce("accession", F.lit("?")))).cast("int")
    schema = "base STRING, accession STRING, tax_id INT, gi STRING"
    return (
        spark.read.schema(schema)
        .options(sep="\t", header=True, mode="FAILFAST", enforceSchema=True)
        .csv(path)
        .select("accession", F.when(F.col("tax_id").isNull(), missing).otherwise(F.col("tax_id")).alias("tax_id"))
    )


def read_header_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(old, new) header names.  A row without two names stops the read."""
    rows = spark.read.schema("old STRING, new STRING").options(sep="\t", quote="", mode="FAILFAST").csv(path)
    missing = F.raise_error(F.concat(F.lit("no new name for header "), F.coalesce("old", F.lit("?")))).cast("string")
    return rows.select("old", F.when(F.col("old").isNull() | F.col("new").isNull(), missing).otherwise(F.col("new")).alias("new"))
