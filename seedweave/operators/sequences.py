"""Row operators on sequence tables (seq_id, header, seq, seq_len)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.session import broadcast_if_small, write_stage

FORWARD, REVERSE = "+", "-"


def normalize_seq(df: DataFrame) -> DataFrame:
    """Upper-case the sequence; the length is taken after the change."""
    return df.withColumn("seq", text.normalize("seq")).withColumn("seq_len", F.length("seq"))


def both_strands(df: DataFrame, strict: bool = True) -> DataFrame:
    """Each sequence as strand '+' plus its reverse complement as strand '-'.

    Works for reads and for references; the row id stays the same on both.
    """
    flipped = df.withColumn("seq", text.reverse_complement("seq", strict=strict))
    return df.withColumn("strand", F.lit(FORWARD)).unionByName(flipped.withColumn("strand", F.lit(REVERSE)))


def forward_only(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", F.lit(FORWARD))


def split_reference(df: DataFrame, n: int) -> DataFrame:
    """Cut sequences into consecutive chunks of ``n`` characters.

    The header repeats on each chunk.  ``seq_id`` still names the parent; pass
    the result through ``number_rows`` to use the chunks as references of
    their own.
    """
    if n < 1:
        raise ValueError(f"chunk length must be positive, got {n}")
    keep = [c for c in df.columns if c not in ("seq", "seq_len")]
    chunked = df.select(*keep, F.posexplode_outer(text.pieces("seq", n)).alias("chunk_no", "seq"))
    # posexplode_outer keeps the optimizer from evaluating the cut twice; a
    # sequence without characters has no chunk.
    return chunked.where(F.col("chunk_no").isNotNull()).withColumn("seq_len", F.length("seq"))


def number_rows(df: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """Dense row numbers 0..n-1 in partition order, without a shuffle of the rows.

    Only one count per partition is aggregated; its running sum is joined back
    as an offset, so the window sees one row per partition.  The rows are
    written with their partition and place once: evaluated a second time, the
    input might come in other partitions.
    """
    marked = df.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    tagged = write_stage(marked, "marked-rows")
    counts = tagged.groupBy("_part").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = write_stage(offsets, "offsets")  # one row per partition
    others = [c for c in df.columns if c != id_col]
    return tagged.join(broadcast_if_small(offsets), "_part").select(
        (F.col("_offset") + F.col("_mono") - F.col("_first")).alias(id_col), *others
    )


def sort_sequences(df: DataFrame, by: str = "seq") -> DataFrame:
    """Range-partitioned sort: reads by text, references by length."""
    if by not in ("seq", "seq_len"):
        raise ValueError(f"sort by 'seq' or 'seq_len', got {by!r}")
    return df.orderBy(by, "seq_id")


def translate_headers(df: DataFrame, header_map: DataFrame) -> DataFrame:
    """Replace a header by its mapped name where the map (old, new) has one.

    A header that the map names several times gets the last of its names in
    text order.  Both sides shuffle unless Spark measures the map to be small.
    """
    names = header_map.groupBy(F.col("old").alias("header")).agg(F.max(F.translate("new", ";", "_")).alias("_new_header"))
    joined = df.join(names, "header", "left")
    return joined.select(
        *[F.coalesce("_new_header", "header").alias("header") if c == "header" else F.col(c) for c in df.columns]
    )


def lookup_taxid(refs: DataFrame, accession_map: DataFrame) -> DataFrame:
    """Attach ``tax_id`` by the accession in the header; -1 when unknown.

    An accession that the map has several times gets its largest taxon.  Neither side is forced to broadcast: an
    accession map of a public archive has hundreds of millions of rows.
    """
    keyed = refs.withColumn("accession", text.extract_accession("header"))
    known = accession_map.groupBy("accession").agg(F.max("tax_id").alias("_tax_id"))
    return (
        keyed.join(known, "accession", "left")
        .withColumn("tax_id", F.coalesce(F.col("_tax_id"), F.lit(-1)).cast("int"))
        .drop("accession", "_tax_id")
    )


def _digest(df: DataFrame) -> DataFrame:
    # 32 bytes stand for the whole text, so long texts do not travel.
    return df.select("seq_id", F.unhex(F.sha2(F.col("seq"), 256)).alias("digest"))


def _first_copies(df: DataFrame) -> DataFrame:
    return _digest(df).groupBy("digest").agg(
        F.min("seq_id").alias("first_id"), (F.count(F.lit(1)) - 1).alias("n_surplus")
    )


def duplicate_queries(reads: DataFrame) -> DataFrame:
    """(first_id, seq_id, n_surplus): every surplus copy and the read it repeats.

    One row per copy rather than one list per group, because a group of copies
    may hold any share of the reads.  Counting combines on the map side; the
    join back is skewed on the copies only, which adaptive execution splits.
    """
    firsts = _first_copies(reads).where("n_surplus > 0")
    return (
        _digest(reads)
        .join(firsts, "digest")
        .where("seq_id <> first_id")
        .select("first_id", "seq_id", "n_surplus")
    )


def skip_duplicates(reads: DataFrame) -> DataFrame:
    """Only the first of each group of identical reads."""
    firsts = _first_copies(reads).select(F.col("first_id").alias("seq_id"))
    return reads.join(firsts, "seq_id", "left_semi")


def unclassified_reads(reads: DataFrame, results: DataFrame) -> DataFrame:
    """Reads without a result row; ``results`` carries the read id as ``q``."""
    answered = results.select(F.col("q").alias("seq_id"))
    return reads.join(answered, "seq_id", "left_anti")
