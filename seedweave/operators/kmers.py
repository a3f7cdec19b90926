"""K-mers of references and seeds of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.operators.sequences import FORWARD
from seedweave.params import MatchParams

# Characters of reference text per exploded piece.  A piece's k-mers live in
# one row's array, so this also bounds that array.
PIECE = 1024
# Pieces per row that moves when the text of long references is spread.
PIECES_MOVED = 64


def ref_kmers(refs: DataFrame, k: int, piece: int = PIECE, skip_all_n: bool = True, spread: int | None = None) -> DataFrame:
    """Postings (db_id, ref_id, rpos, kmer): every k-mer of every reference.

    A narrow two-step explosion: text into pieces that overlap by k-1, pieces
    into k-mers.  No row ever holds more than one piece's k-mers, but
    the pieces of one reference are cut in one task.  With ``spread``, references
    are cut into long pieces first and these are dealt to that many partitions,
    so the k-mers of one chromosome are cut in many tasks; the text moves once,
    before it becomes k-mers.  The ``_outer`` forms keep the
    optimizer from adding a size filter that would run the cut a second time.
    """
    keys = ["db_id", "ref_id"]
    if "db_id" not in refs.columns:
        refs = refs.withColumn("db_id", F.lit(0))
    # No filter on the text's length: it would evaluate an upstream text
    # expression once more, and a short text yields no k-mer anyway.
    start = F.lit(0)
    if spread:
        long = PIECES_MOVED * piece
        refs = refs.select(*keys, F.posexplode_outer(text.overlapping_pieces("seq", long, k - 1)).alias("long_no", "seq"))
        refs = refs.repartition(spread, "ref_id", "long_no")
        start = F.col("long_no") * long
    # A short rest behind the last start of a long piece has fewer than k characters, so no k-mer comes twice.
    cut = refs.select(
        *keys, start.alias("start"), F.posexplode_outer(text.overlapping_pieces("seq", piece, k - 1)).alias("piece_no", "piece")
    )
    words = cut.select(*keys, "start", "piece_no", F.posexplode_outer(text.kmers_of("piece", k)).alias("i", "kmer"))
    kept = words.where(F.col("kmer").isNotNull())
    if skip_all_n:
        kept = drop_all_n(kept, k)
    return kept.select(*keys, (F.col("start") + F.col("piece_no") * piece + F.col("i")).alias("rpos"), "kmer")


def drop_all_n(kmers: DataFrame, k: int) -> DataFrame:
    """A k-mer made of N only says nothing about position."""
    return kmers.where(F.col("kmer") != F.lit("N" * k))


def min_query_len(reads: DataFrame, threshold: int) -> DataFrame:
    """Reads shorter than the threshold cannot score."""
    return reads.where(F.length("seq") >= threshold)


def query_seeds(reads: DataFrame, threshold: int, steps_per_piece: int = 32) -> DataFrame:
    """Seeds (q, strand, qpos, kmer) at 0, step, 2*step ... below len - T.

    A read no longer than T has none.  Reads are cut into pieces of a whole
    number of steps first, so that a long read costs time linear in its text.
    """
    p = MatchParams(threshold)
    if "strand" not in reads.columns:
        reads = reads.withColumn("strand", F.lit(FORWARD))
    size = p.step * steps_per_piece
    cut = reads.where(F.length("seq") > threshold).select(
        F.col("seq_id").alias("q"),
        "strand",
        F.length("seq").alias("len"),
        F.posexplode_outer(text.overlapping_pieces("seq", size, p.k - 1)).alias("piece_no", "piece"),
    )
    offsets = F.sequence(F.lit(0), F.lit(size - p.step), F.lit(p.step))
    spread = cut.select(
        "q", "strand", "len", "piece", (F.col("piece_no") * size).alias("base"), F.explode(offsets).alias("at")
    )
    return (
        spread.withColumn("qpos", F.col("base") + F.col("at"))
        .where(F.col("qpos") < F.col("len") - threshold)
        .select("q", "strand", "qpos", F.substring("piece", F.col("at") + 1, p.k).alias("kmer"))
    )


def seed_count(reads: DataFrame, threshold: int) -> int:
    """Exact number of seeds, from the text lengths alone."""
    p = MatchParams(threshold)
    per_read = F.greatest(F.lit(0), F.ceil((F.length("seq") - threshold) / F.lit(p.step)))
    return reads.agg(F.coalesce(F.sum(per_read), F.lit(0)).alias("n")).first()["n"]
