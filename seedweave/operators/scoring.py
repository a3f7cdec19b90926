"""Extension of runs into segments, and segments into scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions import score as S
from seedweave.functions import text
from seedweave.operators.index import RefBlocks
from seedweave.operators.matching import PAIR
from seedweave.operators.sequences import FORWARD, REVERSE
from seedweave.session import fits_broadcast, row_count

# Characters of reference text per row when flanks are looked up.
FLANK_BLOCK = 1024

RUN = [*PAIR, "n_seeds", "q_start", "r_start", "q_end", "r_end"]


def attach_query(runs: DataFrame, reads: DataFrame) -> DataFrame:
    """Text and length of each run's read, as its strand reads it.

    Joins the one stored copy of a read and derives the '-' strand after the
    join, so reverse complements never travel.
    """
    body = reads.select(F.col("seq_id").alias("q"), F.col("seq").alias("query"))
    return (
        runs.join(body, "q")
        .withColumn("query", _on_strand("query", "strand"))
        .withColumn("query_len", F.length("query"))
    )


def _on_strand(seq: str, strand: str):
    flipped = text.reverse_complement(seq, strict=False)
    return F.when(F.col(strand) == REVERSE, flipped).otherwise(F.col(seq))


def _text_blocks(texts: DataFrame, threshold: int, block: int) -> DataFrame:
    """Texts in rows of ``block`` characters plus a flank's overlap."""
    cut = text.overlapping_pieces("seq", block, threshold + 1)
    return texts.select(
        "of_read", "id", "strand", F.length("seq").alias("text_len"), F.posexplode_outer(cut).alias("block", "block_text")
    )


def _slice(name: str, of_read: bool, row_id: str, strand, at, n, block_of, block: int):
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(of_read).alias("of_read"),
        F.col(row_id).alias("id"),
        strand.alias("strand"),
        F.floor(block_of / block).alias("block"),
        at.cast("long").alias("at"),
        n.cast("int").alias("n"),
    )


def fetch_flanks(
    runs: DataFrame,
    reads: DataFrame,
    refs: DataFrame,
    threshold: int,
    block: int = FLANK_BLOCK,
    n_runs: int | None = None,
    stored: tuple[RefBlocks, ...] = (),
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Text on both sides of each run, from the read and from the reference.

    Adds query_len, ref_len, q_head, r_head (at most ``threshold`` characters
    before the run) and q_tail, r_tail (after it).

    A run asks for four slices and each lies in one block of one text, so there
    is a single join on (text, block): neither a long text nor one that many
    runs touch becomes one row or one task.  With few runs (counted) the
    requests are broadcast and no text moves at all.  Otherwise requests for
    reference text go to the buckets of its ``stored`` blocks and only they
    move; without those (or with blocks that overlap by less than a flank) the
    reference text is cut and shuffled.
    """
    few = fits_broadcast(4 * (row_count(runs) if n_runs is None else n_runs), 4 * threshold, broadcast_bytes)
    T = threshold
    if few or any(b.overlap < T + 1 for b in stored):
        stored = ()
    ref_block = stored[0].size if stored else block
    if any(b.size != ref_block for b in stored):
        stored, ref_block = (), block
    read_strand, no_strand = F.col("run.strand"), F.lit("")
    q_at = F.greatest(F.lit(0), F.col("run.q_start") - T)
    r_at = F.greatest(F.lit(0), F.col("run.r_start") - T)
    q_end, r_end = F.col("run.q_end"), F.col("run.r_end")
    # A tail counts from the block of the last matched character, which exists
    # even where nothing follows.
    wanted = F.array(
        _slice("q_head", True, "run.q", read_strand, q_at, F.col("run.q_start") - q_at, q_at, block),
        _slice("q_tail", True, "run.q", read_strand, q_end, F.lit(T), q_end - 1, block),
        _slice("r_head", False, "run.ref_id", no_strand, r_at, F.col("run.r_start") - r_at, r_at, ref_block),
        _slice("r_tail", False, "run.ref_id", no_strand, r_end, F.lit(T), r_end - 1, ref_block),
    )
    requests = runs.select(F.struct(*RUN).alias("run")).select("run", F.explode(wanted).alias("s")).select("run", "s.*")

    both = F.explode(F.array(F.lit(FORWARD), F.lit(REVERSE))).alias("strand")
    read_texts = reads.select(F.lit(True).alias("of_read"), F.col("seq_id").alias("id"), both, "seq")
    ref_texts = refs.select(F.lit(False).alias("of_read"), F.col("ref_id").alias("id"), no_strand.alias("strand"), "seq")
    if few:
        requests = F.broadcast(requests)
        asked_reads = runs.select(F.col("q").alias("id"), "strand").distinct()
        asked_refs = runs.select(F.col("ref_id").alias("id")).distinct()
        read_texts = read_texts.join(F.broadcast(asked_reads), ["id", "strand"], "left_semi")
        ref_texts = ref_texts.join(F.broadcast(asked_refs), "id", "left_semi")
    else:
        # Spark would judge them by the compressed files of the runs, of which they are four rows each.
        requests = requests.hint("merge")
    read_texts = read_texts.withColumn("seq", _on_strand("seq", "strand"))
    local = (F.col("at") - F.col("block") * F.when(F.col("of_read"), block).otherwise(ref_block) + 1).cast("int")
    shown = ["run.*", "of_read", "name", "text_len", F.col("block_text").substr(local, F.col("n")).alias("slice")]
    if stored:
        blocks = _text_blocks(read_texts, T, block)
        found = blocks.join(requests.where("of_read"), ["of_read", "id", "strand", "block"]).select(*shown)
        for part in stored:
            own = requests.where(~F.col("of_read") & (F.col("id") >= part.first) & (F.col("id") < part.end))
            own = own.withColumn("ref_id", F.col("id") - F.lit(part.first).cast("bigint"))
            found = found.unionByName(part.table.join(own, ["ref_id", "block"]).select(*shown))
    else:
        blocks = _text_blocks(read_texts.unionByName(ref_texts), T, block)
        found = blocks.join(requests, ["of_read", "id", "strand", "block"]).select(*shown)
    names = ["q_head", "r_head", "q_tail", "r_tail"]
    return found.groupBy(*RUN).agg(
        F.max(F.when(F.col("of_read"), F.col("text_len"))).alias("query_len"),
        F.max(F.when(~F.col("of_read"), F.col("text_len"))).alias("ref_len"),
        *[F.max(F.when(F.col("name") == n, F.col("slice"))).alias(n) for n in names],
    )


def extend_runs(flanked: DataFrame, threshold: int) -> DataFrame:
    """Segments (run columns, n_head, n_mid, n_tail, m) of all runs."""
    # Heads are compared from the run outwards.
    head = text.common_prefix_length(F.reverse("q_head"), F.reverse("r_head"), threshold)
    tail = text.common_prefix_length("q_tail", "r_tail", threshold)
    return _segments(flanked.withColumn("n_head", head).withColumn("n_tail", tail))


def keep_unextended(runs: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """The fast mode's segments: runs as they are, with the two text lengths."""
    read_lengths = reads.select(F.col("seq_id").alias("q"), F.length("seq").alias("query_len"))
    length = F.col("ref_len") if "ref_len" in refs.columns else F.length("seq")  # no text where the length is stored
    ref_lengths = refs.select("ref_id", length.alias("ref_len"))
    sized = runs.join(read_lengths, "q").join(ref_lengths, "ref_id")
    return _segments(sized.withColumn("n_head", F.lit(0)).withColumn("n_tail", F.lit(0)))


def _segments(runs: DataFrame) -> DataFrame:
    return (
        runs.withColumn("n_mid", (F.col("q_end") - F.col("q_start")).cast("int"))
        .withColumn("m", F.col("n_head") + F.col("n_mid") + F.col("n_tail"))
        .select(*RUN, "query_len", "ref_len", "n_head", "n_mid", "n_tail", "m")
    )


def segment_filter(segments: DataFrame, threshold: int) -> DataFrame:
    return segments.where(F.col("m") >= threshold)


def raw_score(segments: DataFrame) -> DataFrame:
    """One row per pair: sum_sq, considered, covered, pct and raw.

    Segments are first reduced per distinct start on the read, so the window
    that merges them sees at most one row per character of one read, however
    often a reference repeats.
    """
    starts = (
        segments.withColumn("s", F.col("q_start") - F.col("n_head"))
        .groupBy(*PAIR, "query_len", "ref_len", "s")
        .agg(
            F.max(F.col("s") + F.col("m")).alias("e"),
            F.sum(S.triangle(F.col("m"))).alias("sum_sq"),
            F.sum(F.col("m").cast("bigint")).alias("considered"),
        )
    )
    before = Window.partitionBy(*PAIR).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("e").over(before), F.lit(0))
    gain = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reached))
    return (
        starts.withColumn("gain", gain)
        .groupBy(*PAIR, "query_len", "ref_len")
        .agg(
            F.sum("sum_sq").alias("sum_sq"),
            F.sum("considered").alias("considered"),
            F.sum("gain").cast("int").alias("covered"),
        )
        .withColumn("pct", S.coverage_pct(F.col("covered"), F.col("query_len")))
        .withColumn("raw", S.raw_score(F.col("sum_sq"), F.col("considered"), F.col("pct")))
    )


def coverage(segments: DataFrame) -> DataFrame:
    """Read positions covered by the union of a pair's segments."""
    return raw_score(segments).select(*PAIR, "query_len", "covered", "pct")


def relative_score(scores: DataFrame) -> DataFrame:
    return scores.withColumn(
        "score", S.relative_score(F.col("raw"), F.col("query_len"), F.col("ref_len"))
    )


def drop_zero(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") > 0)
