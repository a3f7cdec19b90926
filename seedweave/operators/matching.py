"""From seeds and postings to chained runs of matching seeds.

Row keys: a *read* is (q, strand), a *pair* is (q, strand, db_id, ref_id).

One read may hit any share of the references and one seed any share of the
postings, so nothing here sorts or collects a whole read or a whole seed in
one task.  Windows run only over groups with a stated bound; everything else
is an aggregation (combined before its shuffle) joined back, where adaptive
execution splits a skewed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.operators.seed_filter import join_filtered
from seedweave.operators.streaks import longest_streaks, seed_words
from seedweave.session import broadcast_if_small, judged_by_rows, row_count, write_stage

READ = ["q", "strand"]
PAIR = ["q", "strand", "db_id", "ref_id"]
SCOPE = ["q", "strand", "db_id"]

# Reference positions per window of the run chaining.
CHAIN_BLOCK = 65_536


def seed_hits(
    seeds: DataFrame,
    postings: DataFrame,
    hot: DataFrame | None = None,
    n_seeds: int | None = None,
    k: int = 32,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Hits (q, strand, db_id, ref_id, qpos, rpos): seeds joined with postings.

    Few seeds (counted, of ``k`` characters) are broadcast, and the postings stream past them
    without a shuffle.  Otherwise both sides meet on the k-mer, and a filter
    of fixed size keeps k-mers that are no seed out of the shuffle.  A stored index
    spreads a frequent k-mer over several ``salt`` values; ``hot`` (kmer,
    n_salts) then copies that k-mer's seeds to each of them, so that the join
    follows the index's buckets and no bucket holds a whole frequent k-mer.
    ``broadcast_bytes`` bounds what is broadcast of the seeds themselves.
    """
    keys, found = ["kmer"], ["q", "strand", "db_id", "ref_id", "qpos", "rpos"]
    n_seeds = row_count(seeds) if n_seeds is None else n_seeds
    few = broadcast_if_small(seeds, n_seeds, 4 * k, broadcast_bytes)
    if few is not seeds:
        seeds = few
    elif hot is not None and "salt" in postings.columns:
        # `hot` grows with the index; Spark broadcasts it while it is small.
        n_salts = F.coalesce(F.col("n_salts"), F.lit(1))
        seeds = (
            seeds.join(hot, "kmer", "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
            .drop("n_salts")
        )
        keys = ["kmer", "salt"]
    else:
        return join_filtered(postings, seeds, n_seeds).select(*found)
    return postings.join(seeds, keys).select(*found)


def chain_runs(hits: DataFrame, step: int, adjacency: str = "sorted", block: int = CHAIN_BLOCK) -> DataFrame:
    """Chain hits into runs (pair keys, n_seeds, q_start, r_start, q_end, r_end).

    ``sorted``: in (rpos, qpos) order within a pair, a hit continues the run of
    the row before it when both positions advance by one step; a hit of another
    diagonal in between ends the run.  ``diagonal``: hits chain along their
    diagonal whatever lies between.  Ends are the last hit plus one step.
    ``sorted`` reads ``hits`` twice where three seeds of a read meet one place.
    """
    if adjacency == "diagonal":
        linked = _linked_on_diagonal(hits, step)
    elif adjacency == "sorted":
        linked = _linked_in_order(hits, step, block)
    else:
        raise ValueError(f"adjacency must be 'sorted' or 'diagonal', got {adjacency!r}")
    return linked.select(
        *PAIR,
        "n_seeds",
        "q_start",
        "r_start",
        (F.col("q_last") + step).alias("q_end"),
        (F.col("r_last") + step).alias("r_end"),
    )


def _extent(*extra):
    return [
        F.count(F.lit(1)).alias("n_seeds"),
        F.min("qpos").alias("q_start"),
        F.min("rpos").alias("r_start"),
        F.max("qpos").alias("q_last"),
        F.max("rpos").alias("r_last"),
        *extra,
    ]


def _linked_on_diagonal(hits: DataFrame, step: int) -> DataFrame:
    # A diagonal of a pair has at most one hit per seed of the read.
    keys = [*PAIR, "diagonal"]
    w = Window.partitionBy(*keys).orderBy("qpos")
    follows = F.coalesce(F.lag("qpos").over(w) == F.col("qpos") - step, F.lit(False))
    return (
        hits.withColumn("diagonal", F.col("rpos") - F.col("qpos"))
        .withColumn("starts", F.when(follows, 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(w))
        .groupBy(*keys, "run")
        .agg(*_extent())
    )


def _linked_in_order(hits: DataFrame, step: int, block: int) -> DataFrame:
    """Runs in sorted order, in blocks on both axes.

    Of the hits at one reference position only the first can continue a run and
    only the last can be continued; those between are runs of their own.  So
    the positions are reduced to their first and last hit, by an aggregation,
    before any window, and the hits between come from the few positions that
    have more than two.
    """
    ends = write_stage(
        hits.groupBy(*PAIR, "rpos").agg(F.min("qpos").alias("low"), F.max("qpos").alias("high"), F.count(F.lit(1)).alias("n")), "chain-ends"
    )
    outer = F.explode(F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high")))
    runs = _linked_in_blocks(ends.select(*PAIR, "rpos", outer.alias("qpos")), step, block)
    crowded = ends.where("n > 2").drop("n")
    n_crowded = row_count(crowded)
    if not n_crowded:
        return runs
    between = hits.join(broadcast_if_small(crowded, n_crowded), [*PAIR, "rpos"]).where("qpos > low AND qpos < high")
    single = between.select(
        *PAIR, F.lit(1).cast("bigint").alias("n_seeds"), F.col("qpos").alias("q_start"), F.col("rpos").alias("r_start"),
        F.col("qpos").alias("q_last"), F.col("rpos").alias("r_last"),
    )
    return runs.select(*single.columns).unionByName(single)


def _linked_in_blocks(hits: DataFrame, step: int, block: int) -> DataFrame:
    """Runs in sorted order of hits that are at most two for a reference position.

    Whether a hit continues a run depends on the row right before it, which is
    at most one step back or does not matter.  So each block of reference
    positions also receives the hits of the last step of the block before it
    (the halo), and blocks of one pair need not meet in one task: a window has
    at most ``2 * (block + step)`` rows.  Pieces of a run that crosses blocks
    are then joined along their diagonal.
    """
    home = F.floor(F.col("rpos") / block)
    blocks = F.when(
        F.col("rpos") % block >= block - step, F.array(home, home + 1)
    ).otherwise(F.array(home))
    placed = hits.select(*PAIR, "qpos", "rpos", F.explode(blocks).alias("block")).withColumn(
        "halo", F.col("block") != home
    )
    w = Window.partitionBy(*PAIR, "block").orderBy("rpos", "qpos")
    follows = F.coalesce(
        (F.lag("rpos").over(w) == F.col("rpos") - step) & (F.lag("qpos").over(w) == F.col("qpos") - step),
        F.lit(False),
    )
    marked = (
        placed.withColumn("follows", follows)
        .withColumn("crosses", F.col("follows") & F.lag("halo").over(w))
        .withColumn("piece", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(w))
    )
    # Grouping by the window's keys plus the piece needs no further shuffle.
    parts = (
        marked.where(~F.col("halo"))
        .groupBy(*PAIR, "block", "piece")
        .agg(*_extent(F.max(F.coalesce("crosses", F.lit(False))).alias("crosses")))
    )
    # Only parts at the rim of a block may belong together: one that crosses into it and those that end
    # in its last step.  The others stand alone in their window.
    rim = F.col("crosses") | (F.col("r_last") % block >= block - step)
    keys = [*PAIR, "diagonal", "alone"]
    along = Window.partitionBy(*keys).orderBy("q_start")
    return (
        parts.withColumn("diagonal", F.col("r_start") - F.col("q_start"))
        .withColumn("alone", F.when(rim, -1).otherwise(F.col("r_start")))
        .withColumn("run", F.sum(F.when(F.col("crosses"), 0).otherwise(1)).over(along))
        .groupBy(*keys, "run")
        .agg(
            F.sum("n_seeds").alias("n_seeds"),
            F.min("q_start").alias("q_start"),
            F.min("r_start").alias("r_start"),
            F.max("q_last").alias("q_last"),
            F.max("r_last").alias("r_last"),
        )
    )


def seed_streaks(words: DataFrame, carry: str | None = None, all_words: DataFrame | None = None) -> DataFrame:
    """Longest streak of consecutive hit seeds per pair, as ``streak``.

    Seeds of a read that hit anything in a database are numbered 0, 1, 2 ...;
    a streak is a row of consecutive numbers within one pair.
    """
    return longest_streaks(words, PAIR, SCOPE, carry, all_words)


def _streak_floor(best_streak):
    # References within one seed of the best streak stay, never below one.
    return F.greatest(F.lit(1), best_streak - 1)


# Hits for each pair of several seeds above which pairs of one seed are left out first.
HITS_PER_PAIR = 8


def _of_several_seeds(hits: DataFrame) -> DataFrame:
    """The hits of pairs that hit several seeds, or all hits where most pairs do."""
    ends = hits.groupBy(*PAIR).agg(F.min("qpos").alias("low"), F.max("qpos").alias("high"))
    several = write_stage(ends.where("low < high").select(*PAIR), "several-seeds")
    n_several, n_hits = row_count(several), row_count(hits)
    if n_several * HITS_PER_PAIR > n_hits:
        return hits
    few = broadcast_if_small(several, n_several)
    found = hits.join(few, PAIR, "left_semi")
    return judged_by_rows(write_stage(found, "several-hits"))


def consecutive_seed_filter(hits: DataFrame, step: int = 1, chained: bool = False) -> DataFrame:
    """Keep the hits of references whose longest streak is near the best.

    Judged per read, strand and database.  All hits of a kept reference stay.
    ``hits`` is read twice; ``step`` is the stride of its seeds, where known,
    and makes the bitmaps that judge them smaller.  ``chained`` says that only
    runs of two seeds or more matter to the caller: references that one seed of
    a read hit are left out early where they are most of all, as many are with
    short seeds.  They are never better than others, but their seeds count.
    """
    if chained:
        all_hits, hits = hits, _of_several_seeds(hits)
    else:
        all_hits = hits
    every = seed_words(all_hits, SCOPE, step) if all_hits is not hits else None
    streaks = seed_streaks(seed_words(hits, PAIR, step), all_words=every)
    best = streaks.groupBy(*SCOPE).agg(F.max("streak").alias("best"))
    kept = streaks.join(best, SCOPE).where(F.col("streak") >= _streak_floor(F.col("best"))).select(*PAIR)
    return hits.join(kept, PAIR, "left_semi")


def longest_run_filter(runs: DataFrame) -> DataFrame:
    """Keep the references tied on a read's longest run, of two seeds or more.

    All runs of a kept reference go on, shorter ones too.
    """
    longest = runs.groupBy(*PAIR).agg(F.max("n_seeds").alias("longest"))
    best = longest.groupBy(*READ).agg(F.max("longest").alias("best"))
    kept = longest.join(best, READ).where("best >= 2 AND longest = best").select(*PAIR)
    return runs.join(kept, PAIR, "left_semi")


def candidate_runs(runs: DataFrame, step: int) -> DataFrame:
    """Both reference filters at once, from runs of *all* hits.

    Equals consecutive_seed_filter on the hits, then chain_runs, then
    longest_run_filter: runs form within one pair and both filters judge whole
    pairs, so the hits need not be shuffled a second time.  The pairs of a read
    are reduced to their distinct (streak, longest) combinations before any
    window; a read with s seeds has at most s*s of them per database.
    """
    seeds_of_runs = runs.select(
        *PAIR, "n_seeds", F.explode(F.sequence("q_start", F.col("q_end") - step, F.lit(step))).alias("qpos")
    )
    pairs = seed_streaks(seed_words(seeds_of_runs, PAIR, step, F.max("n_seeds").alias("longest")), carry="longest")
    combos = pairs.select(*SCOPE, "streak", "longest").distinct()
    kept_combos = (
        combos.withColumn("best_streak", F.max("streak").over(Window.partitionBy(*SCOPE)))
        .where(F.col("streak") >= _streak_floor(F.col("best_streak")))
        .withColumn("best", F.max("longest").over(Window.partitionBy(*READ)))
        .where("best >= 2 AND longest = best")
        .select(*SCOPE, "streak", "longest")
    )
    kept = pairs.join(kept_combos, [*SCOPE, "streak", "longest"], "left_semi").select(*PAIR)
    return runs.join(kept, PAIR, "left_semi")
