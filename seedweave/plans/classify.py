"""The whole classification, reads against an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from seedweave.operators import kmers, matching, ranking, report, scoring
from seedweave.operators import sequences as seqs
from seedweave.operators.index import Index, build_index
from seedweave.operators.scan import scan_postings
from seedweave.params import DEFAULT_THRESHOLD, MatchParams
from seedweave.session import fits_broadcast, judged_by_rows, row_count, write_stage

MODES = ("sensitive", "fast")


def score_reads(
    reads: DataFrame,
    refs: DataFrame | Index,
    threshold: int = DEFAULT_THRESHOLD,
    mode: str = "sensitive",
    strands: bool = True,
    adjacency: str = "sorted",
    spread: int | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Scores (pair keys, sums, raw, score) of all candidates of all reads.

    ``refs`` is a normalized sequence table or an Index.  ``strands`` also
    tries the reverse complement of each read.  ``spread`` redistributes a
    reference table that has fewer splits than the cluster has cores; leave it
    out where files already split well, since it moves the reference text.
    ``broadcast_bytes`` bounds each broadcast of seeds or slices; 0 rules them out.

    References are judged by their seed streaks before anything is chained.
    Hits, runs and candidate runs are written stages: all feed several
    consumers, and the k-mer join behind them must not run twice.  What Spark
    broadcasts of them is judged by their rows, not by their compressed files.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    MatchParams(threshold)
    reads = seqs.normalize_seq(reads)
    if not isinstance(refs, Index):
        table = refs.repartition(spread) if spread else refs
        refs = build_index(seqs.normalize_seq(table), threshold)
    index = refs
    if index.threshold > threshold:
        raise ValueError(f"the index was built with threshold {index.threshold}, above {threshold}")
    seed_params = MatchParams(index.threshold)

    n_seeds = kmers.seed_count(reads, index.threshold) * (2 if strands else 1)
    stranded = seqs.both_strands(reads) if strands else seqs.forward_only(reads)
    seeds = kmers.query_seeds(stranded, index.threshold)
    postings = index.postings
    if index.complete and fits_broadcast(n_seeds, 4 * seed_params.k, broadcast_bytes):
        postings = scan_postings(index.refs, seeds, seed_params.k)
    sources = [(p.postings, p.hot) for p in index.parts] if index.parts and postings is index.postings else [(postings, index.hot)]
    hits = reduce(DataFrame.unionByName, [matching.seed_hits(seeds, p, hot, n_seeds, seed_params.k, broadcast_bytes) for p, hot in sources])
    hits = judged_by_rows(write_stage(hits, "hits"))
    near = matching.consecutive_seed_filter(hits, seed_params.step, chained=True)
    runs = judged_by_rows(write_stage(matching.chain_runs(near, seed_params.step, adjacency), "runs"))
    candidates = write_stage(matching.longest_run_filter(runs), "candidates")
    n_runs = row_count(candidates)
    candidates = judged_by_rows(candidates, n_runs)

    if mode == "fast":
        segments = scoring.keep_unextended(candidates, reads, index.refs)
    else:
        flanked = scoring.fetch_flanks(
            candidates, reads, index.refs, threshold,
            n_runs=n_runs, stored=index.blocks, broadcast_bytes=broadcast_bytes,
        )
        segments = scoring.extend_runs(flanked, threshold)
    kept = scoring.segment_filter(segments, threshold)
    return scoring.drop_zero(scoring.relative_score(scoring.raw_score(kept)))


def classify_scores(reads: DataFrame, refs: DataFrame | Index, top_only: bool = True, **options) -> DataFrame:
    """Long form of the answer: one row per read, score group and reference."""
    scores = judged_by_rows(write_stage(score_reads(reads, refs, **options), "scores"))
    return ranking.score_groups(ranking.best_strand(scores), top_only)


def classify(
    reads: DataFrame,
    refs: DataFrame | Index,
    threshold: int = DEFAULT_THRESHOLD,
    mode: str = "sensitive",
    top_only: bool = True,
    part_size: int | None = None,
    **options,
) -> DataFrame:
    """Result rows: the best references of each read with their taxon vote.

    ``part_size`` bounds the references that one row names; a read that ties
    on more gets several rows, told apart by ``part_no``.
    """
    if not isinstance(refs, Index):
        spread = options.pop("spread", None)
        table = refs.repartition(spread) if spread else refs
        refs = build_index(seqs.normalize_seq(table), threshold)
    grouped = classify_scores(reads, refs, top_only, threshold=threshold, mode=mode, **options)
    return report.report(grouped, refs.refs.drop("seq"), reads, part_size)


def classify_tiers(
    reads: DataFrame, refs: DataFrame | Index, hs: float = 0.4, bal: float = 0.7, hp: float = 1.0, **options
) -> DataFrame:
    """Result rows once per tier they reach.

    The index knows whether its k-mers are a sample, and only a whole index
    vouches for the high-precision tier.
    """
    results = write_stage(classify(reads, refs, **options), "results")
    return report.tiers(results, hs, bal, hp, sampled=isinstance(refs, Index) and refs.sampled)


def classify_fast(reads: DataFrame, refs: DataFrame | Index, **options) -> DataFrame:
    """Classification without extending runs beyond their seeds."""
    return classify(reads, refs, mode="fast", **options)
