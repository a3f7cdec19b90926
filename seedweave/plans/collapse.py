"""Classification in which equal texts are scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seedweave.operators import copies, ranking, report
from seedweave.operators import sequences as seqs
from seedweave.operators.index import Index, build_index, refs_meta
from seedweave.params import DEFAULT_THRESHOLD
from seedweave.plans.classify import score_reads
from seedweave.session import judged_by_rows, write_stage


def classify_collapsed(
    reads: DataFrame,
    refs: DataFrame | Index,
    threshold: int = DEFAULT_THRESHOLD,
    top_only: bool = True,
    strands: bool = True,
    rows_per_salt: int = copies.ROWS_PER_SALT,
    **options,
) -> DataFrame:
    """The rows of ``classify``, from one scoring per distinct text.

    Reads with the same text, or with ``strands`` the reverse complement, share
    a head; so do references with the same text.  Heads meet heads, then the
    scores are ranked once per distinct read, the references' copies join the
    taxon vote, and the finished rows go out to the reads' copies.  The
    references of an Index stay as they are, since its k-mers are made already.
    """
    reads = seqs.normalize_seq(reads)
    same_reads = judged_by_rows(write_stage(copies.find_copies(reads, strands=strands, rows_per_salt=rows_per_salt), "read-copies"))
    distinct = copies.heads_only(reads, same_reads)
    if isinstance(refs, Index):
        same_refs, index, meta = None, refs, refs.refs
    else:
        meta = refs_meta(seqs.normalize_seq(refs))
        same_refs = judged_by_rows(write_stage(copies.find_copies(meta, "ref_id", rows_per_salt=rows_per_salt), "reference-copies"))
        index = build_index(copies.heads_only(meta, same_refs, "ref_id"), threshold)
    scores = judged_by_rows(write_stage(score_reads(distinct, index, threshold, strands=strands, **options), "scores"))
    grouped = ranking.score_groups(ranking.best_strand(copies.turned_scores(scores, same_reads)), top_only)
    if same_refs is not None:
        grouped = copies.fan_back(grouped.select(*report.GROUP, "ref_id"), same_refs, "ref_id", "ref_id")
    members = judged_by_rows(write_stage(report.with_reference(grouped, meta), "members"))
    answers = judged_by_rows(write_stage(report.answers(members), "answers"))
    return report.named(copies.fan_back(answers, same_reads), reads)
