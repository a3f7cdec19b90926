"""The k-mer index as tables, and the aggregations over it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.operators.kmers import ref_kmers
from seedweave.operators.scan import dealt_kmers
from seedweave.operators.sequences import lookup_taxid
from seedweave.operators.seed_filter import join_filtered
from seedweave.params import MatchParams, check_percentage
from seedweave.session import BROADCAST_BYTES, ROW_BYTES, broadcast_if_small, default_spread, row_count, write_stage


@dataclass(frozen=True)
class RefBlocks:
    """Stored reference text, ``size`` characters a row and ``overlap`` of what follows.

    ``table`` (ref_id, block, text_len, block_text) is bucketed by (ref_id,
    block) and counts references from 0; they are ``first`` to ``end`` - 1 of
    the index.
    """

    table: DataFrame
    size: int
    overlap: int
    first: int
    end: int


@dataclass(frozen=True)
class Index:
    """postings (db_id, ref_id, rpos, kmer) and refs (db_id, ref_id, header,
    seq, ref_len, tax_id) of one or more reference sets.

    ``threshold`` fixes the k-mer length and seed stride; a classification may
    use a higher one.  ``hot`` and a ``salt`` column of the postings are there
    when the index was read from storage.  ``parts`` are the indexes that were
    united, each with its own buckets; ``suppressed`` says that frequent k-mers
    were left out.  ``blocks`` holds the stored text of all references, if
    every part was stored with it.
    """

    postings: DataFrame
    refs: DataFrame
    threshold: int
    sampled: bool = False
    hot: DataFrame | None = None
    complete: bool = False
    suppressed: bool = False
    parts: tuple[Index, ...] = ()
    spans: tuple[int, int] | None = None
    blocks: tuple[RefBlocks, ...] = ()

    def id_spans(self) -> tuple[int, int]:
        """(databases, reference ids) that the index takes up, counted from 0."""
        if self.spans is not None:
            return self.spans
        top = self.refs.agg(F.max("db_id").alias("d"), F.max("ref_id").alias("r")).first()
        return (0 if top["d"] is None else top["d"] + 1, 0 if top["r"] is None else top["r"] + 1)


def refs_meta(refs: DataFrame, accession_map: DataFrame | None = None, db_id: int = 0) -> DataFrame:
    """Sequence table to reference table, with taxon ids (-1 when unknown)."""
    named = refs if "ref_id" in refs.columns else refs.withColumnRenamed("seq_id", "ref_id")
    if accession_map is not None:
        named = lookup_taxid(named.drop("tax_id"), accession_map)
    elif "tax_id" not in named.columns:
        named = named.withColumn("tax_id", F.lit(-1))
    return named.select(
        F.lit(db_id).alias("db_id"),
        "ref_id",
        "header",
        "seq",
        F.length("seq").alias("ref_len"),
        F.coalesce(F.col("tax_id"), F.lit(-1)).cast("int").alias("tax_id"),
    )


def build_index(
    refs: DataFrame,
    threshold: int,
    accession_map: DataFrame | None = None,
    suppress: bool = False,
    spread: int | None = None,
) -> Index:
    """An index over normalized references, evaluated lazily.

    ``spread`` cuts k-mers in that many partitions, for references so long
    that one of them would keep a task busy alone.

    ``suppress`` applies the suppression rule, which drops the frequent k-mers
    of thresholds below 20; without it the index holds every k-mer.
    """
    meta = refs_meta(refs, accession_map)
    postings = ref_kmers(meta, MatchParams(threshold).k, spread=spread)
    suppress = suppress and threshold < SUPPRESS_BELOW
    if suppress:
        postings = suppress_frequent_seeds(postings, threshold)
    return Index(postings, meta, threshold, complete=not suppress, suppressed=suppress)


def union_indexes(indexes: list[Index]) -> Index:
    """Stack indexes: each gets its own range of database and reference ids.

    The parts stay apart, so seeds meet each of them in its own buckets and
    only hits are united.
    """
    if not indexes:
        raise ValueError("no index to unite")
    thresholds = {i.threshold for i in indexes}
    if len(thresholds) > 1:
        raise ValueError(f"indexes were built with different thresholds: {sorted(thresholds)}")
    next_db, next_ref, parts, blocks = 0, 0, [], []
    for index in indexes:
        for part in index.parts or (index,):
            parts.append(_shifted(part, next_db, next_ref))
        blocks += [replace(b, first=b.first + next_ref, end=b.end + next_ref) for b in index.blocks]
        dbs, ids = index.id_spans()
        next_db, next_ref = next_db + dbs, next_ref + ids
    columns = ("db_id", "ref_id", "rpos", "kmer")
    return Index(
        reduce(DataFrame.unionByName, (p.postings.select(*columns) for p in parts)),
        reduce(DataFrame.unionByName, (p.refs for p in parts)),
        indexes[0].threshold,
        sampled=any(i.sampled for i in indexes),
        complete=all(i.complete for i in indexes),
        suppressed=any(i.suppressed for i in indexes),
        parts=tuple(parts),
        spans=(next_db, next_ref),
        blocks=tuple(blocks) if all(i.blocks for i in indexes) else (),
    )


def _shifted(index: Index, db_offset: int, ref_offset: int) -> Index:
    """The same index with its ids moved; buckets and salts stay as they are."""
    ids = {
        "db_id": (F.col("db_id") + F.lit(db_offset)).cast("int"),
        "ref_id": F.col("ref_id") + F.lit(ref_offset).cast("bigint"),
    }
    return replace(index, postings=index.postings.withColumns(ids), refs=index.refs.withColumns(ids), spans=None, blocks=())


# Postings of one task that collects lists; all their rows are sorted at once.
POSTINGS_PER_TASK = 1_000_000


def posting_lists(postings: DataFrame, ref_span: int = 64, pos_span: int = 4096, n_postings: int = 0) -> DataFrame:
    """Posting lists (kmer, part keys, n_postings, entries sorted by position).

    A k-mer's list is kept in parts of at most ref_span references by pos_span
    positions, so the list of a k-mer that is everywhere is spread out.  Most
    lists are short, so postings move as they are: lists combined before the
    shuffle would be sorted there and take more room.  ``n_postings``, where
    known, gives the shuffle a partition for each POSTINGS_PER_TASK.
    """
    parts = [(F.col("ref_id") / ref_span, "ref_part"), (F.col("rpos") / pos_span, "pos_part")]
    keys = ["kmer", *[F.floor(part).alias(name) for part, name in parts]]
    n = -(-n_postings // POSTINGS_PER_TASK)
    moved = postings.select("kmer", "ref_id", "rpos").repartition(*([n] if n > 1 else []), "kmer", *[F.floor(part) for part, _ in parts])
    return _lists(moved, keys)


def _lists(postings: DataFrame, keys: list) -> DataFrame:
    entry = F.struct("rpos", "ref_id")
    return postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_postings"), F.sort_array(F.collect_list(entry)).alias("entries"))


def posting_lists_of(refs: DataFrame, k: int, ref_span: int = 64, pos_span: int = 4096) -> DataFrame:
    """``posting_lists`` of all k-mers of references, which move as stretches of text rather than one by one."""
    dealt = dealt_kmers(refs, k, tasks_for(refs, k), F.floor(F.col("ref_id") / ref_span))
    parts = [(F.col("ref_id") / ref_span, "ref_part"), (F.col("rpos") / pos_span, "pos_part")]
    return _lists(dealt, ["home", *[F.floor(part).alias(name) for part, name in parts], "kmer"]).drop("home")


def tasks_for(refs: DataFrame, k: int) -> int:
    """Partitions that deal the k-mers of ``refs`` to tasks of POSTINGS_PER_TASK."""
    n = refs.agg(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0)).cast("bigint"))).first()[0] or 0
    return max(-(-n // POSTINGS_PER_TASK), default_spread(refs.sparkSession))


def _by_kmer(postings: DataFrame) -> list[str]:
    """The keys of a k-mer; postings dealt by their ``home`` are not shuffled again."""
    return ["home", "kmer"] if "home" in postings.columns else ["kmer"]


def posting_summary(postings: DataFrame) -> DataFrame:
    """(kmer, n_postings, n_refs, min_rpos, max_rpos), without any list."""
    keys = _by_kmer(postings)
    per_ref = postings.groupBy(*keys, "ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rpos").alias("lo"), F.max("rpos").alias("hi")
    )
    summary = per_ref.groupBy(*keys).agg(
        F.sum("n").alias("n_postings"),
        F.count(F.lit(1)).alias("n_refs"),
        F.min("lo").alias("min_rpos"),
        F.max("hi").alias("max_rpos"),
    )
    return summary.drop("home")


def unique_seeds(postings: DataFrame, approx: bool = False) -> DataFrame:
    if "home" in postings.columns and not approx:
        return postings.groupBy("home", "kmer").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n"))
    count = F.approx_count_distinct if approx else F.count_distinct
    return postings.agg(count(F.col("kmer")).alias("n"))


def query_seed_uniqueness(seeds: DataFrame) -> DataFrame:
    """Distinct seeds as a percentage of all seeds."""
    per_seed = seeds.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return per_seed.agg((F.lit(100.0) * F.count(F.lit(1)) / F.sum("n")).alias("pct"))


# The suppression rule's threshold bound, quantile and cap.
SUPPRESS_BELOW = 20
SUPPRESS_QUANTILE = 0.30
SUPPRESS_CAP = 20


def suppression_cut(counts: DataFrame, quantile: float = SUPPRESS_QUANTILE, cap: int = SUPPRESS_CAP) -> DataFrame:
    """One row ``cut``: min(cap, the 0-based floor(n*quantile)-th smallest n).

    Counts above the cap are all alike to the rule, so a histogram of at most
    cap+1 rows holds everything and no global sort is needed.
    """
    histogram = counts.groupBy(F.least("n", F.lit(cap + 1)).alias("size")).agg(F.count(F.lit(1)).alias("kmers"))
    upto = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.select(
        "size", F.sum("kmers").over(upto).alias("below"), F.sum("kmers").over(everything).alias("total")
    )
    return ranked.where(F.col("below") > F.floor(F.col("total") * quantile)).agg(
        F.least(F.min("size"), F.lit(cap)).alias("cut")
    )


def suppress_frequent_seeds(
    postings: DataFrame, threshold: int, quantile: float = SUPPRESS_QUANTILE, cap: int = SUPPRESS_CAP
) -> DataFrame:
    """Below a threshold of 20, drop k-mers with more postings than the cut.

    Counts are written once.  The most frequent k-mers, which the cap rules out
    whatever the cut is, are dropped by a broadcast of bounded size, so their
    postings are not shuffled; the join with the kept k-mers decides on the rest.
    """
    if threshold >= SUPPRESS_BELOW:
        return postings
    counts = write_stage(postings.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")), "kmer-counts")
    cut = suppression_cut(counts, quantile, cap).scalar()
    kept = counts.where(F.col("n") <= cut).select("kmer")
    most = BROADCAST_BYTES // (ROW_BYTES + 4 * MatchParams(threshold).k)
    frequent = counts.where(F.col("n") > cap).orderBy(F.desc("n"), "kmer").limit(most).select("kmer")
    rest = postings.join(F.broadcast(frequent), "kmer", "left_anti")
    return rest.join(kept, "kmer", "left_semi")


def sample_index(index: Index, pct: float) -> Index:
    """Keep a fixed ``pct`` percent of the k-mers, by fingerprint."""
    check_percentage(pct)
    kept = sample_postings(index.postings, MatchParams(index.threshold).k, pct)
    return replace(index, postings=kept, sampled=index.sampled or pct < 100, complete=False)


def fingerprint_percent(kmer: str, k: int) -> Column:
    """0 to 99 by fingerprint; a sample of p percent is what lies below p."""
    return F.pmod(text.fingerprint(kmer, k), F.lit(100))


def sample_postings(postings: DataFrame, k: int, pct: float) -> DataFrame:
    return postings.where(fingerprint_percent("kmer", k) < pct)


def prune_index_to_queries(postings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Only the postings whose k-mer some read asks for; few others are shuffled, as in ``seed_hits``."""
    asked = seeds.select("kmer").distinct()
    n_asked = row_count(asked)
    few = broadcast_if_small(asked, n_asked, 128)
    if few is not asked:
        return postings.join(few, "kmer", "left_semi")
    return join_filtered(postings, asked, n_asked, "left_semi")


def ref_stats(refs: DataFrame) -> DataFrame:
    """Number, total and longest length of sequences and headers."""
    return refs.agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.sum(F.length("seq")).alias("total_len"),
        F.max(F.length("seq")).alias("max_len"),
        F.sum(F.length("header")).alias("total_header_len"),
        F.max(F.length("header")).alias("max_header_len"),
    )
