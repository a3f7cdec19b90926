"""One registered query per operator, over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as fx
from seedweave.functions import text
from seedweave.operators import index as ix
from seedweave.operators import kmers, matching, ranking, report, scan, scoring
from seedweave.operators import sequences as seqs
from seedweave.params import MatchParams
from seedweave.plans import classify as plans
from seedweave.plans import collapse, stream
from seedweave.session import default_spread, judged_by_rows, provide_stage_root, row_count, stage_root, write_stage
from seedweave.sources import index_store, lookups, results
from seedweave.sources import sequences as seq_io

THRESHOLD = fx.THRESHOLD
PARAMS = MatchParams(THRESHOLD)
SUPPRESSED = MatchParams(18)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, with integers widened to BIGINT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        provide_stage_root(spark)
        df = fn(spark, sf_dir)
        narrow = (T.IntegerType, T.ShortType, T.ByteType)
        return df.select(
            *[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, narrow) else f.name for f in df.schema]
        )

    QUERIES[fn.__name__] = run
    return fn


# Intermediate tables that several queries start from, written once per
# session and scale.  bench.py clears this before each timing.
_stages: dict[tuple, DataFrame] = {}


def clear_stages() -> None:
    _stages.clear()


def stage(name: str):
    def wrap(fn: Query) -> Query:
        def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _stages:
                _stages[key] = judged_by_rows(write_stage(fn(spark, sf_dir), name))
            return _stages[key]

        return cached

    return wrap


def scratch(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/catalog-{name}-{uuid.uuid4().hex}"


# ---- inputs ---------------------------------------------------------------


@stage("dna-refs")
def dna_refs(spark, sf_dir):
    # As for the documents: one row group must not leave all texts and their k-mers to one task.
    spread = {"part": default_spread(spark, row_count(fx.table(spark, sf_dir, "part")))}
    return fx.run_sql(spark, sf_dir, fx.DNA_REFS, spread).withColumn("ref_len", F.length("seq"))


@stage("dna-reads-raw")
def dna_reads_raw(spark, sf_dir):
    # Spark takes a text made by an expression for 20 bytes and would broadcast all references.
    refs = dna_refs(spark, sf_dir).hint("merge")
    reads = fx.run_sql(spark, sf_dir, fx.dna_reads_raw("{dna_refs}"), dna_refs=refs)
    n_reads = row_count(fx.table(spark, sf_dir, "customer"))
    return fx.as_sequences(reads.repartition(default_spread(spark, n_reads)), "q")


def dna_reads(spark, sf_dir):
    return seqs.normalize_seq(dna_reads_raw(spark, sf_dir))


def dna_ref_sequences(spark, sf_dir):
    return dna_refs(spark, sf_dir).select(F.col("ref_id").alias("seq_id"), "header", "seq", F.col("ref_len").alias("seq_len"))


def text_refs(spark, sf_dir):
    # The test tables are one file with one row group; see `spread` in classify.
    spread = {"documents": default_spread(spark)}
    return fx.run_sql(spark, sf_dir, fx.TEXT_REFS, spread).withColumn("ref_len", F.length("seq"))


def text_reads(spark, sf_dir):
    return fx.as_sequences(fx.run_sql(spark, sf_dir, fx.TEXT_READS), "q")


def dna_index(spark, sf_dir):
    return ix.build_index(dna_refs(spark, sf_dir), THRESHOLD)


def text_index(spark, sf_dir):
    return ix.build_index(text_refs(spark, sf_dir), THRESHOLD)


@stage("dna-seeds")
def dna_seeds(spark, sf_dir):
    return kmers.query_seeds(seqs.both_strands(dna_reads(spark, sf_dir)), THRESHOLD)


def dna_postings(spark, sf_dir):
    # Cut where they are looked up, which reads them once: written they would take several times the references.
    return kmers.ref_kmers(dna_refs(spark, sf_dir), PARAMS.k)


def text_postings(spark, sf_dir):
    return kmers.ref_kmers(text_refs(spark, sf_dir), PARAMS.k)


def text_postings_dealt(spark, sf_dir):
    """The same, equal k-mers in one task; neither is written, which would take several times the text."""
    refs = text_refs(spark, sf_dir)
    return scan.dealt_kmers(refs, PARAMS.k, ix.tasks_for(refs, PARAMS.k))


@stage("dna-hits")
def dna_hits(spark, sf_dir):
    return matching.seed_hits(dna_seeds(spark, sf_dir), dna_postings(spark, sf_dir))


@stage("text-hits")
def text_hits(spark, sf_dir):
    return matching.seed_hits(kmers.query_seeds(text_reads(spark, sf_dir), THRESHOLD), text_postings(spark, sf_dir))


def documents_as_reads(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(default_spread(spark))
    return seq_io.from_table(docs, "doc_id", "text")


@stage("self-hits")
def self_hits(spark, sf_dir):
    """Whole documents as reads against all documents: copies, repeats, many diagonals."""
    seeds = kmers.query_seeds(documents_as_reads(spark, sf_dir), THRESHOLD)
    return matching.seed_hits(seeds, text_postings(spark, sf_dir))


@stage("self-runs")
def self_runs(spark, sf_dir):
    return matching.chain_runs(self_hits(spark, sf_dir), PARAMS.step)


@stage("dna-runs")
def dna_runs(spark, sf_dir):
    return matching.chain_runs(dna_hits(spark, sf_dir), PARAMS.step)


@stage("dna-candidates")
def dna_candidates(spark, sf_dir):
    return matching.candidate_runs(dna_runs(spark, sf_dir), PARAMS.step)


@stage("dna-flanks")
def dna_flanks(spark, sf_dir):
    return scoring.fetch_flanks(dna_candidates(spark, sf_dir), dna_reads(spark, sf_dir), dna_refs(spark, sf_dir), THRESHOLD)


@stage("dna-segments")
def dna_segments(spark, sf_dir):
    return scoring.extend_runs(dna_flanks(spark, sf_dir), THRESHOLD)


@stage("dna-scores")
def dna_scores(spark, sf_dir):
    kept = scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD)
    return scoring.drop_zero(scoring.relative_score(scoring.raw_score(kept)))


@stage("dna-groups")
def dna_groups(spark, sf_dir):
    return ranking.score_groups(ranking.best_strand(dna_scores(spark, sf_dir)), top_only=False)


@stage("dna-members")
def dna_members(spark, sf_dir):
    return report.with_reference(ranking.top_group_only(dna_groups(spark, sf_dir)), dna_refs(spark, sf_dir))


@stage("dna-results")
def dna_results(spark, sf_dir):
    top = ranking.top_group_only(dna_groups(spark, sf_dir))
    return report.report(top, dna_refs(spark, sf_dir), dna_reads(spark, sf_dir))


@stage("kin-refs")
def kin_refs(spark, sf_dir):
    kin = fx.run_sql(spark, sf_dir, fx.kin_refs("{dna_refs}"), dna_refs=dna_refs(spark, sf_dir))
    return kin.withColumn("ref_len", F.length("seq"))


@stage("kin-scores")
def kin_scores(spark, sf_dir):
    return plans.score_reads(dna_reads(spark, sf_dir), ix.build_index(kin_refs(spark, sf_dir), THRESHOLD), THRESHOLD)


@stage("kin-groups")
def kin_groups(spark, sf_dir):
    return ranking.score_groups(ranking.best_strand(kin_scores(spark, sf_dir)), top_only=False)


@stage("kin-members")
def kin_members(spark, sf_dir):
    return report.with_reference(kin_groups(spark, sf_dir), kin_refs(spark, sf_dir))


@stage("copied-reads")
def copied_reads(spark, sf_dir):
    reads = dna_reads(spark, sf_dir).withColumnRenamed("seq_id", "q")
    return fx.as_sequences(fx.run_sql(spark, sf_dir, fx.copied_reads("{dna_reads}"), dna_reads=reads), "q")


def sampled_index(spark, sf_dir):
    path = scratch(spark, "sampleable")
    index_store.write_index(dna_index(spark, sf_dir), path, n_buckets=4, sampleable=True)
    return index_store.read_index(spark, path, THRESHOLD, pct=60)


# ---- sources and sinks ----------------------------------------------------


@query
def read_fasta(spark, sf_dir):
    path = scratch(spark, "fasta")
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    dna_refs(spark, sf_dir).select(F.concat("header", F.lit("\n"), F.lower(wrapped))).write.text(path)
    return seq_io.read_fasta(spark, path).select("header", "seq", "seq_len")


@query
def read_fastq(spark, sf_dir):
    path = scratch(spark, "fastq")
    quality = F.rpad(F.lit("@"), F.col("seq_len"), F.lit("I"))
    record = F.concat_ws("\n", F.regexp_replace("header", "^>", "@"), "seq", F.lit("+"), quality)
    dna_reads_raw(spark, sf_dir).select(record).write.text(path)
    return seq_io.read_fastq(spark, path).select("header", "seq", "seq_len")


@query
def read_sequence_table(spark, sf_dir):
    return seq_io.from_table(fx.table(spark, sf_dir, "documents"), "doc_id", "text")


def _accession_file(spark, sf_dir):
    path = scratch(spark, "accessions")
    rows = dna_refs(spark, sf_dir)
    name = F.concat(F.lit("AC"), F.col("ref_id").cast("string"))
    rows.select(
        name.alias("accession"), F.concat(name, F.lit(".1")).alias("accession.version"),
        F.col("tax_id").alias("taxid"), F.col("ref_id").alias("gi"),
    ).write.options(sep="\t", header=True).csv(path)
    return path


@query
def read_accession_taxid(spark, sf_dir):
    return lookups.read_accession_taxid(spark, _accession_file(spark, sf_dir))


def _header_map_file(spark, sf_dir):
    path = scratch(spark, "header-map")
    fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit(">AC"), F.col("p_partkey").cast("string"), F.lit(".1 synthetic")),
        F.concat_ws(";", F.lit(">named"), "p_name", F.col("p_partkey").cast("string")),
    ).write.options(sep="\t").csv(path)
    return path


@query
def read_header_map(spark, sf_dir):
    return lookups.read_header_map(spark, _header_map_file(spark, sf_dir))


def _stored(spark, sf_dir, where: str = "true") -> str:
    path = scratch(spark, "index")
    refs = dna_refs(spark, sf_dir).where(where)
    index_store.write_index(ix.build_index(refs, THRESHOLD), path, n_buckets=4, rows_per_salt=1000)
    return path


def _stored_halves(spark, sf_dir) -> list[str]:
    """All references, stored as two indexes."""
    return [_stored(spark, sf_dir, f"ref_id % 2 = {i}") for i in (0, 1)]


def _extent(*, n, rpos, low, high) -> list[Column]:
    return [
        n.alias("n"),
        F.sum(rpos).alias("rpos_sum"),
        F.min(low).alias("min_kmer"),
        F.max(high).alias("max_kmer"),
    ]


def _posting_profile(postings: DataFrame) -> DataFrame:
    return postings.groupBy("db_id", "ref_id").agg(*_extent(n=F.count(F.lit(1)), rpos="rpos", low="kmer", high="kmer"))


def _stored_profile(postings: DataFrame, n_postings: int) -> DataFrame:
    """``_posting_profile`` of a stored index.

    In the order of a stored index hardly two postings of a task belong to one reference, so they move as they are,
    once and without a sort before it; a long reference moves in blocks of positions.
    """
    n = -(-n_postings // ix.POSTINGS_PER_TASK)
    spot = F.floor(F.col("rpos") / matching.CHAIN_BLOCK)
    moved = postings.select("ref_id", "db_id", "rpos", "kmer").repartition(*([n] if n > 1 else []), "ref_id", "db_id", spot)
    spots = moved.groupBy("ref_id", "db_id", spot.alias("spot")).agg(*_extent(n=F.count(F.lit(1)), rpos="rpos", low="kmer", high="kmer"))
    return spots.groupBy("db_id", "ref_id").agg(*_extent(n=F.sum("n"), rpos="rpos_sum", low="min_kmer", high="max_kmer"))


def _reduced_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row of neighbours in a batch that belong to one reference."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("db_id", "ref_id")]
        starts = np.flatnonzero(np.concatenate([[True], (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])]))
        sizes = np.diff(np.append(starts, batch.num_rows))
        rpos = batch.column("rpos").to_numpy(zero_copy_only=False).astype(np.int64)
        kmer = batch.column("kmer")
        ends = [pc.min_max(kmer.slice(at, n)) for at, n in zip(starts.tolist(), sizes.tolist())]
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("db_id").take(first),
                batch.column("ref_id").take(first),
                pa.array(sizes),
                pa.array(np.add.reduceat(rpos, starts)),
                pa.array([e["min"].as_py() for e in ends], pa.string()),
                pa.array([e["max"].as_py() for e in ends], pa.string()),
            ],
            names=["db_id", "ref_id", "n", "rpos_sum", "low", "high"],
        )


def _profile_in_order(postings: DataFrame) -> DataFrame:
    """``_posting_profile`` of postings that come reference by reference.

    Spark sorts every row for the least and greatest of a text column.  So the rows of a batch are reduced first, and
    a row per batch and reference is left to sort.
    """
    schema = "db_id INT, ref_id BIGINT, n BIGINT, rpos_sum BIGINT, low STRING, high STRING"
    typed = postings.select(F.col("db_id").cast("int"), F.col("ref_id").cast("bigint"), "rpos", "kmer")
    runs = typed.mapInArrow(_reduced_runs, schema)
    return runs.groupBy("db_id", "ref_id").agg(*_extent(n=F.sum("n"), rpos="rpos_sum", low="low", high="high"))


@query
def write_index(spark, sf_dir):
    loaded = index_store.read_index(spark, _stored(spark, sf_dir), THRESHOLD)
    return _stored_profile(loaded.postings, row_count(loaded.postings))


@query
def read_index(spark, sf_dir):
    """Classification through a stored index."""
    loaded = index_store.read_index(spark, _stored(spark, sf_dir), THRESHOLD)
    return plans.classify(dna_reads(spark, sf_dir), loaded, THRESHOLD).drop("confident_text")


@query
def union_indexes(spark, sf_dir):
    refs = dna_refs(spark, sf_dir)
    halves = [ix.build_index(refs.where(f"ref_id % 2 = {i}"), THRESHOLD) for i in (0, 1)]
    return _profile_in_order(ix.union_indexes(halves).postings)


@query
def classify_two_indexes(spark, sf_dir):
    """One answer from two stored indexes, each judged by its own best streak of seeds."""
    united = index_store.read_index(spark, _stored_halves(spark, sf_dir), THRESHOLD)
    grouped = plans.classify_scores(dna_reads(spark, sf_dir), united, threshold=THRESHOLD)
    members = report.with_reference(grouped, united.refs)
    return members.select("q", "grp", "confident", "header", "tax_id")


@query
def skip_bad_index(spark, sf_dir):
    paths = [scratch(spark, "missing"), _stored(spark, sf_dir)]
    postings = index_store.read_index(spark, paths, THRESHOLD, on_error="skip").postings
    return _stored_profile(postings, row_count(postings))


@query
def write_results_tiered(spark, sf_dir):
    path = scratch(spark, "tiers")
    results.write_results_tiered(dna_results(spark, sf_dir), path)
    schema = results.RESULT_SCHEMA + ", tier STRING"
    return spark.read.schema(schema).options(sep=";", header=True).csv(path)


@query
def combine_results(spark, sf_dir):
    paths = []
    for node in (0, 1):
        paths.append(scratch(spark, "node"))
        part = results.result_columns(dna_results(spark, sf_dir).where(f"q % 2 = {node}"))
        part.write.options(sep=";", header=True).csv(paths[-1])
    return results.combine_results(spark, paths)


# ---- projections, filters, scalar functions -------------------------------


@query
def normalize_seq(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").withColumnRenamed("text", "seq")
    return seqs.normalize_seq(turns.select("conv_id", "turn", "seq"))


@query
def reverse_complement(spark, sf_dir):
    return dna_reads(spark, sf_dir).select("seq_id", text.reverse_complement("seq").alias("rc"))


@query
def both_strands(spark, sf_dir):
    return seqs.both_strands(dna_reads(spark, sf_dir)).select("seq_id", "strand", "seq")


@query
def split_reference(spark, sf_dir):
    pages = seq_io.from_table(fx.table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return seqs.split_reference(pages, 1000)


@query
def extract_accession(spark, sf_dir):
    return dna_refs(spark, sf_dir).select("ref_id", text.extract_accession("header").alias("accession"))


@query
def translate_headers(spark, sf_dir):
    names = lookups.read_header_map(spark, _header_map_file(spark, sf_dir))
    return seqs.translate_headers(dna_refs(spark, sf_dir).select("ref_id", "header"), names)


@query
def ref_kmers(spark, sf_dir):
    return kmers.ref_kmers(dna_refs(spark, sf_dir), PARAMS.k)


@query
def ref_kmers_dealt(spark, sf_dir):
    """All documents, long ones in parts that move to other tasks."""
    return _profile_in_order(kmers.ref_kmers(text_refs(spark, sf_dir), PARAMS.k, spread=default_spread(spark)))


@query
def ref_kmers_text(spark, sf_dir):
    """All k-mers of all documents, profiled per document."""
    return _profile_in_order(kmers.ref_kmers(text_refs(spark, sf_dir), PARAMS.k))


@query
def query_seeds(spark, sf_dir):
    return kmers.query_seeds(seqs.both_strands(dna_reads(spark, sf_dir)), THRESHOLD)


@query
def query_seeds_text(spark, sf_dir):
    """Seeds of whole documents read as queries."""
    return kmers.query_seeds(documents_as_reads(spark, sf_dir), THRESHOLD)


@query
def drop_all_n(spark, sf_dir):
    """References with their first half masked by N."""
    masked = dna_refs(spark, sf_dir).withColumn("seq", F.concat(F.lit("N" * 40), F.expr("substr(seq, 41)")))
    return kmers.drop_all_n(kmers.ref_kmers(masked, PARAMS.k, skip_all_n=False), PARAMS.k).groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rpos").alias("first_rpos")
    )


@query
def min_query_len(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").withColumnRenamed("text", "seq")
    return kmers.min_query_len(turns, 200).select("conv_id", "turn", F.length("seq").alias("len"))


@query
def fingerprint(spark, sf_dir):
    return dna_seeds(spark, sf_dir).select(
        "q", "strand", "qpos",
        text.fingerprint("kmer", PARAMS.k, 32).alias("h32"),
        text.fingerprint("kmer", PARAMS.k).alias("h28"),
        text.fingerprint("kmer", PARAMS.k, 24).alias("h24"),
        text.fingerprint("kmer", PARAMS.k, 16).alias("h16"),
    )


@query
def sort_sequences(spark, sf_dir):
    return seqs.sort_sequences(dna_reads(spark, sf_dir)).select("seq_id", "seq")


@query
def sort_references(spark, sf_dir):
    docs = seq_io.from_table(fx.table(spark, sf_dir, "documents"), "doc_id", "text")
    return seqs.sort_sequences(docs, by="seq_len").select("seq_id", "seq_len")


# ---- index aggregations ---------------------------------------------------


@query
def posting_lists(spark, sf_dir):
    lists = ix.posting_lists_of(dna_refs(spark, sf_dir), PARAMS.k)
    entry = F.transform("entries", lambda e: F.concat_ws(":", e["rpos"].cast("string"), e["ref_id"].cast("string")))
    return lists.select("kmer", "ref_part", "pos_part", "n_postings", F.array_join(entry, ",").alias("entries"))


@query
def posting_summary(spark, sf_dir):
    return ix.posting_summary(text_postings_dealt(spark, sf_dir))


@query
def unique_seeds(spark, sf_dir):
    return ix.unique_seeds(text_postings_dealt(spark, sf_dir))


@query
def query_seed_uniqueness(spark, sf_dir):
    pct = ix.query_seed_uniqueness(dna_seeds(spark, sf_dir))
    return pct.select(F.round("pct", 6).alias("pct"))


@query
def suppress_frequent_seeds(spark, sf_dir):
    postings = kmers.ref_kmers(text_refs(spark, sf_dir), SUPPRESSED.k)
    return _posting_profile(ix.suppress_frequent_seeds(postings, SUPPRESSED.threshold))


@query
def suppress_frequent_seeds_dna(spark, sf_dir):
    """Short k-mers of reads and their copies, where the cut lies above one."""
    reads = dna_reads(spark, sf_dir).select(F.lit(0).alias("db_id"), F.col("seq_id").alias("ref_id"), "seq")
    postings = kmers.ref_kmers(reads, MatchParams(14).k)
    return ix.suppress_frequent_seeds(postings, 14).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_index(spark, sf_dir):
    # Sampled as they are cut: a written table of all k-mers would take several times the references.
    kept = ix.sample_postings(kmers.ref_kmers(dna_refs(spark, sf_dir), PARAMS.k), PARAMS.k, 25)
    return kept.select("ref_id", "rpos", "kmer")


@query
def prune_index_to_queries(spark, sf_dir):
    pruned = ix.prune_index_to_queries(dna_postings(spark, sf_dir), dna_seeds(spark, sf_dir))
    return pruned.select("ref_id", "rpos", "kmer")


@query
def ref_stats(spark, sf_dir):
    return ix.ref_stats(text_refs(spark, sf_dir))


# ---- joins ----------------------------------------------------------------


@query
def seed_hits(spark, sf_dir):
    return matching.seed_hits(dna_seeds(spark, sf_dir), dna_postings(spark, sf_dir))


@query
def seed_hits_text(spark, sf_dir):
    seeds = kmers.query_seeds(text_reads(spark, sf_dir), THRESHOLD)
    return matching.seed_hits(seeds, kmers.ref_kmers(text_refs(spark, sf_dir), PARAMS.k))


@query
def seed_hits_text_filtered(spark, sf_dir):
    """Seeds that may not be broadcast: k-mers pass a filter of fixed size before they are shuffled."""
    seeds = kmers.query_seeds(text_reads(spark, sf_dir), THRESHOLD)
    return matching.seed_hits(seeds, kmers.ref_kmers(text_refs(spark, sf_dir), PARAMS.k), broadcast_bytes=0)


@query
def lookup_taxid(spark, sf_dir):
    known = lookups.read_accession_taxid(spark, _accession_file(spark, sf_dir))
    return seqs.lookup_taxid(dna_refs(spark, sf_dir).select("ref_id", "header"), known)


@query
def lookup_taxid_repeated(spark, sf_dir):
    """A map that has every accession twice, with different taxa."""
    known = lookups.read_accession_taxid(spark, _accession_file(spark, sf_dir))
    twice = known.unionByName(known.withColumn("tax_id", F.col("tax_id") - 7))
    return seqs.lookup_taxid(dna_refs(spark, sf_dir).select("ref_id", "header"), twice)


@query
def fetch_flanks(spark, sf_dir):
    flanks = scoring.fetch_flanks(
        dna_candidates(spark, sf_dir), dna_reads(spark, sf_dir), dna_refs(spark, sf_dir), THRESHOLD, block=64
    )
    return flanks.select("q", "strand", "ref_id", "q_start", "r_start", "q_head", "r_head", "q_tail", "r_tail")


@query
def fetch_flanks_stored(spark, sf_dir):
    """Requests that may not be broadcast, to the stored blocks of two united indexes."""
    index = index_store.read_index(spark, _stored_halves(spark, sf_dir), THRESHOLD)
    moved = index.refs.select("ref_id", F.col("header").alias("__header")).join(
        dna_refs(spark, sf_dir).select(F.col("ref_id").alias("__id"), F.col("header").alias("__header")), "__header"
    )
    runs = dna_candidates(spark, sf_dir).withColumnRenamed("ref_id", "__id").join(moved.drop("__header"), "__id")
    flanks = scoring.fetch_flanks(
        runs, dna_reads(spark, sf_dir), index.refs, THRESHOLD, block=64, stored=index.blocks, broadcast_bytes=0
    )
    named = flanks.join(moved, "ref_id").withColumn("ref_id", F.col("__id"))
    return named.select("q", "strand", "ref_id", "q_start", "r_start", "q_head", "r_head", "q_tail", "r_tail")


@query
def attach_query(spark, sf_dir):
    runs = dna_candidates(spark, sf_dir)
    return scoring.attach_query(runs, dna_reads(spark, sf_dir)).select(
        "q", "strand", "ref_id", "q_start", "r_start", "query", "query_len"
    )


# ---- windows and ranking --------------------------------------------------


@query
def consecutive_seed_filter(spark, sf_dir):
    hits = dna_hits(spark, sf_dir).withColumn("db_id", (F.col("ref_id") % 2).cast("int"))
    return matching.consecutive_seed_filter(hits)


def _pair_profile(rows: DataFrame, at_query: str, at_ref: str) -> DataFrame:
    return rows.groupBy("q", "ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(at_query).alias("q_sum"), F.sum(F.col(at_query) * F.col(at_ref)).alias("qr_sum")
    )


@query
def consecutive_seed_filter_dense(spark, sf_dir):
    return _pair_profile(matching.consecutive_seed_filter(self_hits(spark, sf_dir)), "qpos", "rpos")


@query
def chain_runs(spark, sf_dir):
    return matching.chain_runs(dna_hits(spark, sf_dir), PARAMS.step)


@query
def chain_runs_dense(spark, sf_dir):
    """Sorted chaining where other diagonals interrupt, in small blocks."""
    return _pair_profile(matching.chain_runs(self_hits(spark, sf_dir), PARAMS.step, block=256), "q_start", "r_end")


@query
def chain_runs_diagonal(spark, sf_dir):
    return matching.chain_runs(self_hits(spark, sf_dir), PARAMS.step, adjacency="diagonal")


@query
def longest_run_filter(spark, sf_dir):
    return matching.longest_run_filter(dna_runs(spark, sf_dir))


@query
def candidate_runs_dense(spark, sf_dir):
    """Both reference filters in one pass."""
    kept = matching.candidate_runs(self_runs(spark, sf_dir), PARAMS.step)
    return _pair_profile(kept, "q_start", "r_end")


def _shown(scores: DataFrame) -> DataFrame:
    return scores.select("q", "strand", "ref_id", F.round("score", 6).alias("score"))


@query
def best_strand(spark, sf_dir):
    return _shown(ranking.best_strand(dna_scores(spark, sf_dir)))


@query
def score_groups(spark, sf_dir):
    grouped = ranking.score_groups(ranking.best_strand(dna_scores(spark, sf_dir)), top_only=False)
    return grouped.select("q", "ref_id", "confident", "grp")


@query
def top_group_only(spark, sf_dir):
    grouped = ranking.score_groups(ranking.best_strand(dna_scores(spark, sf_dir)), top_only=True)
    return grouped.select("q", "ref_id", "confident", "grp")


# ---- extension and scoring ------------------------------------------------


@query
def extend_tail(spark, sf_dir):
    return scoring.extend_runs(dna_flanks(spark, sf_dir), THRESHOLD).select(
        "q", "strand", "ref_id", "q_end", "r_end", "n_tail"
    )


@query
def extend_head(spark, sf_dir):
    return scoring.extend_runs(dna_flanks(spark, sf_dir), THRESHOLD).select(
        "q", "strand", "ref_id", "q_start", "r_start", "n_head"
    )


@query
def segment_filter(spark, sf_dir):
    return scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD).select(
        "q", "strand", "ref_id", "q_start", "r_start", "n_head", "n_mid", "n_tail", "m"
    )


@query
def coverage(spark, sf_dir):
    kept = scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD)
    return scoring.coverage(kept).select("q", "strand", "ref_id", "covered", F.round("pct", 6).alias("pct"))


@query
def raw_score(spark, sf_dir):
    kept = scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD)
    return scoring.raw_score(kept).select("q", "strand", "ref_id", "sum_sq", "considered", F.round("raw", 6).alias("raw"))


@query
def relative_score(spark, sf_dir):
    kept = scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD)
    return _shown(scoring.relative_score(scoring.raw_score(kept)))


@query
def drop_zero(spark, sf_dir):
    kept = scoring.segment_filter(dna_segments(spark, sf_dir), THRESHOLD)
    return _shown(scoring.drop_zero(scoring.relative_score(scoring.raw_score(kept))))


@query
def classify(spark, sf_dir):
    return plans.classify(dna_reads(spark, sf_dir), dna_index(spark, sf_dir), THRESHOLD).drop("confident_text")


@query
def classify_all_groups(spark, sf_dir):
    return plans.classify(dna_reads(spark, sf_dir), dna_index(spark, sf_dir), THRESHOLD, top_only=False).drop("confident_text")


@query
def classify_text(spark, sf_dir):
    return plans.classify(text_reads(spark, sf_dir), text_index(spark, sf_dir), THRESHOLD, strands=False).drop(
        "confident_text"
    )


@query
def classify_text_stored(spark, sf_dir):
    """Against a stored index with nothing broadcast: salted bucket join, slices from stored blocks."""
    path = scratch(spark, "text-index")
    index_store.write_index(text_index(spark, sf_dir), path, n_buckets=4, rows_per_salt=200)
    index = index_store.read_index(spark, path, THRESHOLD)
    return plans.classify(text_reads(spark, sf_dir), index, THRESHOLD, strands=False, broadcast_bytes=0).drop("confident_text")


@query
def classify_short(spark, sf_dir):
    """An even, low threshold: short seeds, none of which is suppressed."""
    index = ix.build_index(dna_refs(spark, sf_dir), 18)
    return plans.classify(dna_reads(spark, sf_dir), index, 18).drop("confident_text")


@query
def classify_split(spark, sf_dir):
    """References cut into chunks, each of which is a reference of its own."""
    chunks = seqs.split_reference(dna_refs(spark, sf_dir).drop("ref_len"), 128).drop("chunk_no")
    index = ix.build_index(seqs.number_rows(chunks, "ref_id"), THRESHOLD)
    grouped = plans.classify_scores(dna_reads(spark, sf_dir), index, threshold=THRESHOLD)
    return report.with_reference(grouped, index.refs).select("q", "grp", "confident", "header", "tax_id")


@query
def classify_fast(spark, sf_dir):
    return plans.classify_fast(dna_reads(spark, sf_dir), dna_index(spark, sf_dir), threshold=THRESHOLD).drop(
        "confident_text"
    )


@query
def score_reads_dense(spark, sf_dir):
    scores = plans.score_reads(
        documents_as_reads(spark, sf_dir), text_index(spark, sf_dir), THRESHOLD, strands=False
    )
    return scores.select("q", "ref_id", "sum_sq", "considered", "covered", F.round("score", 6).alias("score"))


@query
def classify_kin(spark, sf_dir):
    """Every score group, against references of which many are copies or nearly so."""
    return plans.classify(dna_reads(spark, sf_dir), kin_refs(spark, sf_dir), THRESHOLD, top_only=False).drop("confident_text")


@query
def classify_collapsed(spark, sf_dir):
    """Equal reads, turned reads and equal references are scored once, in groups of two copies a salt."""
    rows = collapse.classify_collapsed(
        copied_reads(spark, sf_dir), kin_refs(spark, sf_dir), THRESHOLD, top_only=False, rows_per_salt=2
    )
    return rows.drop("confident_text")


@query
def classify_sampled(spark, sf_dir):
    """Six tenths of a stored index's k-mers: no high-precision tier."""
    rows = plans.classify_tiers(dna_reads(spark, sf_dir), sampled_index(spark, sf_dir), threshold=THRESHOLD)
    return rows.select("tier", "q", "confident", "tax_ids", "headers")


@query
def segment_filter_sampled(spark, sf_dir):
    """Unextended runs of sampled seeds, many of them shorter than the threshold."""
    reads, index = dna_reads(spark, sf_dir), sampled_index(spark, sf_dir)
    seeds = kmers.query_seeds(seqs.both_strands(reads), THRESHOLD)
    hits = write_stage(matching.seed_hits(seeds, index.postings, index.hot), "sampled-hits")
    runs = write_stage(matching.candidate_runs(hits_to_runs(hits), PARAMS.step), "sampled-candidates")
    segments = scoring.segment_filter(scoring.keep_unextended(runs, reads, index.refs), THRESHOLD)
    return segments.select("q", "strand", "ref_id", "q_start", "r_start", "m")


def hits_to_runs(hits: DataFrame) -> DataFrame:
    return matching.chain_runs(matching.consecutive_seed_filter(hits, PARAMS.step), PARAMS.step)


@query
def classify_stream(spark, sf_dir):
    """Reads that arrive in files, one file a batch."""
    source, out, checkpoint = (scratch(spark, name) for name in ("arriving", "answers", "stream"))
    reads = dna_reads(spark, sf_dir)
    reads.repartition(3, "seq_id").write.parquet(source)
    arriving = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.classify_stream(arriving, dna_index(spark, sf_dir), out, checkpoint, threshold=THRESHOLD).awaitTermination()
    return spark.read.parquet(out).drop("confident_text", "batch_id")


@query
def unique_seeds_stored(spark, sf_dir):
    """Distinct k-mers of two stored indexes, and whether their sketches come within 3 percent."""
    paths = _stored_halves(spark, sf_dir)
    exact = ix.unique_seeds(index_store.read_index(spark, paths, THRESHOLD).postings).scalar()
    estimate = index_store.unique_seeds_stored(spark, paths)
    close = F.abs(F.col("n") - exact) <= F.lit(0.03) * exact
    return estimate.select(exact.cast("bigint").alias("n"), close.alias("close"))


# ---- taxon vote and report ------------------------------------------------


@query
def tax_occurrences(spark, sf_dir):
    return report.tax_occurrences(dna_members(spark, sf_dir))


@query
def winning_taxa(spark, sf_dir):
    return report.winning_taxa(report.tax_occurrences(dna_members(spark, sf_dir)))


@query
def tax_lists(spark, sf_dir):
    return report.tax_lists(report.winning_taxa(report.tax_occurrences(dna_members(spark, sf_dir))))


@query
def header_list(spark, sf_dir):
    members = dna_members(spark, sf_dir)
    return report.header_list(members, report.winning_taxa(report.tax_occurrences(members)))


@query
def result_rows(spark, sf_dir):
    top = ranking.top_group_only(dna_groups(spark, sf_dir))
    rows = report.report(top, dna_refs(spark, sf_dir), dna_reads(spark, sf_dir))
    return results.result_columns(rows)


@query
def screen_rows(spark, sf_dir):
    top = ranking.top_group_only(dna_groups(spark, sf_dir))
    return report.screen_rows(top, dna_refs(spark, sf_dir), dna_reads(spark, sf_dir))


@query
def score_groups_kin(spark, sf_dir):
    return kin_groups(spark, sf_dir).select("q", "ref_id", "confident", "grp")


@query
def top_group_only_kin(spark, sf_dir):
    return ranking.top_group_only(kin_groups(spark, sf_dir)).select("q", "ref_id", "confident", "grp")


@query
def winning_taxa_kin(spark, sf_dir):
    return report.winning_taxa(report.tax_occurrences(kin_members(spark, sf_dir)))


@query
def result_parts(spark, sf_dir):
    """At most two references a row."""
    rows = report.report(kin_groups(spark, sf_dir), kin_refs(spark, sf_dir), dna_reads(spark, sf_dir), part_size=2)
    return rows.drop("confident_text")


@query
def screen_parts(spark, sf_dir):
    return report.screen_parts(kin_groups(spark, sf_dir), kin_refs(spark, sf_dir), dna_reads(spark, sf_dir), part_size=2)


@query
def tiers(spark, sf_dir):
    return report.tiers(dna_results(spark, sf_dir)).select("tier", "q", "confident")


@query
def relative_abundance(spark, sf_dir):
    """Shares of headers that have commas in them."""
    members = dna_members(spark, sf_dir).withColumn("header", F.concat("header", F.lit(", primary")))
    winners = report.winning_taxa(report.tax_occurrences(members))
    return report.relative_abundance(members, winners).select("header", F.round("pct", 6).alias("pct"))


# ---- duplicates and completeness ------------------------------------------


@query
def duplicate_queries(spark, sf_dir):
    return seqs.duplicate_queries(seq_io.from_table(fx.table(spark, sf_dir, "documents"), "doc_id", "text"))


@query
def skip_duplicates(spark, sf_dir):
    docs = seq_io.from_table(fx.table(spark, sf_dir, "documents"), "doc_id", "text")
    return seqs.skip_duplicates(docs).select("seq_id", "seq_len")


@query
def unclassified_reads(spark, sf_dir):
    return seqs.unclassified_reads(dna_reads(spark, sf_dir), dna_results(spark, sf_dir)).select("seq_id", "header")
