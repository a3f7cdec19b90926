import random

import brute
import pytest
from pyspark.sql import functions as F

from seedweave.operators import kmers, matching, scoring
from seedweave.operators.index import refs_meta

T = 9
STEP, K = brute.sizes(T)
HIT = ["q", "ref_id", "qpos", "rpos"]
RUN = ["q", "ref_id", "n_seeds", "q_start", "r_start", "q_end", "r_end"]


def rows(df, columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module", params=[1, 2])
def texts(request):
    """Repetitive texts over a small alphabet: many diagonals, ties, copies."""
    rng = random.Random(request.param)
    motifs = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(4)] + ["a" * 15]
    make = lambda n: "".join(rng.choice(motifs) for _ in range(n))
    refs = {i: make(rng.randint(1, 9)) for i in range(8)}
    refs[8], refs[9] = refs[0], "N" * 30 + refs[1]
    reads = {i: make(rng.randint(1, 6)) for i in range(6)}
    reads[6], reads[7], reads[8] = refs[2], "zzzzzzzzzzzzzz", "ab"
    return reads, refs


@pytest.fixture(scope="module")
def found(spark, sequences, texts):
    reads, refs = texts
    meta = refs_meta(sequences(refs.items()))
    seeds = kmers.query_seeds(sequences(reads.items()), T, steps_per_piece=2)
    return matching.seed_hits(seeds, kmers.ref_kmers(meta, K, piece=16)).cache()


def test_seeds_and_kmers(sequences, texts):
    reads, refs = texts
    got = rows(kmers.query_seeds(sequences(reads.items()), T, steps_per_piece=2), ["q", "qpos", "kmer"])
    assert got == {(q, p, w) for q, s in reads.items() for p, w in brute.seeds(s, T)}
    assert kmers.seed_count(sequences(reads.items()), T) == len(got)
    got = rows(kmers.ref_kmers(refs_meta(sequences(refs.items())), K, piece=16), ["ref_id", "rpos", "kmer"])
    expected = {(i, p, s[p : p + K]) for i, s in refs.items() for p in range(len(s) - K + 1)}
    assert got == {x for x in expected if x[2] != "N" * K}


def test_edge_lengths(sequences):
    reads = {n: ("ACGTTGCAAC" * 9)[:n] for n in (0, 16, 17, 30, 31, 32, 46, 47, 62)}
    got = rows(kmers.query_seeds(sequences(reads.items()), 31), ["q", "qpos"])
    assert got == {(32, 0), (46, 0), (47, 0), (47, 15), (62, 0), (62, 15), (62, 30)}


def test_hits(found, texts):
    assert rows(found, HIT) == brute.hits(*texts, T)


def test_hits_in_shuffle_mode(sequences, texts, found):
    reads, refs = texts
    seeds = kmers.query_seeds(sequences(reads.items()), T)
    postings = kmers.ref_kmers(refs_meta(sequences(refs.items())), K)
    assert rows(matching.seed_hits(seeds, postings, n_seeds=10**12), HIT) == rows(found, HIT)


def test_consecutive_seed_filter(found, texts):
    assert rows(matching.consecutive_seed_filter(found), HIT) == brute.near_best(brute.hits(*texts, T))


@pytest.mark.parametrize("block", [5, 8, 13, 65536])
def test_chain_runs_in_any_block_size(found, texts, block):
    assert rows(matching.chain_runs(found, STEP, block=block), RUN) == brute.runs(brute.hits(*texts, T), STEP)


def test_chain_runs_on_diagonals(found, texts):
    got = rows(matching.chain_runs(found, STEP, adjacency="diagonal"), RUN)
    assert got == brute.runs(brute.hits(*texts, T), STEP, diagonal=True)
    with pytest.raises(ValueError):
        matching.chain_runs(found, STEP, adjacency="other")


def test_filters_in_sequence_and_at_once(found, texts):
    expected = brute.tied_longest(brute.runs(brute.near_best(brute.hits(*texts, T)), STEP))
    one_by_one = matching.longest_run_filter(matching.chain_runs(matching.consecutive_seed_filter(found), STEP))
    assert rows(one_by_one, RUN) == expected
    assert rows(matching.candidate_runs(matching.chain_runs(found, STEP), STEP), RUN) == expected


def test_databases_are_judged_apart(found):
    split = found.withColumn("db_id", (F.col("ref_id") % 2).cast("int"))
    got = rows(matching.consecutive_seed_filter(split), HIT)
    all_hits = rows(found, HIT)
    assert got == {h for d in (0, 1) for h in brute.near_best([h for h in all_hits if h[1] % 2 == d])}


@pytest.mark.parametrize("n_runs", [None, 10**12])
@pytest.mark.parametrize("block", [12, 1024])
def test_scores(sequences, texts, found, n_runs, block):
    reads, refs = texts
    meta = refs_meta(sequences(refs.items()))
    runs = matching.candidate_runs(matching.chain_runs(found, STEP), STEP)
    flanked = scoring.fetch_flanks(runs, sequences(reads.items()), meta, T, block=block, n_runs=n_runs)
    kept = scoring.segment_filter(scoring.extend_runs(flanked, T), T)
    got = scoring.relative_score(scoring.raw_score(kept)).collect()
    expected = brute.tied_longest(brute.runs(brute.near_best(brute.hits(reads, refs, T)), STEP))
    assert {(r["q"], r["ref_id"]): (r["sum_sq"], r["considered"], r["covered"], round(r["score"], 6)) for r in got} == brute.scores(
        expected, reads, refs, T
    )


def test_references_of_one_seed_are_left_out_early(spark, found, monkeypatch):
    monkeypatch.setattr(matching, "HITS_PER_PAIR", 0)
    runs = [matching.chain_runs(matching.consecutive_seed_filter(found, STEP, chained=c), STEP) for c in (False, True)]
    plain, early = (rows(matching.longest_run_filter(r), RUN) for r in runs)
    assert plain and early == plain

    # Seed 1 is hit by reference 2 alone, and still lies between the seeds 0 and 2 of reference 0.
    seeds = {0: (0, 2), 1: (2, 3, 4), 2: (1,)}
    hits = [(0, "+", 0, ref, n * STEP, n * STEP) for ref, numbers in seeds.items() for n in numbers]
    frame = spark.createDataFrame(hits, "q BIGINT, strand STRING, db_id INT, ref_id BIGINT, qpos INT, rpos INT")
    kept = matching.consecutive_seed_filter(frame, STEP, chained=True)
    assert {r["ref_id"] for r in kept.collect()} == {1}
    assert matching._of_several_seeds(frame).where("ref_id = 2").count() == 0
