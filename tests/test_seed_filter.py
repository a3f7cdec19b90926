import random
import re

import pytest
from pyspark.sql import functions as F

from seedweave import session
from seedweave.operators import kmers, matching, ranking, scoring, seed_filter
from seedweave.operators.index import build_index, prune_index_to_queries, union_indexes
from seedweave.plans import classify, collapse
from seedweave.plans.classify import classify_scores
from seedweave.sources.index_store import read_index, write_index

K = 12


@pytest.fixture(scope="module")
def text(spark, sequences):
    """Reads cut from a few references, and one k-mer that most references hold."""
    rng = random.Random(4)
    body = ["".join(rng.choice("ACGT") for _ in range(600)) + "AACCGGTTACGTA" * (i % 3) for i in range(120)]
    refs = sequences(list(enumerate(body)))
    reads = sequences([(i, body[i * 5][i : i + 90]) for i in range(20)])
    return reads, refs


def parts(text):
    reads, refs = text
    return kmers.query_seeds(reads, 2 * K - 2), kmers.ref_kmers(refs.withColumnRenamed("seq_id", "ref_id"), K)


def as_set(df):
    return {(r["q"], r["ref_id"], r["qpos"], r["rpos"]) for r in df.collect()}


@pytest.mark.parametrize("seeds_per_filter", [seed_filter.SEEDS_PER_FILTER, 40, 1])
def test_hits_are_those_of_the_plain_join(text, monkeypatch, seeds_per_filter):
    monkeypatch.setattr(seed_filter, "SEEDS_PER_FILTER", seeds_per_filter)
    seeds, postings = parts(text)
    n = seeds.count()
    assert seed_filter.passes_for(n) == {1: 0, 40: -(-n // 40)}.get(seeds_per_filter, 1)
    hits = matching.seed_hits(seeds, postings, n_seeds=n, broadcast_bytes=0)
    plain = postings.join(seeds, "kmer")
    assert as_set(hits) == as_set(plain) and hits.count() == plain.count()


def test_few_other_kmers_reach_the_shuffle(text):
    seeds, postings = parts(text)
    n = seeds.count()
    (passed,) = seed_filter.filtered_postings(postings, seeds, 1)
    wanted = postings.join(seeds.select("kmer").distinct(), "kmer", "left_semi").count()
    assert wanted <= passed.count() <= wanted + 0.05 * postings.count()
    plan = matching.seed_hits(seeds, postings, n_seeds=n, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    # The postings' side: the filter's join lies below the exchange of the k-mers.
    side = plan[: plan.index("Generate")]
    assert side.rindex("BroadcastHashJoin") > side.index("Exchange hashpartitioning(kmer")


def test_several_filters_read_the_postings_once(spark, text, monkeypatch, tmp_path):
    seeds, postings = parts(text)
    n = seeds.count()
    plain = as_set(postings.join(seeds, "kmer"))
    postings.write.parquet(str(tmp_path / "postings"))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    monkeypatch.setattr(seed_filter, "SEEDS_PER_FILTER", -(-n // 5))
    assert seed_filter.passes_for(n) == 5
    hits = matching.seed_hits(seeds, stored, n_seeds=n, broadcast_bytes=0)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "rpos" in line]) == 1
    assert as_set(hits) == plain and hits.count() == len(plain)


def test_a_filter_has_a_fixed_size(spark):
    seeds = spark.range(400_000).select(F.md5(F.col("id").cast("string")).alias("kmer"))
    words = seeds.select(seed_filter._word(F.xxhash64("kmer")).alias("w")).distinct()
    assert words.count() <= 1 << seed_filter.WORD_BITS


def test_stored_blocks_move_no_text(spark, text, tmp_path):
    reads, refs = text
    for i in (0, 1):
        half = refs.where(F.col("seq_id") % 2 == i).withColumn("seq_id", F.floor(F.col("seq_id") / 2))
        write_index(build_index(half, 31), str(tmp_path / f"i{i}"), n_buckets=3)
    index = read_index(spark, [str(tmp_path / "i0"), str(tmp_path / "i1")], 31)
    assert [(b.first, b.end) for b in index.blocks] == [(0, 60), (60, 120)]
    runs = spark.createDataFrame(
        [(q, s, 0, r, 2, 20, at, 50, at + 30) for q in range(20) for s in "+-" for r, at in ((q * 6, 20), (q * 6 + 1, 570), (119, 0))],
        "q BIGINT, strand STRING, db_id INT, ref_id BIGINT, n_seeds INT, q_start INT, r_start INT, q_end INT, r_end INT",
    )
    near = scoring.fetch_flanks(runs, reads, index.refs, 31, block=64)
    far = scoring.fetch_flanks(runs, reads, index.refs, 31, block=64, stored=index.blocks, broadcast_bytes=0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, far.select(near.columns).collect()), key=str)
        plan = far._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Per part one exchange into the buckets, that of the requests; the scan below the join has none.
    scans = [line for line in plan.splitlines() if "_blocks" in line and "FileScan" in line or "Scan parquet" in line and "block_text" in line]
    assert len(re.findall(r"Exchange hashpartitioning\(ref_id#\d+L?, block", plan)) == len(index.blocks), plan
    assert scans


def test_an_overlap_too_short_falls_back_to_the_text(spark, text, tmp_path):
    reads, refs = text
    write_index(build_index(refs, 31), str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"), 31)
    assert union_indexes([index, build_index(refs, 31)]).blocks == ()
    with pytest.warns(UserWarning):
        index = read_index(spark, str(tmp_path / "i"), 400)
    runs = spark.createDataFrame(
        [(0, "+", 0, 0, 2, 20, 20, 50, 50)],
        "q BIGINT, strand STRING, db_id INT, ref_id BIGINT, n_seeds INT, q_start INT, r_start INT, q_end INT, r_end INT",
    )
    row = scoring.fetch_flanks(runs, reads, index.refs, 400, stored=index.blocks, broadcast_bytes=0).first()
    assert row["r_tail"] == refs.where("seq_id = 0").first()["seq"][50:450]


def test_classified_alike_with_nothing_broadcast(spark, text, tmp_path):
    reads, refs = text
    write_index(build_index(refs, 21), str(tmp_path / "i"), n_buckets=3, rows_per_salt=20)
    columns = ["q", "strand", "ref_id", "confident", "sum_sq", "covered"]
    near = classify_scores(reads, refs, threshold=21).select(columns)
    for target in (refs, read_index(spark, str(tmp_path / "i"), 21)):
        far = classify_scores(reads, target, threshold=21, broadcast_bytes=0).select(columns)
        assert sorted(near.collect()) == sorted(far.collect())


def test_millions_of_seeds_take_one_broadcast_of_packed_words(spark):
    assert seed_filter.passes_for(14_400_000) == 1 and seed_filter.word_bits_for(14_400_000) == 21
    assert [seed_filter.word_bits_for(n) for n in (0, 1, 8 << 18, (8 << 18) + 1, 1 << 40)] == [18, 18, 18, 19, 21]
    hashes = spark.range(50_000).select(F.xxhash64("id").alias("__h"))
    rows = seed_filter._filter(hashes, 18).collect()
    assert len(rows) == (1 << 18) // seed_filter.ROW_WORDS and {len(r["__words"]) for r in rows} == {seed_filter.ROW_WORDS}
    wanted = {}
    for (h,) in hashes.collect():
        bits = 0
        for shift in (0, 6, 12):
            bits |= 1 << (h >> shift & 63)
        wanted[(h & (1 << 64) - 1) >> 46] = wanted.get((h & (1 << 64) - 1) >> 46, 0) | bits
    got = {r["__row"] * seed_filter.ROW_WORDS + i: w & (1 << 64) - 1 for r in rows for i, w in enumerate(r["__words"]) if w}
    assert got == wanted


def test_many_requests_are_not_broadcast_for_their_small_files(spark, text):
    reads, refs = text
    runs = spark.createDataFrame(
        [(q, "+", 0, q * 5, 2, 20, 20, 50, 50) for q in range(20)],
        "q BIGINT, strand STRING, db_id INT, ref_id BIGINT, n_seeds INT, q_start INT, r_start INT, q_end INT, r_end INT",
    )
    few = scoring.fetch_flanks(runs, reads, refs.withColumnRenamed("seq_id", "ref_id"), 31)
    many = scoring.fetch_flanks(runs, reads, refs.withColumnRenamed("seq_id", "ref_id"), 31, broadcast_bytes=0)
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect()) and many.count() == 20


def test_a_stage_with_many_rows_is_not_broadcast(spark, tmp_path):
    spark.range(600_000).selectExpr("id", "1 AS one").write.parquet(str(tmp_path / "t"))
    stage = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df.join(spark.range(10_000_000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(stage) and "BroadcastHashJoin" not in plan(session.judged_by_rows(stage))
    assert "BroadcastHashJoin" in plan(session.judged_by_rows(stage, 1000))


def test_pruning_filters_postings_before_their_shuffle(text, monkeypatch):
    seeds, postings = parts(text)
    few = prune_index_to_queries(postings, seeds)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    many = prune_index_to_queries(postings, seeds)
    assert "__words" in many._jdf.queryExecution().optimizedPlan().toString()
    assert few.columns == many.columns and few.count() > 0
    assert sorted(few.collect()) == sorted(many.collect())


def test_joins_on_written_stages_are_judged_by_rows(text, monkeypatch):
    reads, refs = text
    near = collapse.classify_collapsed(reads, refs, 21).count()
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return session.write_stage(df, name)

    monkeypatch.setattr(classify, "write_stage", seen)
    monkeypatch.setattr(collapse, "write_stage", seen)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert collapse.classify_collapsed(reads, refs, 21).count() == near > 0
    assert not [name for name in ("candidates", "scores", "answers") if "BroadcastHashJoin" in plans[name]]


@pytest.mark.parametrize("top_only", [True, False])
def test_ranks_are_not_broadcast(spark, top_only):
    scores = spark.createDataFrame([(q, q % 3, (q % 3) / 4) for q in (1, 1, 2)] + [(1, 9, 0.75)], "q BIGINT, ref_id BIGINT, score DOUBLE")
    grouped = ranking.score_groups(scores, top_only).select("q", "ref_id", "grp")
    rows = sorted(tuple(r) for r in grouped.collect())
    # The plan as it ran: Spark may turn to a broadcast on the way.
    assert "BroadcastHashJoin" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert rows == [(1, 1, 2)] * (0 if top_only else 2) + [(1, 9, 1), (2, 2, 1)]
