import shutil
import warnings

import pytest
from pyspark.sql import functions as F

from seedweave.operators import index as ix
from seedweave.operators import kmers, matching, scan
from seedweave.params import MatchParams
from seedweave.plans.classify import classify
from seedweave.session import write_stage
from seedweave.sources import index_store
from seedweave.sources.index_store import read_index, write_index


@pytest.fixture(scope="module")
def refs(sequences):
    unit = "ACGGTCATTGCAGGATCCATGCAAGCTTGA"
    return sequences([(i, unit * 3 + "ACGT"[i % 4] * 20 + unit[i:] + unit[:i]) for i in range(12)])


def postings_of(df):
    return sorted(tuple(r) for r in df.select("kmer", "db_id", "ref_id", "rpos").collect())


def test_write_and_read(spark, refs, tmp_path):
    index = ix.build_index(refs, 31)
    write_index(index, str(tmp_path / "i"), n_buckets=3, rows_per_salt=10)
    loaded = read_index(spark, str(tmp_path / "i"), 31)
    assert postings_of(loaded.postings) == postings_of(index.postings)
    assert loaded.hot.count() > 0 and loaded.postings.agg(F.max("salt")).first()[0] > 0

    # The bucketed join leaves the postings where they are, and copies hot seeds.
    seeds = kmers.query_seeds(refs, 31)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = matching.seed_hits(seeds, loaded.postings, loaded.hot, n_seeds=10**12)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        # Seeds meet the hot table and then the buckets; the postings stay where they are.
        assert plan.count("Exchange hashpartitioning") == 3
        few = matching.seed_hits(seeds, index.postings)
        assert hits.exceptAll(few).count() == few.exceptAll(hits).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_thresholds_are_checked(spark, refs, tmp_path):
    path = str(tmp_path / "i")
    write_index(ix.build_index(refs, 31), path, n_buckets=2)
    with pytest.raises(ValueError, match="above"):
        read_index(spark, path, 25)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert read_index(spark, path, 40).threshold == 31
    assert any("below" in str(w.message) for w in caught)
    reads = refs.limit(2)
    stored = classify(reads, read_index(spark, path, 40), 40)
    direct = classify(reads, ix.build_index(refs, 31), 40)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_bad_indexes(spark, refs, tmp_path):
    good, missing = str(tmp_path / "good"), str(tmp_path / "missing")
    write_index(ix.build_index(refs, 31), good, n_buckets=2)
    with pytest.raises(Exception):
        read_index(spark, [missing, good], 31)
    with pytest.warns(UserWarning, match="skipping"):
        assert read_index(spark, [missing, good], 31, on_error="skip").refs.count() == 12
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        read_index(spark, [missing], 31, on_error="skip")
    with pytest.raises(ValueError):
        read_index(spark, good, 31, on_error="ignore")


def test_lost_files_are_noticed(spark, refs, tmp_path):
    good, lost, gone = (str(tmp_path / x) for x in ("good", "lost", "gone"))
    for path in (good, lost, gone):
        write_index(ix.build_index(refs, 31), path, n_buckets=3)
    next((tmp_path / "lost" / "postings").glob("part-*.parquet")).unlink()
    shutil.rmtree(tmp_path / "gone" / "postings")
    for bad in (lost, gone):
        with pytest.raises(Exception):
            read_index(spark, bad, 31)
        with pytest.warns(UserWarning, match="skipping"):
            assert read_index(spark, [bad, good], 31, on_error="skip").refs.count() == 12


def test_other_failures_are_not_skipped(spark, monkeypatch):
    def fail(*args):
        raise ConnectionError("lost")

    monkeypatch.setattr(index_store, "_read_one", fail)
    with pytest.raises(ConnectionError):
        read_index(spark, ["anywhere"], 31, on_error="skip")


def test_united_stored_indexes_keep_buckets_salts_and_databases(spark, refs, tmp_path):
    paths = [str(tmp_path / x) for x in "ab"]
    for path in paths:
        write_index(ix.build_index(refs, 31), path, n_buckets=3, rows_per_salt=10)
    both = read_index(spark, paths, 31)
    nested = ix.union_indexes([both, ix.build_index(refs, 31)])
    assert [r[0] for r in nested.refs.select("db_id").distinct().orderBy("db_id").collect()] == [0, 1, 2]
    assert nested.refs.select("ref_id").distinct().count() == 36
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in both.parts:
            hits = matching.seed_hits(kmers.query_seeds(refs, 31), part.postings, part.hot, n_seeds=10**12)
            plan = hits._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3  # seeds twice and the hot table: no postings
            assert hits.exceptAll(matching.seed_hits(kmers.query_seeds(refs, 31), part.postings.select("db_id", "ref_id", "rpos", "kmer"))).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_union_offsets(refs):
    one = ix.build_index(refs, 31)
    both = ix.union_indexes([one, one])
    ids = [tuple(r) for r in both.refs.select("db_id", "ref_id").orderBy("ref_id").collect()]
    assert ids == [(i // 12, i) for i in range(24)]
    assert both.postings.count() == 2 * one.postings.count()
    with pytest.raises(ValueError):
        ix.union_indexes([one, ix.build_index(refs, 33)])


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1, 5], [2, 2, 3, 3, 3, 40], [30, 31, 32], list(range(1, 11))])
def test_suppression(spark, sizes):
    rows = [(0, 1, p, f"k{i}") for i, n in enumerate(sizes) for p in range(n)]
    postings = spark.createDataFrame(rows, "db_id INT, ref_id BIGINT, rpos INT, kmer STRING")
    cut = min(20, sorted(sizes)[int(len(sizes) * 0.30)])
    kept = {r["kmer"] for r in ix.suppress_frequent_seeds(postings, 18).select("kmer").distinct().collect()}
    assert kept == {f"k{i}" for i, n in enumerate(sizes) if n <= cut}
    assert ix.suppress_frequent_seeds(postings, 20) is postings


def test_sampling_is_by_kmer(refs):
    index = ix.build_index(refs, 31)
    half = ix.sample_index(index, 50)
    assert half.sampled and not half.complete
    kept = {r["kmer"] for r in half.postings.select("kmer").distinct().collect()}
    whole = {r["kmer"]: r["count"] for r in index.postings.groupBy("kmer").count().collect()}
    got = {r["kmer"]: r["count"] for r in half.postings.groupBy("kmer").count().collect()}
    assert 0 < len(kept) < len(whole) and all(whole[k] == n for k, n in got.items())
    assert ix.sample_index(index, 100).postings.count() == index.postings.count()
    with pytest.raises(ValueError):
        ix.sample_index(index, 101)


def test_posting_lists_are_bounded(refs):
    postings = kmers.ref_kmers(ix.refs_meta(refs), MatchParams().k)
    lists = ix.posting_lists(postings, ref_span=2, pos_span=16)
    assert lists.agg(F.max("n_postings")).first()[0] <= 32
    assert lists.agg(F.sum("n_postings")).first()[0] == postings.count()
    exact, close = (ix.unique_seeds(postings, approx=a).first()["n"] for a in (False, True))
    assert exact == postings.select("kmer").distinct().count()
    assert abs(close - exact) <= 0.2 * exact


def test_frequent_kmers_are_dropped_before_the_shuffle(spark):
    # AAA is beyond the cap, CCC and GGG are above the cut of one, the other three are kept.
    words = ["AAA"] * 30 + ["CCC"] * 3 + ["GGG"] * 2 + ["ACG", "CGT", "GTA"]
    rows = [(0, i, 0, w) for i, w in enumerate(words)]
    postings = spark.createDataFrame(rows, "db_id INT, ref_id BIGINT, rpos INT, kmer STRING")
    kept = ix.suppress_frequent_seeds(postings, 14)
    assert sorted(r["kmer"] for r in kept.collect()) == ["ACG", "CGT", "GTA"]
    assert "LeftAnti" in kept._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_postings(spark, refs, tmp_path, monkeypatch):
    index = ix.build_index(refs, 31)
    monkeypatch.setattr(index_store, "ROWS_PER_BUCKET", 100)
    write_index(index, str(tmp_path / "i"), n_buckets=2, rows_per_salt=10)
    wanted = -(-index.postings.count() // 100)
    files = list((tmp_path / "i" / "postings").glob("part-*.parquet"))
    assert 2 < wanted // 2 < len(files) <= wanted
    assert postings_of(read_index(spark, str(tmp_path / "i"), 31).postings) == postings_of(index.postings)


def test_frequent_kmers_are_counted_in_crowded_slots_only(spark, monkeypatch):
    words = ["AAA"] * 30 + ["CCC"] * 11 + ["GGG"] * 10 + ["ACG", "CGT", "GTA"] * 4
    postings = spark.createDataFrame([(w,) for w in words], "kmer STRING")
    for least in (1, 16):
        monkeypatch.setattr(index_store, "LEAST_SLOTS", least)
        hot = index_store.hot_kmers(postings, 10)
        assert sorted(map(tuple, hot.collect())) == [("AAA", 3), ("CCC", 2)]
        assert sorted(map(tuple, index_store.hot_kmers(postings, 1_000).collect())) == []


def test_a_written_stage_leaves_no_shuffle_files(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).isShuffle()}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = shuffled(), spark.conf.get(key, None)
    stage = write_stage(spark.range(1000).repartition(3, "id"), "no-shuffle-files")
    assert not shuffled() - before
    assert stage.count() == 1000
    assert spark.conf.get(key, None) == set_before


def test_dealt_kmers_are_those_of_the_references(spark, sequences):
    texts = ["ACGT" * 30, "", "AC", "N" * 60, "né漢字 ab" * 700, "ACGGTCATTGCAGGATCCATGCAAGC" * 200, "ACGGTCATTGCAGGATC"]
    meta = ix.refs_meta(sequences(list(enumerate(texts))))
    plain, dealt = kmers.ref_kmers(meta, 17), scan.dealt_kmers(meta, 17, 5)
    assert postings_of(dealt) == postings_of(plain)
    assert dealt.groupBy("kmer").agg(F.count_distinct("home").alias("n")).where("n > 1").count() == 0
    summary = ix.posting_summary(dealt)
    # Only stretches move; both aggregations find equal k-mers where they are.
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, ix.posting_summary(plain).collect()))
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(home") == 1
    assert ix.unique_seeds(dealt).first()["n"] == ix.unique_seeds(plain).first()["n"]
    lists, before = ix.posting_lists_of(meta, 17, 2, 16), ix.posting_lists(plain, 2, 16)
    assert sorted(map(str, lists.collect())) == sorted(map(str, before.select(*lists.columns).collect()))
