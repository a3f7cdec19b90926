import random

import pytest
from pyspark.sql import functions as F

from seedweave.operators import copies
from seedweave.operators import index as ix
from seedweave.operators import report
from seedweave.plans.classify import classify, classify_tiers
from seedweave.plans.collapse import classify_collapsed
from seedweave.plans.stream import classify_stream, write_batch
from seedweave.sources import index_store

FLIP = str.maketrans("ACGT", "TGCA")


def turned(text):
    return text[::-1].translate(FLIP)


@pytest.fixture(scope="module")
def world(sequences):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(240)) for _ in range(4)]
    refs = [(i, base[i % 4]) for i in range(10)] + [(10, turned(base[0])), (11, base[1][:150] + "A" * 60)]
    half = base[2][:40]
    texts = [base[0][20:150], turned(base[0][20:150]), base[1][5:200], half + turned(half), base[3][:70] + base[0][70:140], "ACGU" * 20]
    reads = [(3 * i + j, texts[(i + j) % 6]) for i in range(12) for j in range(3)]
    return sequences(reads), sequences(refs)


def rows(df):
    return sorted(map(tuple, df.select("q", "query_header", "confident_text", "tax_ids", "occurrences", "headers", "grp").collect()))


def test_collapsed_equals_plain(world):
    reads, refs = world
    plain = rows(classify(reads, refs, top_only=False))
    assert plain and rows(classify_collapsed(reads, refs, top_only=False, rows_per_salt=2)) == plain
    assert rows(classify_collapsed(reads, ix.build_index(refs, 31), top_only=False)) == plain


def test_without_strands(world):
    reads, refs = world
    assert rows(classify_collapsed(reads, refs, strands=False)) == rows(classify(reads, refs, strands=False))


def test_heads_and_salts(spark, sequences):
    reads = sequences([(5, "AACC"), (2, "GGTT"), (9, "AACC"), (7, "ACGU"), (1, "ACGU"), (4, "ACGT"), (3, "AACC"), (6, "")])
    found = copies.find_copies(reads, strands=True, rows_per_salt=2)
    got = {r["seq_id"]: (r["leader"], r["head"], r["n_salts"]) for r in found.collect()}
    assert got == {5: (3, 2, 2), 9: (3, 2, 2), 3: (3, 2, 2), 2: (2, 2, 1), 7: (1, 1, 1), 1: (1, 1, 1), 4: (4, 4, 1), 6: (6, 6, 1)}
    assert sorted(r["seq_id"] for r in copies.heads_only(reads, found).collect()) == [1, 2, 4, 6]
    answers = spark.createDataFrame([(3, "x"), (3, "y"), (2, "z")], "q BIGINT, a STRING")
    spread = sorted(map(tuple, copies.fan_back(answers, found).collect()))
    assert spread == [(2, "z"), (3, "x"), (3, "y"), (5, "x"), (5, "y"), (9, "x"), (9, "y")]
    assert copies.find_copies(reads.limit(0)).count() == 0


def test_only_heads_are_scored(world):
    reads, refs = world
    read_heads = copies.heads_only(reads, copies.find_copies(reads, strands=True))
    ref_heads = copies.heads_only(refs, copies.find_copies(refs))
    # 36 reads are 6 texts, two of which are each other's reverse complement.
    assert (read_heads.count(), ref_heads.count()) == (5, 6)


def test_parts_of_long_lines(spark):
    n = 100_000
    members = spark.range(n).select(
        F.lit(1).cast("bigint").alias("q"), F.lit(1).alias("grp"), F.lit(0.5).alias("confident"),
        F.pmod(F.col("id") * 7919, F.lit(n)).alias("ref_id"),
    )
    meta = members.select("ref_id", F.concat(F.lit("h"), "ref_id").alias("header"), (F.col("ref_id") % 2).cast("int").alias("tax_id"))
    full = report.with_reference(members, meta).unionByName(
        spark.sql("SELECT 2L q, 1 grp, 0.5D confident, id ref_id, 'one' header, 0 tax_id FROM range(1)")
    )
    winners = report.winning_taxa(report.tax_occurrences(full))
    parts = report.header_parts(full, winners, 1000).where("q = 1").orderBy("part_no").collect()
    assert [r["part_no"] for r in parts] == list(range(100))
    assert max(r["headers"].count(",") + 1 for r in parts) == 1000
    joined = ",".join(r["headers"] for r in parts).split(",")
    assert joined == [f"h{i}" for i in range(0, n, 2)] + [f"h{i}" for i in range(1, n, 2)]
    assert report.header_parts(full, winners, 1000).where("q = 2").first()["headers"] == "one"
    reads = spark.createDataFrame([(1, ">r")], "seq_id BIGINT, header STRING")
    lines = report.screen_parts(members, meta, reads, 700).orderBy("part_no").collect()
    assert ";".join(r["refs"] for r in lines) == ";".join(f"{i};h{i};" for i in range(n)) and len(lines) == 143


def test_sample_reads_its_share(spark, sequences, tmp_path):
    rng = random.Random(2)
    refs = sequences([(i, "".join(rng.choice("ACGT") for _ in range(4000))) for i in range(100)])
    whole = ix.build_index(refs, 31)
    path = str(tmp_path / "i")
    index_store.write_index(whole, path, n_buckets=1, sampleable=True)
    quarter = index_store.read_index(spark, path, 31, pct=25)
    expected = ix.sample_index(whole, 25).postings.select("kmer", "ref_id", "rpos")
    got = quarter.postings.select("kmer", "ref_id", "rpos")
    assert quarter.sampled and got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got.collect()
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    total = whole.postings.count()
    assert read < 0.35 * total
    # Only the whole index vouches for the high-precision tier.
    reached = [{r["tier"] for r in classify_tiers(refs.limit(3), i).select("tier").distinct().collect()} for i in (quarter, whole)]
    assert reached[0] and "high_precision" in reached[1] and "high_precision" not in reached[0]
    # An index that was not laid out for it is sampled row by row; united parts are each sampled.
    plain = str(tmp_path / "p")
    index_store.write_index(whole, plain, n_buckets=1)
    both = index_store.read_index(spark, [path, plain], 31, pct=25)
    assert both.sampled and both.postings.count() == 2 * expected.count()
    with pytest.raises(ValueError):
        index_store.read_index(spark, path, 31, pct=101)
    # Sketches of both hold the same k-mers.
    exact = ix.unique_seeds(whole.postings).first()["n"]
    for paths in (path, [path, plain]):
        assert abs(index_store.unique_seeds_stored(spark, paths).first()["n"] - exact) <= 0.03 * exact


def test_stream_and_replayed_batch(spark, world, tmp_path):
    reads, refs = world
    index = ix.build_index(refs, 31)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    reads.repartition(2, "seq_id").write.parquet(source)
    arriving = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(source)
    classify_stream(arriving, index, out, str(tmp_path / "c")).awaitTermination()
    plain = rows(classify(reads, index))
    assert rows(spark.read.parquet(out)) == plain
    # A batch that is run again replaces its rows; nothing new arrives for a restarted stream.
    first = spark.read.parquet(out).where("batch_id = 0").select("q").distinct()
    kept = reads.join(first, F.col("seq_id") == F.col("q"), "left_semi").collect()
    again = spark.createDataFrame(kept, reads.schema)
    write_batch(again, 0, index, out)
    classify_stream(arriving, index, out, str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(out)) == plain
