import random

from pyspark.sql import functions as F

from seedweave.operators import index as ix
from seedweave.operators import kmers


def test_one_long_reference_in_many_tasks(sequences):
    rng = random.Random(4)
    lengths = [200_000, 0, 16, 17, 4 * 64, 4 * 64 + 16, 4 * 64 + 17, 5000]
    refs = sequences([(i, "".join(rng.choice("ACGTN") for _ in range(n))) for i, n in enumerate(lengths)])
    refs = refs.select(F.col("seq_id").alias("ref_id"), "seq").coalesce(1)
    whole, dealt = kmers.ref_kmers(refs, 17, piece=64), kmers.ref_kmers(refs, 17, piece=64, spread=16)
    assert dealt.exceptAll(whole).count() == whole.exceptAll(dealt).count() == 0
    assert dealt.count() == sum(max(0, n - 16) for n in lengths)
    tasks = dealt.where("ref_id = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) > 8 and max(r["n"] for r in tasks) < 0.3 * lengths[0]


def test_pieces_meet_without_gap(sequences):
    # Lengths around the end of a long piece, each k-mer once.
    step = 4 * kmers.PIECES_MOVED
    refs = sequences([(i, ("ACGGT" * step)[: step + i]) for i in range(20)]).select(F.col("seq_id").alias("ref_id"), "seq")
    got = kmers.ref_kmers(refs, 8, piece=4, spread=3).groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("rpos").alias("d"), F.max("rpos").alias("last")
    )
    assert {r["ref_id"]: (r["n"], r["d"], r["last"]) for r in got.collect()} == {
        i: (step + i - 7, step + i - 7, step + i - 8) for i in range(20)
    }


def test_index_over_dealt_references(sequences):
    refs = sequences([(0, "ACGGTCATTGCAGGATCCATGCAAGCTTGA" * 100)])
    plain, dealt = ix.build_index(refs, 31).postings, ix.build_index(refs, 31, spread=4).postings
    assert plain.exceptAll(dealt).count() == dealt.exceptAll(plain).count() == 0
