"""Streaks from bitmaps against a walk over the numbered seeds, and chaining where many seeds meet one place."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from seedweave.operators import matching
from seedweave.operators.streaks import seed_words

HITS = "q BIGINT, strand STRING, db_id INT, ref_id BIGINT, qpos BIGINT, rpos BIGINT"


def longest(hits):
    """Longest streak per (q, db_id, ref_id)."""
    out = {}
    for q, db in {(h[0], h[2]) for h in hits}:
        number = {p: i for i, p in enumerate(sorted({h[4] for h in hits if (h[0], h[2]) == (q, db)}))}
        for ref in {h[3] for h in hits if (h[0], h[2]) == (q, db)}:
            own = {number[h[4]] for h in hits if (h[0], h[2], h[3]) == (q, db, ref)}
            best = now = 0
            for i in range(len(number)):
                now = now + 1 if i in own else 0
                best = max(best, now)
            out[q, db, ref] = best
    return out


@pytest.mark.parametrize("step", [1, 15])
def test_streaks_across_words(spark, step):
    rng = random.Random(step)
    hits = []
    for q in range(2):
        for ref, density in enumerate([0.99, 0.9, 0.5, 0.02, 1.0]):
            hits += [(q, "+", ref % 2, ref, i * 15, 0) for i in range(400) if rng.random() < density and not 130 <= i < 270]
    # A streak of whole words, one that ends with a word, one that begins with one, and a seed that only another pair has.
    hits += [(2, "+", 0, 0, i * 15, 0) for i in range(64, 192)] + [(2, "+", 0, 1, i * 15, 0) for i in (*range(40, 64), *range(192, 210))]
    words = seed_words(spark.createDataFrame(hits, HITS), matching.PAIR, step)
    got = {(r["q"], r["db_id"], r["ref_id"]): r["streak"] for r in matching.seed_streaks(words).collect()}
    assert got == longest(hits)


def test_long_read(spark):
    """A read of 300,000 seeds: no window has more than two rows for 64 of them."""
    n = 300_000
    base = spark.range(n).select(F.lit(0).cast("bigint").alias("q"), F.lit("+").alias("strand"), F.lit(0).alias("db_id"), (F.col("id") * 15).alias("qpos"))
    whole = base.withColumn("ref_id", F.lit(0).cast("bigint"))
    gapped = base.where("qpos div 15 <> 200000").withColumn("ref_id", F.lit(1).cast("bigint"))
    words = seed_words(whole.unionByName(gapped), matching.PAIR, 15)
    assert words.count() == 2 * -(-n // 64)
    assert {r["ref_id"]: r["streak"] for r in matching.seed_streaks(words).collect()} == {0: n, 1: 200_000}


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_chains_where_many_seeds_meet_a_place(spark, block):
    rng = random.Random(block)
    hits = {(q, ref, 3 * rng.randrange(6), rng.randrange(30)) for q in range(2) for ref in range(3) for _ in range(90)}
    table = spark.createDataFrame([(q, "+", 0, ref, a, b) for q, ref, a, b in hits], HITS)
    columns = ["q", "ref_id", "n_seeds", "q_start", "r_start", "q_end", "r_end"]
    got = [tuple(r) for r in matching.chain_runs(table, 3, block=block).select(*columns).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.runs(hits, 3)


def test_no_hits(spark):
    none = spark.createDataFrame([], HITS)
    assert matching.consecutive_seed_filter(none, 15).count() == 0 and matching.chain_runs(none, 15).count() == 0
