import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from seedweave.llm import mixing, queries


def poisson_inverse(u, mean):
    k, term = 0, math.exp(-mean)
    total = term
    while total <= u and k < 500:
        k += 1
        term *= mean / k
        total += term
    return k


def test_inverse_equals_the_distribution(spark):
    rows = [(u / 997, m) for u in range(997) for m in (0.0, 0.05, 0.9, 4.0, 16.5)]
    df = spark.createDataFrame(rows, "u DOUBLE, m DOUBLE")
    got = df.select("u", "m", mixing.poisson_inverse(F.col("u"), F.col("m"), mixing.most_copies(17.0)).alias("k")).collect()
    assert all(r["k"] == poisson_inverse(r["u"], r["m"]) for r in got)


def test_shares_meet_the_weights(documents):
    docs = documents([(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(6000)])
    counts = Counter(r["source"] for r in mixing.mixed(docs, {"big": 1.0, "small": 3.0}).collect())
    assert abs(counts["small"] / sum(counts.values()) - 0.75) < 0.03
    assert abs(sum(counts.values()) - 6000) < 300


def test_copies_are_the_same_on_every_run_and_shuffled(documents):
    docs = documents([(i, f"t{i}", "en", f"s{i % 5}") for i in range(300)])
    first = mixing.shuffled(mixing.mixed(docs, {"s1": 4.0})).collect()
    again = mixing.shuffled(mixing.mixed(docs.repartition(7), {"s1": 4.0})).collect()
    assert first == again
    assert [r["shuffle_key"] for r in first] == sorted(r["shuffle_key"] for r in first)
    numbers = Counter(r["doc_id"] for r in first)
    assert all(numbers[r["doc_id"]] == r["copies"] and 1 <= r["copy_no"] <= r["copies"] for r in first)


def test_large_rates_keep_their_whole_part(documents):
    docs = documents([(i, "t", "en", "rare" if i < 10 else "usual") for i in range(1000)])
    got = Counter(r["source"] for r in mixing.mixed(docs, {"rare": 1.0, "usual": 1.0}).collect())
    assert abs(got["rare"] - 500) < 60


def test_null_source_null_id_repeats_and_empty_table(documents):
    docs = documents([(None, "a", None, None), (1, None, "en", None), (1, None, "en", None)]).withColumnRenamed("lang", "copies")
    rows = mixing.mixed(docs, {}, other=1.0, epoch=20.0).collect()
    assert {r["source"] for r in rows} == {None}
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.shuffled(mixing.mixed(documents([]), {"a": 1.0})).count() == 0


@pytest.mark.parametrize("mean", [20.0, 100.0, 1000.0])
def test_any_rate_has_the_variance_of_a_poisson_draw(documents, mean):
    docs = documents([(i, "t", "en", "s") for i in range(600)])
    copies = [r["copies"] for r in mixing.mixed(docs, {}, epoch=mean).where("copy_no = 1").select("copies").collect()]
    assert len(copies) == 600
    found = sum(copies) / 600
    assert abs(found - mean) < 4 * math.sqrt(mean / 600)
    assert abs(sum((c - found) ** 2 for c in copies) / 599 / mean - 1) < 4 * math.sqrt(2 / 599)


def test_large_means_equal_the_distribution_in_whole_numbers(spark):
    rows = [(u / 97, m) for u in range(97) for m in (20.0, 100.0, 699.5, 700.5, 1000.0, 5000.0)]
    df = spark.createDataFrame(rows, "u DOUBLE, m DOUBLE")
    got = df.select("u", "m", mixing.poisson_inverse(F.col("u"), F.col("m"), mixing.most_copies(F.col("m"))).alias("k"))
    for r in got.where("u > 0").collect():
        below = lambda k, m=r["m"]: math.fsum(math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(k + 1))
        assert below(r["k"] - 1) - 1e-9 <= r["u"] < below(r["k"]) + 1e-9


def test_large_rates_equal_the_sql(documents):
    # Rates of about 102 and 20; the SQL sums 150 terms.
    names = ["rare"] * 13 + ["src1"] * 100 + ["src0"] * 5887
    docs = documents([(i, "t", "en", name) for i, name in enumerate(names)])
    got = mixing.mixed(docs, queries.MIX_WEIGHTS, seed=queries.MIX_SEED).select("doc_id", "copies", "copy_no").collect()
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.execute(f"SELECT doc_id, copies, copy_no FROM ({queries.OP7_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
