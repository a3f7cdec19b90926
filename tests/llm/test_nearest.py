import numpy as np
import pytest
from pyspark.sql import functions as F

from seedweave.llm import nearest


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>")


def brute(ids, data, k=5):
    data = data.astype(np.float32).astype(float)
    norms = np.sqrt((data * data).sum(1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        scores = (data * data[q]).sum(1) / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def test_recall_and_scores(spark, shared_folder):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((4000, 32)) + 0.5 * rng.standard_normal((8, 32))[rng.integers(0, 8, 4000)]
    ids = rng.permutation(9000)[:4000]
    table = vectors(spark, list(zip(ids.tolist(), data.tolist())))
    got = nearest.nearest(table, table.where(F.pmod("vec_id", F.lit(50)) == 0)).collect()
    truth = brute(ids, data)
    found = {q: {} for q in truth}
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
    recall = np.mean([len({v for v, _ in found[q].values()} & {v for v, _ in truth[q]}) / 5 for q in truth])
    assert recall >= 0.9
    exact = {(q, v): s for q, t in truth.items() for v, s in t}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, x in found.items() for v, s in x.values() if (q, v) in exact)


def test_copies_tie_to_the_smaller_id(spark, shared_folder):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(1000 + i, [3.0, -1.0, i]) for i in range(20)]
    table = vectors(spark, rows).repartition(6)
    got = nearest.nearest(table, table.where("vec_id in (0, 350)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(350, i) for i in (0, 1, 2, 3, 4)]
    assert all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_vectors_that_take_no_part(spark, shared_folder):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 1]), (2, [-1, 0]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, []), (9, [1, 0, 0]), (None, [1, 0]), (50, [0, 0]), (1, [1, 1])]
    table = vectors(spark, rows).withColumn("rank", F.lit("clash"))
    got = nearest.nearest(table, table.where(F.pmod("vec_id", F.lit(50)) == 0)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert [r["score"] for r in got] == pytest.approx([2**-0.5, -1])
    assert nearest.nearest(vectors(spark, []), vectors(spark, [])).count() == 0


def test_several_query_blocks_equal_one(spark, shared_folder, monkeypatch):
    rng = np.random.default_rng(2)
    table = vectors(spark, list(enumerate(rng.standard_normal((300, 8)).tolist())))
    queries = table.where("vec_id < 40")
    one = sorted(nearest.nearest(table, queries).collect())
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 16)
    assert sorted(nearest.nearest(table, queries).collect()) == one


def test_a_search_does_not_depend_on_the_queries_before(monkeypatch):
    rng = np.random.default_rng(5)
    units = rng.standard_normal((1500, 16))
    units[:300] = units[0] + 0.05 * units[:300]
    units /= np.linalg.norm(units, axis=1)[:, None]
    axes = nearest.directions(16, 64)
    index, rounds = nearest.BlockIndex(units, axes), []
    plain = np.bincount
    monkeypatch.setattr(nearest.np, "bincount", lambda *a, **kw: rounds.append(1) or plain(*a, **kw))
    picks = [*range(0, 300, 30), *range(400, 1500, 20)]
    warm = [index.near(units[i], 5) for i in picks]
    taken, rounds[:] = len(rounds), []
    for i, got in zip(picks, warm):
        index.start = 0
        assert np.array_equal(index.near(units[i], 5), got)
    assert 2 * taken < len(rounds)
