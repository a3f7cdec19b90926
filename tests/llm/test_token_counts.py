import pytest

from seedweave.llm import token_counts as tc


@pytest.fixture
def rollup(spark, tmp_path):
    return tc.TokenRollup(spark, str(tmp_path / "rollup"))


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), tc.CHANGES)


def test_inserts_revisions_and_deletes(spark, rollup):
    assert totals(rollup) == {}
    assert rollup.apply("b1", changes(spark, ("insert", 1, "v", "a", "en", 10), ("insert", 2, "v", "a", "en", 5), ("insert", 3, "v", "b", None, 7)))
    assert totals(rollup) == {("a", "en", "v"): (2, 15), ("b", None, "v"): (1, 7)}
    assert rollup.apply("b2", changes(spark, ("revise", 1, "v", "b", "de", 4), ("delete", 3, "v", None, None, None), ("delete", 9, "v", None, None, None)))
    assert totals(rollup) == {("a", "en", "v"): (1, 5), ("b", "de", "v"): (1, 4)}
    assert rollup.apply("b3", changes(spark, ("insert", 3, "v", "b", "de", 1), ("insert", 3, "w", "b", "de", None)))
    assert totals(rollup) == {("a", "en", "v"): (1, 5), ("b", "de", "v"): (2, 5), ("b", "de", "w"): (1, 0)}


def test_a_batch_is_applied_once(spark, rollup):
    batch = changes(spark, ("insert", 1, "v", "a", "en", 10))
    assert rollup.apply("x", batch) and not rollup.apply("x", batch)
    assert totals(rollup) == {("a", "en", "v"): (1, 10)}


def test_a_batch_that_broke_off_is_written_again(spark, rollup, monkeypatch):
    batch = changes(spark, ("insert", 1, "v", "a", "en", 10))
    real = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda data, schema: (_ for _ in ()).throw(OSError()) if data and data[0][0] == "x" else real(data, schema))
    with pytest.raises(OSError):
        rollup.apply("x", batch)
    monkeypatch.undo()
    assert totals(rollup) == {}
    assert rollup.apply("x", batch)
    assert totals(rollup) == {("a", "en", "v"): (1, 10)}


def test_rows_of_one_key_and_rows_without_one(spark, rollup):
    rollup.apply(
        "b",
        changes(
            spark, ("insert", 1, "v", "a", "en", 3), ("insert", 1, "v", "a", "en", 3), ("insert", 2, "v", "a", "en", 3),
            ("delete", 2, "v", None, None, None), ("insert", None, "v", "a", "en", 9), ("insert", 4, None, "a", "en", 9),
        ),
    )
    assert totals(rollup) == {("a", "en", "v"): (1, 3)}


def test_counts_from_documents(spark, documents, rollup):
    from pyspark.sql import functions as F

    docs = documents([(1, " a  b\tc\n", "en", "s"), (2, None, "en", "s"), (3, "", None, None)])
    rollup.apply("b", tc.counted(docs, {"w": tc.word_tokens(F.col("text")), "b": tc.byte_tokens(F.col("text"))}))
    rollup.apply("none", tc.counted(documents([]), {"w": tc.word_tokens(F.col("text"))}))
    assert totals(rollup) == {("s", "en", "w"): (2, 3), ("s", "en", "b"): (2, 2), (None, None, "w"): (1, 0), (None, None, "b"): (1, 0)}
