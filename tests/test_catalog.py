import pytest

import __spark_entry__ as driver
from catalog import check, oracles, queries

SMALL = "/root/testdata/sf0.001"
# The heavier registered queries are compared by `python -m catalog.check`.
QUICK = [
    "classify_two_indexes", "lookup_taxid_repeated", "relative_abundance", "read_fasta", "read_fastq", "read_sequence_table", "union_indexes", "split_reference", "translate_headers",
    "suppress_frequent_seeds", "sample_index", "fetch_flanks", "screen_rows", "write_results_tiered",
    "classify_text", "classify_all_groups", "duplicate_queries",
    "classify_collapsed", "winning_taxa_kin", "result_parts", "unique_seeds_stored",
]


def test_every_query_has_sql():
    # The dense scoring's SQL takes too long on whole tables; test_matching
    # compares the same steps with brute force.
    assert set(queries.QUERIES) - set(oracles.oracle_sql()) == {"score_reads_dense"}
    assert set(queries.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 3


@pytest.fixture(scope="module")
def db():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    same, detail = check.compare(spark, db, SMALL, name, driver.oracle_sql()[name])
    assert same, detail


def test_references_are_not_broadcast_to_the_reads(spark, monkeypatch):
    # Spark takes a text made by an expression for 20 bytes, so by its own measure a million references fit.
    plans, write = {}, queries.write_stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(queries, "write_stage", seen)
    queries.clear_stages()
    queries.dna_reads(spark, SMALL)
    assert "SortMergeJoin" in plans["dna-reads-raw"]
    assert "BroadcastHashJoin" not in plans["dna-reads-raw"]


@pytest.mark.parametrize("name", ["ref_kmers_text", "ref_kmers_dealt", "union_indexes"])
def test_profiles_do_not_sort_every_posting(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[plan.rindex("Sort [") :]


@pytest.mark.parametrize("order", [["db_id", "ref_id", "rpos"], ["rpos", "ref_id"]])
def test_profile_of_small_batches(spark, order):
    texts = [(0, 1, "ACGTTGCA"), (0, 2, "A"), (1, 1, "zz\u00e4\U0001f600zz"), (1, 3, "NNNNNACG")]
    refs = spark.createDataFrame(texts, "db_id INT, ref_id BIGINT, seq STRING")
    postings = queries.kmers.ref_kmers(refs, 3).repartition(2).sortWithinPartitions(*order)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = sorted(queries._profile_in_order(postings).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == sorted(queries._posting_profile(postings).collect())


@pytest.mark.parametrize("name", ["posting_lists", "sample_index"])
def test_kmers_are_not_written_before_one_use(spark, monkeypatch, name):
    written, write = [], queries.write_stage
    monkeypatch.setattr(queries, "write_stage", lambda df, name: (written.append(name), write(df, name))[1])
    queries.clear_stages()
    queries.QUERIES[name](spark, SMALL)
    assert written == ["dna-refs"]


def test_postings_move_before_lists_are_made(spark):
    plan = queries.QUERIES["posting_lists"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]


def test_references_are_dealt_by_their_number(spark):
    default = queries.default_spread(spark)
    assert queries.default_spread(spark, 20_000 * default) == default
    assert queries.default_spread(spark, 20_000 * default + 1) == default + 1
    queries.clear_stages()
    assert len(queries.dna_refs(spark, SMALL).inputFiles()) > 1
