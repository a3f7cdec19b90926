import pytest
from pyspark.sql import functions as F

from seedweave.operators import report
from seedweave.operators import sequences as seqs
from seedweave.sources import lookups, results
from seedweave.sources import sequences as seq_io


def rows(df):
    return [(r["seq_id"], r["header"], r["seq"]) for r in df.orderBy("seq_id").collect()]


def test_fasta_lines_endings_and_ids(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one first\r\nacgt\r\nAC\r\n>two\r\nGG\r\n")
    (tmp_path / "b.fa").write_bytes(b"\n>three\nTT\nTT\n>empty\n>last\nNNA")
    got = rows(seq_io.read_fasta(spark, str(tmp_path)))
    assert got == [
        (0, ">one first", "ACGTAC"),
        (1, ">two", "GG"),
        (2, ">three", "TTTT"),
        (3, ">empty", ""),
        (4, ">last", "NNA"),
    ]


def test_fasta_over_many_splits(spark, tmp_path):
    records = [(f">r{i}", "ACGT" * (i % 40 + 1)) for i in range(3000)]
    (tmp_path / "big.fa").write_text("".join(f"{h}\n{s[:50]}\n{s[50:]}\n" for h, s in records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = seq_io.read_fasta(spark, str(tmp_path))
        assert rows(df) == [(i, h, s) for i, (h, s) in enumerate(records)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_quality_may_look_like_a_header(spark, tmp_path):
    records = [(f"@r{i}", "acgt"[: i % 4 + 1]) for i in range(2000)]
    text = "".join(f"{h}\n{s}\n+\n{'@' * len(s)}\n" for h, s in records)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@z\nTTTT\n+\n@@@@\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = rows(seq_io.read_fastq(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, h, s.upper()) for i, (h, s) in enumerate([*records, ("@z", "TTTT")])]


def test_accession_map(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("accession\taccession.version\ttaxid\tgi\nA\tA.1\t7\t0\nB\tB.2\t9\t0\n")
    got = lookups.read_accession_taxid(spark, str(tmp_path / "m.tsv")).orderBy("accession").collect()
    assert [tuple(r) for r in got] == [("A.1", 7), ("B.2", 9)]
    (tmp_path / "bad.tsv").write_text("accession\taccession.version\ttaxid\tgi\nA\tA.1\n")
    with pytest.raises(Exception):
        lookups.read_accession_taxid(spark, str(tmp_path / "bad.tsv")).collect()


def test_header_map(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text(">a\t>b\nbroken\n")
    with pytest.raises(Exception, match="no new name|MALFORMED"):
        lookups.read_header_map(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "m.tsv").write_text(">a x\t>b;\"y\n")
    assert [tuple(r) for r in lookups.read_header_map(spark, str(tmp_path / "m.tsv")).collect()] == [(">a x", '>b;"y')]


def test_tiers_and_combining(spark, tmp_path):
    data = [(i, f">q{i}", s, f"{s:.6f}", "1", "1", ">a,>b", 1) for i, s in enumerate((0.2, 0.4, 0.75, 1.0))]
    schema = "q BIGINT, query_header STRING, confident DOUBLE, confident_text STRING, tax_ids STRING, occurrences STRING, headers STRING, grp INT"
    df = spark.createDataFrame(data, schema)
    counts = {r["tier"]: r["count"] for r in report.tiers(df).groupBy("tier").count().collect()}
    assert counts == {"raw": 4, "high_sensitivity": 3, "balanced": 2, "high_precision": 1}
    assert "high_precision" not in {r["tier"] for r in report.tiers(df, sampled=True).select("tier").collect()}

    results.write_results_tiered(df, str(tmp_path / "t"))
    back = results.combine_results(spark, [str(tmp_path / "t" / "tier=balanced"), str(tmp_path / "t" / "tier=raw")])
    assert back.columns == results.RESULT_COLUMNS
    assert back.count() == 6
    assert back.where(F.col("InputID") == 3).first()["Confident"] == "1.000000"
    with pytest.raises(ValueError):
        results.combine_results(spark, [])


def test_relative_abundance(spark):
    rows = [(1, 5, ">a, primary"), (1, 6, ">b"), (2, 5, ">a, primary"), (3, 7, ">a, alt"), (4, 5, ">a, primary"), (4, 7, ">a, alt")]
    data = [(q, 1, 1.0, ref, header, 9) for q, ref, header in rows]
    members = spark.createDataFrame(data, "q BIGINT, grp INT, confident DOUBLE, ref_id BIGINT, header STRING, tax_id INT")
    winners = report.winning_taxa(report.tax_occurrences(members))
    got = {r["header"]: r["pct"] for r in report.relative_abundance(members, winners).collect()}
    assert got == {">a, primary": 75.0, ">a, alt": 25.0}


def test_repeated_lookup_keys_do_not_multiply_references(spark):
    refs = spark.createDataFrame([(1, ">A.1 x"), (2, ">B.1 y")], "ref_id BIGINT, header STRING")
    taxa = spark.createDataFrame([("A.1", 4), ("A.1", 9), ("A.1", 9)], "accession STRING, tax_id INT")
    assert sorted((r["ref_id"], r["tax_id"]) for r in seqs.lookup_taxid(refs, taxa).collect()) == [(1, 9), (2, -1)]
    names = spark.createDataFrame([(">A.1 x", ">n1"), (">A.1 x", ">n;2")], "old STRING, new STRING")
    assert sorted(r["header"] for r in seqs.translate_headers(refs, names).collect()) == [">B.1 y", ">n_2"]


def test_cut_off_fastq_record_is_an_error(spark, tmp_path):
    (tmp_path / "whole.fq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\nII\n\n")
    assert [r["seq"] for r in seq_io.read_fastq(spark, str(tmp_path / "whole.fq")).orderBy("seq_id").collect()] == ["ACGT", "AC"]
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n")
    with pytest.raises(Exception, match="cut off"):
        seq_io.read_fastq(spark, str(tmp_path / "cut.fq")).collect()


@pytest.mark.parametrize("late", [("spark.sql.files.maxPartitionBytes", "3000"), ("spark.sql.files.minPartitionNum", "23")])
def test_records_survive_other_splits_in_a_later_scan(spark, tmp_path, late):
    records = [(f">r{i}", "ACGT" * (i % 9 + 1)) for i in range(2000)]
    (tmp_path / "a.fa").write_text("".join(f"{h}\n{s}\n" for h, s in records))
    (tmp_path / "a.fq").write_text("".join(f"@{h[1:]}\n{s}\n+\n{s}\n" for h, s in records))
    first = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "1"}
    old = {key: spark.conf.get(key, None) for key in (*first, late[0])}
    try:
        for key, value in first.items():
            spark.conf.set(key, value)
        fasta, fastq = seq_io.read_fasta(spark, str(tmp_path / "a.fa")), seq_io.read_fastq(spark, str(tmp_path / "a.fq"))
        numbered = seqs.number_rows(spark.read.text(str(tmp_path / "a.fa")).where("value LIKE '>%'"))
        spark.conf.set(*late)
        assert rows(fasta) == [(i, h, s) for i, (h, s) in enumerate(records)]
        assert rows(fastq) == [(i, f"@{h[1:]}", s) for i, (h, s) in enumerate(records)]
        got = numbered.orderBy("seq_id").collect()
        assert [r["seq_id"] for r in got] == list(range(2000)) and {r["value"] for r in got} == {h for h, _ in records}
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
