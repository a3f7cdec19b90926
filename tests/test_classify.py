import pytest
from pyspark.sql import functions as F

from catalog import queries as registry
from seedweave import session
from seedweave.operators import index as ix
from seedweave.operators import ranking, report
from seedweave.operators import sequences as seqs
from seedweave.plans.classify import classify, classify_scores

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def dna(spark):
    reads, refs = registry.dna_reads(spark, SF), registry.dna_refs(spark, SF)
    return reads, refs, classify_scores(reads, ix.build_index(refs, 31)).cache()


def test_goldens(dna):
    _, _, top = dna
    got = {}
    for r in top.groupBy((F.col("q") % 5).alias("kind"), "strand", "confident").agg(
        F.count_distinct("q").alias("reads"), F.count(F.lit(1)).alias("rows")
    ).collect():
        got[r["kind"], r["strand"], r["confident"]] = (r["reads"], r["rows"])
    chimera = {0.690692: 221, 0.69646: 57, 0.702161: 17, 0.707795: 3, 0.713364: 1, 0.71887: 1}
    assert got == {
        (0, "+", 1.0): (300, 360),
        (1, "-", 1.0): (300, 360),
        (2, "+", 0.842488): (300, 300),
        **{(3, "+", s): (n, n) for s, n in chimera.items()},
    }


def test_same_answer_when_nothing_is_broadcast(dna, monkeypatch):
    reads, refs, top = dna
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    shuffled = classify_scores(reads, ix.build_index(refs.repartition(7), 31))
    columns = ["q", "strand", "ref_id", "confident", "sum_sq", "covered"]
    a, b = top.select(columns), shuffled.select(columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_hand_computed_scores(sequences):
    import random

    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(1000))
    read = base[300:450]
    swapped = read[:70] + ("A" if read[70] != "A" else "C") + read[71:]
    filler = "".join(rng.choice("ACGT") for _ in range(105))
    reads = sequences([(0, read), (1, swapped), (2, read[:45] + filler)])
    got = {r["q"]: r["confident"] for r in classify_scores(reads, sequences([(0, base)]), strands=False).collect()}
    assert got[0] == 1.0 and got[1] == 0.842488
    assert got[2] in (0.476533, pytest.approx(0.4765, abs=0.01))  # the filler may extend the match by chance
    short = classify_scores(reads.where("seq_id = 0"), sequences([(0, base[320:420])]), strands=False).collect()
    assert [r["confident"] for r in short] == [0.899583]


def test_palindrome_goes_forward_and_zero_is_silent(sequences):
    half = "ACGGTCATTGCAGGATCCATGCAAGCTTGACCGATTAGGC"
    flip = half[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = sequences([(0, half + flip), (1, "T" * 100), (2, half[:31])])
    refs = sequences([(0, "GG" + half + flip + "TT"), (1, "C" * 16)])
    out = classify(reads, refs).collect()
    assert [(r["q"], r["confident"], r["headers"], r["tax_ids"]) for r in out] == [(0, 1.0, ">S0.1 x", "-1")]
    scores = classify_scores(reads, refs).collect()
    assert {r["strand"] for r in scores} == {"+"}
    left = seqs.unclassified_reads(reads, classify(reads, refs))
    assert sorted(r["seq_id"] for r in left.collect()) == [1, 2]


def test_bad_arguments(sequences):
    some = sequences([(0, "ACGT" * 20)])
    with pytest.raises(ValueError):
        classify(some, some, mode="ultra")
    with pytest.raises(ValueError):
        classify(some, ix.build_index(some, 31), threshold=25)


def test_taxon_vote(spark):
    rows = [(1, 1, 0.9, r, f">h{r}", t) for r, t in enumerate([5, 5, 7, 7, 9])]
    rows += [(2, 1, 0.9, r, f">h{r}", t) for r, t in enumerate([5, 5, -1])]
    rows += [(3, 1, 0.9, r, f">h{r}", t) for r, t in enumerate([9, -1, 4, 8, 8])]
    rows += [(4, 1, 0.9, r, f">h{r}", t) for r, t in enumerate([9, -1, 4])]
    members = spark.createDataFrame(rows, "q BIGINT, grp INT, confident DOUBLE, ref_id BIGINT, header STRING, tax_id INT")
    winners = report.winning_taxa(report.tax_occurrences(members))
    lists = {r["q"]: (r["tax_ids"], r["occurrences"]) for r in report.tax_lists(winners).collect()}
    assert lists == {1: ("5,7", "2,2"), 2: ("-1", "1"), 3: ("-1", "1"), 4: ("-1,4,9", "1,1,1")}
    headers = {r["q"]: r["headers"] for r in report.header_list(members, winners).collect()}
    assert headers == {1: ">h0,>h1,>h2,>h3", 2: ">h2", 3: ">h1", 4: ">h1,>h2,>h0"}


def test_strands_and_groups(spark):
    rows = [(1, "+", 1, 0.5), (1, "-", 2, 0.5), (2, "+", 1, 0.5), (2, "-", 2, 0.6), (2, "-", 3, 0.6000000001), (2, "-", 4, 0.1), (3, "-", 1, 0.2)]
    scores = spark.createDataFrame(rows, "q BIGINT, strand STRING, ref_id BIGINT, score DOUBLE")
    kept = ranking.best_strand(scores)
    assert sorted((r["q"], r["ref_id"]) for r in kept.collect()) == [(1, 1), (2, 2), (2, 3), (2, 4), (3, 1)]
    groups = sorted((r["q"], r["ref_id"], r["grp"]) for r in ranking.score_groups(kept, top_only=False).collect())
    assert groups == [(1, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 2), (3, 1, 1)]
    assert ranking.score_groups(kept).count() == 4


def test_duplicates(sequences):
    reads = sequences([(3, "AC"), (1, "AC"), (2, "GG"), (7, "AC")])
    assert sorted(map(tuple, seqs.duplicate_queries(reads).collect())) == [(1, 3, 2), (1, 7, 2)]
    assert sorted(r["seq_id"] for r in seqs.skip_duplicates(reads).collect()) == [1, 2]
    numbered = seqs.number_rows(reads.repartition(3))
    assert sorted(r["seq_id"] for r in numbered.collect()) == [0, 1, 2, 3]
