import random

import pytest
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.params import MatchParams, check_percentage


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s STRING").select(column.alias("x")).first()["x"]


def fnv(word, bits):
    prime, h = (1099511628211, 14695981039346656037) if bits == 64 else (16777619, 2166136261)
    for b in word.encode():
        h = (h * prime) % (1 << bits) ^ b
    return h


def test_sizes():
    assert (MatchParams().step, MatchParams().k) == (15, 17)
    assert (MatchParams(18).step, MatchParams(18).k) == (9, 10)
    for bad in (0, 1, -3, 2.5, True):
        with pytest.raises(ValueError):
            MatchParams(bad)
    with pytest.raises(ValueError):
        check_percentage(101)


def test_reverse_complement(spark):
    assert one(spark, "NRACGT", text.reverse_complement("s")) == "ACGTYN"
    assert one(spark, "ACGUYN", text.reverse_complement("s")) == "NRACGT"
    assert one(spark, "RYSWKMBDHVN-~", text.reverse_complement(text.reverse_complement("s"))) == "RYSWKMBDHVN-~"
    assert one(spark, "AXG", text.reverse_complement("s", strict=False)) == "CXT"
    with pytest.raises(Exception, match="unknown nucleotide"):
        one(spark, "AXG", text.reverse_complement("s"))


def test_normalize_keeps_positions(spark):
    assert one(spark, "straße{|}~é", text.normalize("s")) == "STRAßE{|}~é"
    assert one(spark, "acgtN", text.normalize("s")) == "ACGTN"


def test_fingerprint(spark):
    word = "ACGTACGTACGTACGTA"
    assert one(spark, word, text.fingerprint("s", 17, 32)) == 2971834886 == fnv(word, 32)
    assert one(spark, word, text.fingerprint("s", 17)) == 19044877
    assert one(spark, word, F.pmod(text.fingerprint("s", 17), F.lit(100))) == 77
    h = fnv(word, 32)
    assert one(spark, word, text.fingerprint("s", 17, 16)) == (h >> 16 ^ h) & 0xFFFF
    assert one(spark, word, text.fingerprint("s", 17, 64)) % (1 << 64) == fnv(word, 64)
    with pytest.raises(ValueError):
        text.fingerprint("s", 17, 20)


def test_accession(spark):
    for header, expected in ((">AB1.2 some words", "AB1.2"), ("AB1.2", "AB1.2"), (">AB1.2", "AB1.2"), ("", "")):
        assert one(spark, header, text.extract_accession("s")) == expected


def test_pieces(spark):
    rng = random.Random(3)
    for n in (0, 1, 7, 8, 9, 16, 40):
        s = "".join(rng.choice("abé\n👍") for _ in range(n))
        assert (one(spark, s, text.pieces("s", 8)) or []) == [s[i : i + 8] for i in range(0, n, 8)]
        assert one(spark, s, text.overlapping_pieces("s", 8, 3)) == [s[i : i + 11] for i in range(0, n, 8)]
        assert one(spark, s, text.kmers_of("s", 4)) == [s[i : i + 4] for i in range(n - 3)]


def test_common_prefix(spark):
    rows = [("", ""), ("", "a"), ("abc", "abd"), ("abc", "abc"), ("abc", "abcd"), ("xbc", "abc"), ("aaaaaaaaa", "aaaaaaaab")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    got = [r["n"] for r in df.select(text.common_prefix_length("a", "b", 5).alias("n")).collect()]
    assert got == [0, 0, 2, 3, 3, 0, 5]
