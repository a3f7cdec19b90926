"""A filter of fixed size over seeds, applied where k-mers are cut.

Most k-mers of the references match no seed.  A blocked Bloom filter of the
seeds, 64-bit words of which many share a row, is small enough to be broadcast
whatever the number of references, and lets nearly only matching k-mers reach the
shuffle; the join behind it decides.  It is built by aggregations and looked up
by a broadcast join, so neither side leaves the JVM and nothing passes the
driver but the tables of words, 16 MB at most each.  Many seeds take several
filters, each for a range of hashes; the k-mers are read once and look into
the one of their own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.session import write_stage

# Words of a filter, least and most, as powers of two, and those that share a row: a row for each word takes eight
# times the memory of the words.
WORD_BITS, MOST_WORD_BITS = 18, 21
ROW_WORDS = 512
# Seeds of one filter: 8 to a word set at most 24 of its 64 bits, which lets about 3 % of other k-mers pass.
SEEDS_PER_WORD = 8
SEEDS_PER_FILTER = SEEDS_PER_WORD << MOST_WORD_BITS
# Filters at most, so that their words stay within 128 MB.
MOST_PASSES = 8


def _word(h: Column, word_bits: int = WORD_BITS) -> Column:
    return F.shiftrightunsigned(h, 64 - word_bits)


def _bits(h: Column) -> Column:
    one = lambda shift: f"shiftleft(1L, cast(shiftright(__h, {shift}) & 63 as int))"
    return F.expr(" | ".join(one(s) for s in (0, 6, 12)))


def _pass_of(h: Column, passes: int) -> Column:
    return F.pmod(F.shiftright(h, 20).bitwiseAND(F.lit((1 << 24) - 1)), F.lit(passes))


def passes_for(n_seeds: int) -> int:
    """Filters that ``n_seeds`` seeds need, 0 where filtering no longer pays."""
    passes = -(-n_seeds // SEEDS_PER_FILTER) or 1
    return passes if passes <= MOST_PASSES else 0


def word_bits_for(n_seeds: int) -> int:
    """The size of a filter of ``n_seeds`` seeds."""
    return min(max(WORD_BITS, (-(-n_seeds // SEEDS_PER_WORD) - 1).bit_length()), MOST_WORD_BITS)


def _filter(hashes: DataFrame, word_bits: int) -> DataFrame:
    """(__row, __words): the filter of the column ``__h``, with every word, in rows of ROW_WORDS words."""
    return _filters(hashes, 1, word_bits).select("__row", "__words")


def _filters(hashes: DataFrame, passes: int, word_bits: int) -> DataFrame:
    """(__pass, __row, __words): the filters of all ranges of the column ``__h``, from one look at it."""
    pass_no = _pass_of(F.col("__h"), passes) if passes > 1 else F.lit(0).cast("bigint")
    own = hashes.select(pass_no.alias("__pass"), _word(F.col("__h"), word_bits).alias("__word"), _bits(F.col("__h")).alias("__set"))
    empty = hashes.sparkSession.range(passes << word_bits).select(
        F.shiftright("id", word_bits).alias("__pass"),
        F.col("id").bitwiseAND(F.lit((1 << word_bits) - 1)).alias("__word"),
        F.lit(0).cast("bigint").alias("__set"),
    )
    words = own.unionByName(empty).groupBy("__pass", "__word").agg(F.bit_or("__set").alias("__set"))
    packed = F.array_sort(F.collect_list(F.struct("__word", "__set")))["__set"]
    return words.groupBy("__pass", F.expr(f"__word div {ROW_WORDS}").alias("__row")).agg(packed.alias("__words"))


def filtered_postings(postings: DataFrame, seeds: DataFrame, passes: int, word_bits: int = WORD_BITS) -> list[DataFrame]:
    """The postings whose k-mer may be a seed, in one frame that reads ``postings`` once.

    Each posting looks into the filter of its own range of hashes only.  Several filters are written,
    since each is broadcast apart and would look at all seeds again.
    """
    hashes = seeds.select(F.xxhash64("kmer").alias("__h"))
    hashed = postings.withColumn("__h", F.xxhash64("kmer"))
    word, bits = _word(F.col("__h"), word_bits), _bits(F.col("__h"))
    row, place = F.shiftright(word, ROW_WORDS.bit_length() - 1), word.bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int")
    if passes == 1:
        met = hashed.withColumn("__row", row).join(F.broadcast(_filter(hashes, word_bits)), "__row")
        words = F.col("__words")
    else:
        filters = write_stage(_filters(hashes, passes, word_bits), "seed-filters")
        met = hashed.withColumn("__pass", _pass_of(F.col("__h"), passes)).withColumn("__row", row)
        for i in range(passes):
            own = filters.where(F.col("__pass") == i).select(F.col("__row").alias(f"__row{i}"), F.col("__words").alias(f"__words{i}"))
            # No row where the range is another's: such a k-mer is not looked up.
            met = met.withColumn("__own", F.when(F.col("__pass") == i, F.col("__row")))
            met = met.join(F.broadcast(own), F.col("__own") == F.col(f"__row{i}"), "left").drop("__own")
        words = F.coalesce(*[F.col(f"__words{i}") for i in range(passes)])
    return [met.where(F.get(words, place).bitwiseAND(bits) == bits).select(*postings.columns)]


def join_filtered(postings: DataFrame, seeds: DataFrame, n_seeds: int, how: str = "inner") -> DataFrame:
    """``postings``, read once, joined with ``seeds`` on the k-mer, with few other k-mers shuffled."""
    passes = passes_for(n_seeds)
    if passes:
        (postings,) = filtered_postings(postings, seeds, passes, word_bits_for(-(-n_seeds // passes)))
    return postings.join(seeds, "kmer", how)
