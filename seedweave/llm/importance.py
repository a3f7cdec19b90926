"""Importance resampling towards a target corpus, by bit-sliced sums.

Features are runs of consecutive words, hashed into buckets.  How much more
often the target has a bucket than the corpus gives the bucket's gain, and a
document's weight is the sum of the gains of its features.  A document's bucket
counts are held as bit planes (plane j has the buckets whose count has bit j)
and so are the positive and the negative gains; and-ing two planes and counting
bits gives exact integer sums without a multiplication a bucket.

The weights get a hash-seeded Gumbel noise, and the highest ones are drawn:
sampling without replacement in proportion to exp(weight / 1000).

Corpus counts are one row a bucket and task; the driver sees one row a bucket.
Ranks come from one range shuffle of narrow rows, numbered inside the sorted
partitions, so no key or tie gathers in one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.llm.terms import word_blocks
from seedweave.session import write_stage

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Rows whose bit planes are held at once.
PLANE_ROWS = 1024
_HASHES = 4294967296


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(run length, row, bucket) of each feature of a column of texts, block by block."""
    # Runs may cross the place where a very long text is cut, so such texts stay whole for them.
    most = {} if longest == 1 else {"most": max(1 << 20, texts.nbytes)}
    for row, words in word_blocks(texts, **most):
        for n in range(1, longest + 1):
            if len(words) < n:
                break
            last = len(words) - n + 1
            runs = words if n == 1 else pc.binary_join_element_wise(*[words.slice(i, last) for i in range(n)], " ")
            coded = runs.dictionary_encode()
            of = np.array([zlib.crc32(x.encode()) % buckets for x in coded.dictionary.to_pylist()], np.int64)
            whole = row[:last] == row[n - 1 :]
            yield n, row[:last][whole], of[coded.indices.to_numpy()][whole]


def corpus_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of ``texts`` (text) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in feature_buckets(batch.column(0), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket BIGINT, n BIGINT")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) a bucket, from two tables of at most ``buckets`` rows (bucket, n)."""

    def dense(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, n in counts.select("bucket", "n").collect():
            out[bucket] = n
        return out

    s, t = dense(corpus), dense(target)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def _words_of(buckets: int) -> int:
    return -(-buckets // 64)


def planes_of(own: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(j, bits as rows x 64-bit words) of each plane j of ``value``, given per distinct (own, bucket)."""
    width = 8 * _words_of(buckets)
    for j in range(int(value.max()).bit_length() if len(value) else 0):
        has = value >> j & 1 == 1
        # No (row, bucket) comes twice, so adding its bit sets it.
        bits = np.bincount(own[has] * width + (bucket[has] >> 3), weights=1 << (bucket[has] & 7), minlength=rows * width)
        yield j, bits.astype(np.uint8).view(np.uint64).reshape(rows, -1)


class GainPlanes:
    """Signed gains as bit planes."""

    def __init__(self, gain: np.ndarray):
        self.buckets = len(gain)
        at, zero = np.arange(len(gain)), np.zeros(len(gain), np.int64)
        self.planes = [
            (sign, k, bits[0]) for sign in (1, -1) for k, bits in planes_of(zero, at, np.maximum(sign * gain, 0), 1, len(gain))
        ]

    def weights(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        """Sum of the gains of the features of rows 0 to ``rows`` - 1, exactly; ``row`` ascends."""
        if rows > PLANE_ROWS:
            cuts = np.arange(0, rows, PLANE_ROWS)
            at = np.append(np.searchsorted(row, cuts), len(row))
            parts = zip(cuts, at[:-1], at[1:])
            return np.concatenate([self.weights(row[a:b] - c, bucket[a:b], min(PLANE_ROWS, rows - c)) for c, a, b in parts])
        out = np.zeros(rows, np.int64)
        pairs, count = np.unique(row * self.buckets + bucket, return_counts=True)
        own, at = pairs // self.buckets, pairs % self.buckets
        for j, counted in planes_of(own, at, count, rows, self.buckets):
            some = np.flatnonzero(counted.any(axis=1))
            counted = counted[some]
            for sign, k, gained in self.planes:
                out[some] += sign * (np.bitwise_count(counted & gained).sum(axis=1, dtype=np.int64) << (j + k))
        return out


def noise(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """Gumbel noise in thousandths, from the hash of seed and doc_id (null: as an empty text)."""
    h = [int(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:8], 16) for x in doc_ids.to_pylist()]
    return np.array([math.floor(-1000 * math.log(-math.log((x + 0.5) / _HASHES))) for x in h], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, n_features, n_words, weight, score) of every row of ``docs``."""
    planes = GainPlanes(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            found, n_words = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            weight = np.zeros(rows, np.int64)
            for n, row, bucket in feature_buckets(batch.column(2), longest, planes.buckets):
                if not len(row):
                    continue
                low, high = int(row[0]), int(row[-1]) + 1
                counted = np.bincount(row - low, minlength=high - low)
                found[low:high] += counted
                if n == 1:
                    n_words[low:high] += counted
                weight[low:high] += planes.weights(row - low, bucket, high - low)
            columns = [batch.column(0), batch.column(1), found, n_words, weight, weight + noise(batch.column(0), seed)]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_features", "n_words", "weight", "score"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id BIGINT, text_key BIGINT, n_features BIGINT, n_words BIGINT, weight BIGINT, score BIGINT"
    return keyed.mapInArrow(score, schema)


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` (a written table) with ``rank``: 1, 2, 3 ... for the drawn rows, null for all others.

    Of the N rows with ``least_words`` words or more, the floor(percent * N / 100)
    with the highest score are drawn; ties go to the smaller doc_id, then to
    rows with one, then to the smaller text_key.
    """
    may = F.col("n_words") >= least_words
    wanted = percent * scores.where(may).count() // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    parts = max(1, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scores.withColumn("may", may).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Partition in the upper bits, place in the partition in the lower 33; written once, so they stay.
    placed = write_stage(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = dict(placed.where("may").groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for p in sorted(sizes):
        # Later partitions hold no drawn row.
        if before < wanted:
            offsets.append((p, before))
        before += sizes[p]
    starts = placed.sparkSession.createDataFrame(offsets, "__part BIGINT, __before BIGINT")
    joined = placed.join(F.broadcast(starts), part == F.col("__part"), "left")  # one row a shuffle partition
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.select(*scores.columns, F.when(F.col("may") & (rank <= wanted), rank).alias("rank"))


def resampling(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, text_key, n_features, n_words, weight, score, rank) of every row of ``docs`` (doc_id, text).

    Rows with equal doc_id are documents of their own with equal noise.  A null
    or empty text has no features and weight 0 and cannot be drawn; a null
    doc_id takes part, after all others in a tie.  Without documents the result
    is empty; without target texts all gains follow the corpus alone.  Further
    columns play no part.
    """
    gain = gains(corpus_counts(docs, longest, buckets), corpus_counts(target, longest, buckets), buckets)
    return ranked(write_stage(scored(docs, gain, longest, seed), "importance"), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; equal rows (doc_id and text) are drawn together."""
    drawn = resampling(docs, target, **options).where(F.col("rank").isNotNull())
    drawn = drawn.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    met = (F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id"))) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(drawn, met, "left_semi")
