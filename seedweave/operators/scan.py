"""Seed hits straight from reference text, for a bounded set of seeds.

Without a stored index every position of every reference is looked at once.
Writing out each k-mer as a string costs far more than the lookup itself, so
this scan first marks the positions whose rolling hash equals that of some
seed, and makes k-mers only there.  The join on the k-mer itself follows, so
the hits are exact whatever the hash does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.functions import text
from seedweave.operators.kmers import drop_all_n

# Characters per row sent to the tasks, and per vectorized step inside them.
SCAN_PIECE = 4096
STEP_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd multiplier will do
_TABLE_BITS = 22


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of each window of ``k`` code points.

    Windows of doubled length come from two of the length before, so a window
    costs log2(k) steps rather than k.
    """
    if len(codes) < k:
        return np.empty(0, np.uint64)
    done, done_len = None, 0
    part, part_len, power = codes.astype(np.uint64), 1, _BASE
    with np.errstate(over="ignore"):
        rest = k
        while True:
            if rest & 1:
                if done is None:
                    done, done_len = part, part_len
                else:
                    n = len(codes) - (done_len + part_len) + 1
                    done = done[:n] * power + part[done_len : done_len + n]
                    done_len += part_len
            rest >>= 1
            if not rest:
                return done
            n = len(codes) - 2 * part_len + 1
            part = part[:n] * power + part[part_len : part_len + n]
            power = power * power
            part_len *= 2


def _codes(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _TABLE_BITS)


def _matches(texts: list[str], k: int, wanted: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text number, offset) of the windows whose hash is wanted."""
    joined = "".join(texts)
    hashes = window_hashes(_codes(joined), k)
    at = np.flatnonzero(table[_slot(hashes)])
    found = hashes[at]
    near = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    at = at[wanted[near] == found]
    ends = np.cumsum([len(t) for t in texts])
    owner = np.searchsorted(ends, at, side="right")
    whole = at + k <= ends[owner] if len(at) else np.empty(0, bool)
    starts = ends - np.array([len(t) for t in texts])
    for row, position in zip(owner[whole], at[whole]):
        yield int(row), int(position - starts[row])


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > STEP_CHARS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def _least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row, from windows of doubled size."""
    least, done = values, 1
    while 2 * done <= size:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = size - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _homes(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each window of ``k``: the least mixed hash of its parts of k//2+1 characters, so neighbours mostly share it."""
    part = k // 2 + 1
    if len(codes) < k:
        return np.empty(0, np.uint64)
    mixed = window_hashes(codes, part)
    with np.errstate(over="ignore"):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = mixed ^ (mixed >> np.uint64(32))
    return _least_in_windows(mixed, k - part + 1)


def _runs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text number, offset, home, text) of the stretches of neighbouring k-mers with one home."""
    joined = "".join(texts)
    homes = _homes(_codes(joined), k)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(joined) + 1, np.int64)
    np.add.at(inside, ends - lengths, 1)
    np.add.at(inside, np.maximum(ends - k + 1, ends - lengths), -1)
    at = np.flatnonzero(np.cumsum(inside))
    if not len(at):
        return at, at, homes[:0].astype(np.int64), []
    own = homes[at]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
    last = np.append(first[1:] - 1, len(at) - 1)
    owner = np.searchsorted(ends, at[first], side="right")
    stretches = [joined[a:b] for a, b in zip(at[first].tolist(), (at[last] + k).tolist())]
    return owner, at[first] - (ends - lengths)[owner], own[first].view(np.int64), stretches


def dealt_kmers(refs: DataFrame, k: int, n_partitions: int, *keys: Column) -> DataFrame:
    """The postings of ``ref_kmers`` with a ``home``, dealt to ``n_partitions`` by home and ``keys`` of their reference.

    Equal k-mers have equal homes, so an aggregation by (home, kmer) needs no further shuffle.  Neighbouring k-mers mostly
    share their home and move as one stretch of text: about a character and a half of text moves for each k-mer, not k.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            base = batch.column("piece_no").to_numpy(zero_copy_only=False).astype(np.int64) * SCAN_PIECE
            for lo, hi in _groups([len(p) for p in pieces]):
                owner, offset, home, stretch = _runs(pieces[lo:hi], k)
                taken = pa.array(owner + lo, pa.int64())
                starts = (base[owner + lo] + offset).astype(np.int32)
                columns = [batch.column("db_id").take(taken), batch.column("ref_id").take(taken), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(home), pa.array(stretch, pa.string())], names=["db_id", "ref_id", "start", "home", "stretch"]
                )

    moved = _pieces(refs, k).mapInArrow(cut, "db_id INT, ref_id BIGINT, start INT, home BIGINT, stretch STRING")
    moved = moved.repartition(n_partitions, "home", *keys)
    words = moved.select("home", "db_id", "ref_id", "start", F.posexplode_outer(text.kmers_of("stretch", k)).alias("i", "kmer"))
    kept = drop_all_n(words.where(F.col("kmer").isNotNull()), k)
    return kept.select("home", "db_id", "ref_id", (F.col("start") + F.col("i")).alias("rpos"), "kmer")


def _pieces(refs: DataFrame, k: int) -> DataFrame:
    """(db_id, ref_id, piece_no, piece): the text in rows that overlap by k - 1 characters."""
    cut = text.overlapping_pieces("seq", SCAN_PIECE, k - 1)
    return refs.select(
        F.col("db_id").cast("int").alias("db_id"),
        F.col("ref_id").cast("bigint").alias("ref_id"),
        F.posexplode_outer(cut).alias("piece_no", "piece"),
    ).where(F.col("piece").isNotNull())


def scan_postings(refs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The postings of ``ref_kmers`` whose k-mer is (almost surely) a seed.

    ``seeds`` must be counted and small: its distinct k-mers go to the driver
    and, as eight bytes each, to every task.
    """
    spark = refs.sparkSession
    words = seeds.select("kmer").distinct().toArrow().column("kmer").to_pylist()
    schema = "db_id INT, ref_id BIGINT, rpos INT, kmer STRING"
    if not words:
        return spark.createDataFrame([], schema)
    hashes = window_hashes(_codes("".join(words)), k)[::k]
    shared = spark.sparkContext.broadcast(np.unique(hashes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[_slot(wanted)] = True
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            rows, offsets, found = [], [], []
            for lo, hi in _groups([len(p) for p in pieces]):
                for row, offset in _matches(pieces[lo:hi], k, wanted, table):
                    rows.append(lo + row)
                    offsets.append(offset)
                    found.append(pieces[lo + row][offset : offset + k])
            taken = pa.array(rows, pa.int64())
            base = batch.column("piece_no").take(taken).to_numpy(zero_copy_only=False).astype(np.int64) * SCAN_PIECE
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("db_id").take(taken),
                    batch.column("ref_id").take(taken),
                    pa.array((base + np.array(offsets, np.int64)).astype(np.int32)),
                    pa.array(found, pa.string()),
                ],
                names=["db_id", "ref_id", "rpos", "kmer"],
            )

    return drop_all_n(_pieces(refs, k).mapInArrow(scan, schema), k)
