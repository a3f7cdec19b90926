"""Approximate nearest neighbours by collision counting.

A block of vectors is indexed by ``projections`` single random projections,
each kept as one sorted array.  A query opens a window around its own value in
every array; a vector inside the window collides there.  Radii begin where
the query before nearly ended and grow by ``GROWTH`` (virtual rehashing: the same arrays, wider windows, only the new
parts are counted), and a vector whose collisions reach the threshold is
verified with its exact cosine.  The search of a block ends when ``k``
verified vectors lie within the radius: nearer ones have reached the threshold
with the probability that the threshold was made for, whatever is still
unverified.  Blocks are searched independently and their best are merged, so
nothing is capped, and equal vectors of a block are searched once.

Queries come in blocks of at most ``QUERY_BLOCK``, sent to the tasks; vectors
are read from their partitions and moved once, into blocks of even size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count as steps_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.session import write_stage

PROJECTIONS = 128
VECTOR_BLOCK = 8192
QUERY_BLOCK = 8192
GROWTH = 1.1
FIRST_RADIUS = 0.25
# Steps of growth below the last query's radius at which the next query begins.
START_BELOW = 2
# Standard deviations below the mean collisions of a vector at the radius.
SLACK = 1.0


def usable(vector: Column) -> Column:
    """Neither null, empty, all zero nor holding null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """``count`` projections as rows: random rotations, scaled like standard normal vectors."""
    rng = np.random.default_rng([seed, dim])
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-count // dim))]
    return np.concatenate(turns)[:count] * math.sqrt(dim)


def threshold(count: int) -> int:
    """Collisions that a vector at the radius itself reaches with about 84 % probability, nearer ones with more.

    The window is one radius wide to both sides, so each projection of a
    difference of that length falls inside with the chance of one standard
    deviation.
    """
    p = math.erf(1 / math.sqrt(2))
    return max(1, math.floor(count * p - SLACK * math.sqrt(count * p * (1 - p))))


class BlockIndex:
    """Sorted projection arrays of one block of distinct unit vectors."""

    def __init__(self, units: np.ndarray, axes: np.ndarray):
        self.units, self.axes = units, axes
        values = axes @ units.T
        self.order = np.argsort(values, axis=1)
        # All arrays end to end, each moved beyond the one before: one search serves them all.
        self.shift = np.arange(len(axes)) * (4 * math.sqrt(axes.shape[1]) + 4)
        self.row = np.arange(len(axes)) * len(units)
        self.sorted = (np.take_along_axis(values, self.order, axis=1) + self.shift[:, None]).ravel()
        self.need = threshold(len(axes))
        self.start = 0

    def near(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows verified for one unit query: at least min(k, all) of them.

        What a radius verifies does not depend on the radii before it, so a search begins a little below the one at
        which the query before ended, and begins again further below if it could end there at once.
        """
        n, m = len(self.units), len(self.axes)
        at = self.axes @ query
        place = lambda x: np.clip(np.searchsorted(self.sorted, x + self.shift) - self.row, 0, n)
        start = self.start
        while True:
            low = high = place(at)
            hits = np.zeros(n, dtype=np.int64)
            done = np.zeros(n, dtype=bool)
            within = np.zeros(0)
            for step in steps_from(start):
                radius = FIRST_RADIUS * GROWTH**step
                lo, hi = place(at - radius), place(at + radius)
                fresh = [self.order[j, lo[j] : low[j]] for j in range(m)] + [self.order[j, high[j] : hi[j]] for j in range(m)]
                hits += np.bincount(np.concatenate(fresh), minlength=n)
                low, high = lo, hi
                found = np.flatnonzero((hits >= self.need) & ~done)
                done[found] = True
                gaps = np.sqrt(np.maximum(0, 2 - 2 * (self.units[found] @ query)))
                within = np.concatenate([within, gaps])
                if (within <= radius).sum() >= k or done.all():
                    break
            if step > start or not start:
                self.start = max(0, step - START_BELOW)
                return np.flatnonzero(done)
            start = max(0, start - 4 * START_BELOW)


def _distinct(ids: np.ndarray, vectors: np.ndarray, copies: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and for each the ``copies`` smallest ids that have it."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return vectors[first], [np.unique(part)[:copies] for part in np.split(ids[order], cuts)]


def _search(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, count: int):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out: tuple[list, list, list] = ([], [], [])
        for dim, (rows, vectors) in queries.items():
            own = np.flatnonzero(lengths == dim)
            if not len(own):
                continue
            block = np.stack([flat[starts[i] : starts[i] + dim] for i in own])
            # A query's own row takes one place among the copies of its vector.
            distinct, copies = _distinct(ids[own], block, k + 1)
            norms = np.sqrt((distinct * distinct).sum(axis=1))
            index = BlockIndex(distinct / norms[:, None], directions(dim, count))
            for r, q in zip(rows, vectors):
                size = math.sqrt((q * q).sum())
                found = index.near(q / size, k + 1)
                scores = (distinct[found] * q).sum(axis=1) / (norms[found] * size)
                pick = scores >= np.sort(scores)[::-1][min(len(scores), k + 1) - 1]
                best = [(-s, int(i)) for f, s in zip(found[pick], scores[pick]) for i in copies[f] if i != query_ids[r]]
                for s, i in sorted(best)[:k]:
                    out[0].append(query_ids[r])
                    out[1].append(i)
                    out[2].append(-s)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors found, by cosine.

    Both tables have vec_id and embedding.  Vectors that are not ``usable`` and
    rows without vec_id take no part, as query or as answer; a vector only
    meets queries of its own dimension.  A query is never its own answer, and
    rows that repeat a vec_id are one vector.  Ties go to the smaller vec_id.
    A query with fewer than k others gets them all.
    """
    ready = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        usable(F.col("v")) & F.col("vec_id").isNotNull()
    )
    asked = ready(queries)
    n_queries, n_vectors = asked.count(), ready(vectors).count()
    passes = max(1, -(-n_queries // (QUERY_BLOCK // 2)))
    placed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(passes)))
    blocks = ready(vectors).repartition(max(1, -(-n_vectors // VECTOR_BLOCK)), "vec_id")
    schema = "query_id BIGINT, vec_id BIGINT, score DOUBLE"
    found = None
    for block in range(passes):
        got = placed.where(F.col("block") == block).select("vec_id", "v").limit(4 * QUERY_BLOCK + 1).toArrow()
        if got.num_rows > 4 * QUERY_BLOCK:
            raise ValueError("a block of queries is far above its size: vec_id repeats very often")
        ids = got.column("vec_id").to_numpy()
        by_dim: dict[int, list[int]] = {}
        lists = got.column("v").to_pylist()
        for i, v in enumerate(lists):
            by_dim.setdefault(len(v), []).append(i)
        grouped = {d: (np.array(rows), np.array([lists[i] for i in rows], dtype=float)) for d, rows in by_dim.items()}
        part = blocks.mapInArrow(lambda it, ids=ids, grouped=grouped: _search(it, ids, grouped, k, projections), schema)
        if passes > 1:
            part = write_stage(part, "nearest")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.distinct().withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
