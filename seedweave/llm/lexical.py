"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are dealt over tasks, each with the postings of its own documents.
A query's terms are taken rarest first.  A document that holds one gets an
accumulator for its partial score, as long as what the remaining terms can add
at most may still reach the k-th best partial score.  After that no document is
taken up any more: accumulators that can still reach the k-th score are
survivors, and get the contributions of all remaining terms, so their scores
are exact.  A task keeps the k best of each query over all its blocks, and
their k-th score bounds the later blocks from the start.

Queries come in blocks of bounded text; only these, their terms' counts and the
k best documents a query and task leave a task.  Postings are written once a
block of queries and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedweave.llm.terms import word_blocks
from seedweave.session import write_stage

TOP = 10
LENGTH_SHARE = 90
# Bytes of query text that one pass over the documents answers.
QUERY_BYTES = 4 << 20
# A block of accumulators ends with the batch that brings it to so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 20
# Terms taken between two looks at the k-th score.
_LOOK = 4
_LAST = np.iinfo(np.int64).max


def term_sets(texts: pa.Array) -> list[set[str]]:
    """The distinct terms of each text."""
    out: list[set[str]] = [set() for _ in range(len(texts))]
    for row, words in word_blocks(texts):
        for i, word in zip(row.tolist(), words.to_pylist()):
            out[i].add(word)
    return out


def _counted(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, row, term, occurrences) of the wanted ``terms``, by row and term."""
    n = np.zeros(len(texts), np.int64)
    keys = []
    for row, words in word_blocks(texts):
        if not len(row):
            continue
        low = int(row[0])
        counted = np.bincount(row - low)
        n[low : low + len(counted)] += counted
        at = pc.index_in(words, value_set=terms)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        keys.append(row[known] * len(terms) + at.fill_null(0).to_numpy()[known])
    pairs, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
    return n, pairs // max(1, len(terms)), pairs % max(1, len(terms)), tf


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows of ``docs`` with a term: how many they have, and which of ``terms`` how often."""
    wanted = pa.array(terms, pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, term, tf = _counted(batch.column(1), wanted)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield found.filter(pa.array(n > 0))

    schema = "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, tfs ARRAY<INT>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, schema)


def term_weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class _Block:
    """Postings of some documents by term, with what a posting is worth for a term of weight 1."""

    def __init__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, length: int):
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // max(1, length)
        order = np.argsort(term, kind="stable")
        self.docs, tf = row[order], tf[order].astype(np.int64)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.worth, self.bounds[held])
        self.size = len(n)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that may be among the k best with at least the score ``least``; terms come rarest first."""
        gain = weights * self.most[terms]
        held = gain > 0
        terms, weights, gain = terms[held], weights[held], gain[held]
        rest = np.append(np.cumsum(gain[::-1])[::-1], 0)
        partial = np.zeros(self.size, np.int64)
        bar, at = least, 0
        while at < len(terms) and rest[at] >= bar:
            a, b = self.bounds[terms[at]], self.bounds[terms[at] + 1]
            partial[self.docs[a:b]] += weights[at] * self.worth[a:b]
            at += 1
            if at % _LOOK == 0 and self.size >= k:
                bar = max(bar, int(np.partition(partial, self.size - k)[self.size - k]))
        live = np.flatnonzero((partial > 0) & (partial + rest[at] >= bar))
        score = partial[live]
        for i in range(at, len(terms)):
            docs = self.docs[self.bounds[terms[i]] : self.bounds[terms[i] + 1]]
            spot = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            meets = docs[spot] == live
            score[meets] += weights[i] * self.worth[self.bounds[terms[i]] + spot[meets]]
        good = score >= max(least, 1)
        return live[good], score[good]


def _leading(doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then rising document."""
    return np.lexsort((doc, -score))[:k]


def _best_of(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task and query."""

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        docs, entries = 0, 0
        for batch in batches:
            held.append(batch)
            docs, entries = docs + len(batch), entries + len(batch["terms"].flatten())
            if docs >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
                yield held
                held, docs, entries = [], 0, 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in queries]
        for held in blocks_of(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            n = table["n"].to_numpy()
            # A missing doc_id comes after all others in a tie.
            ids = table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy()
            lists = table["terms"].combine_chunks()
            row = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy())
            block = _Block(n, row, lists.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy(), n_terms, n_docs, length)
            for q, (terms, weights) in enumerate(queries):
                known, scores = best[q]
                doc, score = block.best(terms, weights, k, int(scores[-1]) if len(scores) == k else 0)
                if len(doc):
                    known, scores = np.concatenate([known, ids[doc]]), np.concatenate([scores, score])
                    lead = _leading(known, scores, k)
                    best[q] = known[lead], scores[lead]
        query = np.repeat(np.arange(len(queries)), [len(x[0]) for x in best])
        ids = np.concatenate([none, *[x[0] for x in best]])
        columns = [pa.array(query), pa.array(ids, mask=ids == _LAST), pa.array(np.concatenate([none, *[x[1] for x in best]]))]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return found.mapInArrow(search, "query BIGINT, doc_id BIGINT, score BIGINT")


def ranking(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each item (item_id, text).

    Terms, weights and scores are those of the contract of ``op11``.  Rows with
    one item_id (also without any) are one query of all their terms.  Rows with
    one doc_id are documents of their own and may fill several ranks; a missing
    doc_id comes last among equal scores.  Texts that are null or without terms
    take no part on either side, and an empty table gives an empty result.
    Further columns play no part.
    """
    spark = docs.sparkSession
    asked = items.where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select("item_id", "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // query_bytes)
    results = []
    for i in range(passes):
        # Whole items by hash, about query_bytes a pass.
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).toArrow()
        if not len(block):
            continue
        sets: dict[object, set[str]] = {}
        for item, own in zip(block["item_id"].to_pylist(), term_sets(block["text"].combine_chunks())):
            sets.setdefault(item, set()).update(own)
        terms = sorted(set().union(*sets.values()))
        at = {t: j for j, t in enumerate(terms)}
        found = write_stage(postings(docs, terms), "postings")
        n_docs, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        # One row a term of this block of queries.
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = term_weight(n_docs, df)
        queries = []
        for own in sets.values():
            ids = np.array(sorted(at[t] for t in own), np.int64)
            ids = ids[np.argsort(df[ids], kind="stable")]
            queries.append((ids, weights[ids]))
        best = _best_of(found, queries, len(terms), n_docs, length, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(sets)), f"query BIGINT, item_id {dict(items.dtypes)['item_id']}")
        results.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank INT, doc_id BIGINT, score BIGINT")
    return reduce(DataFrame.unionByName, results)
