"""Language identification by bit-sliced Bloom filters of n-grams.

One table of bit masks holds the filters of all languages: bit l of a slot is
language l's filter there, so the masks at an n-gram's slots, and-ed together,
are the set of all languages that contain it.  A text's n-grams are counted
per language by popcount, the counts are corrected for the filters' false
positives, and the language with the largest corrected count is predicted.

An n-gram (``GRAM`` bytes of lower-cased text, everything but letters being
one space) enters a language's filter when it makes up at least ``MIN_SHARE``
of the language's n-grams, which bounds each filter at 1 / MIN_SHARE entries
however large the corpus, and is at least ``MIN_RELATIVE`` times as frequent
there as in the language where it is most frequent, so that single foreign
words in a language's documents do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.llm.text_hash import blocks, mix, text_buffer
from seedweave.session import write_stage

GRAM = 4
SLOT_BITS = 20
HASHES = 3
MIN_SHARE = 1e-5
MIN_RELATIVE = 0.1
UNDETERMINED = "und"
WORD = 64  # languages per mask
_LETTER = re.compile(r"[^\W\d_]")

# Bytes of letters: A-Z lowered, a-z, and all bytes of characters beyond ASCII.
_CLEAN = np.full(256, 0x20, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def in_holdout(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (as numbers) that lie in one document, and each document's first of them (n + 1 bounds)."""
    clean = _CLEAN[data].astype(np.uint32)
    m = len(clean) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    codes = np.zeros(m, dtype=np.uint32)
    for i in range(GRAM):
        codes = (codes << np.uint32(8)) | clean[i : i + m]
    whole = np.ones(m, dtype=bool)
    for i in range(1, GRAM):
        crossing = offsets[1:-1] - i
        whole[crossing[(crossing >= 0) & (crossing < m)]] = False
    whole &= codes != np.uint32(0x20202020)
    bounds = np.concatenate([[0], np.cumsum(whole)])[np.minimum(offsets, m)]
    return codes[whole], bounds


def _slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    hashed = mix(codes.astype(np.uint64) + np.uint64(1))
    for i in range(HASHES):
        yield ((hashed >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for first, last in blocks(offsets):
                codes, bounds = _grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for lang in set(langs[first:last]):
                    own = [codes[bounds[i] : bounds[i + 1]] for i in range(last - first) if langs[first + i] == lang]
                    held.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
                    size += len(held[lang][-1][0])
                if size > 4_000_000:
                    yield from _sums(held)
                    held, size = {}, 0
        yield from _sums(held)

    counted = docs.select("lang", "text").mapInArrow(count, "lang STRING, gram BIGINT, n BIGINT")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _sums(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n)], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class LanguageFilters:
    """Languages by bit, masks by slot (one array per 64 languages), the chance of a false hit, the usual language."""

    languages: tuple[str, ...]
    masks: tuple[np.ndarray, ...]
    false_hit: np.ndarray
    usual: str | None


def fit(docs: DataFrame) -> LanguageFilters:
    """Filters learned from ``docs`` (lang, text); rows whose lang is null teach nothing."""
    counts = write_stage(gram_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}  # a row per language
    languages = tuple(sorted(sizes))
    share = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    kept = share.where(F.col("share") >= MIN_SHARE).join(top, "gram").where(F.col("share") >= MIN_RELATIVE * F.col("top"))
    numbers = F.map_from_arrays(F.array(*[F.lit(x) for x in languages]), F.array(*[F.lit(i) for i in range(len(languages))])) if languages else None
    masks = [np.zeros(1 << SLOT_BITS, dtype=np.uint64) for _ in range(max(1, -(-len(languages) // WORD)))]
    if languages:
        # Bounded: languages times 1 / MIN_SHARE rows at most.
        got = kept.select(F.element_at(numbers, F.col("lang")).alias("l"), "gram").toArrow()
        bits, codes = got.column("l").to_numpy().astype(np.int64), got.column("gram").to_numpy().astype(np.uint32)
        for slots in _slots(codes):
            for w, mask in enumerate(masks):
                own = bits // WORD == w
                np.bitwise_or.at(mask, slots[own], np.uint64(1) << (bits[own] % WORD).astype(np.uint64))
    fill = [float(((masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(languages))]
    usual = max(languages, key=lambda x: (sizes[x], x)) if languages else None
    return LanguageFilters(languages, tuple(_narrow(m, len(languages)) for m in masks), np.array(fill) ** HASHES, usual)


def _narrow(mask: np.ndarray, languages: int) -> np.ndarray:
    return mask.astype(np.uint8) if languages <= 8 else mask


def _predict(filters: LanguageFilters, texts: pa.Array) -> tuple[list[str], list[float]]:
    data, offsets = text_buffer(texts)
    shown, scores = [], []
    for first, last in blocks(offsets):
        codes, bounds = _grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        counts = np.zeros((last - first, len(filters.languages)))
        slots = list(_slots(codes))
        for w, mask in enumerate(filters.masks):
            hit = mask[slots[0]]
            for s in slots[1:]:
                hit = hit & mask[s]
            for i in range(w * WORD, min(len(filters.languages), (w + 1) * WORD)):
                sums = np.concatenate([[0], np.cumsum((hit >> hit.dtype.type(i % WORD)) & hit.dtype.type(1), dtype=np.int64)])
                counts[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
        n = np.maximum(1, bounds[1:] - bounds[:-1])[:, None]
        # Of the n-grams a language lacks, the share false_hit is counted all the same.
        true = np.clip((counts - n * filters.false_hit) / np.maximum(1e-9, n * (1 - filters.false_hit)), 0, 1)
        for i, row in enumerate(true):
            text = texts[first + i].as_py()
            if not text or not _LETTER.search(text) or not filters.languages:
                shown.append(UNDETERMINED)
                scores.append(0.0)
            elif row.max() <= 0:
                shown.append(filters.usual)
                scores.append(0.0)
            else:
                shown.append(filters.languages[int(row.argmax())])
                scores.append(float(row.max() / row.sum()))
    return shown, scores


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is
    everything when nothing was learned.  A text with letters none of whose
    n-grams is known gets the language with most training text, score 0.  The
    score is the language's part in the corrected counts of all languages;
    ties go to the first language in order of name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, scores = _predict(filters, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")
