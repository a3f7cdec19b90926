"""Fixed-size bitmaps that spare a shuffle the rows that cannot meet a partner.

A bitmap marks the hash classes of a join's smaller side.  Rows of the larger
side whose class is unmarked are left out before they are shuffled; the join
itself decides about the rest, so a full bitmap costs time and never a row.
Its size is a constant, so what reaches the driver and the tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_of(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def marked(slots: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the bitmap of 2**bits slots that ``slots`` (slot) marks, eight slots a byte."""
    words = slots.select(
        F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")
    )
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**bits / 64 rows
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def is_marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def split(rows: DataFrame, keys: DataFrame, key: str, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in ``keys`` (key), and those whose key is not."""
    bitmap = marked(keys.select(slot_of(F.col(key), bits).alias("slot")), bits)
    at = len(rows.columns)

    def part(wanted: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column(at).to_numpy(zero_copy_only=False)
                chosen = batch.filter(pa.array(is_marked(bitmap, slots) == wanted))
                yield pa.RecordBatch.from_arrays(chosen.columns[:at], names=chosen.schema.names[:at])

        return rows.select("*", slot_of(F.col(key), bits).alias("__slot")).mapInArrow(keep, rows.schema)

    return part(True), part(False)


def semi_join(rows: DataFrame, keys: DataFrame, key: str, bits: int = 22) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys`` (key), as a left semi join that moves few other rows."""
    return split(rows, keys, key, bits)[0].join(keys, key, "left_semi")
