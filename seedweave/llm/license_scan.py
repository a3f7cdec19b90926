"""License notices in texts, by MinHash bands over overlapping windows.

A template with s shingles is looked for in windows of about 1.25 s shingles,
laid so that any stretch of s shingles lies wholly in one of them.  A window
and a template become a candidate pair when they agree in a band: the shingle
that a band's own hash makes smallest is the same.  Each template gets as many
bands as it takes for a window which contains at least ``CONTAINMENT`` of it,
whichever of its shingles they are, to agree somewhere with at least
``COLLISION`` probability over the other shingles of the window.  Then the
share of the template's shingles that the window has decides exactly.

A template's smallest hashes are a few dozen numbers, so windows are only
looked at around shingles that are one of them: all other windows cannot agree
in any band.  Everything is Spark expressions.

Defined results: a null text or one with fewer than ``SHINGLE`` words has no
match; every row is scanned on its own, so repeated rows give repeated
matches, and rows without doc_id keep a null one; no templates, no matches.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.llm.common import let

SHINGLE = 5
CONTAINMENT = 0.8
COLLISION = 0.9999
WINDOW = 1.25

# Public license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class Template:
    name: str
    shingles: tuple[int, ...]  # hashes, distinct
    window: int  # shingles in a window
    stride: int
    minima: tuple[tuple[int, int], ...]  # (band, shingle with the smallest hash there)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def bands_for(shingles: int, window: int) -> int:
    """Independent bands that let a window with enough of an average template agree in one with probability COLLISION."""
    inside = math.ceil(CONTAINMENT * shingles)
    least = inside / (window + shingles - inside)
    return 1 if least >= 1 else math.ceil(math.log(1 - COLLISION) / math.log(1 - least))


def band_hash(shingle: int, band: int) -> int:
    """The hash that Spark's xxhash64 gives for a shingle's hash and the band's number, both as long."""
    return _signed(xxhash.xxh64_intdigest(_long(band), seed=xxhash.xxh64_intdigest(_long(shingle), seed=42)))


def _long(x: int) -> bytes:
    return x.to_bytes(8, "little", signed=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def minima_of(hashes: tuple[int, ...], window: int) -> tuple[tuple[int, int], ...]:
    """(band, shingle with the smallest hash there) of as many bands as keep the promise of COLLISION.

    A band is lost when its smallest shingle is missing from a window, or when
    one of the window's other shingles is smaller.  The hashes of a template
    are fixed, so it is known which missing shingles lose most: the promise is
    kept for these, and so for any others.
    """
    inside = math.ceil(CONTAINMENT * len(hashes))
    others = window - inside
    worth = dict.fromkeys(hashes, 0.0)  # of a shingle: -log of the chance that all its bands are lost
    minima: list[tuple[int, int]] = []
    while len(minima) < bands_for(len(hashes), window) or sum(sorted(worth.values())[:inside]) < -math.log(1 - COLLISION):
        band = len(minima)
        smallest, h = min((band_hash(h, band), h) for h in hashes)
        minima.append((band, h))
        worth[h] -= math.log(max(1e-300, 1 - (1 - (smallest + (1 << 63)) / (1 << 64)) ** others))
    return tuple(minima)


def templates_from(texts: dict[str, str]) -> list[Template]:
    """Templates with their hashes; a text with fewer than SHINGLE words cannot be one."""
    out = []
    for name, text in texts.items():
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        hashes = tuple(dict.fromkeys(shingle_hash(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))
        span = len(words) - SHINGLE + 1
        window = math.ceil(WINDOW * span)
        out.append(Template(name, hashes, window, window - span + 1, minima_of(hashes, window)))
    return out


def shingle_hash(words: list[str]) -> int:
    """The hash that Spark's xxhash64 gives for the words one after another."""
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed=seed)
    return _signed(seed)


def _hashes(words: Column) -> Column:
    """Hash of each shingle of an array of words."""
    shingle = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    some = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), shingle)
    return F.when(F.size(words) >= SHINGLE, some).otherwise(F.array().cast("array<bigint>"))


def _minima(templates: list[Template]) -> Column:
    """Array of (h, band, name, window, stride, shingles): the bands' smallest hashes of all templates."""
    rows = [
        F.struct(
            F.lit(h).cast("bigint").alias("h"),
            F.lit(b).cast("bigint").alias("band"),
            F.lit(t.name).alias("name"),
            F.lit(t.window).alias("window"),
            F.lit(t.stride).alias("stride"),
            F.array(*[F.lit(x).cast("bigint") for x in t.shingles]).alias("shingles"),
        )
        for t in templates
        for b, h in t.minima
    ]
    return F.array(*rows)


def windows_near(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, name, first, held): windows that agree with a template in a band.

    ``first`` is the number of the window's first shingle in the text, ``held``
    the share of the template's shingles that the window has.
    """
    reach = max(t.window for t in templates)
    tokens = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^\\p{L}\\p{N}]+", -1)
    words = F.filter(tokens, lambda w: w != "")
    wanted = sorted({h for t in templates for _, h in t.minima})

    def marks(hashes: Column) -> Column:
        spots = F.filter(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isin(wanted))

        def around(x: Column) -> Column:
            start = F.greatest(x["i"] - reach, F.lit(0))
            return F.struct(x["h"].alias("h"), x["i"].alias("i"), start.alias("start"), F.slice(hashes, start + 1, 2 * reach + 1).alias("near"))

        return F.transform(spots, around)

    marked = docs.select("doc_id", F.explode(let(let(words, _hashes), marks)).alias("m"))
    banded = marked.select("doc_id", "m", F.explode(F.filter(_minima(templates), lambda t: t["h"] == F.col("m")["h"])).alias("t"))
    # All windows that hold the marked shingle; windows begin at multiples of the stride.
    low = F.greatest(F.ceil((F.col("m.i") - F.col("t.window") + 1) / F.col("t.stride")), F.lit(0))
    starts = F.transform(F.sequence(low, F.floor(F.col("m.i") / F.col("t.stride"))), lambda w: (w * F.col("t.stride")).cast("int"))
    placed = banded.withColumn("first", F.explode(starts))
    window = F.slice("m.near", (F.col("first") - F.col("m.start") + 1).cast("int"), F.col("t.window"))
    cut = placed.select("doc_id", "first", "m.h", "t.band", "t.name", "t.shingles", window.alias("window"))
    smallest = F.array_min(F.transform("window", lambda x: F.xxhash64(x, F.col("band"))))
    agreeing = cut.where(smallest == F.xxhash64("h", "band"))
    held = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    return agreeing.select("doc_id", "name", "first", held.alias("held"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_shingle, n_windows): one row per document and license found.

    ``containment`` is the best share of the template's shingles in a window,
    ``first_shingle`` where the first window with enough of them begins,
    ``n_windows`` how many windows have enough.
    """
    templates = templates_from(texts)
    if not templates:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_shingle"), F.lit(0).cast("bigint").alias("n_windows")).limit(0)
    enough = windows_near(docs, templates).where(F.col("held") >= CONTAINMENT)
    windows = enough.groupBy("doc_id", "name", "first").agg(F.max("held").alias("held"))
    return windows.groupBy("doc_id", F.col("name").alias("license")).agg(
        F.max("held").alias("containment"), F.min("first").alias("first_shingle"), F.count(F.lit(1)).alias("n_windows")
    )


def scan_sql(texts: dict[str, str] = TEMPLATES, documents: str = "documents") -> str:
    """DuckDB SQL for the result of ``scan``: every window of every text, compared shingle by shingle."""
    rows = []
    for t, text in zip(templates_from(texts), texts.values()):
        words = template_words(text)
        shingles = dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
        rows += [f"('{t.name}', '{s}', {len(t.shingles)}, {t.window}, {t.stride})" for s in shingles]
    return f"""
WITH templates(license, shingle, size, span, stride) AS (VALUES {', '.join(rows)}),
w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {documents}
), s AS (
  SELECT doc_id, unnest(range(len(w) - {SHINGLE - 1})) AS i, w FROM w WHERE len(w) >= {SHINGLE}
), h AS (
  SELECT doc_id, i, license, t.shingle, size, span, stride FROM s JOIN templates t
  ON t.shingle = array_to_string(w[i + 1 : i + {SHINGLE}], ' ')
), p AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((i - span + 1) / stride)) AS BIGINT), i // stride + 1)) * stride AS first FROM h
), c AS (
  SELECT doc_id, license, first, count(DISTINCT shingle) / max(size) AS held FROM p GROUP BY ALL HAVING held >= {CONTAINMENT}
)
SELECT doc_id, license, max(held) AS containment, CAST(min(first) AS INT) AS first_shingle, count(*) AS n_windows FROM c GROUP BY ALL
"""
