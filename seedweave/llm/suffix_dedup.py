"""Removal of byte strings that occur more than once in a corpus.

A string of ``SPAN`` bytes repeats when it starts at two places of the corpus.
To find all such strings without sorting all suffixes together:

1. Each window of SPAN bytes has an anchor: of its strings of ``GRAM`` bytes the
   one with the smallest hash.  Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so a text is covered by one
   snippet per anchor, the stretch of all windows that have it.
2. Anchors that occur once are dropped, as are all windows under them.
3. Snippets that are equal as a whole (anchor hash and a 128-bit digest of the
   bytes) repeat as a whole; counts tell so.
4. What is left are different snippets with equal anchors.  They are brought
   together by anchor, and a suffix sort with hashed comparisons finds which of
   their windows repeat.
5. An anchor with very many different snippets (the rim of a passage that many
   documents share) would make one task large.  A window with a bytes before its
   anchor has 168 - a behind it, so all windows with a in a narrow range share
   nearly all bytes, and those decide who meets: snippets are cut into parts by
   ranges of a, equal parts repeat as a whole, parts that share their common
   bytes with no other drop out, and the others are suffix-sorted by those
   bytes.  Should too many still share them, the range is narrowed to a single
   a, where the common bytes are the window itself and equal keys are the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.llm import prefilter
from seedweave.llm.suffix_sort import SuffixSorter
from seedweave.llm.text_hash import blocks, mix, prefix_hashes, span_hash, text_buffer
from seedweave.session import write_stage

SPAN = 200
GRAM = 32
# Different snippets of one anchor that one task may sort together.
MOST_SNIPPETS = 2048
# Snippet bytes that are sorted at once.
SORT_BYTES = 1 << 18
# Bytes of text that are cut at once.
CUT_BYTES = 1 << 21
# The range of bytes before the anchor that a part of a snippet spans; 13 * 13 places in all.
RANGE = 13
# Slots of the bitmap of repeated anchors: so many for each, within these bounds.
SLOTS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 27
# Positions fit the low bits of a packed (hash, position) number.
_PLACE_BITS = 24
_LONGEST = 1 << 19
_ROW = "h BIGINT, c1 BIGINT, c2 BIGINT, id BIGINT, key BIGINT, at BIGINT, n INT, a INT"
_RUN = "id BIGINT, key BIGINT, at BIGINT, n BIGINT"


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, key, text): rows of one doc_id with different texts are told apart by key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")
    )


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` numbers."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(backward[:m], forward[width - 1 : width - 1 + m])


def snippets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, bytes from there to the anchor, anchor hash) of the texts that lie end to end in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none
    prefix = prefix_hashes(data)
    start = np.arange(len(data) - GRAM + 1)
    grams = mix(span_hash(prefix, start, start + GRAM))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    packed = (grams & ~low) | start.astype(np.uint64)
    anchor = (_window_minima(packed, SPAN - GRAM + 1) & low).astype(np.int64)
    # Windows across the end of a document are none.
    valid = np.ones(len(anchor), bool)
    ends = offsets[1:-1]
    marks = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(marks, np.clip(ends - SPAN + 1, 0, len(anchor)), 1)
    np.add.at(marks, np.clip(ends, 0, len(anchor)), -1)
    valid = np.cumsum(marks[:-1]) == 0
    windows = np.flatnonzero(valid)
    if not len(windows):
        return none, none, none, none, none
    chosen = anchor[windows]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(windows) != 1)])
    first = windows[new]
    count = np.diff(np.append(np.flatnonzero(new), len(windows)))
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, first, count, chosen[new] - first, grams[chosen[new]].view(np.int64)


def _digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers each, of the bytes from ``first`` to ``end``."""
    raw = data.tobytes()
    both = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist()))
    return np.frombuffer(both, np.int64).reshape(-1, 2)


def _anchors(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None, bits: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (h) or, with a bitmap of the anchors that may repeat, whole snippet rows of those."""
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = text_buffer(batch.column(2))
        for first, last in blocks(offsets, _LONGEST):
            base = int(offsets[first])
            # A single text may be long: it is cut into stretches that share SPAN - 1 bytes.
            ends = range(base, int(offsets[last]), _LONGEST)
            for begin in ends if last - first == 1 else [base]:
                if last - first == 1:
                    stop = min(int(offsets[last]), begin + _LONGEST + SPAN - 1)
                    part, own = data[begin:stop], np.array([0, stop - begin])
                else:
                    part, own = data[base : offsets[last]], offsets[first : last + 1] - base
                doc, at, n, a, h = snippets(part, own)
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
                    continue
                near = prefilter.is_marked(bitmap, (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
                doc, at, n, a, h = doc[near], at[near], n[near], a[near], h[near]
                c = _digests(part, at, at + n + SPAN - 1)
                place = at - own[doc] + (begin - base)
                arrays = [h, c[:, 0], c[:, 1], ids[first + doc], keys[first + doc], place.astype(np.int64), n.astype(np.int32), a.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["h", "c1", "c2", "id", "key", "at", "n", "a"])


def repeated_anchors(keyed: DataFrame) -> DataFrame:
    """Snippet rows (h, c1, c2, id, key, at, n, a) whose anchor h occurs at least twice."""
    counts = keyed.mapInArrow(lambda it: _anchors(it, None), "h BIGINT").groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    shared = write_stage(counts.where(F.col("m") > 1).select("h"), "anchors")
    # Larger sets than the largest bitmap is made for only let more rows through to the join.
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_EACH * shared.count()).bit_length()))
    bitmap = prefilter.marked(shared.select(F.shiftrightunsigned("h", 64 - bits).alias("slot")), bits)
    rows = keyed.mapInArrow(lambda it: _anchors(it, bitmap, bits), _ROW)
    return rows.join(shared, "h", "left_semi")


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (id, key, at, n) of repeated windows, from snippets sorted by ``h``."""
    held: list[dict] = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["h"] != last and size >= SORT_BYTES:
                yield _runs(held)
                held, size = [], 0
            held.append(row)
            size += len(row["snippet"])
            last = row["h"]
    if held:
        yield _runs(held)


def _runs(rows: list[dict]) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(r["snippet"] for r in rows), np.uint8)
    count = np.array([r["n"] for r in rows])
    begin = np.concatenate([[0], np.cumsum([len(r["snippet"]) for r in rows])])[:-1]
    of = np.repeat(np.arange(len(rows)), count)
    local = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    hit = SuffixSorter(data, SPAN).repeated(begin[of] + local)
    hit &= np.array([r["m"] == 1 for r in rows])[of]  # the others repeat as a whole and are known already
    spots = np.flatnonzero(hit)
    new = np.concatenate([[True], (np.diff(spots) != 1) | (np.diff(of[spots]) != 0)]) if len(spots) else np.zeros(0, bool)
    first = spots[new]
    n = np.diff(np.append(np.flatnonzero(new), len(spots))) if len(spots) else np.zeros(0, np.int64)
    column = lambda name: np.array([rows[i][name] for i in of[first]], dtype=np.int64)
    arrays = [pa.array(column("id"), pa.int64()), pa.array(column("key"), pa.int64()), pa.array(column("at") + local[first], pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "key", "at", "n"])


def _parts(cut: DataFrame) -> DataFrame:
    """Snippets (m, id, key, at, n, a, snippet) cut where the bytes before the anchor pass a multiple of RANGE.

    A part (r, low, high, m, id, key, at, n, snippet) has the n = high - low + 1
    windows with low to high bytes before the anchor.
    """
    least = F.col("a") - F.col("n") + 1
    ranges = cut.withColumn("r", F.explode(F.sequence(F.floor(least / RANGE).cast("int"), F.floor(F.col("a") / RANGE).cast("int"))))
    bounded = ranges.withColumns(
        {"low": F.greatest(least, F.col("r") * RANGE), "high": F.least(F.col("a"), F.col("r") * RANGE + RANGE - 1)}
    )
    skipped, n = F.col("a") - F.col("high"), F.col("high") - F.col("low") + 1
    return bounded.select(
        "r", "low", "high", "m", "id", "key", (F.col("at") + skipped).alias("at"), n.alias("n"),
        F.substring("snippet", skipped + 1, n + SPAN - 1).alias("snippet"),
    )


def _whole(rows: DataFrame, kinds: DataFrame, key: list[str]) -> DataFrame:
    """Runs of the rows not known yet whose key stands for several."""
    repeated = kinds.where(F.col("m") > 1).select(*key)
    return rows.where(F.col("m") == 1).join(repeated, key, "left_semi").select("id", "key", "at", F.col("n").cast("bigint").alias("n"))


def _split_hot(cut: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Runs known from snippets of hot anchors, and what of them is still to be sorted by ``h``."""
    parts = write_stage(_parts(cut), "parts")
    same = ["low", "high", "snippet"]
    kinds = parts.groupBy("r", *same).agg(F.sum("m").alias("m"), F.min(F.struct("id", "key", "at")).alias("rep"))
    kinds = write_stage(kinds, "part-kinds")
    runs = _whole(parts, kinds, same)
    # The bytes that all windows of the range have, wherever the part begins and ends in it.
    shared = F.substring("snippet", F.col("high") - F.col("r") * RANGE + 1, F.lit(SPAN - RANGE + 1))
    kinds = kinds.withColumn("h", F.xxhash64("r", shared)).select(
        "h", "m", "rep.*", (F.col("high") - F.col("low") + 1).alias("n"), "snippet"
    )
    meeting = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where((F.col("k") > 1) & (F.col("least") == 1))
    meeting = write_stage(kinds.join(meeting.select("h", "k"), "h"), "part-groups")
    single = meeting.where(F.col("k") > most).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    single = single.select("m", "id", "key", (F.col("at") + F.col("j")).alias("at"), F.lit(1).alias("n"), F.substring("snippet", F.col("j") + 1, F.lit(SPAN)).alias("snippet"))
    runs = runs.unionByName(_whole(single, single.groupBy("snippet").agg(F.sum("m").alias("m")), ["snippet"]))
    return runs, meeting.where(F.col("k") <= most).select(*_SORTED)


_SORTED = ["h", "m", "id", "key", "at", "n", "snippet"]


def repeated_runs(docs: DataFrame, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """(id, key, at, n): windows at .. at + n - 1 of the text repeat somewhere in the corpus."""
    keyed = _keyed(docs)
    rows = write_stage(repeated_anchors(keyed), "snippets")
    same = ["h", "c1", "c2"]
    kinds = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "key", "at", "n", "a")).alias("rep"))
    kinds = write_stage(kinds, "kinds")
    whole = rows.join(kinds.where(F.col("m") > 1).select(*same), same, "left_semi").select("id", "key", "at", F.col("n").cast("bigint").alias("n"))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where((F.col("k") > 1) & (F.col("least") == 1))
    wanted = kinds.join(mixed.select("h", "k"), "h").select("h", "k", "m", "rep.*")
    bytes_ = F.expr(f"substring(cast(text as binary), cast(at + 1 as int), n + {SPAN - 1})")
    wanted = write_stage(wanted, "wanted")
    holders, _ = prefilter.split(keyed, wanted.select("id"), "id")
    cut = wanted.join(holders, ["id", "key"]).select("h", "k", "m", "id", "key", "at", "n", "a", bytes_.alias("snippet"))
    cut = write_stage(cut, "cut")
    known, left = _split_hot(cut.where(F.col("k") > most_snippets), most_snippets)
    near = cut.where(F.col("k") <= most_snippets).select(*_SORTED).unionByName(left)
    runs = near.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_windows, _RUN)
    return whole.unionByName(known).unionByName(runs)


def spans_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans (from, to) that the windows of the runs cover."""
    out: list[list[int]] = []
    for at, n in sorted(runs):
        end = at + n - 1 + SPAN
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def deduplicated(docs: DataFrame, text: bool = True, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """Every row of ``docs`` with what its repeated bytes leave.

    Adds n_bytes, n_removed, n_spans, kept_sha256 and, when ``text`` is set,
    replaces the text column by the remaining bytes (a character cut in two by
    a removal is left out; a null text stays null).  Without ``text`` only
    doc_id and the four figures are returned.

    A null or empty text has no bytes, texts under SPAN bytes keep all of
    theirs, repeated rows of SPAN bytes or more lose all, and an empty table
    gives an empty table.  Columns of ``docs`` named like the four figures are
    replaced.
    """
    figures = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    runs = write_stage(repeated_runs(docs, most_snippets), "runs")
    lists = runs.groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("__runs"))
    columns = [c for c in docs.columns if c not in figures] if text else ["doc_id", "text"]
    named = docs.select(*columns).withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "__key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    )
    # Only documents that may have a run are moved to meet theirs.
    near, far = prefilter.split(named, runs.select(F.col("id").alias("__id")), "__id")
    met = near.join(lists.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__runs"), ["__id", "__key"], "left")
    none = F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("__runs")
    joined = met.select(*columns, "__runs").unionByName(far.select(*columns, none))
    out_columns = columns if text else ["doc_id"]
    place = columns.index("text")
    schema = joined.limit(0).selectExpr(
        *[f"`{c}`" for c in out_columns], "0L AS n_bytes", "0L AS n_removed", "0L AS n_spans", "'' AS kept_sha256"
    ).schema

    def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in blocks(text_buffer(batch.column(place))[1], CUT_BYTES):
                yield batch.slice(first, last - first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            shown, numbers = [], []
            for body, own in zip(batch.column(place), batch.column(len(columns))):
                data = (body.as_py() or "").encode()
                spans = spans_of([(r["at"], r["n"]) for r in own.as_py() or []])
                kept = _kept(data, spans)
                numbers.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
                shown.append(None if body.as_py() is None else kept.decode("utf-8", "ignore"))
            own_columns = [pa.array(shown, pa.string()) if i == place else batch.column(i) for i in range(len(columns))] if text else [batch.column(0)]
            sums = [pa.array([x[i] for x in numbers], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*own_columns, *sums], names=[*out_columns, *figures])

    return joined.mapInArrow(cut, schema)
