"""Exact Jaccard join of documents on five-word shingles, by pivots.

Jaccard distance is a metric, but documents that share no shingle are all at
distance 1, so pivots drawn from the whole corpus would tell nothing about
most pairs.  Pivots are therefore elected where distance can be below 1:

1. Documents that cannot link are left out.  A set of n shingles linked with
   another shares at least ceil(0.8 n) of them, so among its first
   n - ceil(0.8 n) + k shingles under any common order it shares k.  A first
   pass counts this for the shingles with the smallest hashes, a third of all;
   a second one counts all shingles of the documents that are left.
2. The others share one of their rarest shingles with any partner.  The
   documents with one such shingle elect a pivot; each document's home is the
   pivot that it meets most often, and its exact distance decides whether they
   link.  A group of n near copies is mostly settled by n comparisons here.
3. Shingles whose documents are still in several components tie Voronoi
   regions together that must be joined with each other.  Such a group is cut
   into blocks of bounded size, and only pairs of blocks are joined that may
   hold new links: none inside the group's largest component.
4. A pair of blocks is joined in one task by rounds of pivots.  The distances to
   the first pivots are coordinates; by the triangle inequality a later pivot
   only needs the documents within the threshold of its own coordinates, and
   only those of other components.

Every pair that can link is either compared, ruled out by a coordinate, or
already connected, so the components are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.llm import prefilter
from seedweave.llm.components import connected_components
from seedweave.llm.text_hash import shingle_sets
from seedweave.session import write_stage

# Link: 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 80
# A first prefix has this part of a set's shingles more than it must have.
EXTRA = 10
# Most documents and text bytes, on average, of one side of a block pair.
BLOCK_DOCS = 512
BLOCK_BYTES = 4 << 20
# Pivots of a block pair whose distances serve as coordinates.
COORDINATES = 4
# Slots (as a power of two) of the bitmap of shared shingles, and shingle bits that are kept.
SHARED_BITS = 24
SHINGLE_BITS = 48


def must_share(n: int) -> int:
    """Shingles that a set of n has in common with any set that it links with."""
    return (PERCENT * n + 99) // 100


def prefix_length(n: int) -> int:
    """Length of the first prefix: what need not be shared, and the extra."""
    return n - must_share(n) + max(1, n // EXTRA) if n else 0


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2): the size of each document's shingle set and a 128-bit digest of it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column(1))
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                columns = [[len(s) for s in sets], [int(d[0]) for d in digests], [int(d[1]) for d in digests]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, "doc_id BIGINT, n BIGINT, d1 BIGINT, d2 BIGINT")


def _shingles(docs: DataFrame, whole: bool, bitmap: np.ndarray | None = None, count: bool = False) -> DataFrame:
    """(doc, n, shingle) of documents (doc, text): all shingles or the first prefix, all or those that the bitmap marks.

    With ``count`` only (shingle).  n is the size of the whole set.  Shingles
    are hashes of SHINGLE_BITS bits; two that collide can only make documents
    seem nearer than they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column(1))
                n = [len(s) for s in sets]
                if not whole:
                    sets = [s[: prefix_length(len(s))] for s in sets]
                found = np.concatenate(sets) >> np.uint64(64 - SHINGLE_BITS)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])
                    continue
                sizes = [len(s) for s in sets]
                doc, size = np.repeat(part.column(0).to_numpy(), sizes), np.repeat(np.array(n, np.int64), sizes)
                if bitmap is not None:
                    near = prefilter.is_marked(bitmap, (found >> np.uint64(SHINGLE_BITS - SHARED_BITS)).astype(np.int64))
                    found, doc, size = found[near], doc[near], size[near]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(size), pa.array(found.view(np.int64))], names=["doc", "n", "shingle"])

    return docs.select("doc", "text").mapInArrow(cut, "shingle BIGINT" if count else "doc BIGINT, n BIGINT, shingle BIGINT")


def _shared(docs: DataFrame, whole: bool) -> tuple[DataFrame, np.ndarray]:
    """(shingle, df) of those that at least two documents have, and their bitmap."""
    counts = _shingles(docs, whole, count=True).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    shared = write_stage(counts.where(F.col("df") > 1), "shared")
    slot = F.shiftrightunsigned("shingle", SHINGLE_BITS - SHARED_BITS)
    return shared, prefilter.marked(shared.select(slot.alias("slot")), SHARED_BITS)


def may_link(docs: DataFrame) -> DataFrame:
    """(doc) of the documents (doc, text) whose first prefix shares as many shingles as a linked one's must.

    The prefixes of a linked pair have at least the smaller one's extra in
    common, and a partner has at least must_share(n) shingles.
    """
    shared, bitmap = _shared(docs, False)
    rows = _shingles(docs, False, bitmap).join(shared.select("shingle"), "shingle", "left_semi")
    partner = F.floor((PERCENT * F.col("n") + 99) / 100)
    enough = F.col("c") >= F.greatest(F.lit(1), F.floor(partner / EXTRA))
    return rows.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("c")).where(enough).select("doc").distinct()


def first_regions(docs: DataFrame) -> DataFrame:
    """(region, doc, home) of the documents (doc, text) that have one of their rarest shingles in common.

    All shingles of these documents are counted.  Of a set's shingles, in order
    of how many documents have them, the first n - must_share(n) + 1 hold one
    that a linked set has among its own first ones; those that no other
    document has come first and make no region.  Regions with the same members
    are one region: they are told apart by size and two hashes of the members.
    """
    shared, bitmap = _shared(docs, True)
    rows = _shingles(docs, True, bitmap).join(shared, "shingle")
    held = rows.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("s"))
    must = F.floor((PERCENT * F.col("n") + 99) / 100)
    open_ = held.where(F.col("s") >= must).select("doc", "n", (F.col("s") - must + 1).alias("take"))
    place = F.row_number().over(Window.partitionBy("doc", "n").orderBy("df", "shingle"))
    members = rows.join(open_, ["doc", "n"]).withColumn("place", place).where(F.col("place") <= F.col("take"))
    members = write_stage(members.select(F.col("shingle").alias("region"), "doc").distinct(), "members")
    alike = members.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("doc")).alias("x"),
        F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    )
    chosen = alike.where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min("region").alias("region")).select("region")
    return members.join(chosen, "region", "left_semi").withColumn("home", F.lit(True))


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, same, union) with the exact set sizes, for each pair of documents."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            for part in _parts(batch, 256):
                same, union = [], []
                for i, mine in enumerate(shingle_sets(part.column(2))):
                    other = part.column(1)[i].as_py(), part.column(3)[i]
                    if other != last:  # rows of one pivot stand together
                        last, pivot = other, shingle_sets(part.column(3).slice(i, 1))[0]
                    same.append(int(np.isin(mine, pivot, assume_unique=True, kind="sort").sum()))
                    union.append(len(mine) + len(pivot) - same[-1])
                arrays = [part.column(0), part.column(1), pa.array(same, pa.int64()), pa.array(union, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "same", "union"])

    first = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a BIGINT, b BIGINT, same BIGINT, union BIGINT")
    best = F.max_by(F.struct("same", "union"), F.col("same") / F.col("union")).alias("m")
    return found.groupBy("a", "b").agg(best).select("a", "b", "m.*")


def _merge(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (doc, component) after also joining those of linked documents."""
    of = lambda side: components.select(F.col("doc").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return components.join(merged, "component", "left").select("doc", F.coalesce("root", "component").alias("component"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _open(regions: DataFrame, components: DataFrame) -> DataFrame:
    """(doc, component, pivot) of the regions whose documents are in several components."""
    placed = regions.join(components, "doc")
    election = F.min(F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("doc")))["doc"].alias("pivot")
    sides = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), election)
    unsettled = sides.where(F.col("low") < F.col("high")).select("region", "pivot")
    return placed.join(unsettled, "region").select("doc", "component", "pivot")


def _home_pivots(active: DataFrame) -> DataFrame:
    """(a, b): each document with the pivot that most of its regions have, presumably its nearest."""
    met = active.where(F.col("doc") != F.col("pivot")).groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("n"))
    home = met.groupBy("doc").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot"))
    return home.select(*_pair("doc", "pivot")).distinct()


def _block_pairs(active: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc, component, outer, text): the documents of every pair of blocks that is to be joined.

    A document is outer when it is not in its group's largest component.  The
    pairs are outer blocks with each other and with the blocks of that
    component.
    """
    groups = connected_components(active.select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    member = active.select("doc", "component").distinct().join(groups.withColumnsRenamed({"node": "doc", "component": "grp"}), "doc")
    member = write_stage(member.join(texts.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("bytes")), "doc"), "groups")
    sizes = member.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("grp").agg(
        F.max(F.struct("n", "component", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    plan = main.select(
        "grp",
        F.col("main.component").alias("main"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("outers"),
        blocks(F.col("main.n"), F.col("main.bytes")).alias("mains"),
    )
    placed = member.join(plan, "grp").withColumn("outer", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("mains"))).cast("int")
    key = lambda i, j, kind: F.struct(F.col("grp").alias("grp"), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    with_outer = F.transform(every(F.col("outers")), lambda x: key(F.least(x, F.col("own")), F.greatest(x, F.col("own")), 0))
    with_main = F.transform(every(F.col("mains")), lambda x: key(F.col("own"), x, 1))
    from_main = F.transform(every(F.col("outers")), lambda x: key(x, F.col("own"), 1))
    keys = F.when(F.col("outer"), F.concat(with_outer, with_main)).otherwise(from_main)
    spread = placed.withColumn("own", own).select(F.explode(keys).alias("k"), "doc", "component", "outer")
    return spread.join(texts, "doc").select(F.xxhash64("k.grp", "k.i", "k.j", "k.kind").alias("key"), "doc", "component", "outer", "text")


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found in each pair of blocks; rows come sorted by key."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for part in _parts(batch, 256):
            sets = shingle_sets(part.column(4))
            columns = [part.column(i).to_pylist() for i in range(4)]
            for key, doc, component, outer, own in zip(*columns, sets):
                if key != last and held:
                    yield _links(held)
                    held = []
                last = key
                held.append((doc, component, outer, own))
    if held:
        yield _links(held)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    """The pivot rounds of one pair of blocks: links that connect components, enough of them to connect all that can be."""
    docs = np.array([r[0] for r in rows], np.int64)
    names, root = np.unique([r[1] for r in rows], return_inverse=True)
    outer = np.array([r[2] for r in rows], bool)
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    _, tokens = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(tokens.max()) + 1, bool)
    known: list[np.ndarray] = []
    a, b = [], []
    order = np.flatnonzero(outer)
    for turn, x in enumerate(order):
        near = root != root[x]
        if turn >= COORDINATES:
            # Sizes are the distances to the empty set; a linked pair's differ by a fifth at most.
            near &= (PERCENT * sizes <= 100 * sizes[x]) & (PERCENT * sizes[x] <= 100 * sizes)
            for d in known:
                near &= np.abs(d - d[x]) <= (100 - PERCENT) / 100 + 1e-9
            near[order[:turn]] = False  # compared before, as pivots
        spots = np.flatnonzero(near) if turn >= COORDINATES else np.arange(len(rows))
        if not len(spots):
            continue
        own = tokens[starts[x] : starts[x + 1]]
        mark[own] = True
        if len(spots) == len(rows):
            same = np.add.reduceat(mark[tokens], starts[:-1])
        else:
            same = np.array([mark[tokens[starts[y] : starts[y + 1]]].sum() for y in spots])
        mark[own] = False
        union = sizes[spots] + sizes[x] - same
        if turn < COORDINATES:
            known.append(1 - same / union)
        for y in spots[(100 * same >= PERCENT * union) & (root[spots] != root[x])]:
            if root[y] != root[x]:
                a.append(docs[max(x, y, key=lambda i: docs[i])])
                b.append(docs[min(x, y, key=lambda i: docs[i])])
                root[root == root[y]] = root[x]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def link_regions(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, component) of all documents of the regions."""
    regions = write_stage(regions, "regions")
    components = regions.select("doc").distinct().withColumn("component", F.col("doc"))
    measured = write_stage(_overlaps(_home_pivots(_open(regions, components)), texts), "overlaps")
    links = measured.where(100 * F.col("same") >= PERCENT * F.col("union")).select("a", "b")
    components = write_stage(_merge(components, links), "components")
    active = write_stage(_open(regions, components), "active")
    pairs = _block_pairs(active, texts).repartition("key").sortWithinPartitions("key")
    found = pairs.mapInArrow(_join_blocks, "a BIGINT, b BIGINT")
    return _merge(components, write_stage(found, "links"))


def _wordless() -> Column:
    """Whether the row's text has no shingle."""
    return F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included.
    A null or empty text, or one without words, has no shingles and links with
    nothing.  Rows that share a doc_id stand for one document and link
    together; a row without doc_id links with nothing and has no component.
    Equal sets are joined by their digest and only one of them is compared.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = write_stage(signatures(docs), "signatures")
    reps = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~_wordless()).select(F.col("doc_id").alias("doc"), "text")
    chosen = may_link(texts).join(reps.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
    texts = write_stage(prefilter.semi_join(texts, write_stage(chosen, "chosen"), "doc"), "texts")
    linked = link_regions(first_regions(texts), texts)
    found = signed.join(reps, ["d1", "d2", "n"], "left").join(linked.withColumnRenamed("doc", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the documents row with the smallest doc_id; rows without one stay.

    Of several rows with that doc_id the one with the smallest digest of its
    text stays (then of its other columns), one with words before one without.
    Only rows that may have to go are moved to meet the verdict on them.
    """
    found = write_stage(jaccard_components(docs).where(F.col("doc_id").isNotNull()), "found")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("doc_id")
    near, far = prefilter.split(docs.where(F.col("doc_id").isNotNull()), gone.unionByName(twice), "doc_id")
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    order = F.struct(_wordless().alias("wordless"), F.md5(F.col("text").cast("binary")).alias("text"), F.md5(rest.cast("binary")).alias("rest"))
    left = near.join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    kept = left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return kept.unionByName(far).unionByName(docs.where(F.col("doc_id").isNull()))
