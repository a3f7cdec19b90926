"""Test passages inside training texts, found by winnowing.

A span of ``n`` consecutive words (10, or all words of a shorter item) is looked
for.  With k = (n + 1) div 2, a text's fingerprints are, of every n - k + 1
consecutive k-grams, the one with the smallest hash (the first of equal ones).
Two texts that share n words share all k-grams inside them, so both hold the
same fingerprint at the same place of the shared span: none is missed.  Equal
fingerprints are extended by at most n - k words to both sides, and count when
n words or more are equal, which the words themselves decide.

Everything is column expressions: one pass over the documents cuts words,
takes fingerprints and looks them up in the items' fingerprints, which are sent
to all tasks in slices of a size that is checked; a larger set of items takes
more passes, and no text of a document is ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedweave.llm.common import let
from seedweave.session import BROADCAST_BYTES, ROW_BYTES, write_stage

SPAN = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE_BITS, _SPAN_BITS = 16, 4
# Words of a text that are looked at together: places in a piece fit the low bits of a fingerprint.
PIECE = (1 << _PLACE_BITS) - 2 * SPAN
_LOW = (1 << (_PLACE_BITS + _SPAN_BITS)) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram_length(span: int) -> int:
    return (span + 1) // 2


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case (null: none)."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def fingerprints(words: Column, span: int) -> Column:
    """Hash, span and place of each fingerprint of an array of fewer than 2**16 words, packed into one number."""
    k = gram_length(span)
    window = span - k + 1

    def gram(own: Column, i: Column) -> Column:
        hashed = F.xxhash64(*[F.get(own, i + j) for j in range(k)])
        return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(span << _PLACE_BITS)).bitwiseOR(i.cast("bigint"))

    def chosen(grams: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(grams) - (window - 1)), lambda i: F.array_min(F.slice(grams, i, window)))
        return F.array_distinct(least)

    grams = let(words, lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - k), lambda i: gram(own, i)))
    found = let(grams, chosen)
    return F.when(F.size(words) >= span, found).otherwise(F.array().cast("array<bigint>"))


def pieces(rows: DataFrame, span: int, piece: int = PIECE) -> DataFrame:
    """``rows`` (..., words), one row for each ``piece`` words, with ``at``, its first word, and the ``span`` - 1 words after it."""
    n = F.size("words")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(piece)),
        lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, piece + span - 1).alias("words")),
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("words").alias("words")))
    parts = F.when(n <= piece, whole).otherwise(cut)
    keep = [c for c in rows.columns if c != "words"]
    return rows.select(*keep, F.explode_outer(parts).alias("part")).select(*keep, "part.at", "part.words")


def item_contexts(items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the items in their surroundings, and which items hold them.

    The first table has (context, n, print, before, gram, after), each
    surrounding once; ``before`` starts with the nearest word.  The second has
    (context, item_id), item_id as a string.  Both are written tables.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    named = named.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(span)))
    by_span = reduce(lambda rest, s: F.when(F.col("n") == s, fingerprints(F.col("words"), s)).otherwise(rest), range(1, span + 1), F.array().cast("array<bigint>"))
    seen = pieces(named, span).withColumn("found", by_span)
    seen = seen.select("item_id", "n", "words", F.explode_outer("found").alias("v")).where(F.col("v").isNotNull())
    place, k = F.col("v").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int"), F.floor((F.col("n") + 1) / 2).cast("int")
    side = F.col("n") - k
    shown = seen.select(
        "item_id", "n", F.shiftright("v", _PLACE_BITS).alias("print"),
        F.reverse(F.slice("words", F.greatest(place - side, F.lit(0)) + 1, F.least(place, side))).alias("before"),
        F.slice("words", place + 1, k).alias("gram"),
        F.slice("words", place + 1 + k, side).alias("after"),
    )
    same = ["n", "print", "before", "gram", "after"]
    spots = write_stage(shown.distinct(), "item-spots")
    contexts = write_stage(spots.select(*same).distinct().withColumn("context", F.monotonically_increasing_id()), "contexts")
    return contexts, write_stage(spots.join(contexts, same).select("context", "item_id"), "context-items")


def _equal_words(first: Column, step: int, other: str, most: int) -> Column:
    """How many words from ``first`` on, going by ``step``, equal the leading ones of ``other``."""
    out = F.lit(0)
    for j in reversed(range(most)):
        same = F.get("words", first + step * j) == F.get(other, F.lit(j))
        out = F.when(same, out + 1).otherwise(F.lit(0))
    return out


def passage_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words, start, end, context) and the items of the contexts.

    A row with a context says that words ``start`` to ``end`` - 1 of the text
    are a run that holds the item's span; each row of ``docs`` also has one row
    without a context.  Written tables.
    """
    contexts, members = item_contexts(items, span)
    spans = [r["n"] for r in contexts.select("n").distinct().collect()]  # 1 to span
    length = F.octet_length(F.concat_ws(" ", "before", "gram", "after"))
    size = contexts.agg(F.sum(length + 4 * ROW_BYTES)).first()[0] or 0
    slices = -(-size // BROADCAST_BYTES) or 1

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    cut = pieces(rows.withColumn("n_words", F.size("words").cast("bigint")), span, piece)
    found = [fingerprints(F.col("words"), s) for s in sorted(spans)]
    head = F.when(F.col("at") == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    own = [c for c in cut.columns]
    place = F.col("v").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    k = F.floor((F.col("n") + 1) / 2).cast("int")

    def looked_up(part: int) -> DataFrame:
        first = [head] if part == 0 else []
        some = F.concat(*first, *found) if first or found else F.array().cast("array<bigint>")
        shown = cut.withColumn("found", some).select(*own, F.explode_outer("found").alias("v"))
        table = contexts.where(F.pmod(F.xxhash64("context"), F.lit(slices)) == part)
        met = shown.join(F.broadcast(table), F.shiftright("v", _PLACE_BITS) == F.col("print"), "left")
        widest = span - gram_length(span)
        known = met.select(
            "*", _equal_words(place - 1, -1, "before", widest).alias("left"), _equal_words(place + k, 1, "after", widest).alias("right"), k.alias("k")
        )
        hit = F.col("context").isNotNull() & (F.slice("words", place + 1, F.col("k")) == F.col("gram")) & (F.col("left") + F.col("k") + F.col("right") >= F.col("n"))
        hit = F.coalesce(hit, F.lit(False))
        begin = F.col("at") + place
        return known.where(hit | (F.col("v") == -1)).select(
            "doc_id", "text_key", "n_words",
            F.when(hit, begin - F.col("left")).alias("start"),
            F.when(hit, begin + F.col("k") + F.col("right")).alias("end"),
            F.when(hit, F.col("context")).alias("context"),
        )

    parts = [looked_up(i) for i in range(slices)]
    return write_stage(reduce(DataFrame.unionByName, parts), "passages"), members


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, piece: int = PIECE) -> DataFrame:
    """What each row of ``docs`` (doc_id, text) holds of ``items`` (item_id, text).

    Returns doc_id, text_key (hash of the text), n_words, n_hit (words inside a
    span of an item), n_items, item_ids (sorted strings), items_sha256 and
    contaminated.

    A null or empty text has no words and no hits; an item without words is
    found nowhere, an item without item_id counts as one called ''.  Rows with
    one item_id are one item with all their spans.  Repeated documents each get
    their row, and rows with one doc_id and different texts each get their own
    figures.  Without documents the result is empty, without items nothing is
    hit.  Further columns play no part.
    """
    rows, members = passage_hits(docs, items, span, piece)
    key = ["doc_id", "text_key"]
    hits = rows.where(F.col("context").isNotNull())
    # Words covered by the runs of a text, in the order of their starts.
    ends = hits.groupBy(*key, "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))
    covered = ends.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    held = hits.select(*key, "context").distinct().join(members, "context").select(*key, "item_id").distinct()
    lists = held.groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    out = rows.where(F.col("context").isNull()).select(*key, "n_words")
    for name, found in (("n_hit", covered), ("item_ids", lists)):
        named = found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
        met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
        out = out.join(named, met, "left").drop("__id", "__key")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
