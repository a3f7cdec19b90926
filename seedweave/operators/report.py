"""Taxon vote and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.session import write_stage

GROUP = ["q", "grp", "confident"]
# References per part of an output line, and reference ids per block of the numbering.
PART_SIZE, REF_SPAN = 1_000, 65_536


def with_reference(grouped: DataFrame, refs_meta: DataFrame) -> DataFrame:
    """Long form of the report: one row per read, score group and reference."""
    meta = refs_meta.select("ref_id", "header", "tax_id")
    return grouped.select(*GROUP, "ref_id").join(meta, "ref_id")


def tax_occurrences(members: DataFrame) -> DataFrame:
    """References per taxon inside one score group."""
    return members.groupBy(*GROUP, "tax_id").agg(F.count(F.lit(1)).alias("n"))


def winning_taxa(occurrences: DataFrame) -> DataFrame:
    """Leading taxa whose count equals the first one's, numbered by ``ord``.

    The unknown taxon (-1) comes first whatever its count, then taxa by count
    and id; the list stops at the first differing count.  The window sees the
    distinct taxa of one score group, so the taxonomy bounds it.
    """
    w = Window.partitionBy(*GROUP).orderBy((F.col("tax_id") != -1), F.col("n").desc(), F.col("tax_id"))
    first = F.first("n").over(w)
    return (
        occurrences.withColumn("ord", F.row_number().over(w))
        .withColumn("off", F.max(F.when(F.col("n") != first, 1).otherwise(0)).over(w))
        .where("off = 0")
        .drop("off")
    )


def tax_lists(winners: DataFrame) -> DataFrame:
    """Comma-joined taxon ids with their parallel counts."""
    packed = F.sort_array(F.collect_list(F.struct("ord", "tax_id", "n")))
    return winners.groupBy(*GROUP).agg(packed.alias("t")).select(
        *GROUP,
        F.array_join(F.transform("t", lambda x: x["tax_id"].cast("string")), ",").alias("tax_ids"),
        F.array_join(F.transform("t", lambda x: x["n"].cast("string")), ",").alias("occurrences"),
    )


def header_list(members: DataFrame, winners: DataFrame) -> DataFrame:
    """Comma-joined headers of the references that belong to winning taxa.

    The list is the output line's own field, so its length is the line's
    length; ``with_reference`` is the form with one row per reference.
    """
    won = members.join(winners.select(*GROUP, "tax_id", "ord"), [*GROUP, "tax_id"])
    packed = F.sort_array(F.collect_list(F.struct("ord", "ref_id", "header")))
    return won.groupBy(*GROUP).agg(packed.alias("h")).select(
        *GROUP, F.array_join(F.transform("h", lambda x: x["header"]), ",").alias("headers")
    )


def _placed(rows: DataFrame, order: str, part_size: int) -> DataFrame:
    """Adds ``part_no``: the row's place in its group by (``order``, ref_id), divided by ``part_size``.

    Places come from two passes: rows are counted per block of REF_SPAN
    reference ids, combined before the shuffle, and the blocks' running sums
    shift the places inside a block.  No window sees more than a block's rows
    or a group's blocks.
    """
    block = [*GROUP, order, "block"]
    cut = rows.withColumn("block", F.floor(F.col("ref_id") / REF_SPAN))
    earlier = Window.partitionBy(*GROUP).orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(*block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("ref_id"))
    return cut.join(shifts, block).withColumn("part_no", F.floor((F.col("before") + inside - 1) / part_size)).drop("block", "before")


def header_parts(members: DataFrame, winners: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``header_list`` in numbered parts of at most ``part_size`` references.

    Parts joined in order of ``part_no`` are the packed list; a read that ties
    on all references makes more rows, not longer ones.
    """
    won = members.join(winners.select(*GROUP, "tax_id", "ord"), [*GROUP, "tax_id"])
    parts = _placed(won.select(*GROUP, "ord", "ref_id", "header"), "ord", part_size)
    packed = F.sort_array(F.collect_list(F.struct("ord", "ref_id", "header")))
    return parts.groupBy(*GROUP, "part_no").agg(packed.alias("h")).select(
        *GROUP, "part_no", F.array_join(F.transform("h", lambda x: x["header"]), ",").alias("headers")
    )


def named(answers: DataFrame, reads: DataFrame) -> DataFrame:
    """Answers with their reads' headers, under the columns of a result row."""
    names = reads.select(F.col("seq_id").alias("q"), F.col("header").alias("query_header"))
    return answers.join(names, "q").select(
        "q",
        "query_header",
        "confident",
        F.format_string("%.6f", "confident").alias("confident_text"),
        "tax_ids",
        "occurrences",
        "headers",
        "grp",
        *[c for c in answers.columns if c == "part_no"],
    )


def result_rows(lists: DataFrame, headers: DataFrame, reads: DataFrame) -> DataFrame:
    """The result table: one row per read and score group, or per part of its headers."""
    return named(lists.join(headers, GROUP), reads)


def answers(members: DataFrame, part_size: int | None = None) -> DataFrame:
    """Taxon vote and headers of each score group, without the reads' headers."""
    winners = winning_taxa(tax_occurrences(members))
    headers = header_parts(members, winners, part_size) if part_size else header_list(members, winners)
    return tax_lists(winners).join(headers, GROUP)


def report(grouped: DataFrame, refs_meta: DataFrame, reads: DataFrame, part_size: int | None = None) -> DataFrame:
    """Score groups to result rows, through the taxon vote.

    ``part_size`` bounds the references of a row and adds ``part_no``.
    """
    return named(answers(with_reference(grouped, refs_meta), part_size), reads)


def screen_rows(grouped: DataFrame, refs_meta: DataFrame, reads: DataFrame) -> DataFrame:
    """Flat lines: the references of a group as ``id;header;`` items."""
    names = reads.select(F.col("seq_id").alias("q"), F.col("header").alias("query_header"))
    item = F.struct("ref_id", F.concat_ws(";", F.col("ref_id").cast("string"), "header", F.lit("")).alias("item"))
    lines = (
        with_reference(grouped, refs_meta)
        .groupBy(*GROUP)
        .agg(F.sort_array(F.collect_list(item)).alias("i"))
        .select(*GROUP, F.array_join(F.transform("i", lambda x: x["item"]), ";").alias("refs"))
    )
    return lines.join(names, "q").select("q", "query_header", "confident", "refs", "grp")


def screen_parts(grouped: DataFrame, refs_meta: DataFrame, reads: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``screen_rows`` in numbered parts of at most ``part_size`` references."""
    names = reads.select(F.col("seq_id").alias("q"), F.col("header").alias("query_header"))
    item = F.struct("ref_id", F.concat_ws(";", F.col("ref_id").cast("string"), "header", F.lit("")).alias("item"))
    lines = (
        _placed(with_reference(grouped, refs_meta).select(*GROUP, F.lit(0).alias("ord"), "ref_id", "header"), "ord", part_size)
        .groupBy(*GROUP, "part_no")
        .agg(F.sort_array(F.collect_list(item)).alias("i"))
        .select(*GROUP, "part_no", F.array_join(F.transform("i", lambda x: x["item"]), ";").alias("refs"))
    )
    return lines.join(names, "q").select("q", "query_header", "confident", "refs", "grp", "part_no")


def relative_abundance(members: DataFrame, winners: DataFrame) -> DataFrame:
    """Share of the result rows per first reference header, in percent.

    The first reference of a row is found among its members, so headers may
    hold any character.
    """
    won = members.join(winners.select(*GROUP, "tax_id", "ord"), [*GROUP, "tax_id"])
    first = F.min(F.struct("ord", "ref_id", "header"))["header"]
    counts = won.groupBy(*GROUP).agg(first.alias("header")).groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    counts = write_stage(counts, "header-counts")  # read for the rows and for their total
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.select("header", (F.lit(100.0) * F.col("n") / total).alias("pct"))


def tiers(
    results: DataFrame, hs: float = 0.4, bal: float = 0.7, hp: float = 1.0, sampled: bool = False
) -> DataFrame:
    """Each result once per tier it reaches, in one pass over the results.

    A sub-sampled index cannot vouch for full matches, so ``sampled`` leaves
    the high-precision tier out.
    """
    levels = [("high_sensitivity", hs), ("balanced", bal)]
    if not sampled:
        levels.append(("high_precision", hp))
    reached = [F.when(F.col("confident") >= F.lit(float(t)), F.lit(name)) for name, t in levels]
    names = F.array_compact(F.array(F.lit("raw"), *reached))
    return results.select(F.explode(names).alias("tier"), "*")
