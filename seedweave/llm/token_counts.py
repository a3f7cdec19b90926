"""Token counts by source, language and tokenizer version, kept by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas:
what a document contributed before is taken off, what it contributes now is
added.  Totals are the sum of the deltas of all committed batches, so they are
never counted anew.  A batch commits by one small file written last: a batch
that broke off is written again, one that is committed is not applied twice.

Layout under the root folder: ``ledger/<batch>`` has the documents' current
contributions before and as of that batch, ``deltas/<batch>`` its deltas, ``commits/<batch>``
its number.  Batches of one root are applied by one writer at a time.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.llm.common import words_of
from seedweave.session import path_join

KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")
CHANGES = "op STRING, doc_id BIGINT, version STRING, source STRING, lang STRING, n_tokens BIGINT"
LEDGER = (
    "doc_id BIGINT, version STRING, live BOOLEAN, source STRING, lang STRING, n_tokens BIGINT, batch_no BIGINT, "
    "was BOOLEAN, old_source STRING, old_lang STRING, old_tokens BIGINT"
)
DELTAS = "source STRING, lang STRING, version STRING, d_docs BIGINT, d_tokens BIGINT"


def word_tokens(text: Column) -> Column:
    """Tokens of the plain word tokenizer (null: none)."""
    return F.size(words_of(text)).cast("bigint")


def byte_tokens(text: Column, width: int = 4) -> Column:
    """Tokens of a tokenizer that cuts the UTF-8 bytes every ``width`` bytes."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / width).cast("bigint")


class TokenRollup:
    """Totals of one corpus, kept under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def committed(self) -> dict[str, int]:
        """Numbers of the committed batches: one entry per batch ever applied."""
        try:
            rows = self.spark.read.schema("batch_id STRING, batch_no BIGINT").option("recursiveFileLookup", True).json(path_join(self.root, "commits"))
            return {r["batch_id"]: r["batch_no"] for r in rows.collect()}
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def _folder(self, kind: str, batch_id: str) -> str:
        return path_join(self.root, kind, hashlib.sha256(batch_id.encode()).hexdigest()[:32])

    def _read(self, kind: str, schema: str, batches: dict[str, int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(kind, b) for b in sorted(batches)])

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before.

        ``changes`` has op (insert, delete or revise), doc_id, version, source,
        lang, n_tokens.  Inserting a known key revises it and revising an
        unknown one inserts it; deleting an unknown key changes nothing.  Rows
        of a batch for one key are one change: a delete if any row says so,
        else the largest (n_tokens, source, lang).  Null counts are 0, null
        sources and languages are groups of their own, and rows without doc_id
        or version stay out, as they have no key.
        """
        done = self.committed()
        if batch_id in done:
            return False
        number = max(done.values(), default=0) + 1
        live = F.min((F.col("op") != "delete").cast("int")) == 1
        value = F.struct(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
        new = (
            changes.where(F.col("doc_id").isNotNull() & F.col("version").isNotNull())
            .groupBy(*KEY)
            .agg(live.alias("live"), F.max(value).alias("new"))
        )
        state = F.struct("batch_no", "live", "n_tokens", "source", "lang")
        old = self._read("ledger", LEDGER, done).groupBy(*KEY).agg(F.max(state).alias("old"))
        ledger = self._folder("ledger", batch_id)
        both = new.join(old, [*KEY], "left")
        shown = [F.col(f"new.{c}").alias(c) for c in ("source", "lang", "n_tokens")]
        was = F.coalesce("old.live", F.lit(False))
        before = [F.col(f"old.{c}").alias(f"old_{c.removeprefix('n_')}") for c in ("source", "lang", "n_tokens")]
        rows = both.select(*KEY, "live", *shown, F.lit(number).cast("bigint").alias("batch_no"), was.alias("was"), *before)
        rows.write.mode("overwrite").parquet(ledger)
        moved = self.spark.read.schema(LEDGER).parquet(ledger)
        minus = moved.where("was").select(
            F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).alias("d"), (-F.col("old_tokens")).alias("t")
        )
        plus = moved.where("live").select("source", "lang", "version", F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
        deltas = minus.unionByName(plus).groupBy(*GROUP).agg(F.sum("d").cast("bigint").alias("d_docs"), F.sum("t").cast("bigint").alias("d_tokens"))
        deltas.write.mode("overwrite").parquet(self._folder("deltas", batch_id))
        commit = self.spark.createDataFrame([(batch_id, number)], "batch_id STRING, batch_no BIGINT").coalesce(1)
        commit.write.mode("overwrite").json(self._folder("commits", batch_id))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of groups that have documents."""
        deltas = self._read("deltas", DELTAS, self.committed())
        sums = deltas.groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where(F.col("n_docs") != 0)


def counted(docs: DataFrame, tokenizers: dict[str, Column], op: str = "insert") -> DataFrame:
    """Changes that set the counts of ``docs`` (doc_id, source, lang, text) for each tokenizer version."""
    versions = F.array(*[F.struct(F.lit(v).alias("version"), n.alias("n_tokens")) for v, n in tokenizers.items()])
    rows = docs.select("doc_id", "source", "lang", F.explode(versions).alias("c"))
    return rows.select(F.lit(op).alias("op"), "doc_id", "c.version", "source", "lang", "c.n_tokens")


def deletions(ids: DataFrame, versions: list[str]) -> DataFrame:
    """Changes that delete the documents of ``ids`` (doc_id) under all versions."""
    keyed = ids.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, versions))).alias("version"))
    none = F.lit(None)
    return keyed.select(
        F.lit("delete").alias("op"), "doc_id", "version", none.cast("string").alias("source"), none.cast("string").alias("lang"), none.cast("bigint").alias("n_tokens")
    )


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
