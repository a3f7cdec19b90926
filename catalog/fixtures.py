"""Input tables of the registered queries, as SQL that Spark and DuckDB share.

TEXT: benchmark passages (reads) against documents (references).
DNA: deterministic nucleotide text made from the keys of part (references)
and customer (reads); see FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 31

# Hexadecimal digits and the nucleotide each stands for.
HEX_DIGITS = "0123456789abcdef"
HEX_BASES = "ACGTACGTACGTACGT"


def _blocks(tag: str, key: str, n: int) -> str:
    """``n`` blocks of 32 bases, each from one md5 of a tagged key."""
    return " || ".join(
        f"translate(md5('{tag}' || CAST({key} AS STRING) || ':{j}'), '{HEX_DIGITS}', '{HEX_BASES}')" for j in range(n)
    )


LOWER = "abcdefghijklmnopqrstuvwxyz"


def upper_ascii(column: str) -> str:
    return f"translate({column}, '{LOWER}', '{LOWER.upper()}')"


TEXT_REFS = f"""
SELECT CAST(0 AS INT) AS db_id, doc_id AS ref_id, '>DOC' || CAST(doc_id AS STRING) || '.1 ' || source AS header,
       {upper_ascii('text')} AS seq, coalesce(quality, -1) AS tax_id
FROM documents LEFT JOIN (SELECT doc_id AS label_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
ON doc_id = label_id
"""

TEXT_READS = f"""
SELECT item_id AS q, '>ITEM' || CAST(item_id AS STRING) AS header, {upper_ascii('text')} AS seq FROM benchmark
"""

DNA_REFS = f"""
SELECT CAST(0 AS INT) AS db_id, p_partkey AS ref_id,
       '>AC' || CAST(p_partkey AS STRING) || '.1 synthetic' AS header,
       {_blocks('r', 'sid', 8)} AS seq,
       CASE WHEN p_partkey % 10 = 7 THEN -1 ELSE p_size END AS tax_id
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 25 = 0 THEN p_partkey + 1 ELSE p_partkey END AS sid FROM part) p
"""

def dna_reads_raw(refs: str) -> str:
    """Reads cut from the references ``refs``: copies, turned, changed and chimeric ones, and some of no reference."""
    return f"""
SELECT q, header, CASE WHEN q % 7 = 0 THEN lower(seq) ELSE seq END AS seq FROM (
  SELECT q, '>READ' || CAST(q AS STRING) AS header,
    CASE q % 5
      WHEN 0 THEN w
      WHEN 1 THEN reverse(translate(w, 'ACGT', 'TGCA'))
      WHEN 2 THEN substr(w, 1, 70) || translate(substr(w, 71, 1), 'ACGT', 'CGTA') || substr(w, 72)
      WHEN 3 THEN substr(w, 1, 75) || substr(w2, 76, 75)
      ELSE substr({_blocks('x', 'q', 5)}, 1, 150)
    END AS seq
  FROM (
    SELECT k.q, substr(ra.seq, off + 1, 150) AS w, substr(rb.seq, off + 1, 150) AS w2
    FROM (SELECT c_custkey AS q, c_custkey % (SELECT count(*) FROM part) AS a,
                 (c_custkey * 7 + 3) % (SELECT count(*) FROM part) AS b,
                 CAST((c_custkey * 37) % 106 AS INT) AS off
          FROM customer) k
    JOIN {refs} ra ON ra.ref_id = k.a
    JOIN {refs} rb ON rb.ref_id = k.b
  ) w
) r
"""


DNA_READS_RAW = dna_reads_raw(f"({DNA_REFS})")

DNA_READS = f"SELECT q, header, upper(seq) AS seq FROM ({DNA_READS_RAW}) raw"


def kin_refs(base: str) -> str:
    """References with relatives: twins, twins of another taxon, and copies changed in one place."""
    changed = "substr(seq, 1, 200) || translate(substr(seq, 201, 1), 'ACGT', 'CGTA') || substr(seq, 202)"
    return f"""
SELECT db_id, ref_id, header, seq, tax_id FROM {base} a
UNION ALL SELECT db_id, ref_id + 1000000000, header || ' twin', seq, tax_id FROM {base} b WHERE ref_id % 2 = 0
UNION ALL SELECT db_id, ref_id + 2000000000, header || ' cousin', seq, tax_id + 100 FROM {base} c WHERE ref_id % 4 = 0
UNION ALL SELECT db_id, ref_id + 3000000000, header || ' changed', {changed}, tax_id FROM {base} d WHERE ref_id % 3 = 0
"""


def copied_reads(base: str) -> str:
    """Reads, a third of them twice and a quarter turned round."""
    return f"""
SELECT q, header, seq FROM {base} a
UNION ALL SELECT q + 1000000000, header || ' again', seq FROM {base} b WHERE q % 3 = 0
UNION ALL SELECT q + 2000000000, header || ' turned', reverse(translate(seq, 'ACGT', 'TGCA')) FROM {base} c WHERE q % 4 = 0
"""


TABLES = ["benchmark", "conversations", "customer", "documents", "labels", "pages", "part"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(
    spark: SparkSession, sf_dir: str, sql: str, spread: dict[str, int] | None = None, **frames: DataFrame
) -> DataFrame:
    """Run shared SQL with the table names bound to this scale's files.

    ``spread`` gives tables a partition count before any work on their rows.
    ``frames`` are bound to their names in braces.
    """
    bound = dict(frames)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
            bound[name] = table(spark, sf_dir, name)
            if spread and name in spread:
                bound[name] = bound[name].repartition(spread[name])
    return spark.sql(sql, **bound)


def as_sequences(df: DataFrame, id_col: str) -> DataFrame:
    renamed = df.withColumnRenamed(id_col, "seq_id") if id_col != "ref_id" else df
    return renamed.withColumn("seq_len", F.length("seq"))
