"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.llm import decontamination, importance, jaccard_join, language_id, lexical, license_scan, mixing, nearest, pieces, quality_rules, suffix_dedup, token_counts, warc
from seedweave.llm.common import table
from seedweave.session import path_join, provide_stage_root, stage_root

Query = Callable[[SparkSession, str], DataFrame]

# Shares that the mixture should have: the crawl that dominates counts as much
# as two other sources, two curated ones count more, all others alike.
MIX_WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 1.5}
MIX_SEED = 17


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place for written stages."""
    return path_join(stage_root(spark), f"seedweave-{name}-{uuid.uuid4().hex}")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), text=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archive(spark, path, keep_payload=False))
    found = warc.resolve_revisits(captures)
    is_revisit = F.col("capture.record_type") == "revisit"
    return found.select(
        "page_id",
        F.col("original.payload_bytes").alias("payload_bytes"),
        F.col("original.payload_sha256").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(is_revisit, F.col("original.page_id")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), f AS (
  SELECT *, sha256(body) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM f
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mixed(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)
    return mixing.shuffled(copies, MIX_SEED)


OP7_SQL = f"""
WITH RECURSIVE n AS (
  SELECT source, count(*) AS n, CASE source {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_WEIGHTS.items())} ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source
), rates AS (
  SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n)::DOUBLE FROM n) / n AS mean FROM n
), terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM rates
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM terms WHERE k < 150
), draws AS (
  SELECT d.*, CAST('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM documents d
), counts AS (
  SELECT doc_id, count(*) FILTER (WHERE t.total <= u) AS copies
  FROM draws d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY doc_id
), copies AS (
  SELECT doc_id, CAST(copies AS INT) AS copies, CAST(unnest(range(1, copies + 1)) AS INT) AS copy_no FROM counts WHERE copies > 0
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copies, copy_no,
  md5('order{MIX_SEED}:' || doc_id || ':' || copy_no) AS shuffle_key
FROM copies JOIN documents d USING (doc_id)
"""

def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), k=5)


# Where public tokenizer files lie; SEEDWEAVE_PIECES names another model file.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return os.environ.get("SEEDWEAVE_PIECES") or public_tokenizers.path(PIECE_MODEL)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(~language_id.in_holdout(F.col("doc_id"))))
    shown = language_id.predict(docs, filters)
    return shown.select("doc_id", language_id.in_holdout(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


WORDS_VERSION, BYTES_VERSION = "words-1", "bytes4-1"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches, of which two come twice: first counts, a second tokenizer, revised counts, deletions."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = token_counts.TokenRollup(spark, _folder(spark, "token-counts"))
    text = F.col("text")
    words = {WORDS_VERSION: token_counts.word_tokens(text)}
    lines = {WORDS_VERSION: token_counts.word_tokens(text) + F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)) - 1}
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    bad = labels.where(F.col("quality") == 0)
    batches = {
        "words": token_counts.counted(docs, words),
        "bytes": token_counts.counted(docs, {BYTES_VERSION: token_counts.byte_tokens(text)}),
        "lines-count": token_counts.counted(docs, lines, "revise").join(toxic, "doc_id", "left_semi"),
        "low-quality": token_counts.deletions(bad, [WORDS_VERSION, BYTES_VERSION]),
    }
    for name in ("words", "bytes", "words", "lines-count", "low-quality", "lines-count"):
        rollup.apply(name, batches[name])
    return rollup.totals()


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
), c AS (
  SELECT source, lang, '{WORDS_VERSION}' AS version,
    len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))
      + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN len(string_split(t, chr(10))) - 1 ELSE 0 END AS n
  FROM d
  UNION ALL
  SELECT source, lang, '{BYTES_VERSION}', (strlen(t) + 3) // 4 FROM d
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE_STATS, "base_failed", "kept", "rule")


# Words of letters and digits, with A-Z in lower case, in DuckDB.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH w AS (
  SELECT doc_id, unnest({_WORDS}) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), s AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d
), m AS (
  SELECT doc_id, 100 - 90 + ((90 * n * big_n) // big_l) AS m FROM d, s
), t AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), q AS (
  SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT * FROM o WHERE rank <= 10
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS span
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM i)
), dw AS (
  SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i))
), h AS (
  SELECT doc_id, item_id, n, pos FROM dw JOIN iw USING (n, span)
), c AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 of a word, bit by bit: each byte is followed by seven zeros, so that eight steps are taken a byte.
_CRC_BITS = "flatten(list_transform(range(1, strlen(f) + 1), lambda i: [CAST('0x' || substr(hex(f), 2 * i - 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295, {_CRC_BITS}), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, unnest({_WORDS}) AS f FROM documents
), b AS (
  SELECT unnest({_WORDS}) AS f FROM benchmark
), v AS (
  SELECT f, CAST({_CRC32} % 10000 AS BIGINT) AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b)
), s AS (
  SELECT bucket, count(*) AS s FROM d JOIN v USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN v USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), x AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN v USING (f) JOIN g USING (bucket) GROUP BY doc_id
), y AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN x USING (doc_id)
), z AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM y
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM z
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN place END AS rank
FROM r
"""


def _ready(query: Query) -> Query:
    """The query, with a stage folder for local sessions that have none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        provide_stage_root(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_nearest": op4_nearest,
    "op5_pieces": op5_pieces,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_decontamination": op12_decontamination,
    "op13_importance": op13_importance,
}

QUERIES = {name: _ready(query) for name, query in _QUERIES.items()}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_license_scan": license_scan.scan_sql(),
    "op7_mixing": OP7_SQL,
    "op8_token_counts": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_importance": OP13_SQL,
}
