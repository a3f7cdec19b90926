"""Session helpers: written stages and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for any table this package broadcasts, and the bytes that a row
# without texts (ids, positions, short names) is taken to need.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
# Rows of a few hundred characters that one task of a spread source gets.
ROWS_PER_PARTITION = 20_000


def _configured_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stage_root(spark: SparkSession) -> str:
    """Folder for written stages: the checkpoint folder that all executors share."""
    configured = _configured_root(spark)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return configured.rstrip("/")


def provide_stage_root(spark: SparkSession) -> None:
    """Give a local session without a checkpoint folder a temporary one; for small checks and tests.

    Under a local master driver and executors are one process with one disk.
    """
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master and not _configured_root(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-seedweave-"))


# Whether Spark deletes the shuffle files of a query as it ends; else they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Files that a task may write at once; above 0 Spark does not sort the rows of a task by their bucket.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Compressed bytes of a shuffled partition, the largest of its side, up to which a join hashes that side and sorts neither;
# Spark asks that partitions are put together to no more than that.
HASHED_SIDE = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
PUT_TOGETHER = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
HASHED_BYTES = "16m"


@contextmanager
def _set_for_now(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written_apart(spark: SparkSession):
    """Settings of a write: what it has shuffled goes as it ends, since the written table takes its place; joins hash small sides."""
    own = {PUT_TOGETHER: spark.conf.get(PUT_TOGETHER, None) or HASHED_BYTES}
    return _set_for_now(spark, {SHUFFLE_CLEANUP: "true", HASHED_SIDE: HASHED_BYTES} | own)


def write_buckets(df: DataFrame, path: str, table: str, n: int, keys: list[str], order: list[str], **options) -> None:
    """Write ``df`` to ``path`` in ``n`` buckets of ``keys``, a file each, sorted by ``order`` if any.

    A task has one bucket.  Left to sort the rows itself, Spark would look for their bucket in each comparison.
    """
    spark = df.sparkSession
    dealt = df.repartition(n, *keys)
    with _set_for_now(spark, {SHUFFLE_CLEANUP: "true", OPEN_FILES: "1"}):
        writer = (dealt.sortWithinPartitions(*order) if order else dealt).write.format("parquet").bucketBy(n, *keys)
        writer.options(**options).option("path", path).saveAsTable(table)
    # The catalog entry only serves the writer; the files are what is kept.
    spark.sql(f"DROP TABLE {table}")


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    A written table survives the loss of executors, keeps column pruning and
    carries real size statistics into the next stage's join planning.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/seedweave-{name}-{uuid.uuid4().hex}"
    with written_apart(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()


def fits_broadcast(rows: int, width: int = 0, limit: int | None = None) -> bool:
    """Whether ``rows`` rows with ``width`` bytes of text each may be broadcast, within ``limit`` bytes if given."""
    return rows * (ROW_BYTES + width) <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame, rows: int | None = None, width: int = 0, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted size allows it.

    Beyond the bound the frame is returned unhinted and the join shuffles,
    with skewed partitions split by adaptive execution.
    """
    return F.broadcast(df) if fits_broadcast(row_count(df) if rows is None else rows, width, limit) else df


def judged_by_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table that Spark must not broadcast, however well its files are compressed, if it has too many rows."""
    return df if fits_broadcast(row_count(df) if rows is None else rows) else df.hint("merge")


def default_spread(spark: SparkSession, rows: int = 0) -> int:
    """Partition count for sources with fewer splits than the cluster has cores.

    Executors that have not registered yet do not count as cores; ``rows``, where counted, ask for their own number.
    """
    return max(2, 2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))


def path_join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts]) if "://" in root else os.path.join(root, *parts)
