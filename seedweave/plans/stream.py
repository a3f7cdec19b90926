"""Classification of reads that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seedweave.operators.index import Index
from seedweave.plans.classify import classify
from seedweave.session import path_join, write_stage


def write_batch(reads: DataFrame, batch_id: int, index: Index, path: str, **options) -> None:
    """Answers of one micro-batch in a folder of its own.

    A batch that is run again replaces its folder, so no row is doubled.
    """
    arrived = write_stage(reads, "batch")
    classify(arrived, index, **options).write.mode("overwrite").parquet(path_join(path, f"batch_id={batch_id}"))


def classify_stream(
    reads: DataFrame, index: Index, path: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Classify a stream of sequences against an index, micro-batch by micro-batch.

    Reads are independent of each other, so no state is kept between batches.
    The stream's checkpoint remembers which input went into which batch id;
    ``spark.read.parquet(path)`` gives the answers with their ``batch_id``.
    ``trigger`` defaults to everything that is there now, then stop.
    """
    return (
        reads.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, index, path, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
