"""Following a folder: files that appear are merged into the catalogue, a generation for each micro-batch.

An extension of ours: the catalogue's own rules (upsert by path, hashes kept while size and mtime stay) applied to a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import upsert
from ..operators.store import Store


def latest_generation(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """(number, rows) of the newest published generation below root; 0 and no rows if there is none."""
    store = Store(spark, root)
    newest = store.latest()
    return newest.number, store.files(newest)


def merge_batch(root: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A sink: each batch is one upsert. A generation says which batch of which query it took in, so a batch that is repeated after
    a failure is taken once: a crash before the generation was published leaves nothing behind that the repeat would meet, and after
    one that was the repeat does nothing. Another writer's generation in between is taken up, not overwritten."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        store, query = Store(spark, root), spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query and store.latest().marks.get(query, -1) >= epoch:
            return
        newest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.struct("indexed_at", "mtime")).alias("x")).select("x.*")
        store.update(lambda files: finish(upsert(files, newest)), {query: epoch} if query else None)

    return sink


def follow(entries: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start merging a stream of catalogue rows (columns of FILES; ids are ours) into generations below root."""
    return entries.writeStream.foreachBatch(merge_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
