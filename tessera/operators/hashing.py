"""The hashing queue of a store, batch by batch: what a batch found is kept as soon as it is done, and written to the catalogue at the end.

    root/hashing/b<number>    the results of one batch: the guard's columns, hashes, whether the file could be read

The queue is what the newest generation has not attempted, less what batches hold, so a run that was killed, stopped or paused after
any batch goes on with the next one, and nothing is read twice. Between batches a run asks whether to stop, and looks at the volume: a
batch counts only if the volume was the same before and after it, as an absent one would mark every file as attempted. Results land
where id, path, size and time still agree. The generation that takes them in says up to which batch it did, so a crash between
publishing it and clearing the batches does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from .index import GUARD, HASHES, guarded_hash_write
from .search import not_hashed
from .store import Generation, Store

MARK = "hashing"
RESULTS = "id long, path string, size long, mtime double, content_hash string, image_hash string, image_hash_kind string, phash string, hashed_at double, read boolean"


@dataclass(frozen=True)
class Progress:
    """After a batch: files attempted and read so far by this run, and files that were waiting when it began."""

    batches: int
    attempted: int
    read: int
    waiting: int

    @property
    def fraction(self) -> float:
        return self.attempted / self.waiting if self.waiting else 0.0


def read_files(batch: DataFrame) -> DataFrame:
    """(path, content) of files in a tree that all executors see; null if one can't be read."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():  # one at a time, as contents are large
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return batch.select("path").mapInArrow(part, "path string, content binary")


class HashingRun:
    def __init__(self, store: Store, contents: Callable[[DataFrame], DataFrame] = read_files):
        self.store, self.contents = store, contents
        self.folder = f"{store.root}/hashing"

    def batches(self, of: Generation) -> list[int]:
        """Numbers of the batches that a generation hasn't taken in."""
        return [n for n in self.store.folders(self.folder, "b") if n > of.marks.get(MARK, 0)]

    def results(self, of: Generation) -> DataFrame:
        spark, found = self.store.spark, self.batches(of)
        return spark.read.schema(RESULTS).parquet(*[f"{self.folder}/b{n:08d}" for n in found]) if found else spark.createDataFrame([], RESULTS)

    def queue(self, of: Generation, scope) -> DataFrame:
        """Rows in scope that neither the generation nor a batch has attempted as they are now."""
        return not_hashed(self.store.files(of), scope).join(self.results(of).select(*GUARD), list(GUARD), "left_anti")

    def run(self, scope, now: float, volume: Callable[[], tuple], stop: Callable[[], bool] = lambda: False, batch: int = 10_000, report: Callable[[Progress], None] = lambda p: None) -> Generation:
        """Hash what is waiting in scope until it's done or `stop` says so, and take the results in. PermissionError if the volume changed;
        batches done before that are kept."""
        from ..functions.hashes import hashed

        store, base = self.store, self.store.latest()
        began, progress = volume(), Progress(0, 0, 0, self.queue(base, scope).count())
        while progress.attempted < progress.waiting and not stop():
            some = self.queue(base, scope).orderBy("id").limit(batch).select(*GUARD, "ext")
            met = some.join(self.contents(some), "path", "left")
            done = hashed(met).select(*GUARD, *HASHES[:3], F.lit(None).cast("string").alias("phash"), F.lit(float(now)).alias("hashed_at"), F.col("content").isNotNull().alias("read"))
            # counted while the batch is written, not by another scan
            seen = Observation()
            counted = done.observe(seen, F.count(F.lit(1)).alias("attempted"), F.count_if("read").alias("read"))
            path = store.put(counted, f"{store.root}/attempts/{uuid.uuid4().hex}/batch")
            if volume() != began:
                raise PermissionError("the volume isn't the one the run began on; the batch isn't taken")
            if not seen.get["attempted"]:
                break  # rows went meanwhile
            number = max([base.marks.get(MARK, 0), *store.folders(self.folder, "b")]) + 1
            store.move(path, f"{self.folder}/b{number:08d}")
            progress = Progress(progress.batches + 1, progress.attempted + seen.get["attempted"], progress.read + seen.get["read"], progress.waiting)
            report(progress)
        return self.take_in()

    def take_in(self) -> Generation:
        """The generation that has the results of all batches; they are cleared once it is published."""
        base = self.store.latest()
        if not (found := self.batches(base)):
            return base
        # by guard, the last attempt counts
        last = self.results(base).groupBy(*GUARD).agg(F.max_by(F.struct(*HASHES), "hashed_at").alias("x")).select(*GUARD, "x.*")
        made = self.store.update(lambda files: guarded_hash_write(files, last), {MARK: max(found)})
        for n in found:
            self.store.remove(f"{self.folder}/b{n:08d}")
        return made
