"""Published generations of the catalogue: its files, the words of their names and what was analysed, as one snapshot.

    root/attempts/<name>/...          what one writer wrote; nobody else writes there, and nothing in it ever changes
    root/generations/g<number>/pointer.json   which folders make up a generation

A writer starts from a generation, writes its tables into an attempt of its own and then renames a folder with the pointer to the
next number. The rename is what publishes: it is atomic, and only one can make a number, so of two writers one learns that it has
lost and starts again from what the other published. A writer that dies before the rename leaves an attempt that no pointer names;
readers never see it and the next writer takes the same number. Readers hold a pointer, so what they read stays as it was.
This asks for a file system whose rename of a folder is atomic (HDFS, local disks, most cloud file systems with folders); on plain
object stores let one writer at a time publish.

Dependent rows follow from comparing a generation with the one before by id, so they are right whichever operation made it: words of
names that went or changed are dropped and new ones added as a segment; analysis rows, and the words read from a file, go with the
file or as soon as its size or time changes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .index import FILES
from .postings import DROPPED, NAME, OCR, POSTINGS, joined, laid_out, words_of

ANALYSIS = "file_id long, ocr_text string, text_coverage double, top_labels string, has_faces int, feature_print binary, clip_embedding binary, analyzer_versions string, analyzed_at double"
MAX_SEGMENTS = 8


class LostRace(RuntimeError):
    """Another writer published this number first."""


@dataclass(frozen=True)
class Generation:
    """number 0 is the empty catalogue that no pointer names. segments: (folder of dropped rows or None, folder of added ones)."""

    number: int = 0
    owner: str = ""
    files: str | None = None
    analysis: str | None = None
    segments: list = field(default_factory=list)
    marks: dict = field(default_factory=dict)

    def folders(self) -> list[str]:
        return [x for x in (self.files, self.analysis, *(y for s in self.segments for y in s)) if x]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- the file system ---

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds of its last change) of what is in a folder."""
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self._fs.listStatus(at)]

    def _pointer(self, number: int) -> Generation | None:
        at = self._path(f"{self.root}/generations/g{number:08d}/pointer.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return Generation(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    # --- reading ---

    def numbers(self) -> list[int]:
        return self.folders(f"{self.root}/generations", "g")

    def latest(self) -> Generation:
        for number in reversed(self.numbers()):
            if found := self._pointer(number):
                return found
        return Generation()

    def at(self, number: int) -> Generation:
        found = Generation() if number == 0 else self._pointer(number)
        if found is None:
            raise LookupError(f"there is no generation {number}")
        return found

    def _read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if path is None else self.spark.read.schema(schema).parquet(path)

    def files(self, of: Generation) -> DataFrame:
        return self._read(of.files, FILES)

    def analysis(self, of: Generation) -> DataFrame:
        return self._read(of.analysis, ANALYSIS)

    def postings(self, of: Generation) -> DataFrame:
        if not of.segments:
            return self._read(None, POSTINGS)
        return joined([(None if dropped is None else self._read(dropped, DROPPED), self._read(added, POSTINGS)) for dropped, added in of.segments])

    # --- writing ---

    def publish(self, base: Generation, attempt: str, **tables) -> Generation:
        """Make base's next generation of what an attempt wrote. LostRace if another writer was first."""
        made = Generation(**(asdict(base) | tables | {"number": base.number + 1, "owner": attempt}))
        claim, target = f"{self.root}/attempts/{attempt}/claim", f"{self.root}/generations/g{made.number:08d}"
        out = self._fs.create(self._path(f"{claim}/pointer.json"), True)
        try:
            out.write(bytearray(json.dumps(asdict(made)).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.root}/generations"))
        if self._pointer(made.number) is None:
            # onto a folder that has come up meanwhile this moves into it or fails; either way the pointer in it isn't ours
            self._fs.rename(self._path(claim), self._path(target))
        won = self._pointer(made.number)
        if won is None:
            raise OSError(f"{target} could not be made")
        if won.owner != attempt:
            raise LostRace(f"generation {made.number} is {won.owner}'s")
        return made

    def folders(self, path: str, letter: str) -> list[int]:
        """Numbers of the folders <letter><number> in a folder."""
        return sorted(int(n[1:]) for n, _ in self._names(path) if n[:1] == letter and n[1:].isdigit())

    def put(self, df: DataFrame, path: str) -> str:
        df.write.parquet(path)
        return path

    def move(self, path: str, target: str) -> None:
        """A folder that is complete gets its name at once. LostRace if another one has it."""
        at = self._path(target)
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(self._path(path), at):
            raise LostRace(target)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _written(self, df: DataFrame, attempt: str, name: str) -> str:
        path = f"{self.root}/attempts/{attempt}/{name}"
        df.write.parquet(path)
        return path

    def commit(self, base: Generation, files: DataFrame, marks: dict | None = None, analysis: DataFrame | None = None) -> Generation:
        """The generation after base with these files. analysis: rows that replace those of the same file."""
        attempt = uuid.uuid4().hex
        made = {"marks": base.marks | (marks or {})}
        made["files"] = self._written(files.repartitionByRange("path").sortWithinPartitions("path"), attempt, "files")
        old = self.files(base).select(F.col("id").alias("o"), F.col("name").alias("old_name"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
        new = self._read(made["files"], FILES).select(F.col("id").alias("n"), "name", "size", "mtime")
        gone, fresh = F.col("n").isNull(), F.col("o").isNull()
        met = old.join(new, F.col("o") == F.col("n"), "full_outer").select(
            F.coalesce("n", "o").alias("id"), "name", gone.alias("gone"), fresh.alias("fresh"), (gone | fresh | (F.col("name") != F.col("old_name"))).alias("renamed"),
            (gone | (F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime"))).alias("stale"),
        )
        changes = self.spark.read.schema("id long, name string, gone boolean, fresh boolean, renamed boolean, stale boolean").parquet(
            self._written(met.filter(F.col("renamed") | F.coalesce("stale", F.lit(False))), attempt, "changes")
        )
        lost = changes.filter(~F.col("fresh") & F.col("stale")).select("id")
        dropped = [changes.filter(~F.col("fresh") & F.col("renamed")).select("id", F.lit(NAME).alias("field"))]
        added = [words_of(changes.filter(~F.col("gone") & F.col("renamed")), "name", NAME)]
        if base.analysis or analysis is not None:
            kept = self.analysis(base).join(lost.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
            dropped.append(lost.select("id", F.lit(OCR).alias("field")))
            if analysis is not None:
                known = analysis.join(self._read(made["files"], FILES).select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*kept.columns)
                kept = kept.join(known.select("file_id"), "file_id", "left_anti").unionByName(known)
                dropped.append(known.select(F.col("file_id").alias("id"), F.lit(OCR).alias("field")))
                added.append(words_of(known.select(F.col("file_id").alias("id"), "ocr_text"), "ocr_text", OCR))
            made["analysis"] = self._written(kept, attempt, "analysis")
        made["segments"] = self._segments(base, attempt, dropped, added)
        return self.publish(base, attempt, **made)

    def _segments(self, base: Generation, attempt: str, dropped: list[DataFrame], added: list[DataFrame]) -> list:
        every = lambda parts: parts[0] if len(parts) == 1 else every([parts[0].unionByName(parts[1]), *parts[2:]])
        more = self._written(laid_out(every(added)), attempt, "postings")
        if not base.segments:
            return [[None, more]]
        less = self._written(every(dropped).distinct(), attempt, "dropped")
        if self._read(less, DROPPED).isEmpty() and self._read(more, POSTINGS).isEmpty():
            return base.segments
        segments = [*base.segments, [less, more]]
        if len(segments) <= MAX_SEGMENTS:
            return segments
        whole = joined([(None if d is None else self._read(d, DROPPED), self._read(a, POSTINGS)) for d, a in segments])
        return [[None, self._written(laid_out(whole), attempt, "merged")]]

    def update(self, change: Callable[[DataFrame], DataFrame], marks: dict | None = None, tries: int = 5) -> Generation:
        """The next generation by a change of the files; begun again from the newest one where another writer was first."""
        for left in range(tries - 1, -1, -1):
            base = self.latest()
            try:
                return self.commit(base, change(self.files(base)), marks)
            except LostRace:
                if not left:
                    raise
        raise AssertionError

    def rebuild(self) -> Generation:
        """An empty generation after a broken one: the catalogue only repeats what walks find."""
        attempt = uuid.uuid4().hex
        return self.publish(Generation(number=self.latest().number), attempt)

    def clear(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Remove attempts that none of the newest `keep` generations names and that are older than so many seconds, and older
        pointers. Readers of older generations must be done by then. Returns the attempts removed."""
        numbers = self.numbers()
        kept = [g for g in map(self._pointer, numbers[-keep:]) if g]
        named, removed = {part for g in kept for x in g.folders() for part in x.split("/")} | {g.owner for g in kept}, []
        before = time.time() - older_than
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/generations/g{number:08d}"), True)
        for name, changed in self._names(f"{self.root}/attempts"):
            if name not in named and changed <= before:
                self._fs.delete(self._path(f"{self.root}/attempts/{name}"), True)
                removed.append(name)
        return removed
