"""A walk of a mounted tree, level by level: each round lists the directories that the one before found, in tasks.

A directory is known by device and inode. Of those found in a round, each identity is entered once, by its first path, and not at all
if an earlier round entered it; the others are reported as loops, which only followed links can make. What a task can't look at is
reported as skipped, so that nobody takes it for deleted; a file that is gone between listing and looking is no entry at all. Rounds
are as many as the tree is deep. All executors must see the tree under the same path.

Entries and skipped places are what `index.reconcile` takes.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.index import migrated
from ..operators.staging import written
from .media import MEDIA, OPAQUE
from .walk import split_path

SEEN = "kind string, path string, size long, mtime double, device long, inode long, note string"
#: Rows of a directory that leave its task at once.
BATCH = 10_000


def ending(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return last.lower() if dot and stem else ""


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def seen(kind: str, path: str, st: os.stat_result | None = None, note: str | None = None) -> tuple:
    if st is None:
        return kind, path, None, None, None, None, note
    seconds, rest = divmod(st.st_mtime_ns, 10**9)
    return kind, path, st.st_size, seconds + rest / 1e9, signed(st.st_dev), signed(st.st_ino), note


def identified(path: str) -> tuple:
    """A directory's own row, or why it isn't entered."""
    try:
        st = os.stat(path)
    except OSError:
        return seen("skipped", path, note="unreadable")
    return seen("dir", path, st) if stat.S_ISDIR(st.st_mode) else seen("skipped", path, note="unreadable")


def listed(path: str, recursive: bool, follow: bool) -> Iterator[tuple]:
    """What is in a directory: media files, directories to enter (of links, what they lead to), places that couldn't be looked at."""
    try:
        names = os.listdir(path)
    except OSError:
        yield seen("skipped", path, note="unreadable")
        return
    for name in names:
        if name.startswith(".") or name == "Icon\r":
            continue
        child = os.path.join(path, name)
        try:
            child.encode()
        except UnicodeEncodeError:  # a name that isn't text has no row
            yield seen("skipped", child.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), note="unstatable")
            continue
        try:
            st = os.lstat(child)
            if stat.S_ISLNK(st.st_mode):
                if not follow:
                    continue
                st = os.stat(child)
        except OSError as e:
            if e.errno != errno.ENOENT:
                yield seen("skipped", child, note="unstatable")
            continue
        if stat.S_ISDIR(st.st_mode):
            if recursive and ending(name) not in OPAQUE:
                yield seen("dir", child, st)
        elif stat.S_ISREG(st.st_mode) and (media := MEDIA.get(ending(name))):
            yield seen("file", child, st, media)


def rows_of(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in SEEN.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for row in found:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def scan(spark: SparkSession, root: str, recursive: bool = True, follow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): path, size, mtime, device, inode, media of the media files below root; path and reason of what wasn't looked at.

    Junk names, opaque bundles and, unless they are followed, links are left out without a report, as in a listing.
    """

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows_of(identified(p) for b in batches for p in b.column(0).to_pylist())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows_of(x for b in batches for p in b.column(0).to_pylist() for x in listed(p, recursive, follow))

    root = root.rstrip("/") or "/"
    level = written(spark.createDataFrame([(root,)], "path string").mapInArrow(identify, SEEN), "walk")
    levels, entered = [level], None
    while not (dirs := level.filter("kind = 'dir'")).isEmpty():
        first = dirs.groupBy("device", "inode").agg(F.min("path").alias("path"))
        fresh = first if entered is None else first.join(entered, ["device", "inode"], "left_anti")
        fresh = written(fresh, "entered")
        loops = dirs.join(fresh.select("path"), "path", "left_anti").withColumns({"kind": F.lit("skipped"), "note": F.lit("symlinkLoop")})
        levels.append(loops)
        entered = fresh.select("device", "inode") if entered is None else written(entered.unionByName(fresh.select("device", "inode")), "entered")
        # directories are dealt out anew each round, as one may hold most of the next
        level = written(fresh.select("path").repartition("path").mapInArrow(look, SEEN), "walk")
        levels.append(level)
    everything = levels[0]
    for more in levels[1:]:
        everything = everything.unionByName(more)
    entries = everything.filter("kind = 'file'").select("path", "size", "mtime", "device", "inode", F.col("note").alias("media"))
    return entries, everything.filter("kind = 'skipped'").select("path", F.col("note").alias("reason"))


def catalogued(entries: DataFrame, now: float) -> DataFrame:
    """Entries as rows that an upsert takes; what only reading a file tells is null."""
    parts = split_path(F.col("path"))
    rows = entries.select("path", "size", "mtime", "device", "inode", *[parts[c].alias(c) for c in ("parent_dir", "name", "ext")], F.lit(float(now)).alias("indexed_at"))
    return migrated(rows.withColumn("id", F.lit(None).cast("long")))


