"""Upkeep of the catalogue: pure transforms from one generation of the index to the next.

The index is an immutable table per generation; a single writer makes the next one. Columns: FILES.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from .search import scope_filter
from .staging import written

#: Places that are sent to all tasks.
FEW_PLACES = 20_000

FILES = (
    "id long, path string, parent_dir string, name string, ext string, size long, mtime double, device long, inode long, volume_uuid string, width int, height int, capture_time double, capture_offset string, "
    "camera_make string, camera_model string, orientation int, content_hash string, image_hash string, image_hash_kind string, phash string, hashed_at double, indexed_at double"
)
COLUMNS = [x.split()[0] for x in FILES.split(", ")]
HASHES = ("content_hash", "image_hash", "image_hash_kind", "phash", "hashed_at")
SCALARS = ("parent_dir", "name", "ext", "size", "mtime", "device", "inode", "width", "height", "capture_time", "capture_offset", "camera_make", "camera_model", "orientation", "indexed_at")


def migrated(files: DataFrame) -> DataFrame:
    """A table of an older generation with the columns that came later, null and not filled in."""
    kinds = dict(x.split() for x in FILES.split(", "))
    return files.withColumns({c: F.lit(None).cast(kinds[c]) for c in COLUMNS if c not in files.columns}).select(*COLUMNS)


def needs_reindex(walked: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state): walked files that are new or whose size or exact mtime differ."""
    old = index.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    met = walked.select("path", "size", "mtime").join(old, "path", "left")
    state = F.when(F.col("known").isNull(), "new").when((F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime")), "changed").otherwise("fresh")
    return met.select("path", state.alias("state"))


def diff(walked: DataFrame, index: DataFrame) -> DataFrame:
    """(path, change): insert, update, unchanged or delete, by a full outer join on the path."""
    new = walked.select("path", F.col("size").alias("ns"), F.col("mtime").alias("nm"), F.lit(True).alias("n"))
    old = index.select("path", F.col("size").alias("os"), F.col("mtime").alias("om"), F.lit(True).alias("o"))
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when((F.col("ns") != F.col("os")) | (F.col("nm") != F.col("om")), "update").otherwise("unchanged")
    return new.join(old, "path", "full_outer").select("path", change.alias("change"))


def upsert(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """index with incoming rows merged by path.

    Ids stay. Scalars are overwritten; volume_uuid only by a value. If size or mtime changed, hashes go; else the old ones
    stay, whatever comes in. New rows keep the hashes they bring and get ids after the largest, by path.
    """
    old = index.select(*[F.col(c).alias("o_" + c) for c in COLUMNS])
    new = incoming.select(*[F.col(c).alias("n_" + c) for c in COLUMNS if c != "id"])
    met = old.join(new, F.col("o_path") == F.col("n_path"), "full_outer")
    both = F.col("o_path").isNotNull() & F.col("n_path").isNotNull()
    changed = (F.col("o_size") != F.col("n_size")) | (F.col("o_mtime") != F.col("n_mtime"))
    out = {"id": F.col("o_id"), "path": F.coalesce("o_path", "n_path"), "volume_uuid": F.coalesce("n_volume_uuid", "o_volume_uuid")}
    out |= {c: F.when(F.col("n_path").isNotNull(), F.col("n_" + c)).otherwise(F.col("o_" + c)) for c in SCALARS}
    out |= {c: F.when(both & changed, F.lit(None)).when(F.col("o_path").isNotNull(), F.col("o_" + c)).otherwise(F.col("n_" + c)) for c in HASHES}
    merged = met.select(*[out[c].alias(c) for c in COLUMNS])
    return with_new_ids(merged, index)


def with_new_ids(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Ids for rows without one: after the index's largest, in the order of paths."""
    from .duplicates import group_numbers

    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = group_numbers(rows.filter("id is null").select(F.col("path").alias("fresh_path")), "fresh_path", "nth").crossJoin(F.broadcast(top))  # top is one row
    out = rows.join(fresh, rows["path"] == fresh["fresh_path"], "left")
    return out.select(F.coalesce("id", F.col("top") + F.col("nth")).cast("long").alias("id"), *COLUMNS[1:])


GUARD = ("id", "path", "size", "mtime")


def guarded(index: DataFrame, writes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """index with columns taken from writes where id, path, size and mtime all still agree; nulls are written too."""
    new = writes.select(*[F.col(c).alias("g_" + c) for c in GUARD], *[F.col(c).alias("w_" + c) for c in columns])
    same = [F.col(c) == F.col("g_" + c) for c in GUARD]
    met = index.join(new, same[0] & same[1] & same[2] & same[3], "left")
    return met.select(*[F.when(F.col("g_id").isNotNull(), F.col("w_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in COLUMNS])


def guarded_hash_write(index: DataFrame, writes: DataFrame) -> DataFrame:
    return guarded(index, writes, HASHES)


def refused(index: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes that find no row that still agrees."""
    return writes.join(index.select(*GUARD), list(GUARD), "left_anti")


METADATA = ("width", "height", "capture_time", "capture_offset", "camera_make", "camera_model", "orientation")


def metadata_write_back(index: DataFrame, writes: DataFrame) -> DataFrame:
    """Guarded by the row as it was: new stat facts (new_size, new_mtime, new_inode), metadata and hashes; phash stays."""
    columns = (*METADATA, "content_hash", "image_hash", "image_hash_kind", "hashed_at")
    facts = ("size", "mtime", "inode")
    new = writes.select(*[F.col(c).alias("g_" + c) for c in GUARD], *[F.col("new_" + c).alias("w_" + c) for c in facts], *[F.col(c).alias("w_" + c) for c in columns])
    same = [F.col(c) == F.col("g_" + c) for c in GUARD]
    met = index.join(new, same[0] & same[1] & same[2] & same[3], "left")
    return met.select(*[F.when(F.col("g_id").isNotNull(), F.col("w_" + c)).otherwise(F.col(c)).alias(c) if c in (*columns, *facts) else F.col(c) for c in COLUMNS])


def volume_stamp(index: DataFrame, paths: DataFrame, uuid: str | None, device: int) -> DataFrame:
    """index with the volume on the given paths; a null uuid keeps what is there. Column changed tells which rows differ."""
    hit = paths.select(F.col("path").alias("p"), F.lit(True).alias("hit")).distinct()
    stamped = F.coalesce(F.lit(uuid).cast("string"), F.col("volume_uuid"))
    change = F.coalesce(F.col("hit"), F.lit(False)) & (~F.col("volume_uuid").eqNullSafe(stamped) | (F.col("device") != device))
    met = index.join(hit, F.col("path") == F.col("p"), "left").withColumn("changed", change)
    return met.select(*[F.when(F.col("changed"), stamped).otherwise(F.col(c)).alias(c) if c == "volume_uuid" else F.when(F.col("changed"), F.lit(device)).otherwise(F.col(c)).alias(c) if c == "device" else F.col(c) for c in COLUMNS], "changed")


def on_volume(uuid: str | None, device: int | None) -> Column:
    """Rows of a volume: by uuid, or by device where the row has no uuid. Three-valued: a null uuid matches no stamped row."""
    if device is None:
        return F.lit(True)
    by_device = F.col("volume_uuid").isNull() & (F.col("device") == device)
    return by_device if uuid is None else (F.col("volume_uuid") == uuid) | by_device


def same_volume(uuid: Column, device: Column, now_uuid: Column, now_device: Column) -> Column:
    return F.when(uuid.isNotNull(), uuid.eqNullSafe(now_uuid)).otherwise(device == now_device)


def stale(index: DataFrame, keeping: DataFrame, scope, uuid: str | None = None, device: int | None = None) -> DataFrame:
    """Rows in scope and on the volume whose path isn't kept."""
    return index.filter(scope_filter(scope) & F.coalesce(on_volume(uuid, device), F.lit(False))).join(keeping.select("path").distinct(), "path", "left_anti")


def prune(index: DataFrame, keeping: DataFrame, scope, uuid: str | None = None, device: int | None = None) -> DataFrame:
    return index.join(stale(index, keeping, scope, uuid, device).select("path"), "path", "left_anti")


def ancestors(path: Column) -> Column:
    """The path and all directories above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def component_key(path: Column) -> Column:
    """The path with one slash at its end: of two paths, one is at or under the other if its key begins with the other's."""
    return F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))


def disjoint(places: DataFrame) -> DataFrame:
    """(key) of the places (one column, path) that aren't under another one."""
    own = places.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    own = own.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    above = own.select("path", F.explode(ancestors(F.col("path"))).alias("above")).filter(F.col("above") != F.col("path"))
    nested = above.join(own.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return own.join(nested, "path", "left_anti").select(component_key(F.col("path")).alias("key"))


def at_or_under(rows: DataFrame, places: DataFrame, few: int = FEW_PLACES) -> DataFrame:
    """rows at or under any of the places (one column, path), by whole components.

    Places that aren't under one another are disjoint ranges of keys, so a row is in one of them at most. Up to `few` of them are sent to
    all tasks, and rows look up their own beginnings of the depths that places have, without moving. More of them are ranges that
    rows join by order: both are range-partitioned and sorted by key, and the last place before a row is the one that may cover it.
    """
    found = written(disjoint(places), "places")
    if found.limit(few + 1).count() <= few:
        depths = [r[0] for r in found.select(F.size(F.split("key", "/")).alias("n")).distinct().orderBy("n").collect()]  # of path components
        if not depths:
            return rows.limit(0)
        start = lambda n: F.concat(F.array_join(F.slice(F.split(component_key(F.col("path")), "/"), 1, n - 1), "/"), F.lit("/"))
        own = F.array_distinct(F.array(*[start(n) for n in depths]))  # shorter paths come out alike for several depths
        return rows.withColumn("__start", F.explode(own)).join(F.broadcast(found.withColumnRenamed("key", "__start")), "__start", "left_semi").select(*rows.columns)
    return in_ranges(rows, found)


def in_ranges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows whose key begins with one of the disjoint keys. Each row moves once, to its range; a place goes to all ranges it reaches into."""
    key = component_key(F.col("path"))
    ranges = rows.select(key.alias("key")).repartitionByRange("key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low"))
    bounds = sorted(r.low for r in ranges.collect())[1:]  # a key for each range
    range_of = lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)) if bounds else F.lit(0)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    inner = rows.withColumns({"__part": range_of(key), "__key": key, "__row": F.lit(True)})
    # the byte after the slash ends a place's keys
    past = F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("0"))
    places = found.select(*none, F.explode(F.sequence(range_of(F.col("key")), range_of(past))).alias("__part"), F.col("key").alias("__key"), F.lit(False).alias("__row"))
    laid = inner.unionByName(places).repartition(len(bounds) + 1, "__part").sortWithinPartitions("__part", "__key", "__row")
    names = rows.columns

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place = None
        for b in batches:
            hit = []
            for part, k, is_row in zip(*(b.column(len(names) + i).to_pylist() for i in range(3))):
                if part != at:
                    at, place = part, None
                place = place if is_row else k
                hit.append(is_row and place is not None and k.startswith(place))
            yield b.filter(pa.array(hit, pa.bool_())).select(names)

    return laid.mapInArrow(covered, rows.schema)


def reconcile(index: DataFrame, walked: DataFrame, skipped: DataFrame, scope, uuid: str | None, device: int, volume_before: tuple, volume_after: tuple, root_readable: bool = True) -> tuple[DataFrame, DataFrame]:
    """A tier-0 pass: (next index, metrics of one row).

    A row goes only on evidence of a complete look at its place: rows at or under a skipped place stay, and nothing goes
    unless the root was read and the volume is the same before and after. What is new or changed is found once, by a job that counts
    while it writes; metrics are its counts, not another scan.
    """
    if not root_readable:
        raise PermissionError("the root can't be read; nothing is pruned")
    seen = Observation()
    state = written(needs_reindex(walked, index).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "fresh").alias("completed")), "state")
    changed = walked.join(state.filter("state != 'fresh'").select("path"), "path", "left_semi")
    merged = upsert(index, changed)
    stamped = volume_stamp(merged, walked.select("path"), uuid, device)
    following = stamped.drop("changed")
    protected = at_or_under(following.select("path"), skipped.select("path"))
    keeping = walked.select("path").unionByName(protected.select("path"))
    same = volume_before == volume_after
    final = prune(following, keeping, scope, uuid, device) if same else following
    counted = skipped.agg(F.count("*").alias("skipped")).select(F.lit(seen.get["total"]).cast("long").alias("total"), F.lit(seen.get["completed"]).cast("long").alias("completed"), F.lit(0).alias("failed"), "skipped")
    done = F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0)
    return final, counted.withColumn("fraction", done)


def hash_results(queue: DataFrame, hashed: DataFrame, now: float) -> DataFrame:
    """Writes of a hashing pass: every queued row was attempted, whether or not hashes came out. hashed: id and hashes."""
    got = hashed.select(F.col("id").alias("hid"), *[F.col(c).alias("h_" + c) for c in HASHES[:-1]])
    return queue.join(got, F.col("id") == F.col("hid"), "left").select(*GUARD, *[F.col("h_" + c).alias(c) for c in HASHES[:-1]], F.lit(float(now)).alias("hashed_at"))


def hashing_pass(index: DataFrame, contents: DataFrame, scope, now: float, volume_before: tuple, volume_after: tuple) -> tuple[DataFrame, DataFrame]:
    """A tier-1 pass over the rows in scope that hashing was never attempted on: (next index, metrics of one row).

    contents: path, content (null if it can't be read). A row is marked as attempted whether or not hashes came out, so it isn't
    read again until its size or mtime changes; what the pass didn't reach stays in the queue, and the next pass takes it.
    Nothing is written unless the volume is the same before and after, as an absent one would mark every file as attempted.
    Metrics: total, completed (read), failed.
    """
    from ..functions.hashes import hashed

    if volume_before != volume_after:
        raise PermissionError("the volume isn't the one the pass began on; nothing is marked as attempted")
    queue = index.filter(F.col("hashed_at").isNull() & scope_filter(scope)).select(*GUARD, "ext")
    met = queue.join(contents.select("path", "content"), "path", "left")
    done = hashed(met).select("id", *HASHES[:3], F.lit(None).cast("string").alias("phash"), F.col("content").isNotNull().alias("read"))
    metrics = done.agg(F.count("*").alias("total"), F.count_if("read").alias("completed"), F.count_if(~F.col("read")).alias("failed"))
    return guarded_hash_write(index, hash_results(queue, done, now)), metrics


def write_generation(index: DataFrame, root: str, generation: int) -> str:
    """The rows of a generation in a directory of its own, ordered by path so that statistics prune scopes. Returns the directory.
    `store.Store` publishes them."""
    path = f"{root}/v{generation:08d}"
    index.repartitionByRange("path").sortWithinPartitions("path").write.parquet(path)
    return path


def integrity(index: DataFrame) -> DataFrame:
    """One row: whether ids and paths are unique and required columns filled."""
    required = ("id", "path", "parent_dir", "name", "ext", "size", "mtime", "device", "inode", "indexed_at")
    bad = sum((F.count_if(F.col(c).isNull()) for c in required), F.lit(0))
    twice = lambda c: index.groupBy(c).count().filter("count > 1").agg(F.count("*").alias("twice_" + c))
    out = index.agg(bad.alias("nulls")).crossJoin(F.broadcast(twice("id"))).crossJoin(F.broadcast(twice("path")))  # one row each
    return out.withColumn("ok", (F.col("nulls") == 0) & (F.col("twice_id") == 0) & (F.col("twice_path") == 0))
