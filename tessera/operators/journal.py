"""The journal of file operations: latest state, undo, retention, reconcile, planning. All as queries over rows.

Columns: op_id long, batch_id string, kind string, src string, dst string, trash_url string, timestamp double, state string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.media import JPEG, RAW, SIDECARS
from .index import COLUMNS, HASHES, upsert

# Fixed values.
KINDS = ("move", "copy", "trash", "delete")
STATES = ("in_flight", "complete", "failed", "skipped", "reconciled")
KEEP_DAYS, KEEP_BATCHES, MTIME_SLACK = 30, 200, 2.0


def decoded(journal: DataFrame) -> DataFrame:
    """Rows whose kind and state are known; others are dropped."""
    return journal.filter(F.col("kind").isin(*KINDS) & F.col("state").isin(*STATES))


def append(journal: DataFrame, drafts: DataFrame) -> DataFrame:
    """journal with a row in flight for each draft (nth, batch_id, kind, src, dst, timestamp), op_ids in the drafts' order."""
    top = journal.agg(F.coalesce(F.max("op_id"), F.lit(0)).alias("top"))
    new = drafts.crossJoin(F.broadcast(top))  # one row
    return journal.unionByName(new.select((F.col("top") + F.col("nth")).alias("op_id"), "batch_id", "kind", "src", "dst", F.lit(None).cast("string").alias("trash_url"), "timestamp", F.lit("in_flight").alias("state")))


def of_batch(journal: DataFrame, batch_id: str) -> DataFrame:
    return decoded(journal).filter(F.col("batch_id") == batch_id).orderBy("op_id")


def in_state(journal: DataFrame, state: str) -> DataFrame:
    return decoded(journal).filter(F.col("state") == state).orderBy("op_id")


def latest_batch(journal: DataFrame) -> DataFrame:
    """One row, batch_id: the batch of the largest op_id."""
    return journal.agg(F.max_by("batch_id", "op_id").alias("batch_id"))


def outcome_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("batch_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def is_aside(row_kind: str = "kind") -> Column:
    """A replaced file that was moved out of the way: a trash row with a destination."""
    return (F.col(row_kind) == "trash") & F.col("dst").isNotNull()


def undoability(journal: DataFrame) -> DataFrame:
    """(batch_id, kind, items, refusal) for each batch. A batch's kind is that of its first row that isn't set aside."""
    rows = decoded(journal)
    n = lambda s: F.count_if(F.col("state") == s)
    out = rows.groupBy("batch_id").agg(
        F.min_by("kind", F.when(~is_aside(), F.col("op_id"))).alias("kind"), n("complete").alias("items"), F.count_if(F.col("kind") == "delete").alias("deletes"), n("in_flight").alias("open"), n("reconciled").alias("reconciled"), n("failed").alias("failed"),
    )
    refusal = (
        F.when(F.col("deletes") > 0, "permanentDelete").when(F.col("open") > 0, F.concat(F.lit("unsettled("), F.col("open"), F.lit(")"))).when(F.col("reconciled") > 0, "reconciled").when(F.col("failed") > 0, "failed").when(F.col("items") == 0, "nothingToUndo")
    )
    return out.select("batch_id", "kind", "items", refusal.alias("refusal"))


def undo_steps(journal: DataFrame) -> DataFrame:
    """(batch_id, op_id, action, source, target): what undoes complete rows, last first within a batch."""
    rows = decoded(journal).filter("state = 'complete'")
    action = F.when(F.col("kind") == "move", "move").when(F.col("kind") == "copy", "trash").when(F.col("kind") == "trash", "restore")
    source = F.when(F.col("kind").isin("move", "copy"), F.col("dst")).when(F.col("kind") == "trash", F.coalesce("trash_url", "dst"))
    target = F.when(F.col("kind").isin("move", "trash"), F.col("src"))
    out = rows.select("batch_id", "op_id", action.alias("action"), source.alias("source"), target.alias("target")).filter("action is not null")
    return out.orderBy("batch_id", F.col("op_id").desc())


def undo_checks(steps: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """steps with a problem, if any: source gone, changed since, target taken. facts: path, size, mtime of what is there."""
    here = facts.select(F.col("path").alias("fp"), F.col("size").alias("fs"), F.col("mtime").alias("fm"))
    known = files.select(F.col("path").alias("kp"), F.col("size").alias("ks"), F.col("mtime").alias("km"))
    taken = facts.select(F.col("path").alias("tp"), F.lit(True).alias("taken"))
    met = steps.join(here, F.col("source") == F.col("fp"), "left").join(known, F.col("source") == F.col("kp"), "left").join(taken, F.col("target") == F.col("tp"), "left")
    gone = F.when(F.col("action") == "restore", "trashEmptied").otherwise("sourceVanished")
    problem = F.when(F.col("fp").isNull(), gone).when(F.col("kp").isNotNull() & ((F.col("ks") != F.col("fs")) | (F.col("km") != F.col("fm"))), "modifiedSinceOperation").when(F.col("taken"), "destinationNotReplaceable")
    return met.select(*steps.columns, problem.alias("problem"))


def retained(journal: DataFrame, now: float) -> DataFrame:
    """journal without settled rows of batches that are older than KEEP_DAYS (but for the newest batch) or beyond KEEP_BATCHES."""
    batches = journal.groupBy("batch_id").agg(F.max("timestamp").alias("at"))
    # the newest are a top-k, so no task ranks all batches
    newest = batches.orderBy(F.col("at").desc(), F.col("batch_id").desc()).limit(KEEP_BATCHES)
    ranked = newest.withColumn("rn", F.row_number().over(Window.orderBy(F.col("at").desc(), F.col("batch_id").desc())))
    kept = ranked.filter((F.col("rn") == 1) | (F.col("at") >= now - KEEP_DAYS * 86400)).select(F.col("batch_id").alias("kept"))
    met = journal.join(F.broadcast(kept), F.col("batch_id") == F.col("kept"), "left")  # at most KEEP_BATCHES rows
    return met.filter((F.col("state") == "in_flight") | F.col("kept").isNotNull()).drop("kept")


def conclusions(journal: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """(op_id, conclusion, correction, claimed_by) for rows in flight, by the decision table.

    facts: path, size, mtime, inode of what exists now. Corrections: drop_src, drop_dst, drop_both, move_row, insert_dst.
    The first claim of a destination, in op_id order, wins; a losing row says whose it is and corrects nothing.
    """
    rows = decoded(journal).filter("state = 'in_flight'").select("op_id", "kind", "src", "dst", "trash_url")

    def side(df: DataFrame, key: str, p: str, *cols: str) -> tuple[DataFrame, Column]:
        return df.select(F.col("path").alias(p + "_path"), *[F.col(c).alias(f"{p}_{c}") for c in cols]), F.col(key) == F.col(p + "_path")

    met = rows
    for df, key, p in ((facts, "src", "fs"), (facts, "dst", "fd"), (files, "src", "is"), (files, "dst", "id"), (facts, "trash_url", "ft")):
        other, on = side(df, key, p, "size", "mtime", "inode")
        met = met.join(other, on, "left")
    there = lambda p: F.col(p + "_path").isNotNull()
    off = lambda a, b: (F.col(a + "_size") != F.col(b + "_size")) | (F.abs(F.col(a + "_mtime") - F.col(b + "_mtime")) > MTIME_SLACK)
    stale = lambda i, f: there(i) & (~there(f) | (F.col(i + "_inode") != F.col(f + "_inode")) | (F.col(i + "_size") != F.col(f + "_size")) | (F.col(i + "_mtime") != F.col(f + "_mtime")))
    src, dst, row, dst_row = there("fs"), there("fd"), there("is"), there("id")
    drop_src = F.when(stale("is", "fs"), "drop_src")
    both_gone = F.when(stale("is", "fs") & stale("id", "fd"), "drop_both").when(stale("is", "fs"), "drop_src").when(stale("id", "fd"), "drop_dst")
    nothing = F.lit(None).cast("string")
    insert = F.when(~dst_row, "insert_dst")
    differs = "destinationDiffersFromTheSource"
    table = [
        (F.col("kind").isin("move", "copy") & F.col("dst").isNull(), "malformed", nothing),
        ((F.col("kind") == "move") & src & ~dst, "neverHappened", nothing),
        ((F.col("kind") == "move") & ~src & dst & ~row, "happened", nothing),
        ((F.col("kind") == "move") & ~src & dst & off("is", "fd"), differs, drop_src),
        ((F.col("kind") == "move") & ~src & dst & dst_row, "happened", drop_src),
        ((F.col("kind") == "move") & ~src & dst, "happened", F.lit("move_row")),
        ((F.col("kind") == "move") & src & dst & ~row, "copyDoneDeleteNot", nothing),
        ((F.col("kind") == "move") & src & dst & off("is", "fd"), differs, nothing),
        ((F.col("kind") == "move") & src & dst, "copyDoneDeleteNot", insert),
        (F.col("kind") == "move", "goneFromBoth", both_gone),
        ((F.col("kind") == "copy") & ~dst, "neverHappened", nothing),
        ((F.col("kind") == "copy") & ~row, "happened", nothing),
        ((F.col("kind") == "copy") & off("is", "fd"), differs, nothing),
        (F.col("kind") == "copy", "happened", insert),
        (is_aside() & dst, "inStash", drop_src),
        (is_aside() & there("ft"), "inTrash", drop_src),
        ((F.col("kind") == "trash") & src, "neverHappened", drop_src),
        ((F.col("kind") == "trash") & F.col("dst").isNull() & F.col("trash_url").isNotNull(), "inTrash", drop_src),
        (F.col("kind") == "trash", "trashedUnderAnUnknownName", drop_src),
        (src, "neverHappened", drop_src),
    ]
    said, fix = F.lit("happened"), drop_src
    for test, word, correction in reversed(table):
        said, fix = F.when(test, word).otherwise(said), F.when(test, correction).otherwise(fix)
    decided = met.select("op_id", "dst", said.alias("conclusion"), fix.alias("correction"))
    claims = F.col("correction").isin("move_row", "insert_dst")
    first = decided.filter(claims).groupBy("dst").agg(F.min("op_id").alias("winner"))
    out = decided.join(first.withColumnRenamed("dst", "claimed"), claims & (F.col("dst") == F.col("claimed")), "left")
    lost = F.coalesce(F.col("winner") < F.col("op_id"), F.lit(False))
    return out.select("op_id", F.when(lost, "destinationClaimedByAnotherRow").otherwise(F.col("conclusion")).alias("conclusion"), F.when(~lost, F.col("correction")).alias("correction"), F.when(lost, F.col("winner")).alias("claimed_by"))


def reconcile_summary(journal: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: examined, reconciled, unresolved, corrections, disposition."""
    out = decided.agg(F.count("*").alias("examined"), F.count_if(F.col("conclusion") != "malformed").alias("reconciled"), F.count_if(F.col("conclusion") == "malformed").alias("unresolved"), F.count("correction").alias("corrections"))
    return out.withColumn("disposition", F.when(F.col("examined") == 0, "emptyJournal").otherwise("done"))


def settled(journal: DataFrame, decided: DataFrame) -> DataFrame:
    """journal with examined rows reconciled; malformed ones stay in flight."""
    done = decided.filter("conclusion != 'malformed'").select(F.col("op_id").alias("done"))
    return journal.join(done, F.col("op_id") == F.col("done"), "left").withColumn("state", F.when(F.col("done").isNotNull(), "reconciled").otherwise(F.col("state"))).drop("done")


def companions(files: DataFrame, selected: DataFrame) -> DataFrame:
    """(path, companion): sidecars, and the raw file of a JPEG or the other way, beside selected files of the same stem."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""))
    kind = F.when(F.col("ext").isin(*RAW), "raw").when(F.col("ext").isin(*JPEG), "jpeg").when(F.col("ext").isin(*SIDECARS), "sidecar")
    own = files.join(selected.select("path").distinct(), "path", "left_semi").select(F.col("path"), "parent_dir", stem(F.col("name")).alias("stem"), kind.alias("kind"))
    rest = files.join(selected.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("companion"), "parent_dir", stem(F.col("name")).alias("stem"), kind.alias("other"))
    met = own.join(rest, ["parent_dir", "stem"])
    fits = (F.col("other") == "sidecar") | ((F.col("kind") == "raw") & (F.col("other") == "jpeg")) | ((F.col("kind") == "jpeg") & (F.col("other") == "raw"))
    return met.filter(F.coalesce(fits, F.lit(False))).select("path", "companion")


def distinct_sources(drafts: DataFrame) -> DataFrame:
    """drafts (nth, src, ...) with the first of each source."""
    first = drafts.groupBy("src").agg(F.min("nth").alias("nth"))
    return drafts.join(first, ["src", "nth"], "left_semi")


def collisions(plan: DataFrame, occupants: DataFrame, moving: bool = True) -> DataFrame:
    """plan (nth, src, dst_dir, name[, resolution]) with collision: claimedInBatch, occupied, or null.

    Names are compared lower-cased. An item claims its name if nothing is in its way, or if it replaces what is there; one that is
    skipped, renamed or not resolved yet claims nothing. After the first claim all further items collide with it. A file that
    moves within its directory may keep its own name, whoever has it. Names that renaming deals out are `resolve`'s.
    occupants: parent_dir, name.
    """
    low = F.lower(F.col("name"))
    taken = occupants.groupBy(F.col("parent_dir").alias("dst_dir"), F.lower("name").alias("low")).agg(F.min("name").alias("taken"))
    own = F.lit(moving) & (F.regexp_replace("src", r"/[^/]*$", "") == F.col("dst_dir")) & (F.lower(F.substring_index("src", "/", -1)) == F.col("low"))
    wish = F.coalesce(F.col("resolution"), F.lit("")) if "resolution" in plan.columns else F.lit("")
    met = plan.withColumn("low", low).join(taken, ["dst_dir", "low"], "left").withColumn("own", F.coalesce(own, F.lit(False)))
    claims = F.col("own") | F.col("taken").isNull() | (wish == "replace")
    first = met.filter(claims).groupBy("dst_dir", "low").agg(F.min("nth").alias("first"))
    kind = F.when(F.col("own"), F.lit(None)).when(F.col("first") < F.col("nth"), "claimedInBatch").when(F.col("taken").isNotNull(), "occupied")
    return met.join(first, ["dst_dir", "low"], "left").select(*plan.columns, kind.alias("collision"))


RESOLVED = "nth long, effective string, collisions array<string>, destinations array<string>, stashes array<string>"


def resolve(plan: DataFrame, occupants: DataFrame, batch: str, moving: bool = True) -> DataFrame:
    """What becomes of each item: (nth, effective, collisions, destinations, stashes).

    plan: nth, dst_dir, srcs (the image first, then its companions, which have its stem), resolution (skip, rename, replace or
    null). All names of an item take one suffix, the least from 2 on with which all are free. `replace` moves aside what is on
    disk; where this batch has claimed a name there is nothing to move, and the item is renamed. Items whose names compete are
    one family: a destination and a stem without its trailing numbers; they are decided in order, one by one.
    """
    stem = F.regexp_replace(F.lower(F.substring_index(F.col("srcs")[0], "/", -1)), r"(?<=.)\.[^.]*$", "")
    bare = lambda c: F.regexp_replace(c, r"( ([2-9]|[1-9]\d+))+$", "")
    items = plan.select("dst_dir", bare(stem).alias("family"), "nth", "srcs", "resolution", F.lit(None).cast("string").alias("there"))
    o_stem = F.regexp_replace(F.lower("name"), r"(?<=.)\.[^.]*$", "")
    busy = occupants.select(F.col("parent_dir").alias("dst_dir"), bare(o_stem).alias("family"), F.lit(None).cast("long").alias("nth"), F.lit(None).cast("array<string>").alias("srcs"), F.lit(None).cast("string").alias("resolution"), F.col("name").alias("there"))
    busy = busy.join(items.select("dst_dir", "family").distinct(), ["dst_dir", "family"], "left_semi")

    def decide(key, pdf):
        import pandas as pd

        real = {x.lower(): x for x in sorted(pdf["there"].dropna())}
        claimed: set[str] = set()
        least: dict[tuple, int] = {}  # names are never given back, so a search goes on where the last one ended
        out = []
        for r in pdf[pdf["there"].isna()].sort_values("nth").itertuples():
            names = [x.rsplit("/", 1)[-1] for x in r.srcs]
            own = {n.lower() for x, n in zip(r.srcs, names, strict=True) if moving and x.rsplit("/", 1)[0] == key[0]}
            kind = lambda n, own=own: None if n.lower() in own else "claimedInBatch" if n.lower() in claimed else "occupied" if n.lower() in real else None
            kinds = [kind(n) for n in names]
            found, wish = [k for k in kinds if k], r.resolution if isinstance(r.resolution, str) else None
            effective, stashes = wish if found else None, []
            if effective == "replace" and "claimedInBatch" in found:
                effective = "rename"
            if effective == "rename":
                parts = [(n[: n.rindex(".")], n[n.rindex(".") :]) if "." in n[1:] else (n, "") for n in names]
                same = tuple((a.lower(), b.lower()) for a, b in parts)
                n = least.get(same, 2) if not own else 2
                while any(kind(f"{a} {n}{b}") for a, b in parts):
                    n += 1
                if not own:
                    least[same] = n
                names = [f"{a} {n}{b}" for a, b in parts]
            elif effective == "replace":
                stashes = [f"{key[0]}/.{batch[:8]}-{int(r.nth)}-{i}" for i, _ in enumerate(found)]
            if not found or effective in ("rename", "replace"):
                claimed.update(n.lower() for n in names)
            out.append((int(r.nth), effective, found, [] if effective == "skip" else [f"{key[0]}/{n}" for n in names], stashes))
        return pd.DataFrame(out, columns=["nth", "effective", "collisions", "destinations", "stashes"])

    return items.unionByName(busy).groupBy("dst_dir", "family").applyInPandas(decide, RESOLVED)


def resolved_name(stem: Column, ext: Column, n: Column) -> Column:
    """`stem n.ext` for n from 2; the bare name for 1."""
    return F.concat(stem, F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def renames(plan: DataFrame, occupants: DataFrame) -> DataFrame:
    """plan with new_name: in the items' order, each takes its name with the least number that is free in its destination.

    Names compete within a family: one destination, extension, and stem without its trailing numbers. Where a family's items
    all have one stem, free numbers below the family's size plus its occupants are dealt in order, by equi-joins, however
    large the family. Only families that mix stems such as `a` and `a 2` are dealt one by one.
    """
    parts = lambda c: (F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(c, r"^.+\.([^.]*)$", 1))
    stem, ext = parts(F.col("name"))
    family = F.regexp_replace("low", r"( ([2-9]|[1-9]\d+))+$", "")
    items = plan.withColumn("stem", stem).withColumn("ext", ext).withColumn("low", F.lower("stem")).withColumn("lext", F.lower("ext")).withColumn("family", family)
    o_stem, o_ext = parts(F.lower("name"))
    busy_names = occupants.select(F.col("parent_dir").alias("dst_dir"), o_stem.alias("low"), o_ext.alias("lext")).withColumn("family", family).distinct()
    key = ["dst_dir", "family", "lext"]
    mixed = items.groupBy(*key).agg((F.min("low") != F.max("low")).alias("mixed"))
    marked = items.join(mixed, key)
    one = dealt_by_joins(marked.filter("NOT mixed"), busy_names, plan.columns)
    serial = marked.filter("mixed").select(*key, "nth", "stem", "low", "ext", F.lit(False).alias("there"))
    there = busy_names.join(mixed.filter("mixed"), key, "left_semi").select(*key, F.lit(0).cast("long").alias("nth"), F.col("low").alias("stem"), "low", F.col("lext").alias("ext"), F.lit(True).alias("there"))
    dealt = serial.unionByName(there).groupBy(*key).applyInPandas(deal_one_by_one, "nth long, new_name string")
    return one.unionByName(plan.join(dealt, "nth").select(*plan.columns, "new_name"))


def deal_one_by_one(pdf):
    """One family's names in order; rows that are there already only take theirs."""
    import pandas as pd

    taken = set(pdf.loc[pdf["there"], "low"])
    out, least = [], {}  # names are never given back, so a stem's search goes on where it ended
    for r in pdf[~pdf["there"]].sort_values("nth").itertuples():
        n = least.get(r.low, 1)
        while (name := r.low + (f" {n}" if n > 1 else "")) in taken:
            n += 1
        least[r.low] = n
        taken.add(name)
        out.append((r.nth, r.stem + (f" {n}" if n > 1 else "") + (f".{r.ext}" if r.ext else "")))
    return pd.DataFrame(out, columns=["nth", "new_name"])


def dealt_by_joins(items: DataFrame, busy_names: DataFrame, columns: list[str]) -> DataFrame:
    """Free numbers for items of one stem per family: n-th item, n-th free number."""
    key = ["dst_dir", "low", "lext"]
    number = F.regexp_extract("low", r"^(.*) ([2-9]|[1-9]\d+)$", 2)
    base = F.regexp_extract("low", r"^(.*) ([2-9]|[1-9]\d+)$", 1)
    # an occupant `a 3` takes number 3 of `a`, and number 1 of `a 3`
    as_number = busy_names.filter(number != "").select("dst_dir", base.alias("low"), "lext", number.try_cast("long").alias("n"))
    taken = as_number.unionByName(busy_names.select("dst_dir", "low", "lext", F.lit(1).cast("long").alias("n"))).distinct()
    groups = items.groupBy(*key).agg(F.count("*").alias("wanted"))
    busy = taken.join(groups, key).groupBy(*key).agg(F.count("*").alias("busy"))
    room = groups.join(busy, key, "left").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("wanted") + F.coalesce("busy", F.lit(0)))))
    free = room.join(taken, [*key, "n"], "left_anti")
    nth_free = free.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("n"))).select(*key, "turn", "n")
    turns = items.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("nth")))
    return turns.join(nth_free, [*key, "turn"]).select(*columns, resolved_name(F.col("stem"), F.col("ext"), F.col("n")).alias("new_name"))


def copy_rows(files: DataFrame, copies: DataFrame, now: float) -> DataFrame:
    """Catalogue rows for copies (src, dst, size, mtime, inode, device, carry): the source's metadata, its hashes if carried.

    Hashes are carried only if the source was hashed and is as it was.
    """
    met = copies.select(F.col("src").alias("c_src"), *[F.col(c).alias("c_" + c) for c in ("dst", "size", "mtime", "inode", "device", "carry")]).join(files, F.col("c_src") == F.col("path"))
    own = F.col("c_carry") & F.col("hashed_at").isNotNull() & (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime"))
    name = F.substring_index("c_dst", "/", -1)
    new = {
        "id": F.lit(None).cast("long"), "path": F.col("c_dst"), "parent_dir": F.regexp_replace("c_dst", r"/[^/]*$", ""), "name": name, "size": F.col("c_size"), "mtime": F.col("c_mtime"), "device": F.col("c_device"), "inode": F.col("c_inode"),
        "indexed_at": F.lit(float(now)),
    } | {c: F.when(own, F.col(c)) for c in HASHES}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in COLUMNS])


def applied(files: DataFrame, journal: DataFrame, removals: DataFrame, moves: DataFrame, copies: DataFrame, marks: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(files, journal) after a batch: removals (path) first, then moves (id, path, dst), then copies, then journal marks
    (op_id, state, trash_url), where a null trash_url keeps what is there."""
    left = files.join(removals.select("path"), "path", "left_anti").select(*COLUMNS)
    to = moves.select(F.col("id").alias("m_id"), F.col("path").alias("m_path"), "dst")
    met = left.join(to, (F.col("id") == F.col("m_id")) & (F.col("path") == F.col("m_path")), "left")
    path = F.coalesce("dst", "path")
    moved = met.select(*[{"path": path, "parent_dir": F.when(F.col("dst").isNotNull(), F.regexp_replace("dst", r"/[^/]*$", "")).otherwise(F.col("parent_dir")), "name": F.when(F.col("dst").isNotNull(), F.substring_index("dst", "/", -1)).otherwise(F.col("name"))}.get(c, F.col(c)).alias(c) for c in COLUMNS])
    merged = upsert(moved, copy_rows(files, copies, now))
    marked = journal.join(marks.select(F.col("op_id").alias("k"), F.col("state").alias("s"), F.col("trash_url").alias("t")), F.col("op_id") == F.col("k"), "left")
    return merged, marked.select("op_id", "batch_id", "kind", "src", "dst", F.coalesce("t", "trash_url").alias("trash_url"), "timestamp", F.coalesce("s", "state").alias("state"))


# System error names -> what a failed operation is called.
FAILURES = {
    "ENOENT": "sourceVanished", "EACCES": "permissionDenied", "EPERM": "permissionDenied", "EROFS": "readOnlyVolume", "ENOSPC": "outOfSpace", "EDQUOT": "outOfSpace", "EEXIST": "destinationExists", "ENOTEMPTY": "destinationExists",
    "EXDEV": "crossVolume", "ENAMETOOLONG": "nameTooLong", "EIO": "inputOutput", "ENXIO": "volumeGone", "ENODEV": "volumeGone", "EBUSY": "busy", "ETXTBSY": "busy",
}


def failure(code: Column) -> Column:
    """The failure that an error code means; other for the rest."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])[code], F.when(code.isNotNull(), "other"))
