"""The hashing queue: batches, stops, crashes at every point, volumes; metrics that come with the pass."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as idx, model as m
from tessera.operators.hashing import HashingRun, read_files
from tessera.operators.store import Generation, Store

N = 11


@pytest.fixture
def store(spark, tmp_path):
    rows = []
    for i in range(N):
        path = str(tmp_path / f"f{i:02d}.jpg")
        if i != 3:  # one can't be read
            with open(path, "wb") as f:
                f.write(b"content %d" % i)
        rows.append((i, path, str(tmp_path), os.path.basename(path), "jpg", 1, 1.0, 1, i, 1.0, 5.0 if i == 10 else None))
    schema = "id long, path string, parent_dir string, name string, ext string, size long, mtime double, device long, inode long, indexed_at double, hashed_at double"
    store = Store(spark, str(tmp_path / "store"))
    store.commit(Generation(), idx.migrated(spark.createDataFrame(rows, schema)))
    return store


def state(store):
    return {r.id: (r.hashed_at, r.content_hash) for r in store.files(store.latest()).collect()}


WANT = {i: (9.0, None if i == 3 else hashlib.sha256(b"content %d" % i).hexdigest()) for i in range(N - 1)} | {10: (5.0, None)}
SAME = lambda: ("V", 1)


def test_a_run_in_batches(store):
    seen = []
    made = HashingRun(store).run(m.Everywhere(), 9.0, SAME, batch=4, report=seen.append)
    assert state(store) == WANT and made.number == 2
    assert [(p.batches, p.attempted, p.read, p.waiting) for p in seen] == [(1, 4, 3, 10), (2, 8, 7, 10), (3, 10, 9, 10)] and seen[-1].fraction == 1
    assert HashingRun(store).run(m.Everywhere(), 9.5, SAME).number == 2 and state(store) == WANT  # nothing waits


@pytest.mark.parametrize("after", [1, 2, 3])
def test_a_killed_run_goes_on_where_it_was(store, after):
    asked = []

    def watched(batch):
        asked.append(sorted(r.id for r in batch.select("id").collect()))
        return read_files(batch)

    def dies(progress):
        if progress.batches == after:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        HashingRun(store, watched).run(m.Everywhere(), 9.0, SAME, batch=4, report=dies)
    assert store.latest().number == 1 and all(v[1] is None for v in state(store).values())
    HashingRun(store, watched).run(m.Everywhere(), 9.0, SAME, batch=4)
    assert asked == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and state(store) == WANT


def test_a_crash_before_the_batches_are_cleared_does_no_harm(store, monkeypatch):
    monkeypatch.setattr(Store, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        HashingRun(store).run(m.Everywhere(), 9.0, SAME, batch=6)
    monkeypatch.undo()
    assert state(store) == WANT
    changed = store.update(lambda files: idx.upsert(files, files.filter("id = 1").withColumn("mtime", F.lit(2.0))))
    assert state(store)[1] == (None, None) and HashingRun(store).batches(changed) == []
    HashingRun(store).run(m.Everywhere(), 11.0, SAME)
    assert state(store) == WANT | {1: (11.0, WANT[1][1])}


def test_stop_pause_and_scope(store):
    calls = iter([False, True])
    HashingRun(store).run(m.Everywhere(), 9.0, SAME, stop=lambda: next(calls), batch=3)
    assert sum(v[0] == 9.0 for v in state(store).values()) == 3
    HashingRun(store).run(m.Folder("/elsewhere"), 9.0, SAME)
    assert sum(v[0] == 9.0 for v in state(store).values()) == 3
    HashingRun(store).run(m.Everywhere(), 9.0, SAME)
    assert state(store) == WANT


def test_a_volume_that_changes_takes_no_batch(store):
    volumes = iter([("V", 1), ("V", 1), ("W", 2)])
    with pytest.raises(PermissionError):
        HashingRun(store).run(m.Everywhere(), 9.0, lambda: next(volumes), batch=4)
    assert store.latest().number == 1 and HashingRun(store).batches(store.latest()) == [1]  # the first batch is kept
    HashingRun(store).run(m.Everywhere(), 9.0, SAME)
    assert state(store) == WANT


def test_rows_that_change_meanwhile_are_hashed_again(store):
    def changes(progress):
        if progress.batches == 1:
            store.update(lambda files: files.withColumn("mtime", F.when(F.col("id") == 0, 7.0).otherwise(F.col("mtime"))))

    HashingRun(store).run(m.Everywhere(), 9.0, SAME, batch=20, report=changes)
    assert state(store)[0] == (None, None) and state(store)[1] == WANT[1]  # what was hashed isn't what is there now
    HashingRun(store).run(m.Everywhere(), 12.0, SAME)
    assert state(store)[0] == (12.0, WANT[0][1])


def test_a_reconcile_counts_while_it_runs(store):
    files = store.files(store.latest())
    walked = files.filter("id <> 2").withColumn("mtime", F.when(F.col("id") < 2, 8.0).otherwise(F.col("mtime")))
    none = files.select("path", F.lit("x").alias("reason")).limit(0)
    after, metrics = idx.reconcile(files, walked, none, m.Everywhere(), None, 1, SAME(), SAME())
    assert after.count() == N - 1 and tuple(metrics.first()) == (N - 1, 2, 0, 0, 2 / (N - 1))
    assert "state" not in metrics._jdf.queryExecution().executedPlan().toString()  # nothing is read again to count it
    _, metrics = idx.reconcile(files, walked.limit(0), none, m.Everywhere(), None, 1, SAME(), ("W", 2))
    assert tuple(metrics.first()) == (0, 0, 0, 0, 0.0)
