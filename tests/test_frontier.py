"""Walks of real trees: loops, links, what can't be looked at, and a reconcile fed by a walk."""

import errno
import os

import pytest

from tessera.operators import index as idx, model as m
from tessera.sources import frontier


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("one.jpg", "two.PNG", "notes.txt", ".hidden.jpg", "Icon\r", "sub/three.heic", "sub/deep/er/four.cr2", "sub/._x.jpg", "Lib.photoslibrary/five.jpg", ".git/six.jpg", "a.b/seven.tiff", "noext", "sub/.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * len(name))
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "eight.gif").write_bytes(b"g")
    os.symlink(root, root / "sub" / "up")  # a loop
    os.symlink(tmp_path / "outside", root / "out")
    os.symlink(tmp_path / "outside", root / "sub" / "out2")  # the same folder by another way
    os.symlink(root / "one.jpg", root / "link.jpg")
    os.symlink(root / "nowhere", root / "dangling.jpg")
    os.mkfifo(root / "pipe.jpg")
    return root


def walk(spark, root, **options):
    entries, skipped = frontier.scan(spark, str(root), **options)
    return {os.path.relpath(r.path, root): r for r in entries.collect()}, {(os.path.relpath(r.path, root), r.reason) for r in skipped.collect()}


PLAIN = {"one.jpg", "two.PNG", "sub/three.heic", "sub/deep/er/four.cr2", "a.b/seven.tiff"}


def test_a_tree_without_links(spark, tree):
    files, skipped = walk(spark, tree)
    assert set(files) == PLAIN and skipped == set()
    st, r = os.stat(tree / "two.PNG"), files["two.PNG"]
    assert (r.size, r.device, r.inode, r.media) == (st.st_size, st.st_dev, st.st_ino, "png") and r.mtime == pytest.approx(st.st_mtime, abs=1e-6)
    assert set(walk(spark, tree, recursive=False)[0]) == {"one.jpg", "two.PNG"}


def test_links_are_followed_once(spark, tree):
    files, skipped = walk(spark, tree, follow=True)
    assert set(files) == PLAIN | {"link.jpg", "out/eight.gif"}
    assert skipped == {("sub/up", "symlinkLoop"), ("sub/out2", "symlinkLoop")}
    os.symlink(tree / "sub", tree / "again")  # two ways at one level: the first path is entered
    assert ("sub", "symlinkLoop") in walk(spark, tree, follow=True)[1] and "again/three.heic" in walk(spark, tree, follow=True)[0]


def test_roots_that_are_no_folders(spark, tree):
    assert walk(spark, tree / "missing") == ({}, {(".", "unreadable")}) == walk(spark, tree / "one.jpg")
    (tree / "empty").mkdir()
    assert walk(spark, tree / "empty") == ({}, set())


def test_what_cannot_be_looked_at(tree, monkeypatch):
    real_list, real_stat = os.listdir, os.lstat

    def refuses(path):
        if str(path).endswith("sub"):
            raise PermissionError(errno.EACCES, "no")
        return real_list(path)

    def odd(path):
        if str(path).endswith("one.jpg"):
            raise FileNotFoundError(errno.ENOENT, "gone")
        if str(path).endswith("two.PNG"):
            raise OSError(errno.EIO, "flaky")
        return real_stat(path)

    monkeypatch.setattr(os, "listdir", refuses)
    assert [x[:2] + x[-1:] for x in frontier.listed(str(tree / "sub"), True, False)] == [("skipped", str(tree / "sub"), "unreadable")]
    monkeypatch.setattr(os, "lstat", odd)
    got = {(x[0], os.path.basename(x[1])): x[-1] for x in frontier.listed(str(tree), True, False)}
    assert ("skipped", "two.PNG") in got and got["skipped", "two.PNG"] == "unstatable" and not any(n == "one.jpg" for _, n in got)
    monkeypatch.undo()
    with open(os.fsencode(str(tree)) + b"/bad\xff.jpg", "wb"):
        assert ("skipped", "unstatable") in {(x[0], x[-1]) for x in frontier.listed(str(tree), True, False)}


def test_a_full_folder_leaves_its_task_in_lots(monkeypatch):
    monkeypatch.setattr(frontier, "BATCH", 3)
    assert [b.num_rows for b in frontier.rows_of(frontier.seen("dir", f"/{i}") for i in range(8))] == [3, 3, 2]


def test_a_reconcile_takes_what_a_walk_finds(spark, tree):
    volume = (None, os.stat(tree).st_dev)
    none = idx.migrated(spark.createDataFrame([], "id long, path string"))

    def reconcile(index, now):
        entries, skipped = frontier.scan(spark, str(tree))
        after, metrics = idx.reconcile(index, frontier.catalogued(entries, now), skipped, m.Folder(str(tree)), None, volume[1], volume, volume)
        return spark.createDataFrame(after.collect(), after.schema), metrics.first()

    index, count = reconcile(none, 1.0)
    assert index.count() == len(PLAIN) == count.total == count.completed and idx.integrity(index).first().ok
    os.remove(tree / "one.jpg")
    (tree / "two.PNG").write_bytes(b"longer than before")
    (tree / "new.webp").write_bytes(b"w")
    index, count = reconcile(index, 2.0)
    assert {os.path.relpath(r.path, tree) for r in index.collect()} == PLAIN - {"one.jpg"} | {"new.webp"} and count.completed == 2
    assert {r.name: r.indexed_at for r in index.collect()}["two.PNG"] == 2.0
