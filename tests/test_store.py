"""Published generations: snapshots, crashes, races, dependent rows; words looked up in postings."""

import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import index as idx, model as m, postings as pst, search as s
from tessera.operators.store import ANALYSIS, Generation, LostRace, Store
from tessera.sources import adapters as ad
from tessera.streaming import upsert as stream


def catalogue(spark, rows):
    """rows of (id, path) or (id, path, size)."""
    full = [(r[0], r[1], r[1].rsplit("/", 1)[0], r[1].rsplit("/", 1)[1], "jpg", r[2] if len(r) > 2 else 5, 1.0, 1, r[0] or 0, 9.0) for r in rows]
    df = spark.createDataFrame(full, "id long, path string, parent_dir string, name string, ext string, size long, mtime double, device long, inode long, indexed_at double")
    return idx.migrated(df)


def found(store, generation, text, scope=m.Everywhere()):
    q = m.SearchQuery(scope, m.FilenameText(text))
    by_words = s.matching(store.files(generation), q, postings=store.postings(generation)).select("id").collect()
    by_tokens = s.matching(store.files(generation), q).select("id").collect()
    assert sorted(by_words) == sorted(by_tokens)
    return sorted(r.id for r in by_words)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_words_follow_every_change(spark, store):
    rows = [(1, "/a/Red Fox.jpg"), (2, "/a/red-fern.jpg"), (3, "/b/blue_fox.jpg"), (4, "/b/Ärger 07.jpg")]
    one = store.commit(Generation(), catalogue(spark, rows))
    assert found(store, one, "red fo") == [1] and found(store, one, "fox") == [1, 3] and found(store, one, "arger 0") == [4] and found(store, one, "fo", m.Folder("/b")) == [3]
    # a name changes under its id, one goes, one comes
    two = store.commit(one, catalogue(spark, [(1, "/a/green.jpg"), (2, "/a/red-fern.jpg"), (4, "/b/Ärger 07.jpg"), (5, "/c/fox fox.jpg")]))
    assert found(store, two, "red") == [2] and found(store, two, "fox") == [5] and found(store, two, "green") == [1] and len(two.segments) == 2
    assert found(store, one, "fox") == [1, 3]  # the older generation is as it was
    upserted = store.update(lambda files: idx.upsert(files, catalogue(spark, [(None, "/c/new fox.jpg"), (None, "/a/green.jpg", 77)])))
    assert found(store, upserted, "fox") == [5, 6] and upserted.number == 3
    pruned = store.update(lambda files: idx.prune(files, catalogue(spark, [(1, "/a/green.jpg")]), m.Folder("/c")))
    assert found(store, pruned, "fox") == [] and found(store, pruned, "gre") == [1]
    same = store.commit(pruned, store.files(pruned))
    assert same.segments == pruned.segments  # nothing changed, no segment


def test_segments_are_merged(spark, store):
    made = store.commit(Generation(), catalogue(spark, [(0, "/a/start.jpg")]))
    for i in range(1, 12):
        made = store.commit(made, catalogue(spark, [(j, f"/a/file{j} part{i if j == i else 0}.jpg") for j in range(i + 1)]))
        assert len(made.segments) <= 8
    assert found(store, made, "part0") == list(range(11)) and found(store, made, "part11") == [11] and found(store, made, "start") == []


@pytest.mark.parametrize("text", ["", "***", "img en jp", "zz", "img", "Müller", "a\U0010ffff"])
@pytest.mark.parametrize("wrap", [lambda p: p, m.Not, lambda p: m.Or((p, m.Width(m.AtLeast(1)))), lambda p: m.And((p, m.Not(m.FilenameText("two"))))])
def test_lookups_equal_cutting_names_in_any_predicate(spark, text, wrap):
    rows = catalogue(spark, [(1, "/a/img en one.jpg"), (2, "/a/img two en.jp2"), (3, "/a/muller.jpg"), (4, "/a/….jpg"), (5, "/a/imgen.jp")])
    q = m.SearchQuery(predicate=wrap(m.FilenameText(text)))
    by_words = s.matching(rows, q, postings=pst.words_of(rows, "name", pst.NAME))
    assert sorted(r.id for r in by_words.collect()) == sorted(r.id for r in s.matching(rows, q).collect()) and by_words.columns == rows.columns


def test_the_start_of_a_word_is_a_range():
    assert pst.after_last("jp") == "jq" and pst.after_last("a\U0010ffff") == "b" and pst.after_last("\U0010ffff") is None and pst.after_last("퟿") == ""


def test_lookups_read_ranges_of_postings_and_cut_no_names(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = entry.queries()["pred_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "ReadSchema: struct<term" in x]
    assert len(scans) == 1 and "GreaterThanOrEqual(term,jp)" in scans[0] and "LessThan(term,jq)" in scans[0] and "EqualTo(term,img)" in scans[0]
    assert "split(" not in plan and "LeftOuter" not in plan  # an inner join, as the text must match


def test_analysis_and_its_words_go_with_the_file_or_its_bytes(spark, store):
    one = store.commit(Generation(), catalogue(spark, [(1, "/a/x.jpg"), (2, "/a/y.jpg"), (3, "/a/z.jpg")]))
    read = spark.createDataFrame([(1, "stop sign"), (2, "stop light"), (3, None), (9, "no such file")], "file_id long, ocr_text string")
    names = [x.split()[0] for x in ANALYSIS.split(", ")]
    full = read.select(*[F.col(c) if c in read.columns else F.lit(None).alias(c) for c in names])
    two = store.commit(one, store.files(one), analysis=spark.createDataFrame(full.rdd, ANALYSIS))
    ids = lambda g, *words: sorted(r.id for r in pst.ids_with(store.postings(g), list(words)).collect())
    assert ids(two, "stop") == [1, 2] and ids(two, "stop", "x") == [1] and {r.file_id for r in store.analysis(two).collect()} == {1, 2, 3}
    three = store.commit(two, catalogue(spark, [(1, "/a/x.jpg", 6), (2, "/b/moved.jpg"), (3, "/a/z.jpg")]))  # 1 changed, 2 moved
    assert ids(three, "stop") == [2] and ids(three, "x") == [1] and ids(three, "y") == [] and {r.file_id for r in store.analysis(three).collect()} == {2, 3}
    four = store.commit(three, catalogue(spark, [(1, "/a/x.jpg", 6)]))
    assert ids(four, "stop") == ids(four, "moved") == [] and store.analysis(four).count() == 0


def test_an_attempt_that_died_is_never_seen(spark, store, monkeypatch):
    one = store.commit(Generation(), catalogue(spark, [(1, "/a/x.jpg")]))
    monkeypatch.setattr(Store, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.commit(one, catalogue(spark, [(2, "/a/y.jpg")]))
    monkeypatch.undo()
    assert store.latest() == one and found(store, store.latest(), "x") == [1]
    two = store.update(lambda files: files.unionByName(catalogue(spark, [(3, "/a/z.jpg")])))
    assert two.number == 2 and found(store, two, "jpg") == [1, 3]


def test_of_two_writers_one_wins(spark, store):
    base, outcomes, gate = store.commit(Generation(), catalogue(spark, [(1, "/a/x.jpg")])), [], threading.Barrier(6)

    def write(k):
        gate.wait()
        try:
            outcomes.append(("won", Store(spark, store.root).publish(base, f"writer{k}", files=base.files).owner))
        except LostRace:
            outcomes.append(("lost", f"writer{k}"))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [w for o, w in outcomes if o == "won"]
    assert len(outcomes) == 6 and len(won) == 1 and store.latest().owner == won[0]


def test_who_lost_begins_again_from_what_won(spark, store):
    store.commit(Generation(), catalogue(spark, [(1, "/a/x.jpg")]))
    seen = []

    def slow(files):
        seen.append(files.count())
        if len(seen) == 1:  # meanwhile another writer publishes
            Store(spark, store.root).update(lambda other: other.unionByName(catalogue(spark, [(2, "/a/y.jpg")])))
        return files.unionByName(catalogue(spark, [(3, "/a/z.jpg")]))

    made = store.update(slow)
    assert seen == [1, 2] and made.number == 3 and {r.id for r in store.files(made).collect()} == {1, 2, 3}
    with pytest.raises(LostRace):
        store.commit(store.at(1), catalogue(spark, [(9, "/a/late.jpg")]))


def test_clearing_keeps_what_newer_generations_read(spark, store):
    made = [store.commit(Generation(), catalogue(spark, [(1, "/a/x.jpg")]))]
    for i in range(3):
        made.append(store.update(lambda files, i=i: files.unionByName(catalogue(spark, [(10 + i, f"/a/n{i}.jpg")]))))
    assert store.clear(keep=1, older_than=3600) == [] and store.numbers() == [4]
    store.clear(keep=1, older_than=-10)
    assert found(store, store.latest(), "jpg") == [1, 10, 11, 12]  # its first segment is another generation's
    with pytest.raises(LookupError):
        store.at(1)


def test_a_batch_is_taken_once_and_a_crash_is_recovered_from(spark, tmp_path, monkeypatch):
    source, root, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    catalogue(spark, [(None, "/a/x.jpg"), (None, "/a/y.jpg")]).write.parquet(source)
    entries = lambda: spark.readStream.schema(idx.FILES).parquet(source)
    original = Store.publish
    monkeypatch.setattr(Store, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died before the rename")))
    with pytest.raises(Exception, match="died"):
        stream.follow(entries(), root, cp).awaitTermination()
    assert stream.latest_generation(spark, root)[0] == 0

    def dies_after(self, *a, **k):
        original(self, *a, **k)
        raise RuntimeError("died after the rename")

    monkeypatch.setattr(Store, "publish", dies_after)
    with pytest.raises(Exception, match="died after"):
        stream.follow(entries(), root, cp).awaitTermination()
    monkeypatch.setattr(Store, "publish", original)
    stream.follow(entries(), root, cp).awaitTermination()
    number, rows = stream.latest_generation(spark, root)
    assert number == 1 and {r.path for r in rows.collect()} == {"/a/x.jpg", "/a/y.jpg"}  # the batch was there already
    catalogue(spark, [(None, "/a/z.jpg")]).write.mode("append").parquet(source)
    stream.follow(entries(), root, cp).awaitTermination()
    number, rows = stream.latest_generation(spark, root)
    assert number == 2 and idx.integrity(rows).first().ok and rows.count() == 3


def test_an_index_follows_the_rows_it_was_made_of(spark, tmp_path):
    docs = lambda n: spark.createDataFrame([(i, f"t{i}", "en", "src1", 2) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    docs(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert ad.files(spark, str(tmp_path)).count() == ad.library(spark, str(tmp_path))[0].count() == 3
    docs(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert ad.files(spark, str(tmp_path)).count() == ad.library(spark, str(tmp_path))[0].count() == 5
