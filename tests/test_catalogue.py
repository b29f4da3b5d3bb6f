"""Duplicates, upkeep, journal, kernels and streaming on small made rows, against plain loops where SQL can't help."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import containers as con, dates, edits
from tessera.functions.hashes import phash_bits
from tessera.operators import duplicates as dup, index as idx, journal as jnl, model as m, saved
from tessera.sources import media, metadata, walk
from tessera.operators.store import Store
from tessera.streaming.upsert import follow, latest_generation

G = 0x9F32A3B705AE1B18


def flipped(k):
    return f"{G ^ ((1 << k) - 1):016x}"


def rows_of(spark, rows):
    """rows: path, content, image, kind, phash; ids in the given order."""
    kinds = dict(x.split() for x in idx.FILES.split(", "))
    made = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "id long, path string, content_hash string, image_hash string, image_hash_kind string, phash string")
    made = made.withColumns({"parent_dir": F.regexp_replace("path", "/[^/]*$", ""), "name": F.substring_index("path", "/", -1), "ext": F.substring_index("path", ".", -1), "size": F.lit(1234).cast("long"), "mtime": F.lit(1.7e9), "device": F.lit(1).cast("long"), "inode": F.col("id"), "indexed_at": F.lit(1.0)})
    return made.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in made.columns}).select(*idx.COLUMNS)


def exact(spark, rows):
    found = dup.exact_groups(rows_of(spark, rows)).orderBy("group_no", "file_no").collect()
    out = {}
    for r in found:
        out.setdefault(r.group_no, []).append(r.path.rsplit("/", 1)[1])
    return list(out.values()), found


def near(spark, rows):
    found = dup.near_groups(rows_of(spark, rows)).orderBy("group_no", "match_no").collect()
    name = {i + 1: r[0].rsplit("/", 1)[1] for i, r in enumerate(rows)}
    return [(name[r.seed_id], name[r.match_id], r.distance) for r in found]


def test_exact_groups(spark):
    assert exact(spark, [("/a.cr2", "same", None, None, None), ("/b.cr2", "same", None, None, None), ("/c.cr2", "other", None, None, None)])[0] == [["a.cr2", "b.cr2"]]
    assert exact(spark, [("/a.jpg", "s", "i", "k", None), ("/b.jpg", "s", "i", "k", None), ("/c.cr2", "s", None, None, None)])[0] == [["a.jpg", "b.jpg"]]
    got, rows = exact(spark, [("/zeta", "c2", "i2", "k", None), ("/yankee", "c2", "i2", "k", None), ("/Alpha", "c1", "i1", "k", None), ("/beta", "c3", "i1", "k", None)])
    assert got == [["Alpha", "beta"], ["yankee", "zeta"]]
    assert [r.copy_no for r in rows] == [1, 2, 1, 1]


def test_near_groups(spark):
    assert near(spark, [("/a", None, None, None, flipped(0)), ("/b", None, None, None, flipped(12)), ("/c", None, None, None, f"{G ^ 0x1FFF:016x}")]) == [("a", "b", 12)]
    assert near(spark, [("/a", "x", "i", "k", flipped(0)), ("/b", "y", "i", "k", flipped(0))]) == []
    assert near(spark, [("/a", "x", "i", "k", flipped(0)), ("/b", "y", "i", "k", flipped(0)), ("/c", None, None, None, flipped(4))]) == [("a", "c", 4)]
    assert near(spark, [("/z", None, None, None, flipped(0)), ("/a", None, None, None, flipped(2))]) == [("a", "z", 2)]
    assert near(spark, [("/a", None, None, None, None), ("/b", None, None, None, "not-a-hash")]) == []


def greedy(values, keys=None):
    keys, used, out = keys or [None] * len(values), set(), set()
    for i, x in enumerate(values):
        if i in used:
            continue
        used.add(i)
        for j in range(i + 1, len(values)):
            if j not in used and (x ^ values[j]).bit_count() <= 12 and (keys[i] is None or keys[i] != keys[j]):
                used.add(j)
                out.add((i + 1, j + 1, (x ^ values[j]).bit_count()))
    return out


@pytest.mark.parametrize("batch", [dup.BATCH, 9, 1])
@pytest.mark.parametrize("shape", ["apart", "copies", "walk"])
def test_star_cover_equals_the_greedy_loop(spark, batch, shape):
    rng, n = random.Random(3), 25 if batch == 1 else 120
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(n)]
    if shape == "walk":  # each is near the next one and hardly any other
        for i in range(1, n):
            values[i] = values[i - 1] ^ sum(1 << b for b in rng.sample(range(64), 9))
    keys = [None] * n
    if shape == "copies":
        values = [rng.choice(values[:9]) if rng.random() < 0.7 else v for v in values]
        keys = [rng.choice([None, "k1", "k2", "k3"]) for _ in values]
    rows = rows_of(spark, [(f"/{i:03d}", None, k, "k" if k else None, f"{v:016x}") for i, (v, k) in enumerate(zip(values, keys))])
    got = dup.near_groups(rows, batch=batch).collect()
    want = greedy(values, keys)
    assert {(r.seed_id, r.match_id, r.distance) for r in got} == want and len(got) == len(want)
    groups: dict = {}
    for r in sorted(got, key=lambda r: (r.group_no, r.match_no)):
        groups.setdefault((r.group_no, r.seed_id), []).append((r.match_no, r.distance, r.match_id))
    assert [g for g, _ in sorted(groups)] == list(range(1, len(groups) + 1)) and [s for _, s in sorted(groups)] == sorted(s for _, s in groups)
    assert all([m for m, *_ in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v) for v in groups.values())


def test_claims_come_from_the_first_seed_however_seeds_are_cut():
    rng = np.random.default_rng(6)
    x = np.array([int(v) ^ (1 << int(b)) for v, b in zip(rng.choice([5, 2**40, 2**63], 300), rng.integers(0, 64, 300))], np.uint64)
    who, rank = rng.integers(0, 5, 300), np.arange(300)
    at = np.sort(rng.choice(300, 120, replace=False))
    want = [next((int(s) for s in at if s < i and who[s] != who[i] and int(x[s] ^ x[i]).bit_count() <= 3), -1) for i in range(300)]
    for width in (1, 7, 256):
        assert dup.claims_of(rank, x, who, (at, x[at], who[at]), 3, width).tolist() == want


def test_report_ceiling(spark):
    rows = rows_of(spark, [("/a", "x", "i", "k", flipped(0)), ("/b", "y", "i", "k", "bad")])
    out = dup.duplicate_report(rows, m.SearchQuery(), ceiling=1)
    assert out.near is None and out.near_skipped == 2 and out.exact.count() == 2


@pytest.mark.parametrize(("rows", "root", "gone"), [([(3, "A"), (3, "B"), (3, "A")], (3, "A"), 2), ([(111, "A")], (222, "A"), 1), ([(3, None), (9, None), (3, "B")], (3, "A"), 1), ([(3, None), (9, None), (3, "A")], (3, None), 1), ([(3, None), (9, "A")], (None, None), 2)])
def test_prune_knows_volumes(spark, rows, root, gone):
    files = rows_of(spark, [(f"/lib/{i}", None, None, None, None) for i in range(len(rows))])
    marks = spark.createDataFrame([(i + 1, d, u) for i, (d, u) in enumerate(rows)], "k long, d long, u string")
    files = files.join(marks, F.col("id") == F.col("k")).withColumn("device", F.col("d")).withColumn("volume_uuid", F.col("u")).select(*idx.COLUMNS)
    none = files.limit(0)
    assert files.count() - idx.prune(files, none, m.Folder("/lib"), root[1], root[0]).count() == gone


def test_unreadable_root_prunes_nothing(spark):
    files = rows_of(spark, [("/lib/a", None, None, None, None)])
    with pytest.raises(PermissionError):
        idx.reconcile(files, files, files.select("path"), m.Folder("/lib"), None, 1, (None, 1), (None, 1), root_readable=False)
    out, metrics = idx.reconcile(files, files.limit(0), files.limit(0).select("path"), m.Folder("/lib"), None, 1, ("A", 1), ("B", 1))
    assert out.count() == 1 and metrics.first().fraction == 0


def test_retention(spark):
    now, day = 1_800_000_000.0, 86400
    rows = [(1, "old", now - 31 * day, "complete"), (2, "new", now - day, "complete"), (3, "stuck", now - 99 * day, "in_flight")] + [(10 + i, f"b{i:03d}", now - 10 * day - i, "complete") for i in range(205)]
    j = spark.createDataFrame([(i, b, "move", "/s", "/d", None, t, s) for i, b, t, s in rows], "op_id long, batch_id string, kind string, src string, dst string, trash_url string, timestamp double, state string")
    kept = {r.batch_id for r in jnl.retained(j, now).collect()}
    assert "old" not in kept and {"new", "stuck"} <= kept and len(kept) == 201


def plan_loop(plan, taken):
    """Each item in order takes the least free number."""
    busy, out = {}, {}
    for nth, dst, name in sorted(plan):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, ext) if dot and stem else (name, "")
        names = busy.setdefault(dst, set(taken.get(dst, ())))
        n = 1
        while True:
            new = stem + (f" {n}" if n > 1 else "") + (f".{ext}" if ext else "")
            if new.lower() not in names:
                break
            n += 1
        names.add(new.lower())
        out[nth] = new
    return out


def test_renames_equal_a_loop(spark):
    rng = random.Random(5)
    plan = [(i, f"/d{rng.randint(0, 1)}", rng.choice(["a.jpg", "A.jpg", "b.png", "B 2.png", "b 2 2.png", "c", ".hidden"])) for i in range(80)]
    taken = {"/d0": {"a.jpg", "a 3.jpg", "b 2.png"}, "/d1": {"a 2.jpg"}}
    df = spark.createDataFrame([(n, f"/s/{n}", d, x) for n, d, x in plan], "nth long, src string, dst_dir string, name string")
    occ = spark.createDataFrame([(d, x.upper()) for d, xs in taken.items() for x in xs], "parent_dir string, name string")
    got = {r.nth: r.new_name for r in jnl.renames(df, occ).collect()}
    assert got == plan_loop(plan, taken)


def test_dates(spark):
    rows = spark.createDataFrame([("2019:03:04 10:11:12", "-05:00"), ("2019:03:04 10:11:12", None), ("2019:03:04 10:11:12", "+5:00"), ("nonsense", "+00:00")], "s string, o string")
    assert [r.t for r in rows.select(dates.exif_time(F.col("s"), F.col("o")).alias("t")).collect()] == [1551712272.0, 1551694272.0, 1551694272.0, None]
    amounts = spark.createDataFrame([("90",), ("-1:30",), ("+1:02:03",), ("1:99",), ("x",)], "s string")
    assert [r.x for r in amounts.select(dates.shift_amount(F.col("s")).alias("x")).collect()] == [90, -5400, 3723, None, None]


def test_walk(spark, tmp_path):
    for name in ("a.jpg", ".b.jpg", "c.txt", "d.app/e.png", "f/g.CR2", "f/Icon\r"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xyz")
    got = {r.name: (r.media, r.size) for r in walk.walked(walk.listing(spark, str(tmp_path))).collect()}
    assert got == {"a.jpg": ("jpeg", 3), "g.CR2": ("raw", 3)}


def test_phash_goldens():
    s, grid = 12345, []
    for _ in range(1024):
        s = (s * 1664525 + 1013904223) % 2**32
        grid.append(s >> 24)
    ramp = [(x * 7 + y * 13) % 256 for y in range(32) for x in range(32)]
    got = [np.packbits(b).tobytes().hex() for b in phash_bits(np.array([grid, ramp, [128] * 1024]))]
    assert got == ["9f32a3b705ae1b18", "1b6b0a6ed5c45ab4", "0" * 16]


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments, scan=b"ab\xff\x00c\xff\xd0d", tail=b""):
    return b"\xff\xd8" + b"".join(segments) + segment(0xDA, b"\1\2") + scan + b"\xff\xd9" + tail


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def heic(note, data, tail=b"", grid=False):
    infe = lambda i, kind: box(b"infe", b"\2\0\0\0" + struct.pack(">HH", i, 0) + kind + b"\0")
    items = [(1, b"grid"), (2, b"hvc1"), (3, b"hvc1"), (4, b"Exif")] if grid else [(1, b"hvc1"), (4, b"Exif")]
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", len(items)) + b"".join(infe(*x) for x in items))
    iref = box(b"iref", b"\0\0\0\0" + box(b"dimg", struct.pack(">HHHH", 1, 2, 3, 2))) if grid else b""
    pitm = box(b"pitm", b"\0\0\0\0\0\1")
    ftyp = box(b"ftyp", b"heic\0\0\0\0mif1")

    def build(at):
        half = len(data) // 2
        places = [(2, at, half), (3, at + half, len(data) - half)] if grid else [(1, at, len(data))]
        places.append((4, at + len(data), len(note)))
        iloc = box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">H", len(places)) + b"".join(struct.pack(">HHHII", i, 0, 1, o, n) for i, o, n in places))
        return ftyp + box(b"meta", b"\0\0\0\0" + pitm + iinf + iref + iloc)

    head = build(0)
    return build(len(head) + 8) + box(b"mdat", data + note) + tail


def test_image_hashes_ignore_metadata_only():
    h = lambda b, k: con.image_hash(b, k)
    table = segment(0xDB, b"q")
    assert h(jpeg(segment(0xE1, b"exif one"), table), "jpeg") == h(jpeg(segment(0xE1, b"other"), segment(0xFE, b"note"), table), "jpeg") != h(jpeg(table, scan=b"zz"), "jpeg")
    assert h(jpeg(table), "jpeg") != h(jpeg(segment(0xE2, b"icc"), table), "jpeg")
    assert h(jpeg(table), "jpeg") != h(jpeg(table, tail=b"more"), "jpeg")
    png = lambda *c: con.PNG_SIGNATURE + b"".join(chunk(*x) for x in c) + chunk(b"IEND", b"")
    assert h(png((b"IHDR", b"h"), (b"tEXt", b"a"), (b"IDAT", b"x")), "png") == h(png((b"IHDR", b"h"), (b"IDAT", b"x"), (b"tIME", b"1")), "png")
    assert h(webp((b"VP8 ", b"img"), (b"EXIF", b"a")), "webp") == h(webp((b"VP8 ", b"img")), "webp") is not None
    assert h(heic(b"one", b"pixels"), "heic") == h(heic(b"another", b"pixels"), "heic") != h(heic(b"one", b"pixelz"), "heic")
    assert h(heic(b"one", b"pixels", grid=True), "heic") == hashlib.sha256(b"elspix").hexdigest()  # parts in the order of their references
    assert h(heic(b"one", b"pixels", b"tail data"), "heic") == hashlib.sha256(b"pixelstail data").hexdigest()


@pytest.mark.parametrize(("content", "kind"), [(b"", "jpeg"), (jpeg()[:-2], "jpeg"), (b"\xff\xd8\xff\xe0\0\1", "jpeg"), (con.PNG_SIGNATURE, "png"), (con.PNG_SIGNATURE + b"\xff" * 12, "png"), (webp((b"EXIF", b"a")), "webp"), (b"RIFF\xff\xff\xff\x7fWEBP", "webp"), (heic(b"n", b"d")[:-9], "heic"), (b"\0" * 40, "heic"), (b"x", "gif"), (None, "png")])
def test_malformed_files_have_no_image_hash(content, kind):
    assert con.image_hash(content, kind) is None


def test_hostile_bytes_never_raise():
    rng = random.Random(1)
    seeds = [jpeg(segment(0xDB, b"q")), con.PNG_SIGNATURE + chunk(b"IDAT", b"x") + chunk(b"IEND", b""), webp((b"VP8 ", b"img")), heic(b"n", b"data", grid=True)]
    for kind, seed in zip(("jpeg", "png", "webp", "heic"), seeds, strict=True):
        for _ in range(300):
            b = bytearray(seed)
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = rng.randrange(256)
            con.image_hash(bytes(b[: rng.randint(0, len(b))]), kind)


def test_stream_of_upserts(spark, tmp_path):
    first = rows_of(spark, [("/a", "h1", None, None, None), ("/b", "h2", None, None, None)])
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    first.write.parquet(source)
    stream = lambda: spark.readStream.schema(idx.FILES).parquet(source)
    follow(stream(), root, str(tmp_path / "cp")).awaitTermination()
    rows_of(spark, [("/b", "zz", None, None, None), ("/c", "h3", None, None, None)]).write.mode("append").parquet(source)
    follow(stream(), root, str(tmp_path / "cp")).awaitTermination()
    number, rows = latest_generation(spark, root)
    assert number == 2 and {r.path: r.content_hash for r in rows.collect()} == {"/a": "h1", "/b": "h2", "/c": "h3"}
    assert idx.integrity(rows).first().ok


def test_image_data_is_the_whole_text(spark):
    from tessera.plans.catalogue import containers, hashed

    rows = [(i, "a" * 20000 + end) for i, end in ((3, "b"), (6, "c"), (1, "b"), (2, "c"))]
    got = hashed(containers(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "image_hash").collect()
    assert len({r.image_hash for r in got}) == 4


def test_collisions_by_the_rule(spark):
    rows = [  # nothing in the way; then a file in the way, by what is to become of the first of two
        (1, "/s/a", "/d", "new.jpg", None, None), (2, "/s/b", "/d", "NEW.jpg", None, "claimedInBatch"),
        (3, "/s/c", "/d", "old.jpg", None, "occupied"), (4, "/s/d", "/d", "old.jpg", None, "occupied"),
        (5, "/s/e", "/d", "over.jpg", "skip", "occupied"), (6, "/s/f", "/d", "over.jpg", "replace", "occupied"), (7, "/s/g", "/d", "over.jpg", "replace", "claimedInBatch"),
        (8, "/d/Own.jpg", "/d", "own.jpg", None, None), (9, "/s/h", "/d", "own.jpg", "rename", "claimedInBatch"),
        (10, "/s/i", "/e", "old.jpg", None, None),
    ]
    plan = spark.createDataFrame([r[:5] for r in rows], "nth long, src string, dst_dir string, name string, resolution string")
    taken = spark.createDataFrame([("/d", x) for x in ("OLD.jpg", "over.jpg", "own.jpg")], "parent_dir string, name string")
    assert {r.nth: r.collision for r in jnl.collisions(plan, taken).collect()} == {r[0]: r[5] for r in rows}


def resolve_loop(plan, taken, batch):
    """The whole plan in order, with sets of names for each folder."""
    claimed, out = {}, {}
    for nth, dst, srcs, wish in sorted(plan):
        names, real, mine = [x.rsplit("/", 1)[1] for x in srcs], {x.lower() for x in taken.get(dst, ())}, claimed.setdefault(dst, set())
        own = {x.rsplit("/", 1)[1].lower() for x in srcs if x.rsplit("/", 1)[0] == dst}

        def kind(name, own=own, mine=mine, real=real):
            return None if name.lower() in own else "claimedInBatch" if name.lower() in mine else "occupied" if name.lower() in real else None

        found = [kind(x) for x in names if kind(x)]
        effective = ("rename" if wish == "replace" and "claimedInBatch" in found else wish) if found else None
        if effective == "rename":
            parts, n = [x.rpartition(".") for x in names], 2
            while any(kind(f"{a} {n}.{b}") for a, _, b in parts):
                n += 1
            names = [f"{a} {n}.{b}" for a, _, b in parts]
        if not found or effective in ("rename", "replace"):
            mine |= {x.lower() for x in names}
        stashes = [f"{dst}/.{batch[:8]}-{nth}-{i}" for i in range(len(found))] if effective == "replace" else []
        out[nth] = (effective, found, [] if effective == "skip" else [f"{dst}/{x}" for x in names], stashes)
    return out


def test_resolutions_equal_a_loop(spark):
    rng = random.Random(8)
    plan = []
    for i in range(150):
        dst, stem, ext = f"/d{rng.randint(0, 1)}", rng.choice(["a", "A", "a 2", "a 3", "b", "b 2 2"]), rng.choice(["jpg", "cr2"])
        folder = dst if rng.random() < 0.1 else f"/s/{i}"
        plan.append((i, dst, [f"{folder}/{stem}.{ext}"] + ([f"{folder}/{stem}.xmp"] if rng.random() < 0.4 else []), rng.choice([None, "skip", "rename", "rename", "replace"])))
    taken = {"/d0": {"a.jpg", "A 3.xmp", "b 2.cr2", "b.xmp"}, "/d1": {"a 2.jpg"}}
    df = spark.createDataFrame(plan, "nth long, dst_dir string, srcs array<string>, resolution string")
    occ = spark.createDataFrame([(d, x) for d, xs in taken.items() for x in xs], "parent_dir string, name string")
    got = {r.nth: (r.effective, list(r.collisions), list(r.destinations), list(r.stashes)) for r in jnl.resolve(df, occ, "12345678-9").collect()}
    assert got == resolve_loop(plan, taken, "12345678-9")


def test_no_saved_searches_have_no_counts(spark):
    assert saved.counts(spark.createDataFrame([], idx.FILES), spark.createDataFrame([], saved.SCHEMA)).collect() == []


def test_media_kinds(spark):
    kinds = {"a.RAW": "raw", "a.3fr": "raw", "a.erf": "raw", "a.heif": "heic", "a.psb": None, "a.crw": None, "a": None}
    rows = spark.createDataFrame([(k,) for k in kinds], "name string").select("name", media.media_kind(media.extension(F.col("name"))).alias("kind"))
    assert {r.name: r.kind for r in rows.collect()} == kinds


def ifd(*entries):
    """A little-endian TIFF of one directory with short, long or text values."""
    body, data, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in sorted(entries):
        if kind == 2:
            text = value.encode() + b"\0"
            body += struct.pack("<HHII", tag, 2, len(text), at + len(data)) if len(text) > 4 else struct.pack("<HHI", tag, 2, len(text)) + text.ljust(4, b"\0")
            data += text if len(text) > 4 else b""
        else:
            body += struct.pack("<HHII", tag, kind, 1, value)
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + body + b"\0" * 4 + data


EXIF = ifd((0x010F, 2, "Canon "), (0x0110, 2, "R5"), (0x0112, 3, 6), (0x0132, 2, "2020:01:02 03:04:05"))


def heic_with_properties():
    """Two items with sizes of their own, the second one primary, and an EXIF item."""
    infe = lambda i, kind: box(b"infe", b"\2\0\0\0" + struct.pack(">HH", i, 0) + kind + b"\0")
    ispe = lambda w, h: box(b"ispe", b"\0" * 4 + struct.pack(">II", w, h))
    iprp = box(b"iprp", box(b"ipco", ispe(1, 2) + ispe(4032, 3024)) + box(b"ipma", b"\0" * 4 + struct.pack(">IHBBHBB", 2, 1, 1, 1, 2, 1, 0x82)))
    note = b"\0\0\0\6Exif\0\0" + EXIF

    def build(at):
        iloc = box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">H", 1) + struct.pack(">HHHII", 3, 0, 1, at, len(note)))
        iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 3) + infe(1, b"hvc1") + infe(2, b"hvc1") + infe(3, b"Exif"))
        return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", b"\0" * 4 + box(b"pitm", b"\0\0\0\0\0\2") + iinf + iprp + iloc)

    return build(len(build(0)) + 8) + box(b"mdat", note)


def test_headers_of_more_containers(spark):
    sized = ifd((0x0100, 4, 6000), (0x0101, 4, 4000), (0x010F, 2, "Canon"), (0x0112, 3, 8))
    moment = ifd((0x9003, 2, "2021:01:01 00:00:00"), (0x9011, 2, "+01:00"))
    resource = b"8BIM" + struct.pack(">H", 0x0422) + b"\0\0" + struct.pack(">I", len(EXIF)) + EXIF + b"\0" * (len(EXIF) % 2)
    frame = segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\1")
    rows = {
        "gif": b"GIF89a" + struct.pack("<HH", 320, 200) + b"\0" * 9,
        "psd": b"8BPS\0\1" + b"\0" * 6 + struct.pack(">HIIHH", 3, 70, 90, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", len(resource)) + resource,
        "raf": b"FUJIFILMCCD-RAW ".ljust(84, b"0") + struct.pack(">II", 92, 200) + jpeg(segment(0xE1, b"Exif\0\0" + EXIF), frame),
        "cr3": box(b"ftyp", b"crx \0\0\0\1crx ") + box(b"moov", box(b"uuid", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48") + box(b"CMT1", sized) + box(b"CMT2", moment))),
        "heic": heic_with_properties(),
        "orf": b"IIRO" + sized[4:],
        "cut": heic_with_properties()[:60],
        "unsized": EXIF,
        "none": None,
    }
    got = {r.path: r for r in metadata.read_headers(spark.createDataFrame(list(rows.items()), "path string, content binary")).collect()}
    taken = 1577934245.0
    assert [tuple(got[k][1:]) for k in ("gif", "psd", "raf", "heic")] == [
        (320, 200, None, None, None, None, 1, None),
        (90, 70, taken, None, "Canon", "R5", 6, None),
        (40, 30, taken, None, "Canon", "R5", 6, None),
        (4032, 3024, taken, None, "Canon", "R5", 6, None),
    ]
    assert tuple(got["cr3"][1:]) == (6000, 4000, 1609455600.0, "+01:00", "Canon", None, 8, None)
    assert (got["orf"].width, got["orf"].height, got["orf"].error) == (6000, 4000, None)
    assert [got[k].error for k in ("cut", "unsized", "none")] == ["notAnImage", "notAnImage", "unreadable"]


def test_hostile_headers_never_raise(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        b = bytearray(heic_with_properties())
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        rows.append((str(i), bytes(b[: rng.randint(0, len(b))])))
    assert metadata.read_headers(spark.createDataFrame(rows, "path string, content binary")).count() == 400


def test_an_unknown_box_is_no_trailing_data():
    assert con.image_hash(heic(b"n", b"pixels", tail=box(b"more", b"x")), "heic") == con.image_hash(heic(b"n", b"pixels"), "heic") is not None


def test_natural_order_of_long_numbers(spark):
    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b1", "a02"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(walk.natural_key(F.col("name")), "name").collect()]
    assert got == ["a02", "a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b1"]


def test_a_hashing_pass_marks_attempts_and_leaves_the_rest(spark, tmp_path):
    row = lambda i, name, hashed_at=None: {"id": i, "path": f"/p/{name}", "parent_dir": "/p", "name": name, "ext": name[-3:], "size": 1, "mtime": 1.0, "device": 1, "inode": i, "indexed_at": 1.0, "hashed_at": hashed_at}
    index = idx.migrated(spark.createDataFrame([row(1, "a.jpg"), row(2, "b.png"), row(3, "c.jpg"), row(4, "d.jpg", 5.0)], "id long, path string, parent_dir string, name string, ext string, size long, mtime double, device long, inode long, indexed_at double, hashed_at double"))
    contents = spark.createDataFrame([("/p/a.jpg", bytes(jpeg())), ("/p/b.png", b"no image")], "path string, content binary")
    after, metrics = idx.hashing_pass(index, contents, m.Everywhere(), 9.0, ("V", 1), ("V", 1))
    got = {r.id: r for r in after.collect()}
    assert got[1].image_hash == con.image_hash(jpeg(), "jpeg") and got[1].image_hash_kind == "jpeg-scan-v1"
    assert got[2].content_hash == hashlib.sha256(b"no image").hexdigest() and got[2].image_hash is None
    assert [got[i].hashed_at for i in (1, 2, 3, 4)] == [9.0, 9.0, 9.0, 5.0] and got[3].content_hash is None
    assert tuple(metrics.first()) == (3, 2, 1)
    with pytest.raises(PermissionError):
        idx.hashing_pass(index, contents, m.Everywhere(), 9.0, ("V", 1), ("W", 1))
    assert Store(spark, str(tmp_path)).files(Store(spark, str(tmp_path)).rebuild()).count() == 0


@pytest.mark.parametrize(("lat", "lon", "action"), [("", None, "nothingToWrite"), ("12.5", " -170 ", "write"), ("91", "0", "invalid"), ("1", "", "invalid"), ("x", "1", "invalid"), ("-90", "180", "write")])
def test_typed_coordinates(spark, lat, lon, action):
    df = spark.createDataFrame([(lat, lon)], "a string, b string")
    assert df.select(edits.gps_edit(F.col("a"), F.col("b"))).first()[0] == action


def test_values_read_back(spark):
    rows = [("absent", "x", None, True), ("absent", None, "y", False), ("list", "a, b", "a,b", True), ("list", "a", "a,b", False), ("integer", "3", "03", True), ("number", "1.5", "1.5000001", True), ("number", "1.5", "1.6", False), ("text", "a", None, False), ("text", "a", "a", True)]
    df = spark.createDataFrame(rows, "kind string, want string, got string, same boolean")
    assert df.filter(edits.same_value(F.col("kind"), F.col("want"), F.col("got")) != F.col("same")).count() == 0
