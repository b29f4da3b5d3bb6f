"""The registered queries of the catalogue, each with the SQL that states the same over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dates, edits
from ..functions.hashes import hashed, phash_of
from ..functions.text import ascii_fold
from ..operators import duplicates as dup, facets as fct, index as idx, journal as jnl, model as m, saved, search as s
from ..operators.search import SORT_COLUMNS
from ..operators.vectors import top_k
from ..sources import adapters as ad, walk
from ..sources.adapters import FACTS_SQL, FILES_SQL, JOURNAL_SQL, NEXT_SQL, PHASH_SQL
from ..sources.metadata import read_headers
from ..sources.media import HASH_KINDS, RAW, is_junk, media_kind

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PAGE = ["id", "path", "width", "height", "size"]
ROW = "id, path, width, height, size"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def with_files(sql: str, *more: str) -> str:
    return f"WITH {', '.join([FILES_SQL, *more])} {sql}"


# --- search: one query for each scope and predicate -------------------------------------------------------------------

FOLD_MAKE = "translate(camera_make, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MAKE_CANON = f"{FOLD_MAKE} = 'canon'"
RANGE_SRC1 = "(path = '/lib/src1' OR (path > '/lib/src1/' AND path < '/lib/src10'))"
TWINS = "(image_hash IN (SELECT image_hash FROM files WHERE image_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) OR content_hash IN (SELECT content_hash FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
SRC1 = m.Folder("/lib/src1/")
CANON = m.CameraMake("cAnOn")
NESTED = m.And((m.Or((m.Width(m.AtLeast(1920)), m.FileExtension(("JPG", "cr2")))), m.Not(m.And((CANON, m.Not(m.CaptureDate(None, 1550000000.0)))))))
SEARCHES = {
    "scope_everywhere": (m.SearchQuery(), "true"),
    "scope_recursive": (m.SearchQuery(SRC1), RANGE_SRC1),
    "scope_shallow": (m.SearchQuery(m.Folder("/lib/src1/en", False)), "parent_dir = '/lib/src1/en'"),
    "scope_root": (m.SearchQuery(m.Folder("/")), "path = '/' OR (path > '/' AND path < '0')"),
    "pred_width": (m.SearchQuery(predicate=m.Width(m.AtLeast(1920))), "width >= 1920"),
    "pred_height": (m.SearchQuery(predicate=m.Height(m.AtMost(300))), "height <= 300"),
    "pred_size": (m.SearchQuery(predicate=m.FileSize(m.Between(3000, 1000))), "size BETWEEN 1000 AND 3000"),
    "pred_megapixels": (m.SearchQuery(predicate=m.Megapixels(m.AtLeast(6))), "CAST(width AS DOUBLE) * height / 1e6 >= 6"),
    "pred_aspect": (m.SearchQuery(predicate=m.AspectRatio(m.Between(1.3, 1.8))), "height > 0 AND CAST(width AS DOUBLE) / nullif(height, 0) BETWEEN 1.3 AND 1.8"),
    "pred_aspect_not": (m.SearchQuery(predicate=m.Not(m.AspectRatio(m.Between(1.3, 1.8)))), "(height > 0 AND CAST(width AS DOUBLE) / nullif(height, 0) BETWEEN 1.3 AND 1.8) IS NOT TRUE"),
    "pred_exact_dims": (m.SearchQuery(predicate=m.ExactDimensions(274, 256)), "width = 274 AND height = 256"),
    "pred_equal": (m.SearchQuery(predicate=m.Height(m.Equal(0))), "height = 0"),
    "pred_ext": (m.SearchQuery(predicate=m.FileExtension(("JPG", "heic"))), "ext IN ('jpg', 'heic')"),
    "pred_ext_empty": (m.SearchQuery(predicate=m.FileExtension(())), "false"),
    "pred_capture_range": (m.SearchQuery(predicate=m.CaptureDate(1500500000.0, 1501000000.0)), "capture_time BETWEEN 1500500000 AND 1501000000"),
    "pred_has_date": (m.SearchQuery(predicate=m.CaptureDate()), "capture_time IS NOT NULL"),
    "pred_modified_range": (m.SearchQuery(predicate=m.ModifiedDate(1700006000.0, None)), "mtime >= 1700006000"),
    "pred_make_nocase": (m.SearchQuery(predicate=CANON), MAKE_CANON),
    "pred_make_not_ascii": (m.SearchQuery(predicate=m.CameraMake("É-CAM")), f"{FOLD_MAKE} = 'É-cam'"),
    "pred_model_nocase": (m.SearchQuery(predicate=m.CameraModel("EOS r5")), "translate(camera_model, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'eos r5'"),
    "pred_text": (m.SearchQuery(predicate=m.FilenameText("img EN jp")), "list_contains(string_split_regex(lower(name), '[^a-z0-9]+'), 'img') AND list_contains(string_split_regex(lower(name), '[^a-z0-9]+'), 'en') AND len(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: starts_with(x, 'jp'))) > 0"),
    "pred_text_blank": (m.SearchQuery(predicate=m.FilenameText("  ")), "true"),
    "pred_text_hostile": (m.SearchQuery(predicate=m.FilenameText("***")), "false"),
    "pred_and_empty": (m.SearchQuery(predicate=m.And()), "true"),
    "pred_or_empty": (m.SearchQuery(predicate=m.Or()), "false"),
    "pred_not_null": (m.SearchQuery(predicate=m.Not(m.Width(m.AtLeast(1920)))), "(width >= 1920) IS NOT TRUE"),
    "pred_nested": (m.SearchQuery(predicate=NESTED), f"(width >= 1920 OR ext IN ('jpg', 'cr2')) AND ({MAKE_CANON} AND (capture_time IS NOT NULL AND capture_time <= 1550000000) IS NOT TRUE) IS NOT TRUE"),
    "pred_has_duplicates": (m.SearchQuery(m.Folder("/lib"), m.HasDuplicates()), f"path > '/lib/' AND path < '/lib0' AND {TWINS}"),
}


def _search(q: m.SearchQuery):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if s.texts(q.predicate):
            rows, postings = ad.library(spark, sf_dir)
            return s.matching(rows, q, postings=postings).select(*PAGE)
        return s.matching(ad.files(spark, sf_dir), q).select(*PAGE)

    return run


for _name, (_q, _where) in SEARCHES.items():
    query(_name, with_files(f"SELECT {ROW} FROM files WHERE {_where}"))(_search(_q))

FLAGSHIP = m.SearchQuery(SRC1, m.And((m.Width(m.AtLeast(1920)), m.Not(m.CameraMake("canon")))), m.Sort("captureDate", False), 50)


@query("flagship_search", with_files(f"SELECT {ROW}, capture_time FROM files WHERE {RANGE_SRC1} AND width >= 1920 AND ({MAKE_CANON}) IS NOT TRUE ORDER BY capture_time IS NULL, capture_time DESC, id LIMIT 50"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(ad.files(spark, sf_dir), FLAGSHIP, [*PAGE, "capture_time"])


def _page(name: str, q: m.SearchQuery, order: str, page: str):
    """A page with its place, as the order is the point; a unique order makes pages the same in both engines."""

    @query(name, with_files(f"SELECT id, path, row_number() OVER (ORDER BY {order}) AS place FROM (SELECT * FROM files ORDER BY {order} {page}) p"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = s.search(ad.files(spark, sf_dir), q)
        key = {"__key": ascii_fold(F.col("name"))} if q.sort.by == "name" else {}
        by = s.sort_columns(q.sort) if not key else [F.col("__key").asc_nulls_last() if q.sort.ascending else F.col("__key").desc_nulls_last(), F.col("id").asc()]
        return rows.withColumns(key).select("id", "path", F.row_number().over(Window.orderBy(*by)).cast("long").alias("place"))


ASCII_NAME = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_page("sort_name_nocase", m.SearchQuery(limit=300), f"{ASCII_NAME}, id", "LIMIT 300")
_page("sort_capture_desc_nulls_last", m.SearchQuery(sort=m.Sort("captureDate", False), limit=300), "capture_time IS NULL, capture_time DESC, id", "LIMIT 300")
_page("page_limit_offset", m.SearchQuery(sort=m.Sort("size", False), limit=40, offset=60), "size IS NULL, size DESC, id", "LIMIT 40 OFFSET 60")


@query("page_offset_only", with_files("SELECT id, path FROM files ORDER BY width IS NULL, width, id LIMIT 1000000000 OFFSET 100"))
def page_offset_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(ad.files(spark, sf_dir), m.SearchQuery(sort=m.Sort("width"), offset=100), ["id", "path"])


@query("lookup_by_path", with_files("SELECT id, path FROM files WHERE path = (SELECT max(path) FROM files)"))
def lookup_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.files(spark, sf_dir)
    return s.by_path(rows, rows.agg(F.max("path")).first()[0]).select("id", "path")


@query("paths_in_scope", with_files(f"SELECT path FROM files WHERE {RANGE_SRC1}"))
def paths_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.matching(ad.files(spark, sf_dir), m.SearchQuery(SRC1)).select("path")


@query("lookup_by_ids", with_files(f"SELECT {ROW} FROM files WHERE id IN (SELECT l.doc_id + 1 FROM labels l WHERE quality = 0)"))
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select((F.col("doc_id") + 1).alias("id"))
    return s.by_ids(ad.files(spark, sf_dir), ids).select(*PAGE)


@query("path_parts", with_files("SELECT id, parent_dir, name, ext, to_timestamp(mtime) AT TIME ZONE 'UTC' AS modified FROM files"))
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = walk.split_path(F.col("path"))
    return ad.files(spark, sf_dir).select("id", *[parts[c].alias(c) for c in ("parent_dir", "name", "ext")], F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")).alias("modified"))


# --- walk --------------------------------------------------------------------------------------------------------------

PAGE_PATHS = "SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', concat('/w/', CASE page_id % 9 WHEN 0 THEN '.hidden' WHEN 1 THEN 'Old.PhotosLibrary' WHEN 2 THEN 'my.app' ELSE 'pics' END)) || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.nef' ELSE '.heic' END AS path FROM pages"


@query("walk_media", f"WITH p AS ({PAGE_PATHS}) SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN 'jpeg' WHEN 2 THEN 'raw' WHEN 3 THEN 'heic' END AS media FROM p WHERE page_id % 9 > 2 AND page_id % 4 <> 1 AND NOT regexp_matches(path, '/\\.')")
def walk_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk's filters over paths made of the pages' addresses."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.select("page_id", "url").createOrReplaceTempView("tessera_pages")
    paths = spark.sql(PAGE_PATHS.replace("FROM pages", "FROM tessera_pages").replace("^[a-z]+://[^/]*", "^[a-z]+://[^/]*"))
    return walk.walked(paths).select("page_id", "path", "media")


@query("folder_children", with_files("SELECT name, count(*) AS files FROM (SELECT split_part(substr(path, 6), '/', 1) AS name FROM files WHERE starts_with(path, '/lib/')) t GROUP BY name"))
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.folder_children(ad.files(spark, sf_dir), "/lib")


@query("cache_evictions", with_files("SELECT CAST(id AS VARCHAR) AS key, size, mtime AS modified FROM (SELECT id, size, mtime, sum(size) OVER (ORDER BY mtime DESC, CAST(id AS VARCHAR)) AS held, row_number() OVER (ORDER BY mtime DESC, CAST(id AS VARCHAR)) AS n FROM files) WHERE held > 400000 AND n > 1"))
def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.files(spark, sf_dir).select(F.col("id").cast("string").alias("key"), "size", F.col("mtime").alias("modified"))
    return walk.evictions(rows, 400_000)


@query("directory_loops", with_files("SELECT path, CASE WHEN path <> first THEN 'symlinkLoop' WHEN err = 'EACCES' THEN 'unreadable' WHEN err = 'EIO' THEN 'unstatable' END AS reason, err IS NULL AND path = first AS entered FROM (SELECT path, err, min(path) OVER (PARTITION BY device, ino) AS first FROM (SELECT path, device, id % 700 AS ino, CASE id % 29 WHEN 3 THEN 'EACCES' WHEN 4 THEN 'ENOENT' WHEN 5 THEN 'EIO' END AS err FROM files))"))
def directory_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = ad.files(spark, sf_dir).select("path", "device", (F.col("id") % 700).alias("inode"), F.expr("CASE id % 29 WHEN 3 THEN 'EACCES' WHEN 4 THEN 'ENOENT' WHEN 5 THEN 'EIO' END").alias("error"))
    return walk.first_seen_directories(dirs).select("path", "reason", "entered")


# --- facets ------------------------------------------------------------------------------------------------------------

WIDE = m.SearchQuery(m.Folder("/lib"), m.Width(m.AtLeast(1000)), limit=5, offset=3)
WIDE_SQL = "path > '/lib/' AND path < '/lib0' AND width >= 1000"


def _facet(name: str, facet: str, sql: str):
    @query(name, with_files(sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fct.facets(ad.files(spark, sf_dir), WIDE).filter(F.col("facet") == facet)
        return out.select("n") if facet == "total" else out.select("bucket", "n")


_facet("facet_ext", "ext", f"SELECT ext AS bucket, count(*) AS n FROM files WHERE {WIDE_SQL} AND ext <> '' GROUP BY 1")
_facet("facet_make", "camera_make", f"SELECT camera_make AS bucket, count(*) AS n FROM files WHERE {WIDE_SQL} AND camera_make <> '' GROUP BY 1")
_facet("facet_total", "total", f"SELECT count(*) AS n FROM files WHERE {WIDE_SQL}")


@query("facet_self_excluding", with_files(f"SELECT 'ext' AS facet, ext AS bucket, count(*) AS n FROM files WHERE {WIDE_SQL} GROUP BY ext UNION ALL SELECT 'camera_make', camera_make, count(*) FROM files WHERE {WIDE_SQL} AND ext IN ('jpg', 'png') AND camera_make <> '' GROUP BY camera_make UNION ALL SELECT 'total', NULL, count(*) FROM files WHERE {WIDE_SQL} AND ext IN ('jpg', 'png')"))
def facet_self_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fct.self_excluding_ext(ad.files(spark, sf_dir), WIDE, ["jpg", "PNG"])


AGREE = "CASE WHEN min(coalesce({c}, '')) = max(coalesce({c}, '')) THEN nullif(min(coalesce({c}, '')), '') ELSE '<mixed>' END"
OFFSET_OK = "CASE WHEN regexp_matches(capture_offset, '^[+-][0-9][0-9]:[0-9][0-9]$') THEN capture_offset END"


@query("selection_agreement", with_files(f"SELECT parent_dir, id % 45 AS pick, {AGREE.format(c='camera_make')} AS make, {AGREE.format(c='camera_model')} AS model, CASE WHEN min({OFFSET_OK}) = max({OFFSET_OK}) THEN min({OFFSET_OK}) END AS \"offset\", count(*) FILTER (WHERE ext = 'cr2') AS raw_files, count(*) AS files FROM files GROUP BY parent_dir, pick"))
def selection_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of each folder agree on, in 45 selections of each."""
    return fct.selection_summary(ad.files(spark, sf_dir).groupBy("parent_dir", (F.col("id") % 45).alias("pick")), RAW)


@query("missing_hashes", with_files("SELECT parent_dir, count(*) AS n FROM files WHERE hashed_at IS NULL AND path > '/lib/' AND path < '/lib0' GROUP BY parent_dir"))
def missing_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.files(spark, sf_dir).filter(F.col("hashed_at").isNull() & s.scope_filter(m.Folder("/lib")))
    return rows.groupBy("parent_dir").agg(F.count("*").alias("n"))


@query("hash_queue", with_files("SELECT id, path FROM files WHERE hashed_at IS NULL ORDER BY id LIMIT 64"))
def hash_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.not_hashed(ad.files(spark, sf_dir), m.Everywhere(), 64).select("id", "path")


QUEUED = "hashed_at IS NULL AND path > '/lib/' AND path < '/lib0'"


@query("hashing_pass", with_files(f"SELECT id, CASE WHEN {QUEUED} THEN CASE WHEN id % 50 <> 4 THEN sha256(text) END ELSE content_hash END AS content_hash, CASE WHEN NOT ({QUEUED}) THEN image_hash END AS image_hash, CASE WHEN {QUEUED} THEN 1800000000.0::DOUBLE ELSE hashed_at END AS hashed_at FROM files JOIN docs ON i = id - 1"))
def hashing_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts as files' contents; every fifth queued file can't be read. A text is no image, so it has no image hash."""
    index, docs = ad.files(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select((F.col("doc_id") + 1).alias("id"), F.when((F.col("doc_id") + 1) % 50 != 4, F.col("text").cast("binary")).alias("content"))
    volume = ("VOL-B", 2)
    after, _ = idx.hashing_pass(index, index.select("id", "path").join(texts, "id"), m.Folder("/lib"), 1.8e9, volume, volume)
    return after.select("id", "content_hash", "image_hash", "hashed_at")


@query("display_order", with_files("SELECT id, size, row_number() OVER (ORDER BY size IS NULL, size DESC, id) AS place FROM files WHERE id IN (SELECT user_id FROM events)"))
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that events name, largest first, with their places."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"))
    return s.placed(s.by_ids(ad.files(spark, sf_dir), ids), m.Sort("size", False)).select("id", "size", "place")


@query("page_deep", with_files("SELECT id, path, place FROM (SELECT id, path, row_number() OVER (ORDER BY capture_time IS NULL, capture_time, id) AS place, count(*) OVER () AS n FROM files) WHERE place > n // 2 AND place <= n // 2 + 100"))
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows from the middle of an order, with their places."""
    rows = ad.files(spark, sf_dir)
    half = rows.count() // 2
    return s.placed(rows, m.Sort("captureDate"), half, half + 100).select("id", "path", "place")


@query("volume_identity", with_files("SELECT f.id, CASE WHEN f.volume_uuid IS NOT NULL THEN f.volume_uuid IS NOT DISTINCT FROM w.volume_uuid ELSE f.device = w.device END AS same FROM files f JOIN walked w ON f.path = w.path", NEXT_SQL))
def volume_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each file that is walked again is on the volume it was on."""
    index = ad.files(spark, sf_dir)
    now = ad.next_generation(index).select("path", F.col("volume_uuid").alias("now_uuid"), F.col("device").alias("now_device"))
    same = idx.same_volume(F.col("volume_uuid"), F.col("device"), F.col("now_uuid"), F.col("now_device"))
    return index.join(now, "path").select("id", same.alias("same"))


# --- upkeep ------------------------------------------------------------------------------------------------------------


@query("freshness_diff", with_files("SELECT w.path, CASE WHEN f.path IS NULL THEN 'new' WHEN f.size <> w.size OR f.mtime <> w.mtime THEN 'changed' ELSE 'fresh' END AS state FROM walked w LEFT JOIN files f USING (path)", NEXT_SQL))
def freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.needs_reindex(ad.next_generation(index), index)


@query("generation_diff", with_files("SELECT path, CASE WHEN f.path IS NULL THEN 'insert' WHEN w.path IS NULL THEN 'delete' WHEN f.size <> w.size OR f.mtime <> w.mtime THEN 'update' ELSE 'unchanged' END AS change FROM walked w FULL JOIN files f USING (path)", NEXT_SQL))
def generation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.diff(ad.next_generation(index), index)


UPSERT_SQL = """merged AS (SELECT f.id AS fid, coalesce(f.path, w.path) AS path, coalesce(w.volume_uuid, f.volume_uuid) AS volume_uuid, CASE WHEN w.path IS NULL THEN f.mtime ELSE w.mtime END AS mtime, CASE WHEN w.path IS NULL THEN f.width ELSE w.width END AS width,
CASE WHEN f.path IS NOT NULL AND w.path IS NOT NULL AND (f.size <> w.size OR f.mtime <> w.mtime) THEN NULL WHEN f.path IS NOT NULL THEN f.content_hash ELSE w.content_hash END AS content_hash FROM files f FULL JOIN walked w ON f.path = w.path),
upserted AS (SELECT coalesce(fid, (SELECT max(id) FROM files) + row_number() OVER (PARTITION BY fid IS NULL ORDER BY path)) AS id, path, volume_uuid, mtime, width, content_hash FROM merged)"""


@query("upsert_merge", with_files("SELECT * FROM upserted", NEXT_SQL, UPSERT_SQL))
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.upsert(index, ad.next_generation(index)).select("id", "path", "volume_uuid", "mtime", "width", "content_hash")


TEXT_AFTER = "SELECT id, path FROM (SELECT *, regexp_replace(path, '.*/', '') AS name FROM upserted) WHERE " + SEARCHES["pred_text"][1]


@query("text_after_upsert", with_files(TEXT_AFTER, NEXT_SQL, UPSERT_SQL))
def text_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up in a generation into which a later walk was merged."""
    rows, postings = ad.library(spark, sf_dir, 2)
    return s.matching(rows, SEARCHES["pred_text"][0], postings=postings).select("id", "path")


@query("text_after_prune", with_files(TEXT_AFTER + " AND path IN (SELECT path FROM walked)", NEXT_SQL, UPSERT_SQL))
def text_after_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up in the generation after that, without the files that weren't found."""
    rows, postings = ad.library(spark, sf_dir, 3)
    return s.matching(rows, SEARCHES["pred_text"][0], postings=postings).select("id", "path")


WRITES = "SELECT id, path, size, CASE WHEN id % 5 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN id % 4 <> 0 THEN concat('h', id) END AS h FROM files WHERE id % 3 = 0"


@query("guarded_hash_write", with_files(f"SELECT f.id, CASE WHEN w.id IS NULL THEN f.content_hash ELSE w.h END AS content_hash, CASE WHEN w.id IS NULL THEN f.hashed_at ELSE 1 END AS hashed_at, w.id IS NOT NULL AS landed FROM files f LEFT JOIN ({WRITES}) w ON f.id = w.id AND f.path = w.path AND f.size = w.size AND f.mtime = w.mtime"))
def guarded_hash_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    writes = index.filter("id % 3 = 0").select("id", "path", "size", F.expr("CASE WHEN id % 5 = 0 THEN mtime + 1 ELSE mtime END").alias("mtime"), F.expr("CASE WHEN id % 4 <> 0 THEN concat('h', id) END").alias("content_hash"), *[F.lit(None).cast("string").alias(c) for c in ("image_hash", "image_hash_kind", "phash")], F.lit(1.0).alias("hashed_at"))
    out = idx.guarded_hash_write(index, writes)
    bad = idx.refused(index, writes).select(F.col("id").alias("bad"))
    tried = F.col("id") % 3 == 0
    return out.join(bad, F.col("id") == F.col("bad"), "left").select("id", "content_hash", "hashed_at", (tried & F.col("bad").isNull()).alias("landed"))


@query("metadata_write_back", with_files("SELECT id, CASE WHEN id % 6 = 0 THEN size + 7 ELSE size END AS size, CASE WHEN id % 6 = 0 THEN 'Edited' ELSE camera_make END AS camera_make, CASE WHEN id % 6 = 0 THEN NULL ELSE content_hash END AS content_hash FROM files"))
def metadata_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    new = index.filter("id % 2 = 0").withColumns({"new_size": F.col("size") + 7, "new_mtime": F.col("mtime") + 1, "new_inode": F.col("inode"), "camera_make": F.lit("Edited"), "content_hash": F.lit(None).cast("string"), "mtime": F.expr("CASE WHEN id % 3 = 0 THEN mtime ELSE mtime - 1 END")})
    return idx.metadata_write_back(index, new).select("id", "size", "camera_make", "content_hash")


@query("volume_stamp", with_files("SELECT id, CASE WHEN id % 2 = 0 THEN 'VOL-B' ELSE volume_uuid END AS volume_uuid, CASE WHEN id % 2 = 0 THEN 2 ELSE device END AS device, id % 2 = 0 AND (volume_uuid IS DISTINCT FROM 'VOL-B' OR device <> 2) AS changed FROM files"))
def volume_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.volume_stamp(index, index.filter("id % 2 = 0").select("path"), "VOL-B", 2).select("id", "volume_uuid", F.col("device").cast("long").alias("device"), "changed")


@query("prune_recursive", with_files("SELECT id, path FROM files f WHERE NOT ((path > '/lib/' AND path < '/lib0') AND (volume_uuid = 'VOL-A' OR (volume_uuid IS NULL AND device = 1)) IS TRUE AND path NOT IN (SELECT path FROM walked))", NEXT_SQL))
def prune_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.prune(index, ad.next_generation(index), m.Folder("/lib"), "VOL-A", 1).select("id", "path")


@query("prune_shallow", with_files("SELECT id, path FROM files WHERE NOT (parent_dir = '/lib/src3/en' AND volume_uuid IS NULL AND device = 2 AND path NOT IN (SELECT path FROM walked))", NEXT_SQL))
def prune_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ad.files(spark, sf_dir)
    return idx.prune(index, ad.next_generation(index), m.Folder("/lib/src3/en", False), None, 2).select("id", "path")


@query("protected_rows", with_files("SELECT id, path FROM files WHERE starts_with(path, '/lib/src1/') OR starts_with(path, '/lib/src5/de/')"))
def protected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([("/lib/src1",), ("/lib/src5/de",)], "path string")
    return idx.at_or_under(ad.files(spark, sf_dir), places).select("id", "path")


RECONCILED_SQL = """w2 AS (SELECT * FROM walked WHERE path NOT LIKE '/lib/src2/%'),
chg AS (SELECT w.* FROM w2 w LEFT JOIN files f ON f.path = w.path WHERE f.path IS NULL OR f.size <> w.size OR f.mtime <> w.mtime),
mrg AS (SELECT f.id AS fid, coalesce(f.path, c.path) AS path, coalesce(c.volume_uuid, f.volume_uuid) AS vu, coalesce(f.device, c.device) AS dev, f.path IS NOT NULL AND c.path IS NOT NULL AND (f.size <> c.size OR f.mtime <> c.mtime) AS gone, f.content_hash AS fh, c.content_hash AS ch, f.path IS NULL AS fresh FROM files f FULL JOIN chg c ON f.path = c.path),
nxt AS (SELECT m.path, CASE WHEN gone THEN NULL WHEN fresh THEN ch ELSE fh END AS content_hash, CASE WHEN w2.path IS NOT NULL THEN 'VOL-A' ELSE vu END AS vu, CASE WHEN w2.path IS NOT NULL THEN 1 ELSE dev END AS dev, w2.path IS NOT NULL AS kept FROM mrg m LEFT JOIN w2 ON w2.path = m.path)"""


@query("reconcile_pass", with_files("SELECT path, content_hash, vu AS volume_uuid FROM nxt WHERE NOT ((path > '/lib/' AND path < '/lib0') AND (vu = 'VOL-A' OR (vu IS NULL AND dev = 1)) IS TRUE AND NOT kept AND path NOT LIKE '/lib/src2/%')", NEXT_SQL, RECONCILED_SQL))
def reconcile_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole tier-0 pass in which one folder couldn't be read: its rows stay."""
    index = ad.files(spark, sf_dir)
    walked = ad.next_generation(index).filter(~F.col("path").startswith("/lib/src2/"))
    skipped = spark.createDataFrame([("/lib/src2", "unreadable")], "path string, reason string")
    out, _ = idx.reconcile(index, walked, skipped, m.Folder("/lib"), "VOL-A", 1, ("VOL-A", 1), ("VOL-A", 1))
    return out.select("path", "content_hash", "volume_uuid")


@query("index_integrity", with_files("SELECT CAST(0 AS BIGINT) AS nulls, (SELECT count(*) FROM (SELECT id FROM files GROUP BY id HAVING count(*) > 1)) AS twice_id, (SELECT count(*) FROM (SELECT path FROM files GROUP BY path HAVING count(*) > 1)) AS twice_path, (SELECT count(*) = count(DISTINCT id) AND count(*) = count(DISTINCT path) FROM files) AS ok"))
def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idx.integrity(ad.files(spark, sf_dir)).withColumn("nulls", F.col("nulls").cast("long"))


# --- duplicates --------------------------------------------------------------------------------------------------------

SCOPE = m.SearchQuery(m.Folder("/lib"))
SCOPED = "scoped AS (SELECT *, CASE WHEN image_hash IS NOT NULL THEN concat('i', image_hash) WHEN content_hash IS NOT NULL THEN concat('c', content_hash) END AS k FROM files WHERE path > '/lib/' AND path < '/lib0')"
CANDS = "cands AS (SELECT *, struct_pack(n := lower(name), p := path) AS place FROM scoped WHERE k IN (SELECT k FROM scoped WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1))"
GROUPED = """heads AS (SELECT k, min(place) AS head, arg_min(image_hash_kind, place) AS kind FROM cands GROUP BY k), groups AS (SELECT k, kind, row_number() OVER (ORDER BY head) AS group_no FROM heads),
firsts AS (SELECT k, content_hash, dense_rank() OVER (PARTITION BY k ORDER BY min(place)) AS copy_no FROM cands GROUP BY k, content_hash)"""


@query("exact_candidates", with_files("SELECT id, path, substr(k, 1, 1) AS ns, substr(k, 2) AS hash FROM cands", SCOPED, CANDS))
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.exact_candidates(s.matching(ad.files(spark, sf_dir), SCOPE)).select("id", "path", F.col("key.ns").alias("ns"), F.col("key.hash").alias("hash"))


@query("exact_groups", with_files("SELECT group_no, kind, row_number() OVER (PARTITION BY cands.k ORDER BY place) AS file_no, id, path FROM cands JOIN groups ON cands.k = groups.k", SCOPED, CANDS, GROUPED))
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.exact_groups(s.matching(ad.files(spark, sf_dir), SCOPE)).select("group_no", "kind", F.col("file_no").cast("long").alias("file_no"), "id", "path")


@query("copy_subgroups", with_files("SELECT group_no, copy_no, cands.content_hash, count(*) AS files, min(path) AS first_path FROM cands JOIN groups ON cands.k = groups.k JOIN firsts ON firsts.k = cands.k AND firsts.content_hash IS NOT DISTINCT FROM cands.content_hash GROUP BY ALL", SCOPED, CANDS, GROUPED))
def copy_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dup.exact_groups(s.matching(ad.files(spark, sf_dir), SCOPE))
    return rows.groupBy("group_no", F.col("copy_no").cast("long").alias("copy_no"), "content_hash").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


NEAR = """near AS (SELECT id, struct_pack(n := lower(name), p := path) AS place, hi, lo, CASE WHEN image_hash IS NOT NULL THEN concat('i', image_hash) WHEN content_hash IS NOT NULL THEN concat('c', content_hash) END AS k FROM files JOIN halves ON pid = id WHERE id <> 6),
pairs AS (SELECT a.id AS a, b.id AS b, a.place AS pa, b.place AS pb, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM near a JOIN near b ON a.place < b.place AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12 AND (a.k = b.k) IS NOT TRUE)"""


@query("near_pairs", with_files("SELECT a, b, distance FROM pairs", PHASH_SQL, NEAR))
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.near_pairs(ad.files(spark, sf_dir, with_phash=True)).select("a", "b", F.col("distance").cast("int").alias("distance"))


STAR = """RECURSIVE {files}, {phash}, {near},
ord AS (SELECT id, row_number() OVER (ORDER BY place) AS r FROM near), er AS (SELECT x.r AS ra, y.r AS rb, distance FROM pairs JOIN ord x ON x.id = a JOIN ord y ON y.id = b),
earlier AS (SELECT rb AS r, list(ra) AS e FROM er GROUP BY rb), steps AS (SELECT ord.r, e FROM ord LEFT JOIN earlier ON earlier.r = ord.r),
w(r, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT steps.r, CASE WHEN e IS NOT NULL AND list_has_any(e, seeds) THEN seeds ELSE list_append(seeds, steps.r) END FROM w JOIN steps ON steps.r = w.r + 1),
seeds AS (SELECT unnest(seeds) AS r FROM w WHERE w.r = (SELECT max(r) FROM ord)), claims AS (SELECT rb, min(ra) AS ra FROM er WHERE ra IN (SELECT r FROM seeds) AND rb NOT IN (SELECT r FROM seeds) GROUP BY rb),
found AS (SELECT claims.ra, claims.rb, distance FROM claims JOIN er ON er.ra = claims.ra AND er.rb = claims.rb)"""


@query("near_star_cover", f"WITH {STAR.format(files=FILES_SQL, phash=PHASH_SQL, near=NEAR)} SELECT dense_rank() OVER (ORDER BY found.ra) AS group_no, x.id AS seed_id, row_number() OVER (PARTITION BY found.ra ORDER BY distance, found.rb) AS match_no, y.id AS match_id, distance FROM found JOIN ord x ON x.r = found.ra JOIN ord y ON y.r = found.rb")
def near_star_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.near_groups(ad.files(spark, sf_dir, with_phash=True)).select("group_no", "seed_id", "match_no", "match_id", F.col("distance").cast("int").alias("distance"))


@query("near_ceiling_count", with_files("SELECT count(*) + 1 AS with_phash, count(*) + 1 > 500 AS refused FROM near", PHASH_SQL, NEAR))
def near_ceiling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have a perceptual hash, malformed ones included, and whether a ceiling of 500 refuses the near tier."""
    return ad.files(spark, sf_dir, with_phash=True).agg(dup.near_tier(500).alias("x")).select("x.*")


@query("duplicates_of_file", with_files("SELECT id, path FROM scoped_all WHERE k = (SELECT k FROM scoped_all WHERE id = (SELECT * FROM asked)) AND id <> (SELECT * FROM asked)", "scoped_all AS (SELECT *, CASE WHEN image_hash IS NOT NULL THEN concat('i', image_hash) WHEN content_hash IS NOT NULL THEN concat('c', content_hash) END AS k FROM files), asked AS (SELECT min(id) FROM scoped_all WHERE k IN (SELECT k FROM scoped_all GROUP BY k HAVING count(*) > 1))"))
def duplicates_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twins of the first file that has any."""
    rows = ad.files(spark, sf_dir)
    return dup.duplicates_of(rows, dup.exact_candidates(rows).agg(F.min("id")).first()[0] or 0).select("id", "path")


# --- journal -----------------------------------------------------------------------------------------------------------

GOOD = "good AS (SELECT * FROM journal WHERE kind IN ('move', 'copy', 'trash', 'delete') AND state IN ('in_flight', 'complete', 'failed', 'skipped', 'reconciled'))"


def with_journal(sql: str, *more: str) -> str:
    return f"WITH {', '.join([JOURNAL_SQL, *more])} {sql}"


@query("journal_latest_batch", with_journal("SELECT batch_id FROM journal ORDER BY op_id DESC LIMIT 1"))
def journal_latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.latest_batch(ad.journal(spark, sf_dir))


@query("journal_in_state", with_journal("SELECT op_id, batch_id FROM good WHERE state = 'in_flight'", GOOD))
def journal_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.in_state(ad.journal(spark, sf_dir), "in_flight").select("op_id", "batch_id")


@query("journal_append", with_journal("SELECT op_id, batch_id, src, state FROM journal UNION ALL SELECT (SELECT max(op_id) FROM journal) + row_number() OVER (ORDER BY doc_id), 'new', concat('/lib/', doc_id), 'in_flight' FROM labels WHERE quality = 0"))
def journal_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that trashes the files of all low-quality labels."""
    low = dup.group_numbers(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id"), "doc_id", "nth")
    drafts = low.select("nth", F.lit("new").alias("batch_id"), F.lit("trash").alias("kind"), F.concat(F.lit("/lib/"), F.col("doc_id").cast("string")).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1.7e9).alias("timestamp"))
    return jnl.append(ad.journal(spark, sf_dir), drafts).select("op_id", "batch_id", "src", "state")


@query("journal_outcomes", with_journal("SELECT batch_id, " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x}" for x in jnl.STATES) + " FROM journal GROUP BY batch_id"))
def journal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.outcome_counts(ad.journal(spark, sf_dir))


@query("journal_undoability", with_journal("""SELECT batch_id, arg_min(kind, op_id) FILTER (WHERE NOT (kind = 'trash' AND dst IS NOT NULL)) AS kind, count(*) FILTER (WHERE state = 'complete') AS items,
CASE WHEN count(*) FILTER (WHERE kind = 'delete') > 0 THEN 'permanentDelete' WHEN count(*) FILTER (WHERE state = 'in_flight') > 0 THEN concat('unsettled(', count(*) FILTER (WHERE state = 'in_flight'), ')') WHEN count(*) FILTER (WHERE state = 'reconciled') > 0 THEN 'reconciled'
WHEN count(*) FILTER (WHERE state = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE state = 'complete') = 0 THEN 'nothingToUndo' END AS refusal FROM good GROUP BY batch_id""", GOOD))
def journal_undoability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.undoability(ad.journal(spark, sf_dir))


@query("journal_undo_steps", with_journal("SELECT batch_id, op_id, CASE kind WHEN 'move' THEN 'move' WHEN 'copy' THEN 'trash' ELSE 'restore' END AS action, CASE WHEN kind = 'trash' THEN coalesce(trash_url, dst) ELSE dst END AS source, CASE WHEN kind <> 'copy' THEN src END AS target FROM good WHERE state = 'complete' AND kind <> 'delete'", GOOD))
def journal_undo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.undo_steps(ad.journal(spark, sf_dir))


@query("journal_undo_checks", with_journal("""SELECT g.op_id, CASE WHEN f.path IS NULL THEN CASE WHEN kind = 'trash' THEN 'trashEmptied' ELSE 'sourceVanished' END WHEN k.path IS NOT NULL AND (k.size <> f.size OR k.mtime <> f.mtime) THEN 'modifiedSinceOperation' WHEN t.path IS NOT NULL THEN 'destinationNotReplaceable' END AS problem
FROM (SELECT *, CASE WHEN kind = 'trash' THEN coalesce(trash_url, dst) ELSE dst END AS source, CASE WHEN kind <> 'copy' THEN src END AS target FROM good WHERE state = 'complete' AND kind <> 'delete') g LEFT JOIN facts f ON f.path = g.source LEFT JOIN known k ON k.path = g.source LEFT JOIN facts t ON t.path = g.target""", GOOD, FACTS_SQL))
def journal_undo_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.undo_checks(jnl.undo_steps(ad.journal(spark, sf_dir)), ad.facts(spark, sf_dir), ad.known(spark, sf_dir)).select("op_id", "problem")


@query("journal_retention", with_journal("""SELECT op_id, batch_id, state FROM journal WHERE state = 'in_flight' OR batch_id IN (SELECT batch_id FROM (SELECT batch_id, newest, row_number() OVER (ORDER BY newest DESC, batch_id DESC) AS rn FROM (SELECT batch_id, max(timestamp) AS newest FROM journal GROUP BY batch_id)) WHERE rn <= 200 AND (rn = 1 OR newest >= 1712642400 - 30 * 86400))"""))
def journal_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.retained(ad.journal(spark, sf_dir), 1712642400.0).select("op_id", "batch_id", "state")


OFF = "(i.size <> d.size OR abs(i.mtime - d.mtime) > 2)"
SRC_STALE = "(i.path IS NOT NULL AND (s.path IS NULL OR i.inode <> s.inode OR i.size <> s.size OR i.mtime <> s.mtime))"
DST_STALE = "(j.path IS NOT NULL AND (d.path IS NULL OR j.inode <> d.inode OR j.size <> d.size OR j.mtime <> d.mtime))"
DECIDED = f"""dec AS (SELECT g.op_id, g.dst, CASE WHEN kind IN ('move', 'copy') AND g.dst IS NULL THEN 'malformed|' WHEN kind = 'move' THEN CASE WHEN s.path IS NOT NULL AND d.path IS NULL THEN 'neverHappened|' WHEN s.path IS NULL AND d.path IS NULL THEN
concat('goneFromBoth|', CASE WHEN {SRC_STALE} AND {DST_STALE} THEN 'drop_both' WHEN {SRC_STALE} THEN 'drop_src' WHEN {DST_STALE} THEN 'drop_dst' ELSE '' END)
WHEN s.path IS NULL THEN CASE WHEN i.path IS NULL THEN 'happened|' WHEN {OFF} THEN concat('destinationDiffersFromTheSource|', CASE WHEN {SRC_STALE} THEN 'drop_src' ELSE '' END) WHEN j.path IS NOT NULL THEN concat('happened|', CASE WHEN {SRC_STALE} THEN 'drop_src' ELSE '' END) ELSE 'happened|move_row' END
ELSE CASE WHEN i.path IS NULL THEN 'copyDoneDeleteNot|' WHEN {OFF} THEN 'destinationDiffersFromTheSource|' WHEN j.path IS NULL THEN 'copyDoneDeleteNot|insert_dst' ELSE 'copyDoneDeleteNot|' END END
WHEN kind = 'copy' THEN CASE WHEN d.path IS NULL THEN 'neverHappened|' WHEN i.path IS NULL THEN 'happened|' WHEN {OFF} THEN 'destinationDiffersFromTheSource|' WHEN j.path IS NULL THEN 'happened|insert_dst' ELSE 'happened|' END
ELSE concat(CASE WHEN kind = 'trash' AND g.dst IS NOT NULL AND d.path IS NOT NULL THEN 'inStash' WHEN kind = 'trash' AND g.dst IS NOT NULL AND t.path IS NOT NULL THEN 'inTrash' WHEN s.path IS NOT NULL THEN 'neverHappened' WHEN kind = 'trash' AND g.dst IS NULL AND g.trash_url IS NOT NULL THEN 'inTrash' WHEN kind = 'trash' THEN 'trashedUnderAnUnknownName' ELSE 'happened' END, '|', CASE WHEN {SRC_STALE} THEN 'drop_src' ELSE '' END) END AS x
FROM good g LEFT JOIN facts s ON s.path = g.src LEFT JOIN facts d ON d.path = g.dst LEFT JOIN known i ON i.path = g.src LEFT JOIN known j ON j.path = g.dst LEFT JOIN facts t ON t.path = g.trash_url WHERE state = 'in_flight'),
dec2 AS (SELECT op_id, dst, split_part(x, '|', 1) AS conclusion, nullif(split_part(x, '|', 2), '') AS correction FROM dec),
dec3 AS (SELECT *, CASE WHEN correction IN ('move_row', 'insert_dst') THEN min(CASE WHEN correction IN ('move_row', 'insert_dst') THEN op_id END) OVER (PARTITION BY dst) END AS winner FROM dec2)"""


@query("journal_reconcile", with_journal("SELECT op_id, CASE WHEN winner < op_id THEN 'destinationClaimedByAnotherRow' ELSE conclusion END AS conclusion, CASE WHEN winner < op_id THEN NULL ELSE correction END AS correction, CASE WHEN winner < op_id THEN winner END AS claimed_by FROM dec3", GOOD, FACTS_SQL, DECIDED))
def journal_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jnl.conclusions(ad.journal(spark, sf_dir), ad.known(spark, sf_dir), ad.facts(spark, sf_dir))


@query("journal_settled", with_journal("SELECT j.op_id, CASE WHEN d.conclusion <> 'malformed' THEN 'reconciled' ELSE j.state END AS state FROM journal j LEFT JOIN dec3 d ON d.op_id = j.op_id", GOOD, FACTS_SQL, DECIDED))
def journal_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ad.journal(spark, sf_dir)
    return jnl.settled(j, jnl.conclusions(j, ad.known(spark, sf_dir), ad.facts(spark, sf_dir))).select("op_id", "state")


@query("journal_reconcile_summary", with_journal("SELECT count(*) AS examined, count(*) FILTER (WHERE conclusion <> 'malformed') AS reconciled, count(*) FILTER (WHERE conclusion = 'malformed') AS unresolved, count(CASE WHEN winner < op_id THEN NULL ELSE correction END) AS corrections, CASE WHEN count(*) = 0 THEN 'emptyJournal' ELSE 'done' END AS disposition FROM dec3", GOOD, FACTS_SQL, DECIDED))
def journal_reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ad.journal(spark, sf_dir)
    return jnl.reconcile_summary(j, jnl.conclusions(j, ad.known(spark, sf_dir), ad.facts(spark, sf_dir)))


# --- planning ----------------------------------------------------------------------------------------------------------

PLAN = "SELECT id AS nth, CASE WHEN id % 10 = 7 THEN concat(dst_dir, '/', upper(name)) ELSE path END AS src, dst_dir, name, CASE id % 5 WHEN 1 THEN 'skip' WHEN 2 THEN 'rename' WHEN 3 THEN 'replace' END AS resolution FROM (SELECT id, path, concat('/dest/', CAST(id % 3 AS STRING)) AS dst_dir, concat(CASE WHEN id % 2 = 0 THEN 'Photo' ELSE 'photo' END, CAST(id % 40 AS STRING), '.', ext) AS name FROM {files} WHERE id % 4 <> 0) AS p"
OCCUPANTS = "SELECT DISTINCT concat('/dest/', CAST(id % 3 AS STRING)) AS parent_dir, concat('PHOTO', CAST(id % 25 AS STRING), CASE WHEN id % 5 = 0 THEN ' 2' ELSE '' END, '.', ext) AS name FROM {files} WHERE id % 4 = 0"


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ad.files(spark, sf_dir).createOrReplaceTempView("tessera_files")
    return spark.sql(PLAN.format(files="tessera_files")), spark.sql(OCCUPANTS.format(files="tessera_files"))


PLAN_SQL = f"plan AS ({PLAN.format(files='files').replace('STRING', 'VARCHAR')}), occ AS ({OCCUPANTS.format(files='files').replace('STRING', 'VARCHAR')})"


@query("collisions_occupied", with_files("""SELECT nth, name, CASE WHEN own THEN NULL WHEN nth > min(CASE WHEN own OR NOT occupied OR resolution = 'replace' THEN nth END) OVER (PARTITION BY dst_dir, lower(name)) THEN 'claimedInBatch' WHEN occupied THEN 'occupied' END AS collision FROM met""", PLAN_SQL,
"met AS (SELECT *, lower(src) = lower(concat(dst_dir, '/', name)) AS own, EXISTS (SELECT 1 FROM occ WHERE occ.parent_dir = plan.dst_dir AND lower(occ.name) = lower(plan.name)) AS occupied FROM plan)"))
def collisions_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, occupants = _plan(spark, sf_dir)
    return jnl.collisions(plan, occupants).select("nth", "name", "collision")


@query("collisions_resolved")
def collisions_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each item of the plan, every second with a sidecar. Beyond SQL, as items are decided in order; tested against a loop."""
    plan, occupants = _plan(spark, sf_dir)
    folder = F.regexp_replace("src", r"/[^/]*$", "")
    side = F.concat(folder, F.lit("/"), F.regexp_replace("name", r"\.[^.]*$", ".xmp"))
    srcs = F.concat(F.array(F.concat(folder, F.lit("/"), F.col("name"))), F.when(F.col("nth") % 2 == 0, F.array(side)).otherwise(F.array().cast("array<string>")))
    return jnl.resolve(plan.select("nth", "dst_dir", srcs.alias("srcs"), "resolution"), occupants, "batch-000001")


@query("rename_suffix")
def rename_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, occupants = _plan(spark, sf_dir)
    return jnl.renames(plan, occupants).select("nth", "dst_dir", "name", "new_name")


COMPANION_FILES = "SELECT id, concat('/c/', CAST(id % 40 AS STRING), '/', CASE WHEN id % 2 = 0 THEN 'A' ELSE 'a' END, CAST(id % 60 AS STRING), '.', CASE id % 7 WHEN 0 THEN 'xmp' WHEN 1 THEN 'cr2' WHEN 2 THEN 'aae' ELSE 'jpg' END) AS path FROM {files}"


@query("companions", with_files("""SELECT DISTINCT s.path, r.path AS companion FROM cf s JOIN cf r ON s.dir = r.dir AND s.stem = r.stem AND (r.ext IN ('xmp', 'aae') OR (s.ext = 'cr2' AND r.ext = 'jpg') OR (s.ext = 'jpg' AND r.ext = 'cr2'))
WHERE s.path IN (SELECT path FROM cf WHERE id % 9 < 4) AND r.path NOT IN (SELECT path FROM cf WHERE id % 9 < 4)""", f"cf AS (SELECT id, path, split_part(path, '/', 3) AS dir, lower(split_part(split_part(path, '/', 4), '.', 1)) AS stem, split_part(path, '.', 2) AS ext FROM ({COMPANION_FILES.format(files='files').replace('STRING', 'VARCHAR')}))"))
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ad.files(spark, sf_dir).createOrReplaceTempView("tessera_files")
    rows = spark.sql(COMPANION_FILES.format(files="tessera_files"))
    rows = rows.withColumns(walk.split_path(F.col("path")))
    return jnl.companions(rows, rows.filter("id % 9 < 4").select("path")).distinct()


@query("distinct_sources", with_files("SELECT src, min(nth) AS nth FROM (SELECT id AS nth, concat('/s/', CAST(id % 300 AS VARCHAR)) AS src FROM files) GROUP BY src"))
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = ad.files(spark, sf_dir).select(F.col("id").alias("nth"), F.concat(F.lit("/s/"), (F.col("id") % 300).cast("string")).alias("src"))
    return jnl.distinct_sources(drafts).select("src", "nth")


@query("apply_batch", with_files("""SELECT CASE WHEN id % 9 = 2 THEN concat('/moved', path) ELSE path END AS path, content_hash FROM files WHERE id % 9 <> 1
UNION ALL SELECT concat('/copied', path), CASE WHEN id % 2 = 0 AND hashed_at IS NOT NULL THEN content_hash END FROM files WHERE id % 9 = 3"""))
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals, moves and copies of one batch applied to the catalogue."""
    rows, journal = ad.files(spark, sf_dir), ad.journal(spark, sf_dir)
    gone = rows.filter("id % 9 = 1").select("path")
    moves = rows.filter("id % 9 = 2").select("id", "path", F.concat(F.lit("/moved"), "path").alias("dst"))
    copies = rows.filter("id % 9 = 3").select(F.col("path").alias("src"), F.concat(F.lit("/copied"), "path").alias("dst"), "size", "mtime", "inode", "device", (F.col("id") % 2 == 0).alias("carry"))
    marks = journal.filter("state = 'in_flight'").select("op_id", F.lit("complete").alias("state"), F.lit(None).cast("string").alias("trash_url"))
    return jnl.applied(rows, journal, gone, moves, copies, marks, 1.0)[0].select("path", "content_hash")


@query("failure_kinds", "SELECT event_id, CASE event_type WHEN 'view' THEN 'sourceVanished' WHEN 'click' THEN 'permissionDenied' WHEN 'purchase' THEN 'outOfSpace' WHEN 'signup' THEN 'crossVolume' ELSE 'other' END AS failure FROM events")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE event_type WHEN 'view' THEN 'ENOENT' WHEN 'click' THEN 'EACCES' WHEN 'purchase' THEN 'ENOSPC' WHEN 'signup' THEN 'EXDEV' ELSE 'EWHAT' END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", jnl.failure(code).alias("failure"))


# --- dates -------------------------------------------------------------------------------------------------------------

STAMP = "CASE WHEN id % 13 = 0 THEN 'unreadable' ELSE {clock} END"


@query("exif_parse", with_files("SELECT id, CASE WHEN id % 13 <> 0 THEN capture_time - CASE capture_offset WHEN '-05:00' THEN -18000 ELSE 0 END END AS seconds FROM files"))
def exif_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.files(spark, sf_dir).withColumn("clock", dates.wall_clock(F.col("capture_time"), F.lit("+00:00")))
    return rows.select("id", dates.exif_time(F.expr(STAMP.format(clock="clock")), F.col("capture_offset")).alias("seconds"))


@query("capture_shift", with_files("SELECT id, capture_time + CASE id % 5 WHEN 0 THEN 90 WHEN 1 THEN -5400 WHEN 2 THEN 3723 WHEN 3 THEN NULL ELSE 0 END AS shifted FROM files"))
def capture_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.expr("CASE id % 5 WHEN 0 THEN '90' WHEN 1 THEN '-1:30' WHEN 2 THEN '+1:02:03' WHEN 3 THEN '1:99' ELSE '0' END")
    return ad.files(spark, sf_dir).select("id", (F.col("capture_time") + dates.shift_amount(amount)).alias("shifted"))


@query("capture_sequence", with_files(f"SELECT id, 1600000000 + 30 * (row_number() OVER (ORDER BY {ASCII_NAME}, id) - 1) AS seconds FROM files WHERE parent_dir = '/lib/src1/en'"))
def capture_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ad.files(spark, sf_dir).filter("parent_dir = '/lib/src1/en'").select("id", F.struct(ascii_fold(F.col("name")).alias("name"), "id").alias("at"))
    return dup.group_numbers(chosen, "at", "nth").select("id", dates.capture_sequence(1600000000, 30, F.col("nth")).cast("long").alias("seconds"))


@query("offset_seconds", with_files("SELECT id, CASE capture_offset WHEN '-05:00' THEN -18000 WHEN '+00:00' THEN 0 END AS seconds FROM files"))
def offset_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.files(spark, sf_dir).select("id", dates.offset_seconds(F.col("capture_offset")).cast("int").alias("seconds"))


BATCH_OK = "count(*) = count(capture_time) AND count(*) = count(CASE WHEN capture_offset IN ('-05:00', '+00:00') THEN 1 END)"


@query("batch_shift", with_files(f"SELECT id, CASE WHEN ok THEN capture_time + 3600 END AS shifted FROM files JOIN (SELECT parent_dir, id % 28 AS batch, {BATCH_OK} AS ok FROM files GROUP BY parent_dir, batch) b ON b.parent_dir = files.parent_dir AND b.batch = files.id % 28"))
def batch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's files shifted in 28 batches: refused where any lacks its time or zone."""
    rows = ad.files(spark, sf_dir).withColumn("batch", F.col("id") % 28)
    ok = rows.groupBy("parent_dir", "batch").agg(((F.count("*") == F.count("capture_time")) & (F.count("*") == F.count(dates.offset_seconds(F.col("capture_offset"))))).alias("ok"))
    return rows.join(ok, ["parent_dir", "batch"]).select("id", edits.shifted(F.col("ok"), F.col("capture_time"), dates.shift_amount(F.lit("1:00"))).alias("shifted"))


EDIT = """SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 9 - 1 AS INT) END AS rating, CASE WHEN id % 5 = 0 THEN CAST(id % 200 - 100 AS DOUBLE) END AS lat, CASE WHEN id % 10 = 0 THEN CAST(id % 500 - 250 AS DOUBLE) END AS lon,
CASE WHEN id % 4 = 1 THEN capture_time END AS cap, capture_offset AS off, CASE WHEN id % 7 = 2 THEN '12x' WHEN id % 7 = 3 THEN '12' END AS sub, id % 6 = 1 AS others FROM {files}"""


@query("edit_validation", with_files("SELECT id, CASE WHEN rating IS NULL AND lat IS NULL AND lon IS NULL AND cap IS NULL AND NOT others THEN 'emptyEdit' WHEN rating NOT BETWEEN 0 AND 5 THEN 'badRating' WHEN (lat IS NULL) <> (lon IS NULL) THEN 'halfCoordinate' WHEN abs(lat) > 90 THEN 'badLatitude' WHEN abs(lon) > 180 THEN 'badLongitude' WHEN cap IS NOT NULL AND off IS NULL THEN 'offsetRequired' WHEN cap IS NOT NULL AND off = '+5:30' THEN 'badOffset' WHEN sub = '12x' THEN 'badSubseconds' END AS error FROM edits", f"edits AS ({EDIT.format(files='files')})"))
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ad.files(spark, sf_dir).createOrReplaceTempView("tessera_files")
    rows = spark.sql(EDIT.format(files="tessera_files"))
    return rows.select("id", edits.edit_error(*[F.col(c) for c in ("rating", "lat", "lon", "cap", "off", "sub", "others")]).alias("error"))


@query("edit_parsing", with_files("SELECT id, CASE WHEN trim(typed) = '' THEN 'nothingToWrite' WHEN try_cast(trim(typed) AS INTEGER) BETWEEN 0 AND 5 THEN 'write' ELSE 'invalid' END AS rating, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_keywords FROM (SELECT id, CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', id % 8, ' ') ELSE 'five' END AS typed FROM files)"))
def edit_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.expr("CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', id % 8, ' ') ELSE 'five' END")
    words = F.expr("CASE id % 3 WHEN 0 THEN 'a, b,,' WHEN 1 THEN concat('one', chr(10)) ELSE ' , ' END")
    return ad.files(spark, sf_dir).select("id", edits.rating_edit(typed)["action"].alias("rating"), F.size(edits.keywords(words)).alias("n_keywords"))


# --- extras: what the catalogue's design has room for --------------------------------------------------------------------


@query("ocr_text_search", "WITH t AS (SELECT doc_id + 1 AS id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents) SELECT id FROM t WHERE list_contains(w, 'license') AND len(list_filter(w, lambda x: starts_with(x, 'apach'))) > 0")
def ocr_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms in the text of files: documents' texts stand for what was read from the images."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1).alias("id"), "text")
    rows = ad.files(spark, sf_dir).join(docs.withColumnRenamed("text", "ocr_text"), "id")
    return s.matching(rows, m.SearchQuery(predicate=m.FilenameText("License apach"))).select("id")


SAVED = {"large": SEARCHES["pred_megapixels"][0], "twins": SEARCHES["pred_has_duplicates"][0], "nested": SEARCHES["pred_nested"][0]}


@query("saved_search_counts", with_files(f"SELECT 'large' AS name, count(*) AS n FROM files WHERE {SEARCHES['pred_megapixels'][1]} UNION ALL SELECT 'twins', count(*) FROM files WHERE {SEARCHES['pred_has_duplicates'][1]} UNION ALL SELECT 'nested', count(*) FROM files WHERE {SEARCHES['pred_nested'][1]}"))
def saved_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved.counts(ad.files(spark, sf_dir), saved.saved_table(spark, SAVED, builtin=True))


# --- kernels -----------------------------------------------------------------------------------------------------------


@query("content_sha", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def containers(docs: DataFrame) -> DataFrame:
    """Image files around the documents' bytes, by Spark: JPEG or PNG with the text as image data, and a metadata segment that
    differs from row to row."""
    body = F.hex(F.regexp_replace(F.col("text"), "[^a-z ]", "").cast("binary"))
    size = lambda c, n, extra: F.lpad(F.hex((F.length(c) / 2).cast("long") + extra), n, "0")
    note = F.hex(F.concat(F.lit("id "), F.col("doc_id").cast("string")).cast("binary"))
    jpeg = F.concat(F.lit("FFD8FFE1"), size(note, 4, 2), note, F.lit("FFDB00040101FFDA00040101"), body, F.lit("FFD9"))
    png = F.concat(F.lit("89504E470D0A1A0A"), size(note, 8, 0), F.lit("74455874"), note, F.lit("00000000"), size(body, 8, 0), F.lit("49444154"), body, F.lit("000000000000000049454E44AE426082"))
    return docs.withColumn("ext", F.when(F.col("doc_id") % 3 == 0, "png").otherwise("jpg")).withColumn("content", F.unhex(F.when(F.col("ext") == "png", png).otherwise(jpeg)))


@query("image_hash_kernels")
def image_hash_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(containers(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return rows.select("doc_id", "content_hash", "image_hash", "image_hash_kind")


def photos(docs: DataFrame) -> DataFrame:
    """JPEG files whose headers Spark builds from the documents' columns: EXIF with make, orientation and time, and a frame."""
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    make = F.hex(F.concat(F.lit("Cam "), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" \0")).cast("binary"))
    stamp = F.hex(F.concat(dates.wall_clock(F.col("doc_id") * 1000 + 1500000000, F.lit("+00:00")), F.lit("\0")).cast("binary"))
    ifd = F.concat(F.lit("49492A0008000000" "0300" "0F01020008000000" "32000000" "1201030001000000"), number(1 + F.col("doc_id") % 8, 2), F.lit("000000" "3201020014000000" "3A000000" "00000000"), make, stamp)
    exif = F.concat(F.lit("457869660000"), ifd)
    frame = F.concat(F.lit("FFC0000B08"), number(F.col("n_chars") % 5000, 4), number(F.length("text") % 3000 + F.col("doc_id") % 7, 4), F.lit("01011100"))
    whole = F.concat(F.lit("FFD8FFE1"), number((F.length(exif) / 2).cast("long") + 2, 4), exif, frame, F.lit("FFDA0002AAFFD9"))
    return docs.withColumn("content", F.unhex(F.when(F.col("doc_id") % 23 == 0, F.lit("00112233")).otherwise(whole)))


@query("image_metadata", "SELECT doc_id, CASE WHEN ok THEN CAST(length(text) % 3000 + doc_id % 7 AS INTEGER) END AS width, CASE WHEN ok THEN CAST(n_chars % 5000 AS INTEGER) END AS height, CASE WHEN ok THEN CAST(doc_id * 1000 + 1500000000 AS DOUBLE) END AS capture_time, CASE WHEN ok THEN concat('Cam ', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')) END AS camera_make, CASE WHEN ok THEN CAST(1 + doc_id % 8 AS INTEGER) END AS orientation, CASE WHEN NOT ok THEN 'notAnImage' END AS error FROM (SELECT *, doc_id % 23 <> 0 AS ok FROM documents)")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars"))
    return read_headers(rows, "doc_id").select("doc_id", "width", "height", "capture_time", "camera_make", "orientation", "error")


@query("phash_grid")
def phash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of grids made of the embeddings: outer products of their halves."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("e"))
    grey = F.flatten(F.transform(F.slice("e", 1, 32), lambda a: F.transform(F.slice("e", 33, 32), lambda b: F.lpad(F.hex((F.least(F.greatest((a + b) * 200 + 128, F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0"))))
    grids = rows.select("vec_id", F.explode(F.array(F.unhex(F.array_join(grey, "")))).alias("grid"))  # a step of its own, so that the hash reads a column
    return grids.select("vec_id", phash_of(F.col("grid")).alias("phash"))


@query("cosine_topk", "WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT qid, vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(q[i] AS DOUBLE) * embedding[i])) AS d FROM q JOIN embeddings ON vec_id <> qid) SELECT qid AS query_id, vec_id, place FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9) DESC, vec_id) AS place FROM c) WHERE place <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows.filter("vec_id % 20 = 0"), rows, 5).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "place")


@query("media_kinds", with_files("SELECT id, CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'cr2' THEN 'raw' ELSE ext END AS media, CASE ext WHEN 'jpg' THEN 'jpeg-scan-v1' WHEN 'png' THEN 'png-idat-v1' WHEN 'webp' THEN 'webp-chunk-v1' WHEN 'heic' THEN 'heic-item-v1' END AS kind, starts_with(name, '.') AS junk FROM files"))
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_kind(F.col("ext"))
    kind = F.create_map(*[F.lit(x) for pair in HASH_KINDS.items() for x in pair])[media]
    return ad.files(spark, sf_dir).select("id", media.alias("media"), kind.alias("kind"), is_junk(F.col("name")).alias("junk"))


__all__ = ["ORACLES", "QUERIES", "SORT_COLUMNS"]
