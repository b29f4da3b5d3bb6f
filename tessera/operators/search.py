"""Search: a predicate tree becomes one Column, a query becomes one DataFrame.

Comparisons stay three-valued. Only `Not` folds: unknown counts as "doesn't match", so its negation matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ascii_fold, folded_words, matches_terms, name_tokens, search_terms
from . import model as m
from .postings import ids_with
from .staging import folder

SORT_COLUMNS = {"name": None, "captureDate": "capture_time", "modifiedDate": "mtime", "size": "size", "width": "width", "height": "height"}
#: Up to so deep a page is cut off a sorted stream.
SHALLOW = 10_000
#: Marks of library-wide twins that `search` joins where a predicate asks for them.
IMAGE_TWIN, CONTENT_TWIN = "__image_twin", "__content_twin"


def normal_folder(path: str) -> str:
    if not path.startswith("/"):
        raise m.InvalidScope(path)
    return path.rstrip("/") or "/"


def scope_filter(scope) -> Column:
    """A byte range on the path, which Parquet statistics can prune; never LIKE, which folds case and has wildcards."""
    if isinstance(scope, m.Everywhere):
        return F.lit(True)
    folder = normal_folder(scope.path)
    if not scope.recursive:
        return F.col("parent_dir") == folder
    low = folder if folder == "/" else folder + "/"
    high = low[:-1] + "0"  # the byte after the slash
    return (F.col("path") == folder) | ((F.col("path") > low) & (F.col("path") < high))


def number_test(c: Column, test) -> Column:
    if isinstance(test, m.Equal):
        return c == float(test.value)
    if isinstance(test, m.AtLeast):
        return c >= float(test.value)
    if isinstance(test, m.AtMost):
        return c <= float(test.value)
    low, high = sorted((float(test.low), float(test.high)))
    return (c >= low) & (c <= high)


def date_test(c: Column, start: float | None, end: float | None) -> Column:
    test = c.isNotNull()
    if start is not None:
        test &= c >= float(start)
    if end is not None:
        test &= c <= float(end)
    return test


def megapixels() -> Column:
    return F.col("width").cast("double") * F.col("height") / 1e6


def aspect_ratio() -> Column:
    return F.try_divide(F.col("width").cast("double"), F.col("height"))


def by_tokens(terms: list[str]) -> Column:
    return matches_terms(F.col("name_tokens"), terms)


def predicate_filter(p, depth: int = 0, words: Callable[[list[str]], Column] = by_tokens) -> Column:
    """words: the test for search terms."""
    if depth > m.MAX_DEPTH:
        raise m.PredicateTooDeep(m.MAX_DEPTH)
    match p:
        case m.All():
            return F.lit(True)
        case m.And(parts) | m.Or(parts):
            joined = [predicate_filter(x, depth + 1, words) for x in parts]
            if isinstance(p, m.And):
                return reduce(Column.__and__, joined) if joined else F.lit(True)
            return reduce(Column.__or__, joined) if joined else F.lit(False)
        case m.Not(inner):
            return ~F.coalesce(predicate_filter(inner, depth + 1, words), F.lit(False))
        case m.Width(test):
            return number_test(F.col("width"), test)
        case m.Height(test):
            return number_test(F.col("height"), test)
        case m.FileSize(test):
            return number_test(F.col("size"), test)
        case m.Megapixels(test):
            return number_test(megapixels(), test)
        case m.AspectRatio(test):
            return (F.col("height") > 0) & number_test(aspect_ratio(), test)
        case m.ExactDimensions(width, height):
            return (F.col("width") == width) & (F.col("height") == height)
        case m.FileExtension(values):
            return F.col("ext").isin([v.lower() for v in values]) if values else F.lit(False)
        case m.CaptureDate(start, end):
            return date_test(F.col("capture_time"), start, end)
        case m.ModifiedDate(start, end):
            return date_test(F.col("mtime"), start, end)
        case m.CameraMake(value):
            return ascii_fold(F.col("camera_make")) == ascii_fold(F.lit(value))
        case m.CameraModel(value):
            return ascii_fold(F.col("camera_model")) == ascii_fold(F.lit(value))
        case m.FilenameText(text):
            terms = search_terms(text)
            return F.lit(True) if terms is None else words(terms) if terms else F.lit(False)
        case m.HasDuplicates():
            return F.col(IMAGE_TWIN) | F.col(CONTENT_TWIN)
    raise TypeError(p)


def asks(p, kind: type) -> bool:
    if isinstance(p, kind):
        return True
    if isinstance(p, m.And | m.Or):
        return any(asks(x, kind) for x in p.parts)
    return isinstance(p, m.Not) and asks(p.inner, kind)


def with_twins(files: DataFrame, library: DataFrame) -> DataFrame:
    """Whether a row's image hash, or content hash, is on more than one row of the whole library.

    Counts are partial sums before the shuffle, null hashes are left out of both sides, and the joins are equi-joins.
    """
    out = files
    for hash_col, mark in (("image_hash", IMAGE_TWIN), ("content_hash", CONTENT_TWIN)):
        many = library.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("__h")).count().filter("count > 1").select("__h", F.lit(True).alias(mark))
        out = out.join(many, F.col(hash_col) == F.col("__h"), "left").drop("__h").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))
    return out


def texts(p) -> list[str]:
    """The texts that a predicate searches names for."""
    if isinstance(p, m.FilenameText):
        return [p.text]
    parts = p.parts if isinstance(p, m.And | m.Or) else (p.inner,) if isinstance(p, m.Not) else ()
    return [t for x in parts for t in texts(x)]


def matching(files: DataFrame, query: m.SearchQuery, library: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Rows in scope that match, without sort, limit and offset: what counts and duplicate scans read.

    With postings (term, id, field) of these files, words of names are looked up there: a mark for each text that is searched for,
    joined by id. Where the text must match, the mark's join becomes an inner one. Without, names are cut into words.
    """
    columns = files.columns
    rows = files.filter(scope_filter(query.scope))
    if postings is not None:
        marks: dict[tuple, str] = {}
        for terms in map(search_terms, texts(query.predicate)):
            key = tuple(folded_words(terms or []))
            if key and key not in marks:
                marks[key] = f"__text_{len(marks)}"
                rows = rows.join(ids_with(postings, list(key)).withColumn(marks[key], F.lit(True)), "id", "left")
        found = lambda terms: F.coalesce(marks[k], F.lit(False)) if (k := tuple(folded_words(terms))) in marks else F.lit(False)
        test = predicate_filter(query.predicate, words=found)
    else:
        test = predicate_filter(query.predicate)
    if postings is None and asks(query.predicate, m.FilenameText) and "name_tokens" not in columns:
        text = [F.col("name")] + ([F.col("ocr_text")] if "ocr_text" in columns else [])
        rows = rows.withColumn("name_tokens", name_tokens(*text))
    if asks(query.predicate, m.HasDuplicates):
        rows = with_twins(rows, files if library is None else library)
    return rows.filter(test).select(*columns)


def sort_columns(sort: m.Sort) -> list[Column]:
    """Nulls last either way, then by id; names in ASCII-folded order."""
    c = ascii_fold(F.col("name")) if sort.by == "name" else F.col(SORT_COLUMNS[sort.by])
    return [c.asc_nulls_last() if sort.ascending else c.desc_nulls_last(), F.col("id").asc()]


def search(files: DataFrame, query: m.SearchQuery, columns: list[str] | None = None, postings: DataFrame | None = None) -> DataFrame:
    """The page of rows that a query asks for, in its order.

    Up to SHALLOW rows from the top are kept by each task while it sorts. Deeper pages, and pages without an end, come from ranges
    whose rows are counted.
    """
    rows = matching(files, query, postings=postings)
    if query.offset and (query.limit is None or query.offset + query.limit > SHALLOW):
        keep = [*(columns or rows.columns)]
        last = None if query.limit is None else query.offset + query.limit
        return placed(rows, query.sort, query.offset, last).orderBy("place").select(*keep)
    out = rows.orderBy(*sort_columns(query.sort))
    if query.offset:
        out = out.offset(query.offset)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*columns) if columns else out


def placed(rows: DataFrame, sort: m.Sort, after: int = 0, last: int | None = None) -> DataFrame:
    """rows with their place in an order, from 1; only those after the first `after` ones and up to the last one.

    Ranges of the order are sorted side by side and written apart, so that the counts of the ranges say which of them have rows of the
    page; the others aren't read.
    """
    order = sort_columns(sort)
    own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": own})
    path = f"{folder(rows.sparkSession)}/catalogue-{uuid.uuid4().hex}-ranges"
    ranged.write.partitionBy("__part").parquet(path)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect()):  # a row for each range
        if total + n > after and (last is None or total < last):
            before.append((part, total))
        total += n
    wanted = ranged.filter(F.col("__part").isin([p for p, _ in before]))  # whole folders are left out
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.col("__before") + F.col("__place")
    out = wanted.join(F.broadcast(offsets), "__part").withColumn("place", place).filter(F.col("place") > after)
    return (out if last is None else out.filter(F.col("place") <= last)).drop("__part", "__place", "__before")


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ids (one column, id)."""
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def in_display_order(files: DataFrame, ids: DataFrame, sort: m.Sort) -> DataFrame:
    return by_ids(files, ids).orderBy(*sort_columns(sort))


def not_hashed(files: DataFrame, scope, limit: int | None = None) -> DataFrame:
    """The hashing queue: rows in scope that hashing was never attempted on, by id."""
    out = files.filter(F.col("hashed_at").isNull() & scope_filter(scope)).orderBy("id")
    return out if limit is None else out.limit(limit)
