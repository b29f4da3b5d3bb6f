"""Metadata edits as columns: what typed text means, what is wrong with an edit, whether a value was written as meant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import offset_seconds
from .text import trimmed

# Fields that may be cleared.
CLEARABLE = ("artist", "copyright", "description", "keywords", "label")
NOTHING, CLEAR, WRITE, INVALID = "nothingToWrite", "clear", "write", "invalid"


def keywords(text: Column) -> Column:
    """The words of a list typed with commas or line ends."""
    parts = F.transform(F.split(text, r"[,\n]"), trimmed)
    return F.filter(parts, lambda x: x.isNotNull())


def text_edit(field: Column, text: Column, clear: Column) -> Column:
    """(action, value) of a text field: blank means nothing to write, a clear only counts for fields that may be cleared."""
    value = trimmed(text)
    action = F.when(clear & field.isin(*CLEARABLE), CLEAR).when(clear, INVALID).when(value.isNull(), NOTHING).otherwise(WRITE)
    return F.struct(action.alias("action"), F.when(action == WRITE, value).alias("value"))


def rating_edit(text: Column) -> Column:
    """(action, value): a whole number from 0 to 5."""
    value = trimmed(text).try_cast("int")
    action = F.when(trimmed(text).isNull(), NOTHING).when(value.between(0, 5), WRITE).otherwise(INVALID)
    return F.struct(action.alias("action"), F.when(action == WRITE, value).alias("value"))


def gps_edit(latitude: Column, longitude: Column) -> Column:
    """The action of a pair of typed coordinates: both or neither, each in its range."""
    lat, lon = trimmed(latitude).try_cast("double"), trimmed(longitude).try_cast("double")
    blank = trimmed(latitude).isNull(), trimmed(longitude).isNull()
    fine = F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))
    return F.when(blank[0] & blank[1], NOTHING).when(fine, WRITE).otherwise(INVALID)


def capture_edit(clock: Column, offset: Column, seed: Column) -> Column:
    """The action of an edited capture time: unchanged from its seed is nothing to write."""
    return F.when(clock.isNull() | clock.eqNullSafe(seed), NOTHING).when(offset_seconds(offset).isNotNull(), WRITE).otherwise(INVALID)


def edit_error(rating: Column, latitude: Column, longitude: Column, capture: Column, offset: Column, subsec: Column, others: Column) -> Column:
    """The first thing wrong with an edit, or null. others tells whether any other field is set."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    nothing = rating.isNull() & latitude.isNull() & longitude.isNull() & capture.isNull() & ~others
    return (
        F.when(nothing, "emptyEdit")
        .when(rating.isNotNull() & ~rating.between(0, 5), "badRating")
        .when(latitude.isNull() != longitude.isNull(), "halfCoordinate")
        .when(latitude.isNotNull() & ~(finite(latitude) & (F.abs(latitude) <= 90)), "badLatitude")
        .when(longitude.isNotNull() & ~(finite(longitude) & (F.abs(longitude) <= 180)), "badLongitude")
        .when(capture.isNotNull() & offset.isNull(), "offsetRequired")
        .when(capture.isNotNull() & offset_seconds(offset).isNull(), "badOffset")
        .when(subsec.isNotNull() & ~subsec.rlike(r"^\d+$"), "badSubseconds")
    )


def same_value(kind: Column, want: Column, got: Column) -> Column:
    """Whether a value read back is the one meant; kind is text, list, integer, number or absent. Values are texts."""
    as_list = lambda c: F.transform(F.split(c, r",\s*"), trimmed)
    number = F.abs(want.try_cast("double") - got.try_cast("double")) <= 1e-6
    return F.coalesce(
        F.when(kind == "absent", got.isNull()).when(kind == "list", as_list(want) == as_list(got)).when(kind == "integer", want.try_cast("long") == got.try_cast("long")).when(kind == "number", number).otherwise(want == got), F.lit(False)
    )


def shifted(rows_ok: Column, capture: Column, seconds: Column) -> Column:
    """A batch's shifted times: none at all where any row lacks its time or a readable zone (rows_ok is over the batch)."""
    return F.when(rows_ok, capture + seconds)
