"""Which files are images, and what kind of image each extension means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extension -> kind of image.
MEDIA = {
    "jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "heic": "heic", "heif": "heic", "tif": "tiff", "tiff": "tiff", "psd": "psd",
    "cr2": "raw", "cr3": "raw", "nef": "raw", "nrw": "raw", "arw": "raw", "srf": "raw", "sr2": "raw", "raf": "raw", "orf": "raw", "rw2": "raw", "pef": "raw", "dng": "raw", "raw": "raw", "3fr": "raw", "erf": "raw",
}
# Kinds that have an image hash, with the name of its rule.
HASH_KINDS = {"jpeg": "jpeg-scan-v1", "png": "png-idat-v1", "webp": "webp-chunk-v1", "heic": "heic-item-v1"}
# Directories that are opaque bundles, by extension; sidecar extensions.
OPAQUE = ("photoslibrary", "aplibrary", "migratedaplibrary", "lrdata", "lrcat", "app", "bundle", "framework", "photolibrary", "pkg")
SIDECARS = ("xmp", "aae", "thm")
RAW = tuple(k for k, v in MEDIA.items() if v == "raw")
JPEG = tuple(k for k, v in MEDIA.items() if v == "jpeg")


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty if there is none or only a leading one."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def media_kind(ext: Column) -> Column:
    """jpeg, png, ... or null."""
    return F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])[F.lower(ext)]


def is_junk(name: Column) -> Column:
    return name.startswith(".") | (name == "Icon\r")


def in_opaque_bundle(path: Column) -> Column:
    """Whether a directory above the file is an opaque bundle."""
    above = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(above, lambda part: extension(part).isin(*OPAQUE))
