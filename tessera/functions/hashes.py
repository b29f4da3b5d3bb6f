"""Hashing columns of image files: content, image and perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..sources.media import HASH_KINDS, media_kind
from .containers import image_hash

MAX_BYTES = 256 << 20


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


@pandas_udf(T.StringType())
def image_hash_of(contents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, media in contents:
        yield pd.Series([image_hash(c, m) for c, m in zip(content, media, strict=True)], dtype=object)


def hashed(files: DataFrame) -> DataFrame:
    """files (content, ext, ...) with content_hash, image_hash and image_hash_kind. Files over MAX_BYTES get no image hash."""
    media = media_kind(F.col("ext"))
    kind = F.create_map(*[F.lit(x) for pair in HASH_KINDS.items() for x in pair])[media]
    small = F.when(F.octet_length("content") <= MAX_BYTES, F.col("content"))
    out = files.withColumn("content_hash", content_hash(F.col("content"))).withColumn("image_hash", image_hash_of(small, media))
    return out.withColumn("image_hash_kind", F.when(F.col("image_hash").isNotNull(), kind))


def cosines() -> np.ndarray:
    """The orthonormal basis: rows are frequencies."""
    k, x = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    return np.cos(np.pi * k * (2 * x + 1) / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))


def phash_bits(grid: np.ndarray) -> np.ndarray:
    """64 bits for each 32 x 32 grid of grey values (n, 1024): low frequencies against their median.

    The 8 x 8 lowest without the constant, and the next of the first row; coefficients are rounded to a millionth, halves up.
    """
    c = cosines()
    spectrum = c @ grid.reshape(-1, 32, 32).astype(np.float64) @ c.T
    low = spectrum[:, :8, :8].reshape(-1, 64)
    parts = np.concatenate([low[:, 1:], spectrum[:, 0, 8:9]], axis=1)
    parts = np.floor(parts * 1e6 + 0.5) / 1e6
    ordered = np.sort(parts, axis=1)
    return parts > ((ordered[:, 31] + ordered[:, 32]) / 2)[:, None]


@pandas_udf(T.StringType())
def phash_of(grids: pd.Series) -> pd.Series:
    """16 hex digits for a grid of 1024 grey bytes; null for anything else."""
    good = [i for i, g in enumerate(grids) if g is not None and len(g) == 1024]
    out = pd.Series([None] * len(grids), dtype=object)
    if good:
        bits = phash_bits(np.stack([np.frombuffer(grids.iloc[i], np.uint8) for i in good]))
        for i, x in zip(good, np.packbits(bits, axis=1), strict=True):
            out.iloc[i] = x.tobytes().hex()
    return out
