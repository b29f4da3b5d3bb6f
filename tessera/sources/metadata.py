"""Reading image headers: size, orientation, camera and capture time, from the bytes of JPEG, PNG, WebP, GIF, PSD, HEIC and raw files.

Every file gives a row; what can't be read is null, and a file that can't be read at all has an error instead.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.containers import Malformed, Reader, box_at, boxes, item_kinds, locations
from ..functions.dates import exif_time
from ..functions.text import trimmed

# Tags of the first directory and of the EXIF one; sizes of value types.
TAGS = {0x0100: "width", 0x0101: "height", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified", 0x8769: "exif", 0x9003: "original", 0x9004: "digitized", 0x9011: "offset_original", 0x9012: "offset_digitized"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
MAX_ENTRIES = 1000
# How TIFF and raw files built like it begin; the number of a PSD's EXIF block; the maker block of CR3 files.
TIFF_LIKE = (b"II*\0", b"MM\0*", b"IIRO", b"IIRS", b"MMOR")
PSD_EXIF, CR3_UUID = b"\x04\x22", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
COLUMNS = "width int, height int, stamp string, capture_offset string, camera_make string, camera_model string, orientation int, error string"


class Unreadable(ValueError):
    pass


def tiff_tags(b: bytes) -> dict[str, object]:
    """Known tags of a TIFF structure; later directories add to earlier ones. Places outside the bytes end it."""
    if b[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if b[:2] == b"II" else ">"
    out: dict[str, object] = {}
    try:
        todo, seen = [struct.unpack_from(order + "I", b, 4)[0]], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for i in range(min(MAX_ENTRIES, struct.unpack_from(order + "H", b, at)[0])):
                tag, kind, n = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
                if tag not in TAGS:
                    continue
                place = at + 10 + 12 * i
                if SIZES.get(kind, 1) * n > 4:
                    place = struct.unpack_from(order + "I", b, place)[0]
                if kind == 2:
                    value: object = b[place : place + n].split(b"\0")[0].decode("utf-8", "replace")
                elif kind in (3, 4):
                    value = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, place)[0]
                else:
                    continue
                if TAGS[tag] == "exif":
                    todo.append(int(value))
                else:
                    out.setdefault(TAGS[tag], value)
    except (struct.error, ValueError):
        pass
    return out


def jpeg_header(b: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            break
        size = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + size]
        if marker in FRAMES and len(body) >= 5:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            found = tiff_tags(body[6:])
            out = {k: v for k, v in found.items() if k not in ("width", "height")} | out
        at += 2 + size
    return out


def png_header(b: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 8
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if kind == b"IHDR" and size >= 8:
            out["width"], out["height"] = struct.unpack_from(">II", b, at + 8)
        elif kind == b"eXIf":
            out = {k: v for k, v in tiff_tags(b[at + 8 : at + 8 + size]).items() if k not in ("width", "height")} | out
        elif kind in (b"IEND", b"IDAT") and "width" in out and kind == b"IEND":
            break
        at += 12 + size
    return out


def webp_header(b: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 12
    while at + 8 <= len(b):
        kind, size = struct.unpack_from("<4sI", b, at)
        body = b[at + 8 : at + 8 + size]
        if kind == b"VP8X" and size >= 10:
            out["width"], out["height"] = 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        elif kind == b"VP8 " and size >= 10 and "width" not in out:
            out["width"], out["height"] = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and size >= 5 and "width" not in out:
            bits = int.from_bytes(body[1:5], "little")
            out["width"], out["height"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"EXIF":
            found = tiff_tags(body[6:] if body[:6] == b"Exif\0\0" else body)
            out = {k: v for k, v in found.items() if k not in ("width", "height")} | out
        at += 8 + size + size % 2
    return out


def psd_header(b: bytes) -> dict[str, object]:
    """The frame's size, and the EXIF block among the image resources."""
    out: dict[str, object] = {}
    out["height"], out["width"] = struct.unpack_from(">II", b, 14)
    at = 30 + struct.unpack_from(">I", b, 26)[0]
    end = at + 4 + struct.unpack_from(">I", b, at)[0]
    at += 4
    while at + 12 <= min(end, len(b)) and b[at : at + 4] == b"8BIM":
        name = 1 + b[at + 6]
        start = at + 6 + name + name % 2
        size = struct.unpack_from(">I", b, start)[0]
        if b[at + 4 : at + 6] == PSD_EXIF:
            out = tiff_tags(b[start + 4 : start + 4 + size]) | out
        at = start + 4 + size + size % 2
    return out


def heic_header(b: bytes) -> dict[str, object]:
    """The primary item's extent by its properties, and the EXIF item."""
    found = dict[bytes, tuple[int, int]]()
    for kind, s, e in top_boxes(b):
        if kind == b"meta":
            found = {k: (s2, e2) for k, s2, e2 in boxes(b, s + 4, e)}
            break
    if not {b"pitm", b"iinf", b"iloc"} <= set(found):
        raise Unreadable("notAnImage")
    r = Reader(b, *found[b"pitm"])
    primary = r.take(2) if r.take(4) >> 24 == 0 else r.take(4)
    out: dict[str, object] = {}
    properties = {k: (s, e) for k, s, e in boxes(b, *found[b"iprp"])} if b"iprp" in found else {}
    if {b"ipco", b"ipma"} <= set(properties):
        kept = boxes(b, *properties[b"ipco"])
        for i in associated(b, *properties[b"ipma"]).get(primary, []):
            if 0 < i <= len(kept) and kept[i - 1][0] == b"ispe":
                out["width"], out["height"] = struct.unpack_from(">II", b, kept[i - 1][1] + 4)
    places = locations(b, *found[b"iloc"])
    for item, kind in item_kinds(b, *found[b"iinf"]).items():
        method, extents = places.get(item, (0, []))
        if kind == b"Exif" and extents:
            base = 0 if method == 0 else found.get(b"idat", (0, 0))[0]
            data = b"".join(b[base + o : base + o + n] for o, n in extents)
            out = tiff_tags(data[4 + int.from_bytes(data[:4], "big") :]) | out
    return out


def top_boxes(b: bytes) -> list[tuple[bytes, int, int]]:
    out, at = [], 0
    while found := box_at(b, at, len(b)):
        out.append(found)
        at = found[2]
    return out


def associated(b: bytes, s: int, e: int) -> dict[int, list[int]]:
    """Numbers of the properties of each item, from 1 on."""
    r = Reader(b, s, e)
    version = r.take(4)
    wide = version & 1
    out: dict[int, list[int]] = {}
    for _ in range(r.take(4)):
        item = r.take(2 if version >> 24 == 0 else 4)
        out[item] = [r.take(2) & 0x7FFF if wide else r.take(1) & 0x7F for _ in range(r.take(1))]
    return out


def cr3_header(b: bytes) -> dict[str, object]:
    """Directories of the movie box's maker block: the image's own, then that of the exposure."""
    out: dict[str, object] = {}
    for kind, s, e in top_boxes(b):
        for k, s2, e2 in boxes(b, s, e) if kind == b"moov" else []:
            if k == b"uuid" and b[s2 : s2 + 16] == CR3_UUID:
                for block, s3, e3 in boxes(b, s2 + 16, e2):
                    if block in (b"CMT1", b"CMT2"):
                        out |= {t: v for t, v in tiff_tags(b[s3:e3]).items() if t not in out}
    return out


def header(b: bytes | None) -> dict[str, object]:
    """What the header of an image says; raises Unreadable with the reason."""
    if b is None:
        raise Unreadable("unreadable")
    if b[:2] == b"\xff\xd8":
        return jpeg_header(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return png_header(b)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return webp_header(b)
    if b[:4] in TIFF_LIKE:
        return tiff_tags(b)
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return dict(zip(("width", "height"), struct.unpack_from("<HH", b, 6), strict=True))
    if b[:6] == b"8BPS\0\1":
        return psd_header(b)
    if b[:15] == b"FUJIFILMCCD-RAW":
        at, size = struct.unpack_from(">II", b, 84)
        return jpeg_header(b[at : at + size])
    if b[4:8] == b"ftyp":
        return cr3_header(b) if b[8:12] == b"crx " else heic_header(b)
    raise Unreadable("notAnImage")


def read_headers(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, width, height, capture_time, capture_offset, camera_make, camera_model, orientation, error) from key and content."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    x, error = header(content), None
                    if x.get("width") is None or x.get("height") is None:
                        raise Unreadable("notAnImage")
                except (Unreadable, Malformed, struct.error, IndexError) as e:
                    x, error = {}, str(e) if isinstance(e, Unreadable) else "notAnImage"
                stamp = x.get("original") or x.get("digitized") or x.get("modified")
                rows.append((x.get("width"), x.get("height"), stamp, x.get("offset_original") or x.get("offset_digitized"), x.get("make"), x.get("model"), None if error else x.get("orientation", 1), error))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            out = pd.DataFrame(rows, columns=names, index=pdf.index).astype({c: "Int32" for c in ("width", "height", "orientation")})
            yield pd.concat([pdf[[key]], out], axis=1)

    kind = files.schema[key].dataType.simpleString()
    read = files.select(key, "content").mapInPandas(part, f"{key} {kind}, {COLUMNS}")
    return read.select(
        key, "width", "height", exif_time(F.col("stamp"), F.col("capture_offset")).alias("capture_time"), "capture_offset", trimmed(F.col("camera_make")).alias("camera_make"), trimmed(F.col("camera_model")).alias("camera_model"), "orientation", "error"
    )
