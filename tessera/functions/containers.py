"""Which bytes of an image file are the image: ranges for hashing that editing metadata leaves alone.

Each function gives (start, end) ranges or raises Malformed. Rules by container:
JPEG  everything but APP0, APP1, APP13 and comments, from the start marker on; what follows the end marker counts.
PNG   all chunks but texts, EXIF, time and physical size; no signature; what follows the end chunk counts.
WebP  image, alpha, animation and colour chunks with header and padding; chunks must tile the RIFF; the rest of the file counts.
HEIC  the extents of the primary item, or of the items that a derived one is made of, in their order; trailing data counts.
"""

from __future__ import annotations

import hashlib
import struct

MAX_CHUNK, MAX_EXTENTS = (1 << 31) - 1, 65_536
# Markers, chunks, boxes and brands.
JPEG_DROPPED = {0xE0, 0xE1, 0xED, 0xFE}
PNG_SIGNATURE, PNG_DROPPED = b"\x89PNG\r\n\x1a\n", {b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME", b"pHYs"}
WEBP_KEPT = {b"VP8 ", b"VP8L", b"ALPH", b"ANIM", b"ANMF", b"ICCP"}
HEIC_BRANDS, HEIC_DERIVED = {b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"mif1", b"msf1"}, {b"grid", b"iovl", b"iden"}


class Malformed(ValueError):
    """A file that doesn't have its container's form; it gets no image hash."""


def jpeg_ranges(b: bytes) -> list[tuple[int, int]]:
    n = len(b)
    if b[:2] != b"\xff\xd8":
        raise Malformed("no start marker")
    out, at = [(0, 2)], 2
    while True:
        start = at
        if at >= n or b[at] != 0xFF:
            raise Malformed("marker expected")
        while at < n and b[at] == 0xFF:
            at += 1
        if at >= n:
            raise Malformed("truncated")
        marker = b[at]
        at += 1
        if marker == 0xD9:
            return [*out, (start, n)]
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            out.append((start, at))
            continue
        if marker in (0x00, 0xD8) or at + 2 > n:
            raise Malformed("bad segment")
        size = struct.unpack_from(">H", b, at)[0]
        if size < 2 or at + size > n:
            raise Malformed("bad length")
        at += size
        if marker == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= n:
                    raise Malformed("truncated scan")
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                elif b[at + 1] == 0xFF:
                    at += 1
                else:
                    break
        if marker not in JPEG_DROPPED:
            out.append((start, at))


def png_ranges(b: bytes) -> list[tuple[int, int]]:
    if b[:8] != PNG_SIGNATURE:
        raise Malformed("no signature")
    out, at = [], 8
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if size > MAX_CHUNK or at + 12 + size > len(b):
            raise Malformed("bad length")
        if kind == b"IEND":
            return [*out, (at, len(b))]
        if kind not in PNG_DROPPED:
            out.append((at, at + 12 + size))
        at += 12 + size
    raise Malformed("truncated")


def webp_ranges(b: bytes) -> list[tuple[int, int]]:
    if len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        raise Malformed("no header")
    end = 8 + struct.unpack_from("<I", b, 4)[0]
    if end > len(b) or end < 12:
        raise Malformed("bad length")
    out, at = [], 12
    while at < end:
        if at + 8 > end:
            raise Malformed("chunks don't tile")
        kind, size = struct.unpack_from("<4sI", b, at)
        after = at + 8 + size + size % 2
        if after > end:
            raise Malformed("bad chunk")
        if kind in WEBP_KEPT:
            out.append((at, after))
        at = after
    if not out:
        raise Malformed("no image")
    return [*out, (end, len(b))] if end < len(b) else out


def box_at(b: bytes, at: int, end: int) -> tuple[bytes, int, int] | None:
    """(kind, start of the payload, end) of the box at a place, or None if none fits before the end."""
    if at + 8 > end:
        return None
    size, kind = struct.unpack_from(">I4s", b, at)
    head = 8
    if size == 1:
        if at + 16 > end:
            return None
        size, head = struct.unpack_from(">Q", b, at + 8)[0], 16
    elif size == 0:
        size = end - at
    return (kind, at + head, at + size) if size >= head and at + size <= end else None


def boxes(b: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """(kind, start of the payload, end) of boxes that tile a range."""
    out = []
    while at < end:
        found = box_at(b, at, end)
        if found is None:
            raise Malformed("bad box")
        out.append(found)
        at = found[2]
    return out


class Reader:
    """Big-endian numbers from a range, failing at its end."""

    def __init__(self, b: bytes, at: int, end: int):
        self.b, self.at, self.end = b, at, end

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise Malformed("truncated field")
        self.at += n
        return int.from_bytes(self.b[self.at - n : self.at], "big")


def heic_ranges(b: bytes) -> list[tuple[int, int]]:
    n, top, trailer = len(b), [], 0
    while trailer < n and (found := box_at(b, trailer, n)):  # what follows the last box that fits is trailing data
        top.append(found)
        trailer = found[2]
    if not top or top[0][0] != b"ftyp":
        raise Malformed("no file type")
    _, s, e = top[0]
    brands = {b[s : s + 4], *(b[i : i + 4] for i in range(s + 8, e, 4))}
    if not brands & HEIC_BRANDS:
        raise Malformed("not this kind of file")
    meta = [(s, e) for k, s, e in top if k == b"meta"]
    if not meta:
        raise Malformed("no meta box")
    inner: dict[bytes, tuple[int, int]] = {}
    for k, s, e in boxes(b, meta[0][0] + 4, meta[0][1]):
        if k in inner:
            raise Malformed("repeated box")
        inner[k] = (s, e)
    if not {b"pitm", b"iinf", b"iloc"} <= set(inner):
        raise Malformed("missing box")
    r = Reader(b, *inner[b"pitm"])
    primary = r.take(2) if r.take(4) >> 24 == 0 else r.take(4)
    kinds = item_kinds(b, *inner[b"iinf"])
    refs = references(b, *inner[b"iref"]) if b"iref" in inner else {}
    if primary not in kinds:
        raise Malformed("no primary item")
    items = [primary]
    if kinds[primary] in HEIC_DERIVED:
        items = refs.get(primary, [])
        if not items or any(i == primary or i not in kinds or kinds[i] in HEIC_DERIVED for i in items):
            raise Malformed("bad derivation")
    places = locations(b, *inner[b"iloc"])
    out = []
    for i in dict.fromkeys(items):
        method, extents = places.get(i, (0, []))
        if not extents:
            raise Malformed("no data")
        base, limit = (0, n) if method == 0 else inner.get(b"idat", (0, 0))
        for offset, size in extents:
            size = size or limit - base - offset
            if size <= 0 or base + offset + size > limit:
                raise Malformed("bad extent")
            out.append((base + offset, base + offset + size))
    return [*out, (trailer, n)] if trailer < n else out


def item_kinds(b: bytes, s: int, e: int) -> dict[int, bytes]:
    r = Reader(b, s, e)
    version = r.take(4) >> 24
    count = r.take(2 if version == 0 else 4)
    out: dict[int, bytes] = {}
    for kind, s2, e2 in boxes(b, r.at, e):
        if kind != b"infe":
            raise Malformed("bad item list")
        q = Reader(b, s2, e2)
        v = q.take(4) >> 24
        if v < 2:
            raise Malformed("item without a type")
        item = q.take(2 if v == 2 else 4)
        q.take(2)
        if item in out:
            raise Malformed("repeated item")
        out[item] = q.take(4).to_bytes(4, "big")
    if len(out) != count:
        raise Malformed("bad item count")
    return out


def references(b: bytes, s: int, e: int) -> dict[int, list[int]]:
    """The parts of each derived item, in order."""
    r = Reader(b, s, e)
    size = 2 if r.take(4) >> 24 == 0 else 4
    out: dict[int, list[int]] = {}
    for kind, s2, e2 in boxes(b, r.at, e):
        q = Reader(b, s2, e2)
        item = q.take(size)
        to = [q.take(size) for _ in range(q.take(2))]
        if kind == b"dimg":
            if item in out:
                raise Malformed("repeated derivation")
            out[item] = to
    return out


def locations(b: bytes, s: int, e: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """(method, extents) of each item; method 0 is the file, 1 the item data box."""
    r = Reader(b, s, e)
    version = r.take(4) >> 24
    if version > 2:
        raise Malformed("unknown version")
    sizes = r.take(2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    if not {offset_size, length_size, base_size, index_size} <= {0, 4, 8}:
        raise Malformed("bad field size")
    out: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    total = 0
    for _ in range(r.take(2 if version < 2 else 4)):
        item = r.take(2 if version < 2 else 4)
        method = r.take(2) & 15 if version else 0
        if method > 1 or r.take(2):
            raise Malformed("data elsewhere")
        base = r.take(base_size)
        extents = []
        for _ in range(r.take(2)):
            total += 1
            if total > MAX_EXTENTS:
                raise Malformed("too many extents")
            r.take(index_size)
            offset = base + r.take(offset_size)
            extents.append((offset, r.take(length_size)))
        if item in out:
            raise Malformed("repeated item")
        out[item] = (method, extents)
    return out


RANGES = {"jpeg": jpeg_ranges, "png": png_ranges, "webp": webp_ranges, "heic": heic_ranges}


def image_hash(content: bytes | None, media: str | None) -> str | None:
    """Hex SHA-256 of the image's ranges, or null where there is no rule or the file is malformed."""
    if content is None or media not in RANGES:
        return None
    try:
        ranges = RANGES[media](content)
    except (Malformed, struct.error, IndexError):
        return None
    h, view = hashlib.sha256(), memoryview(content)
    for a, b in ranges:
        h.update(view[a:b])
    return h.hexdigest()
