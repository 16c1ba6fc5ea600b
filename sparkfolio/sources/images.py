"""Image facts: format, size and EXIF, from the first bytes of a file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package
from sparkfolio.sources.detect import image_kind

MIN_SIDE = 48
MAX_PIXELS = 50_000_000
#: EXIF tags that are shown, by their number
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x9003: "taken", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal length", 0xA434: "lens"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def dimensions(head: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, BMP, WebP and JPEG images."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if head[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", head[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if head[12:16] == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if head[:2] == b"\xff\xd8":
        for marker, body in segments(head):
            if marker in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB) and len(body) >= 5:
                h, w = struct.unpack(">HH", body[1:5])
                return w, h
    return None


def segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """JPEG segments up to the image data."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if marker == 0xDA or size < 2:
            return
        yield marker, raw[at + 4 : at + 2 + size]
        at += 2 + size


def _entries(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, list]]:
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(min(count, 512)):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * n
        if not size or size > 4096:
            continue
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            yield tag, [raw.split(b"\0")[0].decode("latin-1").strip()]
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            yield tag, [Fraction(a, b) if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in (3, 4, 9):
            yield tag, list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw))


def degrees(parts: list, ref: str) -> float | None:
    """Signed decimal degrees of degrees, minutes and seconds."""
    if len(parts) != 3 or None in parts:
        return None
    value = float(parts[0] + Fraction(parts[1]) / 60 + Fraction(parts[2]) / 3600)
    return round(-value if ref in ("S", "W") else value, 6)


def exif(raw: bytes) -> dict[str, str]:
    """What a JPEG's EXIF block says about the camera, the exposure and the place."""
    tiff = next((b[6:] for m, b in segments(raw) if m == 0xE1 and b[:6] == b"Exif\0\0"), b"")
    if len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if tiff[:2] == b"II" else ">"
    found: dict[int, list] = {}
    try:
        first = dict(_entries(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order))
        found.update(first)
        if 0x8769 in first:
            found.update(_entries(tiff, first[0x8769][0], order))
        place = dict(_entries(tiff, first[0x8825][0], order)) if 0x8825 in first else {}
    except struct.error:
        return {}
    out = {}
    for tag, name in TAGS.items():
        value = found.get(tag, [None])[0]
        if value not in (None, ""):
            out[name] = f"{float(value):g}" if isinstance(value, Fraction) and name != "exposure" else str(value)
    lat, lon = degrees(place.get(2, []), place.get(1, [""])[0]), degrees(place.get(4, []), place.get(3, [""])[0])
    if lat is not None and lon is not None:
        out["position"] = f"{lat}, {lon}"
    return out


def facts(files: DataFrame) -> DataFrame:
    """(path, kind, width, height, exif) of image files (path, content)."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            sizes = [dimensions(r) if r else None for r in raws]
            tags = [sorted(exif(r).items()) if r and r[:2] == b"\xff\xd8" else [] for r in raws]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([s and s[0] for s in sizes], pa.int32()), pa.array([s and s[1] for s in sizes], pa.int32()),
                    pa.array(tags, pa.map_(pa.string(), pa.string())),
                ],
                ["path", "kind", "width", "height", "exif"],
            )

    rows = files.select("path", "content", image_kind(F.col("content")).alias("kind")).filter("kind IS NOT NULL")
    return rows.mapInArrow(run, "path string, kind string, width int, height int, exif map<string,string>")


def decorative(width: Column, height: Column) -> Column:
    return (width < MIN_SIDE) | (height < MIN_SIDE)


def embeds(images: DataFrame, repeated: DataFrame, key_col: str = "sha256") -> DataFrame:
    """Images that belong to the document: neither decoration, nor too large, nor repeated on many pages."""
    kept = images.filter(~decorative(F.col("width"), F.col("height")) & (F.col("width").cast("long") * F.col("height") <= MAX_PIXELS))
    return kept.join(repeated.select(key_col), key_col, "left_anti")


def reference(caption: Column, digest: Column, width: Column, height: Column) -> Column:
    """A Markdown image by the first 16 digits of its digest, with its size as a comment."""
    return F.format_string("![%s](%s.png) <!-- %dx%d -->", F.coalesce(caption, F.lit("image")), F.substring(digest, 1, 16), width, height)


def fact_table(pairs: Column) -> Column:
    """An ordered array of struct<key, value> as a Markdown table, keys with a capital."""
    line = lambda p: F.concat(F.lit("|"), F.upper(F.substring(p["key"], 1, 1)), F.substring(p["key"], F.lit(2), F.length(p["key"])), F.lit("|"), p["value"], F.lit("|"))
    return F.concat(F.lit("|Property|Value|\n|---|---|\n"), F.array_join(F.transform(pairs, line), "\n"))
