"""Image facts from hand-made headers."""

import struct

from pyspark.sql import functions as F

from sparkfolio.sources import images


def a_jpeg():
    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + value

    data_at = 8 + 2 + 3 * 12 + 4
    gps_at = data_at + 8
    rationals = struct.pack("<IIIIII", 10, 1, 30, 1, 0, 1)
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", gps_at + 54)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", gps_at + 54)) + b"\0" * 4
    first = struct.pack("<H", 3) + entry(0x010F, 2, 6, struct.pack("<I", data_at)) + entry(0x8827, 3, 1, struct.pack("<HH", 200, 0)) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + first + b"Maker\0\0\0" + gps + rationals
    app1 = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, 480, 640, 3)
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\x02"


def test_dimensions_and_exif(spark):
    assert images.dimensions(a_jpeg()) == (640, 480)
    assert images.exif(a_jpeg()) == {"make": "Maker", "iso": "200", "position": "-10.5, 10.5"}
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert images.dimensions(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    assert images.dimensions(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x07\0\0\x08\0\0") == (8, 9)
    assert images.dimensions(b"zz") is None and images.exif(b"\xff\xd8\xff\xe1\0\x20Exif\0\0II*\0\xff\xff\xff\xff") == {}
    files = spark.createDataFrame([("a.jpg", a_jpeg()), ("b.txt", b"x")], "path string, content binary")
    row = images.facts(files).collect()
    assert [(r["path"], r["kind"], r["width"], r["exif"]["make"]) for r in row] == [("a.jpg", "jpeg", 640, "Maker")]


def test_embeds(spark):
    found = spark.createDataFrame([("k1", 100, 100), ("k2", 20, 100), ("k3", 100, 100), ("k4", 60_000, 60_000)], "sha256 string, width int, height int")
    repeated = spark.createDataFrame([("k3",)], "sha256 string")
    assert [r["sha256"] for r in images.embeds(found, repeated).collect()] == ["k1"]
    text = found.filter("sha256 = 'k1'").select(images.reference(F.lit(None).cast("string"), F.lit("0123456789abcdef00"), F.col("width"), F.col("height"))).first()[0]
    assert text == "![image](0123456789abcdef.png) <!-- 100x100 -->"
    pairs = spark.createDataFrame([([("size", "1 KB"), ("iso", "200")],)], "p array<struct<key:string,value:string>>")
    assert pairs.select(images.fact_table(F.col("p"))).first()[0] == "|Property|Value|\n|---|---|\n|Size|1 KB|\n|Iso|200|"
