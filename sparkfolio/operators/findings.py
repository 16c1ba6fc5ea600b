"""Findings from the places and paints of text, and from links and images of pages.

Items are rows (keys, item, text, left, bottom, right, top, ...): keys name the page. Boxes without an area, or with a null side, overlap nothing and lie
nowhere; their other findings stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import visible_characters

#: Text lower than this many points is tiny; boxes that share this much of the smaller one overlap.
TINY, OVERLAP = 4.0, 0.5
#: Side of the squares that pages are split into for joins, in points.
SQUARE = 72.0
SEVERITY = {"hidden_text": "high", "off_page_text": "medium", "overlapping_text": "medium", "tiny_text": "low"}
# URL schemes that run or read something, and limits for scans and sparse pages.
UNSAFE_SCHEMES = ("javascript", "data", "file", "vbscript")
SCAN_SIDE, SCAN_DPI, SCAN_COVER, SPARSE_CHARS = 48, 50.0, 0.5, 24
WHITE, INK = 0.95, 0.05


def is_white(space: Column, color: Column) -> Column:
    """Whether a colour paints almost white: grey and RGB above WHITE, CMYK below INK in its first four; other spaces never."""
    n = F.size(color)
    grey = (n >= 1) & (F.get(color, F.lit(0)) > WHITE)
    rgb = (n >= 3) & F.forall(F.slice(color, 1, 3), lambda v: v > WHITE)
    cmyk = (n >= 4) & F.forall(F.slice(color, 1, 4), lambda v: v < INK)
    out = F.when(space.isin("DeviceGray", "CalGray"), grey).when(space.isin("DeviceRGB", "CalRGB"), rgb).when(space == "DeviceCMYK", cmyk)
    return F.coalesce(out, F.lit(False))


_BOX = ("text", "left", "bottom", "right", "top")


def _touching(boxes: DataFrame, keys: list[str], least: float, square: float) -> DataFrame:
    """(keys, a, b): boxes (keys, _box, item) of different texts that share `least` or more of the smaller one, as structs of item and _box, a.item < b.item."""
    spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"_box.{low}") / square), F.floor(F.col(f"_box.{high}") / square)))
    spread_boxes = boxes.withColumn("_x", spread("left", "right")).withColumn("_y", spread("bottom", "top"))
    side = lambda s: spread_boxes.select(*keys, "_x", "_y", F.struct("item", "_box").alias(s))
    at = lambda s, c: F.col(f"{s}._box.{c}")
    x0, y0 = F.greatest(at("a", "left"), at("b", "left")), F.greatest(at("a", "bottom"), at("b", "bottom"))
    w, h = F.least(at("a", "right"), at("b", "right")) - x0, F.least(at("a", "top"), at("b", "top")) - y0
    area = lambda s: (at(s, "right") - at(s, "left")) * (at(s, "top") - at(s, "bottom"))
    shared = (w > 0) & (h > 0) & (w * h >= F.least(area("a"), area("b")) * least)
    here = (F.floor(x0 / square) == F.col("_x")) & (F.floor(y0 / square) == F.col("_y"))
    met = side("a").join(side("b"), [*keys, "_x", "_y"]).filter((F.col("a.item") <= F.col("b.item")) & ~at("a", "text").eqNullSafe(at("b", "text")) & shared & here)
    return met.select(*keys, "a", "b")


def _placed_boxes(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.filter("left < right AND bottom < top").select(*keys, F.struct(*_BOX).alias("_box"), "item")


def overlapping_pairs(items: DataFrame, keys: list[str], least: float = OVERLAP, square: float = SQUARE) -> DataFrame:
    """(keys, a, b): items of a page, a < b, of different texts, whose boxes share `least` or more of the smaller one; each pair once.

    A box goes to every square that it covers; a pair counts only in the square that holds the lower left corner of what the two share. Equal
    boxes with one text (bold by double print) are one box in here, so a page of copies makes no pairs.
    """
    boxes = _placed_boxes(items, keys).groupBy(*keys, "_box").agg(F.min("item").alias("item"))
    return _touching(boxes, keys, least, square).filter("a.item < b.item").select(*keys, F.col("a.item").alias("a"), F.col("b.item").alias("b"))


def first_overlaps(items: DataFrame, keys: list[str], least: float = OVERLAP, square: float = SQUARE) -> DataFrame:
    """(keys, item, partner): every item that overlaps an earlier one of another text, copies too, with the first such.

    The first item of all boxes that a box overlaps is the partner of each of its copies that comes later, so boxes meet once for all copies.
    """
    placed = _placed_boxes(items, keys)
    met = _touching(placed.groupBy(*keys, "_box").agg(F.min("item").alias("item")), keys, least, square)
    both = met.select(*keys, F.explode(F.array(F.struct("b._box", F.col("a.item").alias("with")), F.struct("a._box", F.col("b.item").alias("with")))).alias("_m"))
    first = both.groupBy(*keys, F.col("_m._box").alias("_box")).agg(F.min("_m.with").alias("partner"))
    return placed.join(first, [*keys, "_box"]).filter(F.col("partner") < F.col("item")).groupBy(*keys, "item").agg(F.min("partner").alias("partner"))


def text_findings(items: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, type, severity, partner): hidden, tiny, off-page and overlapping text. pages: keys, width, height; items: also visible.

    An overlap is told once an item, the later one of each pair, with the first item that it overlaps; partner is null in other findings.
    """
    placed = items.join(pages.select(*keys, "width", "height"), keys, "left")
    off = (F.col("right") <= 0) | (F.col("left") >= F.col("width")) | (F.col("top") <= 0) | (F.col("bottom") >= F.col("height"))
    kinds = {"hidden_text": ~F.col("visible"), "tiny_text": F.abs(F.col("top") - F.col("bottom")) < TINY, "off_page_text": off}
    alone = placed.withColumn("type", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])))).select(*keys, "item", "type")
    met = first_overlaps(items, keys)
    found = alone.withColumn("partner", F.lit(None).cast(met.schema["partner"].dataType)).unionByName(met.withColumn("type", F.lit("overlapping_text")), allowMissingColumns=True)
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.select(*keys, "item", "type", F.element_at(severity, F.col("type")).alias("severity"), "partner")


def link_signals(links: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """(keys, url, type, severity): external links, those of schemes that run or read something as unsafe. Links without a URL are none."""
    scheme = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^([a-z][a-z0-9+.\-]*):", 1)
    unsafe = scheme.isin(*UNSAFE_SCHEMES)
    kept = links.filter(F.col(url).isNotNull())
    return kept.select(*keys, F.col(url).alias("url"), F.when(unsafe, "unsafe_external_link").otherwise("external_link").alias("type"), F.when(unsafe, "high").otherwise("low").alias("severity"))


def is_scan_like(width: Column, height: Column, placed_width: Column, placed_height: Column) -> Column:
    """Whether an image of so many pixels looks like a scan where it is placed (points): large enough, and fine enough."""
    w, h = F.abs(placed_width), F.abs(placed_height)
    fine = (w > 0) & (h > 0) & (width * 72.0 / w >= SCAN_DPI) & (height * 72.0 / h >= SCAN_DPI)
    return F.coalesce((width >= SCAN_SIDE) & (height >= SCAN_SIDE) & fine, F.lit(False))


def page_sources(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, image_only, scanned, sparse): where a page's text has to come from. pages: keys, text, markdown, area, images array<struct<left,bottom,right,top>>.

    image_only: images and no letter or digit; scanned: besides, images cover half of the page; sparse: under SPARSE_CHARS visible characters of
    Markdown. Null texts and image lists count as empty.
    """
    images = F.coalesce("images", F.array().cast(pages.schema["images"].dataType))
    only = (F.size(images) > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}]")
    side = lambda a, b: F.greatest(a - b, F.lit(0.0))
    covered = F.aggregate(images, F.lit(0.0), lambda acc, i: acc + side(i["right"], i["left"]) * side(i["top"], i["bottom"]))
    scanned = only & (F.col("area") > 0) & (F.least(covered, F.col("area")) >= F.col("area") * SCAN_COVER)
    sparse = visible_characters(F.coalesce("markdown", F.lit(""))) < SPARSE_CHARS
    return pages.select(*keys, only.alias("image_only"), F.coalesce(scanned, F.lit(False)).alias("scanned"), sparse.alias("sparse"))
