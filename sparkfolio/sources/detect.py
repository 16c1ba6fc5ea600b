"""Admission and format detection of files, as column expressions over the binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: extensions by what can be searched, and media besides
SEARCHABLE = ("csv", "docm", "docx", "epub", "htm", "html", "markdown", "md", "pdf", "pptm", "pptx", "srt", "text", "tsv", "txt", "vtt", "xhtml", "xlsm", "xlsx")
MEDIA = ("avi", "flac", "gif", "jpeg", "jpg", "m4a", "m4v", "mkv", "mov", "mp3", "mp4", "ogg", "png", "tif", "tiff", "wav", "webm", "webp")
MIME = {
    "application/pdf": "pdf", "text/html": "html", "application/xhtml+xml": "html", "text/csv": "csv", "text/tab-separated-values": "tsv",
    "application/epub+zip": "epub", "text/plain": "text", "text/markdown": "text",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
BY_EXTENSION = {
    "pdf": "pdf", "docx": "docx", "docm": "docx", "pptx": "pptx", "pptm": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "epub": "epub", "html": "html", "htm": "html", "xhtml": "html",
    "csv": "csv", "tsv": "tsv", "srt": "subtitles", "vtt": "subtitles", "txt": "text", "text": "text", "md": "text", "markdown": "text",
    **{e: "image" for e in ("png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp")},
    **{e: "media" for e in ("mp4", "m4v", "mov", "mkv", "webm", "avi", "mp3", "m4a", "wav", "flac", "ogg")},
}
MAX_BYTES = 512 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def searchable(path: Column) -> Column:
    return extension(path).isin(*SEARCHABLE)


def readable(path: Column) -> Column:
    return extension(path).isin(*SEARCHABLE, *MEDIA)


def is_url(spec: Column) -> Column:
    return F.ltrim(F.lower(spec)).rlike("^https?://")


def _starts(content: Column, hexed: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(hexed) // 2)) == hexed


def image_kind(content: Column) -> Column:
    """The image format by its first bytes, null for others."""
    return (
        F.when(_starts(content, "89504E470D0A1A0A"), "png")
        .when(_starts(content, "FFD8FF"), "jpeg")
        .when(_starts(content, "47494638"), "gif")
        .when(_starts(content, "52494646") & _starts(content, "57454250", 9), "webp")
        .when(_starts(content, "49492A00") | _starts(content, "4D4D002A"), "tiff")
        .when(_starts(content, "424D"), "bmp")
    )


def media_container(content: Column) -> Column:
    """The media container by its first bytes, null for others."""
    return (
        F.when(_starts(content, "66747970", 5), "mp4")
        .when(_starts(content, "1A45DFA3"), "matroska")
        .when(_starts(content, "52494646") & _starts(content, "57415645", 9), "wav")
        .when(_starts(content, "52494646") & _starts(content, "41564920", 9), "avi")
        .when(_starts(content, "4F676753"), "ogg")
        .when(_starts(content, "664C6143"), "flac")
        .when(_starts(content, "494433"), "mp3")
    )


def zip_kind(content: Column) -> Column:
    """What a ZIP container holds, by names near its start."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(head.contains("application/epub+zip"), "epub").when(head.contains("word/"), "docx").when(head.contains("ppt/"), "pptx").when(head.contains("xl/"), "xlsx")
    )


def text_or_html(prefix: Column) -> Column:
    return F.when(F.ltrim(F.lower(prefix)).rlike("^(?:<!doctype html|<html)"), "html").otherwise("text")


def detect(path: Column, content: Column) -> Column:
    """The format: magic bytes first, then the extension, then a look at the text."""
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv]), extension(path))
    prefix = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    binary = prefix.rlike(r"[\x00-\x08\x0B\x0E-\x1F]")
    return (
        F.when(_starts(content, "255044462D"), "pdf")
        .when(_starts(content, "504B0304"), F.coalesce(zip_kind(content), by_name))
        .when(image_kind(content).isNotNull(), "image")
        .when(media_container(content).isNotNull(), "media")
        .when(by_name.isNotNull(), by_name)
        .when(~binary, text_or_html(prefix))
    )


def from_content_type(value: Column) -> Column:
    bare = F.trim(F.lower(F.substring_index(value, ";", 1)))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), bare)
    return F.when(known.isNotNull(), known).when(bare.startswith("image/"), "image").when(bare.startswith("audio/") | bare.startswith("video/"), "media")


def decode_text(content: Column) -> Column:
    """Text of UTF-8 or, by its mark, UTF-16 bytes, without the mark."""
    return (
        F.when(_starts(content, "EFBBBF"), F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
        .when(_starts(content, "FFFE"), F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
        .when(_starts(content, "FEFF"), F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def admitted(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the roots, '..' never."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | path.startswith(root.rstrip("/") + "/")
    return inside & ~path.rlike(r"(^|/)\.\.(/|$)")


def scan(spark: SparkSession, folder: str, glob: str = "*", roots: list[str] | None = None) -> DataFrame:
    """Files of a folder tree: (path, modificationTime, length, content, format, sha256, error). Files that are too large or outside the roots keep their row, with an error and without content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    inside = F.lit(True) if roots is None else admitted(F.regexp_replace("path", "^file:/+", "/"), roots)
    fits = inside & (F.col("length") <= MAX_BYTES)
    return files.withColumns(
        {
            "content": F.when(fits, F.col("content")),
            "format": F.when(fits, detect(F.col("path"), F.col("content"))),
            "sha256": F.when(fits, F.sha2("content", 256)),
            "error": F.when(~inside, F.lit("outside the roots")).when(~fits, F.lit(f"larger than {MAX_BYTES} bytes")),
        }
    )


def listing(files: DataFrame, shown: int = 500) -> DataFrame:
    """The first files by path with their sizes: a top-k, so each task keeps its own first ones only."""
    from sparkfolio.functions.text import human_size

    return files.select("path", "length", human_size(F.col("length")).alias("size")).orderBy("path").limit(shown)
