"""Cues, scenes and clocks of timed media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import clock

STAMP = r"(?:(\d{1,3}):)?([0-5]?\d):([0-5]\d)[.,](\d{1,3})"


def parse_stamp(value: Column) -> Column:
    """HH:MM:SS,mmm or MM:SS.mmm as milliseconds; null for anything else."""
    pattern = rf"^\s*{STAMP}\s*$"
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(value, pattern, k), F.lit("")), F.lit("999")), F.lit(0)).cast("long")
    millis = F.rpad(F.regexp_extract(value, pattern, 4), 3, "0").cast("long")
    return F.when(value.rlike(pattern), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + millis)


def clean_cue(line: Column) -> Column:
    """A cue's text: voice tags as 'Speaker: ', other tags and overrides gone, five entities resolved."""
    out = F.regexp_replace(line, r"<v(?:\.[^ >]*)?\s+([^>]+)>", "$1: ")
    out = F.regexp_replace(F.regexp_replace(out, r"</?[A-Za-z][^>]*>|<\d[^>]*>", ""), r"\{\\[^}]*\}", "")
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return F.trim(out)


def cues(tracks: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Cues of SRT and WebVTT texts: (ids, n, start_ms, end_ms, text)."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "^﻿", ""), "\n[ \t]*\n+")
    at = tracks.select(*id_cols, F.posexplode(blocks).alias("_k", "_b")).filter(~F.ltrim(F.col("_b")).rlike(r"^(?:NOTE|STYLE|REGION)\b"))
    timing = r"(?m)^\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+)"
    body = F.filter(
        F.transform(F.split(F.regexp_replace(F.col("_b"), r"(?s)^.*?-->[^\n]*\n?", ""), "\n"), clean_cue), lambda x: x != ""
    )
    parsed = at.filter(F.col("_b").contains("-->")).select(
        *id_cols, "_k", parse_stamp(F.regexp_extract("_b", timing, 1)).alias("start_ms"), parse_stamp(F.regexp_extract("_b", timing, 2)).alias("end_ms"), F.array_join(body, " ").alias("text")
    )
    kept = parsed.filter("start_ms IS NOT NULL AND text <> ''")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*id_cols).orderBy("_k"))).drop("_k")


def render_cues(rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """Each track as Markdown lines '[mm:ss] text'; with hours if any cue has them."""
    held = rows.groupBy(*id_cols).agg(F.max("start_ms").alias("_m"), F.sort_array(F.collect_list(F.struct("start_ms", "n", "text"))).alias("_c"))
    line = lambda c: F.concat(F.lit("["), clock(c["start_ms"], F.col("_m") >= 3_600_000), F.lit("] "), c["text"])
    return held.select(*id_cols, F.array_join(F.transform("_c", line), "\n").alias("markdown"))


def cues_in_window(rows: DataFrame, start_ms: Column, end_ms: Column) -> DataFrame:
    """Cues that overlap the half-open window."""
    return rows.filter((F.col("start_ms") < end_ms) & (F.col("end_ms") > start_ms))


def scenes(cuts: DataFrame, key_cols: list[str], at: str, start: int, end: int, cap: int = 20) -> DataFrame:
    """Scenes between the distinct cuts inside [start, end): (keys, scene, start_ms, end_ms, truncated)."""
    inside = cuts.filter((F.col(at) > start) & (F.col(at) < end)).select(*key_cols, F.col(at).cast("long").alias("start_ms"))
    starts = inside.unionByName(cuts.select(*key_cols, F.lit(start).cast("long").alias("start_ms"))).distinct()
    order = Window.partitionBy(*key_cols).orderBy("start_ms")
    numbered = starts.withColumn("scene", F.row_number().over(order)).withColumn("end_ms", F.lead("start_ms", 1, end).over(order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*key_cols))
    return numbered.withColumn("truncated", total > cap).filter(F.col("scene") <= cap)


def exact_micros(ticks: Column, num: Column, den: Column) -> Column:
    """ticks * num / den seconds in microseconds where that is a whole number, else null."""
    top = ticks.cast("decimal(38,0)") * num.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)")
    return F.when((den > 0) & (top % den.cast("decimal(38,0)") == 0), (top / den.cast("decimal(38,0)")).cast("long"))


def playback(pts: Column, origin: Column) -> Column:
    return pts - origin


def sidecars(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Media files with the subtitle files beside them: stem.srt, stem.vtt, stem.lang.srt and stem.lang.vtt."""
    stem = F.regexp_extract(path_col, r"^(.*?)(?:\.[A-Za-z]{2,3}(?:-[A-Za-z]+)?)?\.(?:srt|vtt)$", 1)
    media = files.filter(F.lower(path_col).rlike(r"\.(mp4|mkv|webm|mov|avi|mp3|m4a|wav|flac|ogg)$")).select(F.col(path_col).alias("media"), F.regexp_replace(path_col, r"\.[^.]+$", "").alias("_stem"))
    subs = files.filter(F.lower(path_col).rlike(r"\.(srt|vtt)$")).select(F.col(path_col).alias("sidecar"), stem.alias("_stem"))
    return media.join(subs, "_stem").select("media", "sidecar")
