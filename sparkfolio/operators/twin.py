"""The document's structured projections: section paths, element and chunk links, page maps, roll-ups, visual candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import WS, overlap_ratio
from sparkfolio.session import ship_package


def element_chunks(elements: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each element with the ids of the chunks that hold it, in order; none for those in no chunk."""
    held = chunks.select(id_col, F.explode("element_ids").alias("element_id"), "chunk_id")
    listed = held.groupBy(id_col, "element_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return elements.join(listed, [id_col, "element_id"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def cogroup_elements(texts: DataFrame, tables: DataFrame, images: DataFrame, key_cols: list[str]) -> DataFrame:
    """Text, image and table elements of each page in one order: kind first, then position."""
    ranked = lambda df, kind, rank: df.select(*key_cols, F.lit(kind).alias("type"), F.lit(rank).alias("_k"), "position", "content")
    union = ranked(texts, "text", 0).unionByName(ranked(images, "image", 1)).unionByName(ranked(tables, "table", 2))
    return union.withColumn("n", F.row_number().over(Window.partitionBy(*key_cols).orderBy("_k", "position"))).drop("_k")


def section_parents(headings: DataFrame, doc_cols: list[str], order_col: str, level_col: str = "level") -> DataFrame:
    """Each heading with the order number of its parent: the nearest heading before it of a lower level; null at the top.

    For levels 1 to 6 the nearest earlier heading of each level is a running last(): the parent is the latest of those below.
    """
    order = Window.partitionBy(*doc_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    lasts = {f"_l{k}": F.last(F.when(F.col(level_col) == k, F.col(order_col)), ignorenulls=True).over(order) for k in range(1, 6)}
    with_lasts = headings.withColumns(lasts)
    parent = F.greatest(F.lit(None).cast("long"), *[F.when(F.col(level_col) > k, F.col(f"_l{k}")).cast("long") for k in range(1, 6)])
    return with_lasts.withColumn("parent", parent).drop(*lasts)


def section_path(items: Column) -> Column:
    """Paths of an ordered array of struct<level, title>: 'A > B' for each, by a fold that keeps the open sections."""
    step = lambda acc, h: F.struct(
        F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]), F.array(h)).alias("open"),
        F.concat(acc["paths"], F.array(F.array_join(F.transform(F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]), F.array(h)), lambda o: o["title"]), " > "))).alias("paths"),
    )
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("open"), F.array().cast("array<string>").alias("paths"))
    return F.aggregate(items, start, step)["paths"]


def rollup_nodes(nodes: DataFrame, doc_cols: list[str], path_col: str = "path") -> DataFrame:
    """Counts, page range and depth of every ancestor's subtree; path is the array of node ids from the root to the node itself."""
    spread = nodes.select(*doc_cols, F.explode(path_col).alias("ancestor"), "page", F.size(path_col).alias("_d"), F.array_position(F.col(path_col), F.element_at(path_col, -1)).alias("_e"))
    return spread.groupBy(*doc_cols, "ancestor").agg(F.count(F.lit(1)).alias("nodes"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max("_d").alias("deepest"))


def page_map(pages: DataFrame, parts: dict[str, DataFrame], key_cols: list[str]) -> DataFrame:
    """Pages with the number of rows that each part has for them; parts without any count as 0."""
    out = pages.select(*key_cols).distinct()
    for name, rows in parts.items():
        out = out.join(rows.groupBy(*key_cols).agg(F.count(F.lit(1)).alias(name)), key_cols, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def unmatched_enrichments(enrichments: DataFrame, elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """Enrichments whose element is unknown: they become nodes of their page."""
    return enrichments.join(elements.select(*key_cols).distinct(), key_cols, "left_anti")


def kind_counts(enrichments: DataFrame, doc_cols: list[str], kind_col: str = "target_element_type") -> DataFrame:
    return enrichments.groupBy(*doc_cols, F.coalesce(F.col(kind_col), F.lit("visual_region")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def captions_without_target(captions: DataFrame, targets: DataFrame, key_cols: list[str], reach: float = 112.0) -> DataFrame:
    """Captions with no target of their kind close by on their page: an anti-join on page and kind with a distance condition."""
    c, t = captions.alias("c"), targets.alias("t")
    across = overlap_ratio(F.col("c.left"), F.col("c.right"), F.col("t.left"), F.col("t.right"))
    along = overlap_ratio(F.col("c.bottom"), F.col("c.top"), F.col("t.bottom"), F.col("t.top"))
    apart = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))
    close = ((across >= 0.12) & (apart("c.bottom", "c.top", "t.bottom", "t.top") <= reach)) | ((along >= 0.32) & (apart("c.left", "c.right", "t.left", "t.right") <= reach))
    same = F.lit(True)
    for k in (*key_cols, "kind"):
        same = same & (F.col(f"c.{k}") == F.col(f"t.{k}"))
    return c.join(t, same & close, "left_anti")


def words_of(text: Column) -> Column:
    """Words of a line with their UTF-16 start and end: array<struct<word, start, end>>."""
    units = lambda s: (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")
    runs = F.regexp_extract_all(text, F.lit(f"[{WS}]+|[^{WS}]+"), F.lit(0))
    folded = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + units(r)).cast("int").alias("at"),
            F.when(r.rlike(f"^[{WS}]"), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(r.alias("word"), acc["at"].cast("int").alias("start"), (acc["at"] + units(r)).cast("int").alias("end"))))).alias("out"),
        ),
    )
    return folded["out"]


def text_layer(elements: DataFrame, doc_cols: list[str], text_col: str = "content") -> DataFrame:
    """Lines, words, characters and UTF-16 units of each document's page."""
    words = F.size(F.regexp_extract_all(F.col(text_col), F.lit(f"[^{WS}]+"), F.lit(0)))
    units = (F.octet_length(F.encode(text_col, "UTF-16BE")) / 2).cast("long")
    return elements.groupBy(*doc_cols).agg(F.count(F.lit(1)).alias("lines"), F.sum(words).alias("words"), F.sum(F.length(text_col)).alias("chars"), F.sum(units).alias("utf16"))


def signal_presence(rows: DataFrame, doc_cols: list[str], flags: dict[str, Column]) -> DataFrame:
    """Whether any row of a document has each flag."""
    return rows.groupBy(*doc_cols).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


#: Weights are drawn by a polynomial of degree three modulo this prime, in numbers of 64 bits; its coefficients are fixed.
PRIME = (1 << 31) - 1
COEFFICIENTS = (1_640_531_527, 69_069, 1_812_433_253 % PRIME, 1_103_515_245)
#: The distribution function of Poisson(1), in the prime's units.
POISSON = tuple(int(p * PRIME) for p in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941))
_ROWS = 256  # rows whose weights are drawn at a time


def poisson_weights(ids: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row (id) is drawn in each round, rows by rounds: the same for a row wherever it is."""
    x = (ids.astype(np.int64)[:, None] % PRIME * 7_919 + np.arange(1, rounds + 1)[None, :] * 104_729) % PRIME
    u = np.full_like(x, COEFFICIENTS[0])
    for c in COEFFICIENTS[1:]:
        u = (u * x + c) % PRIME
    return np.searchsorted(np.array(POISSON), u, "right")


def bootstrap_interval(rows: DataFrame, errors: str, units: str, rounds: int = 1_000, id_col: str = "id") -> DataFrame:
    """Rate in percent, and its 95 % interval by Poisson resampling: (rate, low, high); each row draws a weight of its own in each round.

    A task adds up all rounds in one pair of arrays and gives one row; those meet in one task, which adds array to array. Null errors and units count
    as 0, ids are whole numbers. Without rows there is no row.
    """
    ship_package(rows.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, rounds + 1), np.int64)
        seen = False
        for batch in batches:
            ids, *values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            seen |= len(ids) > 0
            for low in range(0, len(ids), _ROWS):
                weights = np.pad(poisson_weights(ids[low : low + _ROWS], rounds), ((0, 0), (1, 0)), constant_values=1)  # round 0 has every row once
                total += np.stack([v[low : low + _ROWS] for v in values]) @ weights
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in total], ["errors", "units"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = np.array(pair) if total is None else total + np.array(pair)
        if total is not None:
            rate = total[0] * 100.0 / np.maximum(total[1], 1)
            low, high = np.quantile(rate[1:], [0.025, 0.975])
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (rate[0], low, high)], ["rate", "low", "high"])

    kept = rows.select(F.col(id_col).cast("long"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_{k}") for k, c in enumerate((errors, units))])
    parts = kept.mapInArrow(sums, "errors array<long>, units array<long>")
    return parts.repartition(1).mapInArrow(merged, "rate double, low double, high double")


def multiset_overlap(expected: DataFrame, actual: DataFrame, key_cols: list[str], value_col: str) -> DataFrame:
    """How many of the expected values each key got, counting repeats: one aggregation of both sides."""
    sided = lambda df, s: df.select(*key_cols, F.col(value_col).alias("_v"), F.lit(s).alias("_s"))
    counted = sided(expected, 0).unionByName(sided(actual, 1)).groupBy(*key_cols, "_v").agg(F.count_if(F.col("_s") == 0).alias("_a"), F.count_if(F.col("_s") == 1).alias("_b"))
    return counted.groupBy(*key_cols).agg(F.sum(F.least("_a", "_b")).alias("matched"), F.sum("_a").alias("expected"), F.sum("_b").alias("extracted"))


def navigation_score(rows: DataFrame) -> DataFrame:
    """Answer and page accuracy; rows: answers, answer, evidence_pages, pages."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    right = F.exists("answers", lambda a: norm(a) == norm(F.col("answer")))
    cited = F.size(F.array_intersect("evidence_pages", "pages"))
    rated = rows.select(right.alias("_right"), cited.alias("_cited"), F.size("pages").alias("_pages"), F.size("evidence_pages").alias("_evidence"))
    return rated.agg(
        F.avg(F.col("_right").cast("double")).alias("answer"), F.avg((F.col("_right") & (F.col("_cited") > 0)).cast("double")).alias("answer_and_page"),
        F.avg(F.col("_cited") / F.greatest(F.col("_pages"), F.lit(1))).alias("page_precision"), F.avg(F.col("_cited") / F.greatest(F.col("_evidence"), F.lit(1))).alias("page_recall"),
    )
