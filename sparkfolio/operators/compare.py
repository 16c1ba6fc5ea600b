"""Comparison of documents, quote verification, and extraction scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import collapse, term_set
from sparkfolio.session import ship_package

TERM_CAP = 200


def compare_texts(a: Column, b: Column) -> Column:
    """struct<identical, chars_a, chars_b, added, removed> of two texts; terms sorted, the first TERM_CAP."""
    ta, tb = term_set(a), term_set(b)
    diff = lambda x, y: F.slice(F.array_except(x, y), 1, TERM_CAP)
    return F.struct((a == b).alias("identical"), F.length(a).alias("chars_a"), F.length(b).alias("chars_b"), diff(tb, ta).alias("added"), diff(ta, tb).alias("removed"))


def text_facts(text: Column) -> Column:
    """struct<terms, chars, digest>: what a comparison needs of a text, so that the text itself stays where it is."""
    return F.struct(term_set(text).alias("terms"), F.length(text).alias("chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))


def compare_facts(a: Column, b: Column) -> Column:
    """As compare_texts, of the facts of two texts."""
    diff = lambda x, y: F.slice(F.array_except(x["terms"], y["terms"]), 1, TERM_CAP)
    return F.struct((a["digest"] == b["digest"]).alias("identical"), a["chars"].alias("chars_a"), b["chars"].alias("chars_b"), diff(b, a).alias("added"), diff(a, b).alias("removed"))


def compare_pages(a: DataFrame, b: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Pages of two documents side by side: 'same', 'changed', 'added' or 'removed'."""
    x = a.select(*key_cols, F.col(text_col).alias("_a"), F.lit(True).alias("_in_a"))
    y = b.select(*key_cols, F.col(text_col).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return x.join(y, key_cols, "full").select(*key_cols, state.alias("state"), F.length("_a").alias("chars_a"), F.length("_b").alias("chars_b"))


def cite_check(citations: DataFrame, units: DataFrame, key_cols: list[str], quote_col: str = "quote", text_col: str = "text") -> DataFrame:
    """Each citation against the unit it names: 'exact', 'normalized', 'unmatched' or 'insufficient' (no such unit or no quote)."""
    found = citations.join(units.select(*key_cols, F.col(text_col).alias("_text")), key_cols, "left")
    quote = F.trim(F.col(quote_col))
    verdict = (
        F.when(F.col("_text").isNull() | (F.coalesce(quote, F.lit("")) == ""), "insufficient")
        .when(F.instr(F.col("_text"), quote) > 0, "exact")
        .when(F.instr(collapse(F.col("_text")), collapse(quote)) > 0, "normalized")
        .otherwise("unmatched")
    )
    return found.withColumn("verdict", verdict).drop("_text")


def contains_tolerant(outer: dict[str, Column], inner: dict[str, Column], tolerance: float = 0.0001) -> Column:
    return (
        (inner["left"] >= outer["left"] - tolerance) & (inner["bottom"] >= outer["bottom"] - tolerance) & (inner["right"] <= outer["right"] + tolerance) & (inner["top"] <= outer["top"] + tolerance)
    )


def valid_box(box: dict[str, Column]) -> Column:
    finite = F.lit(True)
    for c in box.values():
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite & (box["right"] > box["left"]) & (box["top"] > box["bottom"])


def score_tokens(text: Column) -> Column:
    """Lower-cased words without underscores; each CJK character by itself. Markup signs are no words."""
    from sparkfolio.functions.text import ALNUM, CJK

    # ASCII first and possessively: the classes of all letters are slow to test
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?:[a-z0-9]++|[{ALNUM}&&[^{CJK}]])++|[{CJK}]"), F.lit(0))


def bag_f1(pairs: DataFrame, id_cols: list[str], reference: str, output: str) -> DataFrame:
    """Precision, recall and F1 of the multisets of words.

    Words are counted by (pair, word) for both sides at once, so one aggregation stands in for a join of two, and pairs are made once. A pair without
    words keeps its row.
    """
    words = lambda c, side: F.transform(F.coalesce(score_tokens(F.col(c)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("w"), F.lit(side).alias("s")))
    told = pairs.select(*id_cols, F.explode_outer(F.concat(words(reference, 0), words(output, 1))).alias("_t"))
    counted = told.groupBy(*id_cols, F.col("_t.w").alias("_w")).agg(F.count_if(F.col("_t.s") == 0).alias("_a"), F.count_if(F.col("_t.s") == 1).alias("_b"))
    rated = counted.groupBy(*id_cols).agg(F.sum(F.least("_a", "_b")).alias("overlap"), F.sum("_a").alias("_nr"), F.sum("_b").alias("_no"))
    p, r = F.col("overlap") / F.col("_no"), F.col("overlap") / F.col("_nr")
    # 2pr / (p + r) by the counts: rounded once, so that what lies halfway between two decimals stays there
    f1 = 2 * F.col("overlap") / (F.col("_nr") + F.col("_no"))
    zero = F.col("overlap") == 0
    return rated.select(*id_cols, "overlap", *[F.when(zero, 0.0).otherwise(c).alias(name) for name, c in (("precision", p), ("recall", r), ("f1", f1))])


def sentence_recall(rows: DataFrame, id_cols: list[str], sentences: str, text: str) -> DataFrame:
    """How many of an array of sentences the text holds, white space collapsed."""
    flat = collapse(F.col(text))
    hits = F.size(F.filter(sentences, lambda s: F.contains(flat, collapse(s))))
    return rows.select(*id_cols, hits.alias("found"), F.size(sentences).alias("total"))


def leaderboard(corpus: DataFrame, results: DataFrame) -> DataFrame:
    """Mean of category means for each tool; a document without a good result scores 0.

    corpus: doc, category. results: tool, doc, status, score.
    """
    tools = results.select("tool").distinct()
    good = results.filter("status = 'ok'").select("tool", "doc", "score")
    # each tool's categories: sums over what it converted, over the corpus' own counts
    sizes = corpus.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    sums = good.join(corpus, "doc").groupBy("tool", "category").agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_ok"))
    means = sums.join(sizes, "category").select("tool", "_ok", (F.col("_s") / F.col("_n")).alias("_m"))
    categories = sizes.count()
    rated = means.groupBy("tool").agg(F.sum("_m").alias("_t"), F.sum("_ok").alias("converted"))
    return tools.join(rated, "tool", "left").select("tool", (F.coalesce("_t", F.lit(0.0)) / max(1, categories)).alias("overall"), F.coalesce("converted", F.lit(0)).alias("converted"))


def common_documents(results: DataFrame) -> DataFrame:
    """Documents that every tool converted."""
    tools = results.agg(F.countDistinct("tool")).first()[0]
    return results.filter("status = 'ok'").groupBy("doc").agg(F.countDistinct("tool").alias("tools")).filter(F.col("tools") == tools)


def merge_shards(shards: list[DataFrame], corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of result shards, and what is wrong with it: documents missing or met twice."""
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s)
    seen = merged.groupBy("doc").agg(F.count(F.lit(1)).alias("times"))
    faults = corpus.select("doc").join(seen, "doc", "left").fillna(0, ["times"]).filter("times <> 1")
    return merged, faults


def error_rate(rows: DataFrame, key_cols: list[str], reference: str, hypothesis: str) -> DataFrame:
    """Character errors over reference characters, in percent.

    A band around the diagonal gives the exact distance where it is no wider than the band, so the full table is filled only for texts that are far apart.
    """
    a, b = F.col(reference), F.col(hypothesis)
    errors = F.coalesce(*[F.nullif(F.levenshtein(a, b, width), F.lit(-1)) for width in (16, 128)], F.levenshtein(a, b))
    return rows.groupBy(*key_cols).agg(F.sum(errors).alias("errors"), F.sum(F.length(reference)).alias("units"), (F.sum(errors) * 100 / F.greatest(F.sum(F.length(reference)), F.lit(1))).alias("rate"))


def longest_increasing(values: list[int]) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def _masks(words: list[str]) -> dict[str, int]:
    """For each word the places that hold it, as the bits of one number."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        places.setdefault(w, []).append(k)
    out = {}
    for w, ks in places.items():
        raw = bytearray(ks[-1] // 8 + 1)
        for k in ks:
            raw[k >> 3] |= 1 << (k & 7)
        out[w] = int.from_bytes(raw, "little")
    return out


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is one number: a zero bit is a place where the row's value grows."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def word_edits(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and changes between two sequences: a column of the table is two numbers, of the places where it grows and shrinks."""
    if not a:
        return len(b)
    masks, full, last = _masks(a), (1 << len(a)) - 1, len(a) - 1
    up, down, score = full, 0, len(a)
    for w in b:
        match = masks.get(w, 0)
        level = (((match & up) + up) ^ up) | match | down
        right_up, right_down = (down | ~(level | up)) & full, up & level
        score += (right_up >> last & 1) - (right_down >> last & 1)
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up, down = (right_down | ~(level | right_up)) & full, right_up & level
    return score


_DP = {"common_subsequence": common_subsequence, "word_edits": word_edits}


def sequence_measure(rows: DataFrame, id_cols: list[str], a: str, b: str, measure: str) -> DataFrame:
    """A dynamic-programming measure of two arrays of strings, row by row in Arrow batches: (ids, value)."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_DP[measure](x or [], y or []) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), pa.array(found, pa.int64())], [*id_cols, "value"])

    kept = rows.select(*id_cols, a, b)
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in id_cols)
    return kept.mapInArrow(run, f"{schema}, value long")
