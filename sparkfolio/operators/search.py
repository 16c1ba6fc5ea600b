"""Literal and ranked search over units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import ALNUM, collapse, term_count, terms
from sparkfolio.session import cut_lineage

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, sorted."""
    import re

    cjk = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
    return sorted(set(re.findall(f"[{cjk}]|[^\\W_{cjk}]+", query.lower())))


def _is(word: str):
    return lambda x: x == F.lit(word)


def bm25(units: DataFrame, query: str, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Units with a positive BM25 score: id columns, score.

    One pass over the texts writes a narrow row a unit, its length and the counts of the query's terms; statistics and scores come from those. Only
    texts that hold a term as a string are cut into terms, the others are merely counted.
    """
    wanted = query_terms(query)
    if not wanted:
        return units.select(*id_cols, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.col(text_col))
    holds = reduce(lambda x, y: x | y, [low.contains(w) for w in wanted])
    cut = units.select(*id_cols, F.when(holds, terms(F.col(text_col))).alias("_t"), F.when(~holds, term_count(F.col(text_col))).alias("_none"))
    hits = cut.select(*id_cols, F.when(F.col("_t").isNotNull(), F.size("_t")).otherwise(F.col("_none")).alias("_len"), F.filter("_t", lambda t: t.isin(*wanted)).alias("_hits"))
    counts = [F.coalesce(F.size(F.filter("_hits", _is(w))), F.lit(0)).alias(f"_tf{k}") for k, w in enumerate(wanted)]
    counted = cut_lineage(hits.select(*id_cols, "_len", *counts))
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(F.col("_len").cast("double")).alias("_avg"), *[F.count_if(F.col(f"_tf{k}") > 0).cast("double").alias(f"_df{k}") for k in range(len(wanted))]
    ).first()
    n, avg = stats["_n"], max(1.0, stats["_avg"] or 0.0)
    score = F.lit(0.0)
    for k in range(len(wanted)):
        df = F.lit(stats[f"_df{k}"])
        idf = F.log((F.lit(n) - df + 0.5) / (df + 0.5) + 1)
        tf = F.col(f"_tf{k}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / avg))).otherwise(F.lit(0.0))
    return counted.select(*id_cols, score.alias("score")).filter("score > 0")


def ranked(units: DataFrame, query: str, limit: int, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The best units, ties in unit order. A top-k: each task keeps its own best first."""
    return bm25(units, query, id_cols, text_col).orderBy(F.desc("score"), *id_cols).limit(limit)


def literal_pattern(query: str, whole_word: bool) -> str:
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?<![{ALNUM}_]){quoted}(?![{ALNUM}_])" if whole_word else quoted


def literal_counts(units: DataFrame, query: str, id_cols: list[str], text_col: str = "text", case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """Non-overlapping matches of the folded query in each unit's folded text; units without any are left out."""
    fold = lambda c: collapse(c if case_sensitive else F.lower(c))
    needle = " ".join((query if case_sensitive else query.lower()).split())
    hits = F.regexp_count(fold(F.col(text_col)), F.lit(literal_pattern(needle, whole_word)))
    return units.select(*id_cols, hits.cast("long").alias("matches")).filter("matches > 0")


def literal_hits(units: DataFrame, query: str, id_cols: list[str], doc_cols: list[str], per_doc: int, context: int = 40, text_col: str = "text", whole_word: bool = False) -> DataFrame:
    """The first per_doc matches of each document, with their number, offset and surroundings in the folded text."""
    needle = " ".join(query.lower().split())
    folded = units.select(*id_cols, collapse(F.lower(F.col(text_col))).alias("_f")).filter(F.col("_f").contains(needle))
    pieces = F.split(F.col("_f"), literal_pattern(needle, whole_word))
    # a match starts where the pieces before it, and the matches between them, end
    offsets = F.slice(
        F.aggregate(
            F.transform(pieces, F.length), F.array(F.lit(0).cast("int")), lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n + len(needle)).cast("int")))
        ),
        2,
        F.size(pieces) - 1,
    )
    at = folded.select(*id_cols, "_f", F.posexplode(F.transform(offsets, lambda o: o - len(needle))).alias("_k", "offset"))
    order = Window.partitionBy(*doc_cols).orderBy(*[c for c in id_cols if c not in doc_cols], "offset")
    kept = at.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_doc)
    start = F.greatest(F.col("offset") - context + 1, F.lit(1))
    return kept.select(*id_cols, "n", "offset", F.substring("_f", start, F.col("offset") + len(needle) + context - start + 1).alias("snippet"))


def auto_search(units: DataFrame, query: str, limit: int, id_cols: list[str], text_col: str = "text") -> tuple[str, DataFrame]:
    """Literal search, or ranked search where nothing matches literally."""
    found = literal_counts(units, query, id_cols, text_col)
    if not found.isEmpty():
        return "literal", found.orderBy(F.desc("matches"), *id_cols).limit(limit)
    return "ranked", ranked(units, query, limit, id_cols, text_col)


def quota_union(sources: list[DataFrame], key_cols: list[str], order_cols: list[str], quota: int) -> DataFrame:
    """The rows of ranked sources that fit a quota for each key: all of the first source before the next, in order; with source, place and truncated.

    What a source leaves of a key's quota is what the next may use; truncated tells that the key had more rows than the quota. The limit is a rank of
    the joint order, which Spark applies in each task before it shuffles, so a key with a third of all rows sends `quota` rows a task. Ties
    beyond order_cols are broken by the columns of the row.
    """
    ranked_rows = None
    for k, source in enumerate(sources):
        one = source.withColumn("source", F.lit(k))
        ranked_rows = one if ranked_rows is None else ranked_rows.unionByName(one)
    rest = [c for c in sorted(sources[0].columns) if c not in (*key_cols, *order_cols)]
    order = Window.partitionBy(*key_cols).orderBy("source", *order_cols, *rest)
    admitted = ranked_rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota + 1)
    known = admitted.withColumn("truncated", F.max("place").over(Window.partitionBy(*key_cols)) > quota)
    return known.filter(F.col("place") <= quota)
