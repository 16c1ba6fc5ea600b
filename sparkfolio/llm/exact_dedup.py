"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at the rows that the step before could not tell apart. What survives a step is kept
as a bitmap of bounded size, so no text is shuffled to find the groups. Built-in functions only.

Cases: a null text counts as empty, and empty texts are equal to each other. Of equal texts the row with
the largest id stays; where that row itself is repeated, one of the repeats stays. A null id counts as
smaller than any other. An empty table gives an empty result. Other columns are ignored by
exact_duplicates and carried, whatever their names, by drop_exact_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import ascii_lower, bitmap, bitmap_words, flag, materialize, packed

#: Characters of the prefix that the second step hashes.
PREFIX_CHARS = 64


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def _length_key(text):
    return F.xxhash64(F.octet_length(text))


def _prefix_key(text, chars: int):
    return F.xxhash64(F.octet_length(text), ascii_lower(F.substring(text, 1, chars)))


def _full_key(text):
    return F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS):
    """Groups of two and more equal texts (_sha, keep_id, group_size), and the bitmap of prefix keys that they passed, with its words."""
    rows = _rows(docs, id_col, text_col)
    # 1: lengths that occur more than once
    lengths = rows.groupBy(_length_key(F.col("_text")).alias("_k")).count().filter("count > 1")
    by_length = flag(rows, bitmap(lengths, "_k"), _length_key(F.col("_text"))).filter("_hit")
    # 2: of those, (length, prefix) that occurs more than once
    prefixes = by_length.groupBy(_prefix_key(F.col("_text"), prefix_chars).alias("_k")).count().filter("count > 1").select("_k")
    prefixes = materialize(prefixes, "prefixes")
    words = bitmap_words(prefixes.count())
    seen = bitmap(prefixes, "_k", words)
    # 3: of those, the whole text
    by_prefix = flag(rows, seen, _prefix_key(F.col("_text"), prefix_chars), words).filter("_hit")
    groups = by_prefix.groupBy(_full_key(F.col("_text")).alias("_sha")).agg(
        F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # written, so that a join with them shuffles both of its sides and can split a hot group
    return materialize(groups.filter("group_size > 1"), "groups"), seen, words


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    groups, _, _ = duplicate_groups(docs, id_col, text_col)
    all_rows = _rows(docs, id_col, text_col).select("_id", _full_key(F.col("_text")).alias("_sha"))
    joined = all_rows.join(groups, "_sha", "left")
    # by the pair as one value: by two columns, the rows of a group would stay where the join has put them, in one task
    repeat = F.row_number().over(Window.partitionBy(F.struct("_id", "_sha")).orderBy("_sha"))
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("_id").eqNullSafe(F.col("keep_id")) & (repeat == 1))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows whose (length, prefix) is met once stay without a shuffle; the others meet their group's keep_id.
    """
    groups, seen, words = duplicate_groups(docs, id_col, text_col)
    rows = packed(docs, _id=F.col(id_col), _text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    flagged = flag(rows, seen, _prefix_key(F.col("_text"), PREFIX_CHARS), words)
    alone = flagged.filter(~F.col("_hit")).select("_all.*")
    met = flagged.filter("_hit").select("_all", "_id", _full_key(F.col("_text")).alias("_sha")).join(groups, "_sha", "left")
    first = F.row_number().over(Window.partitionBy(F.struct("_id", "_sha")).orderBy("_sha"))
    stay = met.filter(F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).withColumn("_n", first)
    return alone.unionByName(stay.filter("_n = 1").select("_all.*"))
