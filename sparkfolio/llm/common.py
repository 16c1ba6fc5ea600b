"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most words of 64 bits in a survivor bitmap: 16 MB of bits, whatever the size of the input. Smaller ones follow the number of keys.
#: Beyond some 10**8 keys most bits are set: more rows then get the closer look, with the same answer.
BITMAP_WORDS = 1 << 21

_slot: dict = {}

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(key, build):
    """What build() gives, kept in this Python worker until another operator needs the place: workers live on over many stages."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = build()
    return _slot[key]


def text_slices(batch, column: int, chars: int):
    """(start, texts) of a record batch, some `chars` bytes at a time: texts become Python objects only as they are needed."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        stop, total = start, 0
        while stop < len(sizes) and (stop == start or total + sizes[stop] <= chars):
            total += int(sizes[stop])
            stop += 1
        yield start, batch.column(column)[start:stop].to_pylist()
        start = stop


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder is made and set if everything runs in one JVM (tests); elsewhere executors would not share it, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkfolio-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone, and with it the way to the folder
            pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read from there.

    Cuts the lineage like checkpoint(), but computes df once; a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkfolio_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_sparkfolio_path", None)
    if path:
        delete_path(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that are gone.

    Its cleaner acts when the driver's JVM collects garbage, by itself every half an hour; between the phases of an operator that shuffles much,
    the disk should not wait for that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Text of one byte a character takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(words)).cast("int")


def bitmap_words(n_keys: int) -> int:
    """Words for a bitmap of n_keys keys: some 16 bits a key, at most BITMAP_WORDS words."""
    return min(BITMAP_WORDS, 1 << max(10, (n_keys // 4).bit_length()))


def bitmap(keys: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """A bitmap of the 64-bit hashes in column key: at most `words` rows (word, bits).

    Its size is bounded whatever the number of keys, so it may be broadcast. Different keys may share a
    bit: it can only tell which rows need a closer look, never which rows are equal.
    """
    return keys.groupBy(_word(F.col(key), words).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("_bits")
    )


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with all its columns in one, _all, and columns beside it: no name of df can clash with them. select("_all.*") unpacks it."""
    return df.select(F.struct("*").alias("_all"), *[c.alias(name) for name, c in columns.items()])


def flag(df: DataFrame, bits: DataFrame, key: Column, words: int = 1 << 18) -> DataFrame:
    """df, whose columns are the caller's own or packed, with a boolean column _hit: whether the bitmap has the bit of key."""
    marked = df.withColumn("_key", key).withColumn("_word", _word(F.col("_key"), words))
    return marked.join(F.broadcast(bits), "_word", "left").withColumn(
        "_hit", F.coalesce(F.expr("getbit(_bits, cast(_key & 63 as int)) = 1"), F.lit(False))
    ).drop("_word", "_bits", "_key")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells a document from others, whether or not ids are null or repeated: its id and a hash of its text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash"))


def without_rows(docs: DataFrame, gone: DataFrame, key: Column, once: DataFrame | None = None) -> DataFrame:
    """docs less the rows whose key (a struct, so never null itself) is in gone (one column, _row).

    Of rows whose key is in once (the same), one stays. Only rows that a bounded bitmap of either hits are shuffled; the others pass.
    """
    keys = gone if once is None else gone.union(once)
    keys = keys.select("_row", F.xxhash64("_row").alias("_h"))
    words = bitmap_words(keys.count())
    flagged = flag(packed(docs, _row=key), bitmap(keys, "_h", words), F.xxhash64("_row"), words)
    passed = flagged.filter(~F.col("_hit")).select("_all.*")
    looked_at = flagged.filter("_hit").select("_all", "_row").join(gone, "_row", "left_anti")
    if once is not None:
        looked_at = looked_at.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).filter("_n = 1")
    return passed.unionByName(looked_at.select("_all.*"))


def sample_by_hash(rows: DataFrame, group: str, key: str, per_group: int, counts: dict | None = None) -> list[tuple]:
    """At most per_group distinct (key, group) of each group, those whose keys hash lowest, as sorted by (group, hash, key).

    Counts come first, with map-side combine; then only keys below a group's threshold are collected, about one and a half times
    per_group at most. No group meets in one task, however large it is. Rows of each group may be given where they are known.
    """
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 1.5 * per_group / n + 50 / n))])
    unit = F.shiftrightunsigned(F.xxhash64(F.col(key)), 11).cast("double") / F.lit(float(1 << 53))
    low = rows.select(key, group, unit.alias("_u")).filter(F.col("_u") < F.element_at(share, F.col(group))).distinct().collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(low, key=lambda r: (r[1], r[2], r[0])):
        if taken[r[1]] < per_group:
            taken[r[1]] += 1
            out.append((r[0], r[1]))
    return out
