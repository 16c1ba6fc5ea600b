"""The prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

A turn is a unit of fixed width: 128 bits of hash of role and text, and the text's length in code points. Equal conversations meet in one
row; the distinct ones are sorted by range, numbered, and compared with their neighbour: LCP[i] is the number of first turns that
sequence i shares with sequence i - 1. The nearest smaller value of LCP to the left and to the right of each place bounds the interval of
sequences below it. These are found in all blocks of the array at once; where a block does not hold the answer, the same search over the
blocks' minima names the block that does, and so on up. Places with equal bounds and depth are one node; the depths between a node and its
parent, and those below the last branching, are nodes with the same interval. What a node reports is a difference of prefix sums
at its bounds, or a least value over blocks.

Every step is a join, a window by range partition, or an aggregate; what is broadcast has a row for each range partition.

Cases: a null role or text is empty; turns are ordered by turn, null first, and of equal turns by hash. A null id is one conversation with
empty digits, and names a node only if it is alone there. Conversations without turns are members of the root. One conversation is
one value (40 bytes a turn). An empty table gives an empty result, without a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkfolio.llm.common import materialize, release
from sparkfolio.session import ship_package

#: Values of an array that are looked at together.
BLOCK = 256
#: Ids that are joined to one piece before the pieces of a group meet.
PIECE = 1 << 14


def unit_of(role: Column, text: Column) -> Column:
    """32 hex digits of hash of role and text, 8 of the text's code points."""
    role, text = (F.coalesce(x.cast("string"), F.lit("")) for x in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, units): the turns of each conversation in order."""
    rows = turns.select("conv_id", "turn", unit_of(F.col("role"), F.col("text")).alias("_unit"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "_unit"))).alias("_turns"))
    return found.select("conv_id", F.transform("_turns", lambda t: t["_unit"]).alias("units"))


def _shared(a: str, b: str) -> Column:
    """The number of first units that two distinct arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(same, F.lit(False)) - 1).cast("long")


@F.pandas_udf(ArrayType(LongType()))
def _running(sizes: pd.Series) -> pd.Series:
    """0, and the running sums of each array."""
    return sizes.map(lambda x: pd.Series([0, *x], dtype="int64").cumsum().to_numpy())


def ordered(seqs: DataFrame) -> tuple[DataFrame, int]:
    """The distinct sequences in order, and how many: pos, units, size, sums (of text lengths), ends, least, gid, lcp, next_lcp and, of the sequences before each one, w (ends), f (leaves), a and b (text)."""
    spark = seqs.sparkSession
    ship_package(spark)
    groups = seqs.groupBy("units").agg(F.count(F.lit(1)).alias("ends"), F.min("conv_id").alias("least"))
    ranged = groups.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "units").sortWithinPartitions("units")
    placed = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    placed = materialize(placed, "placed")
    every = Window.orderBy("part")  # a row for each range partition
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", "n", (F.sum("n").over(every) - F.col("n")).alias("offset"), F.lag("part").over(every).alias("before"), F.lead("part").over(every).alias("after"))
    rows = placed.join(F.broadcast(parts), "part").withColumn("pos", F.col("offset") + F.col("at"))
    # the last row of a partition also goes to the next one, and the first to the one before
    homes = F.array_compact(F.array("part", F.when(F.col("at") == F.col("n") - 1, F.col("after")), F.when(F.col("at") == 0, F.col("before"))))
    by_home = Window.partitionBy("home").orderBy("pos")
    met = rows.withColumn("home", F.explode(homes)).withColumn("_before", F.lag("units").over(by_home)).withColumn("_after", F.lead("units").over(by_home))
    lengths = F.transform("units", lambda u: F.conv(F.substring(u, 33, 8), 16, 10).cast("long"))
    kept = met.filter("home = part").select(
        "part", "pos", "units", F.size("units").cast("long").alias("size"), _running(lengths).alias("sums"), "ends", "least", F.sha2(F.array_join("units", ""), 256).alias("gid"),
        F.coalesce(_shared("_before", "units"), F.lit(-1)).alias("lcp"), F.coalesce(_shared("units", "_after"), F.lit(-1)).alias("next_lcp"),
    )
    total = F.element_at("sums", -1)
    kept = kept.withColumns({"_f": (F.col("size") > F.col("next_lcp")).cast("long"), "_a": F.col("ends") * total, "_b": total - F.get("sums", F.greatest("lcp", F.lit(0)))})
    kept = materialize(kept, "kept")
    names = {"w": "ends", "f": "_f", "a": "_a", "b": "_b"}
    sums = kept.groupBy("part").agg(*[F.sum(c).alias(f"_t{k}") for k, c in names.items()])
    sums = sums.select("part", *[(F.sum(f"_t{k}").over(every) - F.col(f"_t{k}")).alias(f"_o{k}") for k in names])
    inside = Window.partitionBy("part").orderBy("pos")
    out = kept.join(F.broadcast(sums), "part").withColumns({k: F.sum(c).over(inside) - F.col(c) + F.col(f"_o{k}") for k, c in names.items()})
    out = materialize(out.drop("part", "_f", "_a", *[f"_o{k}" for k in names]), "ordered")
    release(placed)
    release(kept)
    return out, out.count()


def _blocks(values: DataFrame, op) -> DataFrame:
    """(block, arr, low): BLOCK neighbouring values (pos, v) in a row, and op of them."""
    rows = values.groupBy(F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_rows"), op("v").alias("low"))
    return materialize(rows.select("block", F.transform("_rows", lambda r: r["v"]).alias("arr"), "low"), "blocks")


def nearest_smaller(values: DataFrame, queries: DataFrame, n: int, left: bool) -> DataFrame:
    """(pos, x, at): for queries (pos, x) the nearest place before pos (left) or after it whose value is below x; where there is none, -1 or n.

    values: (pos, v) for all places from 0 to n - 1.
    """
    blocks = _blocks(values, F.min)
    below = lambda arr: F.transform(arr, lambda v: v < F.col("x"))
    k = F.col("pos") % BLOCK
    near = below(F.slice("arr", F.lit(1), k.cast("int")) if left else F.slice("arr", (k + 2).cast("int"), BLOCK))
    step = F.array_position(F.reverse(near) if left else near, F.lit(True))
    own = queries.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks, "block").withColumn("_step", step)
    own = materialize(own.select("block", "pos", "x", F.when(F.col("_step") > 0, F.col("pos") - F.col("_step") if left else F.col("pos") + F.col("_step")).alias("at")), "own")
    done = own.filter("at IS NOT NULL").select("pos", "x", "at")
    rest = own.filter("at IS NULL").select("block", "pos", "x")
    none = F.lit(-1 if left else n).cast("long")
    if n <= BLOCK:
        return done.unionByName(rest.select("pos", "x", none.alias("at")))
    count = -(-n // BLOCK)
    upper = nearest_smaller(blocks.select(F.col("block").alias("pos"), F.col("low").alias("v")), rest.select(F.col("block").alias("pos"), "x").distinct(), count, left)
    told = rest.join(upper.select(F.col("pos").alias("block"), "x", F.col("at").alias("_block")), ["block", "x"])
    target = blocks.select(F.col("block").alias("_block"), "arr")
    found = told.join(target, "_block", "left")
    place = F.array_position(F.reverse(below("arr")) if left else below("arr"), F.lit(True))
    at = F.col("_block") * BLOCK + (F.size("arr") - place if left else place - 1)
    return done.unionByName(found.select("pos", "x", F.coalesce(at, none).alias("at")))


def range_least(values: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(lo, hi, least): the least v of the places lo to hi - 1, for queries (lo, hi), lo < hi."""
    blocks = _blocks(values, F.min)
    head, tail = (blocks.select(F.col("block").alias(c), F.col("arr").alias(f"{c}_arr")) for c in ("_p", "_q"))
    placed = queries.withColumns({"_p": F.floor(F.col("lo") / BLOCK), "_q": F.floor((F.col("hi") - 1) / BLOCK)}).join(head, "_p").join(tail, "_q")
    first, size = (F.col("lo") % BLOCK + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")
    one = F.array_min(F.slice("_p_arr", first, F.least(size, F.lit(BLOCK))))
    two = F.least(F.array_min(F.slice("_p_arr", first, F.lit(BLOCK))), F.array_min(F.slice("_q_arr", F.lit(1), ((F.col("hi") - 1) % BLOCK + 1).cast("int"))))
    edges = placed.select("lo", "hi", "_p", "_q", F.when(F.col("_p") == F.col("_q"), one).otherwise(two).alias("least"))
    if n <= 2 * BLOCK:
        return edges.select("lo", "hi", "least")
    edges = materialize(edges, "edges")
    inner = edges.filter("_q - _p > 1").select((F.col("_p") + 1).alias("lo"), F.col("_q").alias("hi")).distinct()
    within = range_least(blocks.select(F.col("block").alias("pos"), F.col("low").alias("v")), inner, -(-n // BLOCK)).select((F.col("lo") - 1).alias("_p"), F.col("hi").alias("_q"), F.col("least").alias("_inner"))
    return edges.join(within, ["_p", "_q"], "left").select("lo", "hi", F.least("least", "_inner").alias("least"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gid, conv_id): ids of a group joined, some PIECE at a time."""
    gid, ids = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([ids[0]], pa.int64()), pa.array([",".join("" if i is None else str(i) for i in ids)])], ["gid", "first", "piece"])
    for batch in batches:
        for g, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (g != gid or len(ids) == PIECE):
                yield out()
                ids = []
            gid = g
            ids.append(i)
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gid, first): the digest of each group's pieces, joined."""
    gid, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([digest.hexdigest()])], ["gid", "ends_sha256"])
    for batch in batches:
        for g, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if g == gid:
                digest.update(b",")
            else:
                if digest:
                    yield out()
                gid, digest = g, hashlib.sha256()
            digest.update(piece.encode())
    if digest:
        yield out()


def end_digests(seqs: DataFrame) -> DataFrame:
    """(gid, ends_sha256) of each distinct sequence: of its members' ids, ascending. A large group is sorted and joined in many tasks; the last only hashes its pieces."""
    members = seqs.select(F.sha2(F.array_join("units", ""), 256).alias("gid"), F.col("conv_id").cast("long"))
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(n, "gid", "conv_id").sortWithinPartitions("gid", "conv_id").mapInArrow(_pieces, "gid string, first long, piece string")
    return pieces.repartition("gid").sortWithinPartitions("gid", "first").mapInArrow(_digests, "gid string, ends_sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row a node of the trie of sequences (conv_id, units): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = materialize(seqs.select("conv_id", "units"), "sequences")
    order, n = ordered(seqs)
    lcp = order.select("pos", F.col("lcp").alias("v"))
    places = lcp.filter("pos > 0").select("pos", F.col("v").alias("x"))
    low, high = (nearest_smaller(lcp, places, n, left).select("pos", F.col("at").alias(c)) for c, left in (("lo", True), ("hi", False)))
    bounds = materialize(places.join(low, "pos").join(high, "pos"), "bounds")
    least = range_least(order.select("pos", F.col("least").alias("v")), bounds.select("lo", "hi").distinct(), n)
    bounds = materialize(bounds.join(least, ["lo", "hi"]), "intervals")
    inner = bounds.groupBy("lo", "x").agg(F.max("hi").alias("hi"), (F.count(F.lit(1)) + 1).alias("_splits"), F.min("least").alias("least")).withColumnRenamed("x", "bottom")
    leaves = order.filter("size > greatest(lcp, next_lcp)").select(F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"), F.col("size").alias("bottom"), F.lit(None).cast("long").alias("_splits"), "least")
    sums = ["w", "f", "a", "b"]
    last = order.agg(F.sum("ends"), F.sum((F.col("size") > F.col("next_lcp")).cast("long")), F.sum(F.col("ends") * F.element_at("sums", -1)), F.sum("_b")).first()
    left = order.select(F.col("pos").alias("lo"), F.col("lcp").alias("_lcp"), "size", "sums", "gid", F.col("_b").alias("_own"), *sums)
    right = order.select(F.col("pos").alias("hi"), F.col("lcp").alias("_next"), *[F.col(c).alias(f"_{c}2") for c in sums])
    nodes = inner.unionByName(leaves).join(left, "lo").join(right, "hi", "left")
    nodes = nodes.withColumns({"_next": F.coalesce("_next", F.lit(-1))} | {f"_{c}": F.coalesce(f"_{c}2", F.lit(t)) - F.col(c) for c, t in zip(sums, last, strict=True)})
    nodes = nodes.withColumns({"top": F.greatest("_lcp", "_next"), "_up": F.when(F.col("_lcp") >= F.col("_next"), F.col("lo")).otherwise(F.col("hi"))})
    above = bounds.select(F.col("pos").alias("_up"), F.col("least").alias("_above"))
    nodes = materialize(nodes.join(above, "_up", "left").drop("_up"), "nodes")
    deep = nodes.withColumn("depth", F.explode(F.sequence(F.col("top") + 1, F.col("bottom"))))
    ends_here = (F.col("depth") == F.col("bottom")) & (F.col("size") == F.col("bottom"))
    before = F.get("sums", F.greatest(F.col("depth") - 1, F.lit(0)))  # text of the turns above the node's own
    own = F.col("_b") - F.col("_own") + F.element_at("sums", -1) - before  # text of the subtree's nodes, once each
    at_bottom = F.when(F.col("_splits").isNull(), 0).otherwise(F.col("_splits") - (F.col("size") == F.col("bottom")).cast("long"))
    found = deep.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top") + 1, F.col("_above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("_w").alias("n_convs"), F.when(F.col("depth") < F.col("bottom"), F.lit(1)).otherwise(at_bottom).cast("long").alias("n_children"), F.col("_f").alias("n_leaves"),
        (F.col("_a") - F.col("_w") * before - own).alias("saved_tokens"), F.when(ends_here, F.col("gid")).alias("gid"),
    )
    empty = F.sha2(F.lit("").cast("binary"), 256)
    ends = materialize(end_digests(seqs), "ends")
    out = found.join(ends, "gid", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).drop("gid")
    for done in (seqs, order, bounds):
        release(done)
    return out
