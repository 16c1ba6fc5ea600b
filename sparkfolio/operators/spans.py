"""Well-nested spans of tracked changes from flat marks that may cross.

Tokens are rows (keys, pos, kind, mark, by, text, format): kind is open, close, text, raw or comment; keys name the paragraph. Nesting is a matter of
running sums: a mark is open where its opens outnumber the closes that had something to close, its attribution is that of the last open that found it
shut, and the marks open at a leaf nest in the order in which they were opened. So a close that crosses other spans needs no stack: the leaves behind
it have a shorter path. Neighbours with equal (mark, by) at a level are one span; spans without text vanish, as no leaf is in them.

Cases: a close without an open is nothing, an open of an open mark belongs to it, spans open at the end close. Comments leave spans that hold nothing
else, and highlights, behind which they stand. Null attributions are equal to each other; a null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.session import cut_lineage

MARKS = ("insertion", "deletion", "highlight")
# The delimiters of the notation.
DELIMITERS = {"insertion": ("{++", "++}"), "deletion": ("{--", "--}"), "highlight": ("{==", "==}"), "comment": ("{>>", "<<}")}


def leaf_paths(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The leaves with path: array<struct<opened, mark, by>>, outermost first."""
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = tokens
    active = []
    for k, m in enumerate(MARKS):
        own = F.col("mark") == m
        step = F.when(own & (F.col("kind") == "open"), 1).when(own & (F.col("kind") == "close"), -1).otherwise(0)
        rows = rows.withColumn(f"_s{k}", F.sum(step).over(order))
        rows = rows.withColumn(f"_d{k}", F.col(f"_s{k}") - F.least(F.lit(0), F.min(f"_s{k}").over(order)))
        opened = own & (F.col("kind") == "open") & (F.col(f"_d{k}") == 1)
        node = F.last(F.when(opened, F.struct(F.col("pos").alias("opened"), F.lit(m).alias("mark"), "by")), ignorenulls=True).over(order)
        rows = rows.withColumn(f"_n{k}", node)
        active.append(F.when(F.col(f"_d{k}") > 0, F.col(f"_n{k}")))
    rows = rows.withColumn("path", F.sort_array(F.array_compact(F.array(*active))))
    return rows.filter(F.col("kind").isin("text", "raw", "comment")).drop(*[f"_{c}{k}" for c in "sdn" for k in range(len(MARKS))])


def _comments_moved(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """leaves with _order, and the paths of comments cut where they leave a span."""
    levels = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    nested = leaves.filter(F.size("path") > 0).withColumn("_node", F.explode(levels))
    nodes = nested.groupBy(*keys, "_node").agg(F.bool_or(F.col("kind") != "comment").alias("_content"), F.max("pos").alias("_end"))
    inside = nested.filter("kind = 'comment'").select(*keys, "pos", "_node").join(nodes.hint("merge"), [*keys, "_node"])
    leaving = inside.filter(~F.col("_content") | (F.element_at("_node", -1)["mark"] == "highlight"))
    first = leaving.groupBy(*keys, "pos").agg(F.min_by(F.struct("_content", "_end", (F.size("_node") - 1).alias("_keep")), F.size("_node")).alias("_out"))
    moved = leaves.join(first.hint("merge"), [*keys, "pos"], "left")
    behind = F.col("_out._content")
    order = F.struct(F.when(behind, F.col("_out._end")).otherwise(F.col("pos")).alias("at"), F.when(behind, 1).otherwise(0).alias("behind"), F.col("pos").alias("pos"))
    path = F.when(F.col("_out").isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), F.col("_out._keep")))
    return moved.withColumns({"_order": order, "path": path}).drop("_out")


def _shared(a: Column, b: Column) -> Column:
    """How many first levels two paths share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def span_runs(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run, path, kind, text, closes, opens): leaves in order, neighbouring texts of one path and format joined; the spans that close and open before each.

    path: array<struct<mark, by>>; closes and opens count levels: after `closes` of the spans of the run before, `opens` new ones lead to path.
    """
    leaves = _comments_moved(cut_lineage(leaf_paths(tokens, keys).select(*keys, "pos", "kind", "text", "format", "path")), keys)
    rows = leaves.withColumn("path", F.transform("path", lambda p: F.struct(p["mark"].alias("mark"), p["by"].alias("by"))))
    order = Window.partitionBy(*keys).orderBy("_order")
    text = F.struct("path", "kind", "format")
    new = ((F.col("kind") != "text") | ~text.eqNullSafe(F.lag(text).over(order))).cast("int")
    joined = rows.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("_new").over(order))
    parts = joined.groupBy(*keys, "run").agg(F.first("path").alias("path"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("_order", F.coalesce("text", F.lit("")).alias("t")))).alias("_t"))
    runs = parts.select(*keys, "run", "path", "kind", F.array_join(F.transform("_t", lambda t: t["t"]), "").alias("text"))
    before = F.coalesce(F.lag("path").over(Window.partitionBy(*keys).orderBy("run")), F.array().cast(runs.schema["path"].dataType))
    runs = runs.withColumn("_before", before).withColumn("_keep", _shared(F.col("_before"), F.col("path")))
    return runs.withColumns({"closes": F.size("_before") - F.col("_keep"), "opens": F.size("path") - F.col("_keep"), "_left": F.slice("_before", F.col("_keep") + 1, F.size("_before") + 1)}).drop("_before", "_keep")


def rendered(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markup): the runs of each paragraph in the notation."""
    sign = lambda side: F.create_map(*[F.lit(x) for m, d in DELIMITERS.items() for x in (m, d[side])])
    listed = lambda path, side: F.array_join(F.transform(path, lambda p: F.element_at(sign(side), p["mark"])), "")
    body = F.when(F.col("kind") == "comment", F.concat(F.lit("{>>"), "text", F.lit("<<}"))).otherwise(F.col("text"))
    opened = F.slice("path", F.size("path") - F.col("opens") + 1, F.greatest(F.col("opens"), F.lit(1)))
    opened = F.when(F.col("opens") > 0, listed(opened, 0)).otherwise("")
    piece = F.concat(listed(F.reverse("_left"), 1), opened, body)
    joined = runs.select(*keys, F.struct("run", piece.alias("piece"), "path").alias("_r")).groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    return joined.select(*keys, F.concat(F.array_join(F.transform("_r", lambda r: r["piece"]), ""), listed(F.reverse(F.element_at("_r", -1)["path"]), 1)).alias("markup"))
