"""Ignore files: which paths of a tree are left out by rules of its folders.

Rules are rows (folder, line, pattern): the lines of the ignore file of a folder ('' is the root). A pattern with '!' in front takes paths in again, one
with '/' at its end means folders, one with '/' elsewhere is anchored in its own folder; '*', '?', '[...]' stay within a name and '**' does not. Of the rules
of all folders above a path the deepest folder decides, in it the last line that matches. What lies in an ignored folder stays out, whatever its
own rules. Blank lines and comments are no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_regex(pattern: Column) -> Column:
    """The regular expression of a pattern, for paths relative to its folder."""
    bare = F.regexp_replace(F.regexp_replace(pattern, "^!", ""), "/$", "")
    anchored = bare.contains("/")
    body = F.regexp_replace(F.regexp_replace(bare, "^/", ""), r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[!", "[^")
    # the wider signs first, under names that no path has
    for sign, name in ((r"^\*\*/", "\x01"), (r"/\*\*/", "\x02"), (r"/\*\*$", "\x03"), (r"\*+", "\x04"), (r"\?", "\x05")):
        body = F.regexp_replace(body, sign, name)
    for name, regex in (("\x01", "(?:.*/)?"), ("\x02", "/(?:.*/)?"), ("\x03", "/.+"), ("\x04", "[^/]*"), ("\x05", "[^/]")):
        body = F.replace(body, F.lit(name), F.lit(regex))
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body, F.lit("$"))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(folder, line, regex, folders_only, takes_in)."""
    pattern = F.rtrim("pattern")
    rows = rules.withColumn("_p", pattern).filter("_p <> '' AND NOT startswith(_p, '#') AND _p NOT IN ('!', '/', '!/')")
    return rows.select("folder", "line", rule_regex(F.col("_p")).alias("regex"), F.col("_p").endswith("/").alias("folders_only"), F.col("_p").startswith("!").alias("takes_in"))


def ignored_paths(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """paths (relative, of files) with `ignored` and `cut_at`: the first folder or the path itself that a rule leaves out, null where none does.

    Each folder above a path is judged once for all paths in it: distinct prefixes meet the rules of their own ancestors by equality, and a
    folder with a third of all files is one prefix.
    """
    pieces = F.split(F.col(path_col), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.struct(F.array_join(F.slice(pieces, F.lit(1), n), "/").alias("prefix"), (n < F.size(pieces)).alias("is_folder")))
    spread = paths.select(path_col, F.explode(heads).alias("_h")).select(path_col, "_h.prefix", "_h.is_folder")
    entries = spread.select("prefix", "is_folder").distinct()
    own = F.split("prefix", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.struct(F.array_join(F.slice(own, F.lit(1), n), "/").alias("folder"), n.alias("depth"), F.array_join(F.slice(own, n + 1, F.size(own)), "/").alias("rest")))
    asked = entries.withColumn("_a", F.explode(above)).select("prefix", "is_folder", "_a.folder", "_a.depth", "_a.rest")
    matched = asked.join(parsed_rules(rules), "folder").filter("(is_folder OR NOT folders_only) AND rest RLIKE regex")
    rank = F.col("depth").cast("long") * (1 << 32) + F.col("line").cast("long")
    last = matched.groupBy("prefix", "is_folder").agg(F.max_by("takes_in", rank).alias("_in"))
    out = spread.join(last.filter("NOT _in").select("prefix", "is_folder"), ["prefix", "is_folder"])
    first = out.groupBy(path_col).agg(F.min_by("prefix", F.length("prefix")).alias("cut_at"))
    return paths.join(first, path_col, "left").withColumn("ignored", F.col("cut_at").isNotNull())


def searched_files(paths: DataFrame, rules: DataFrame, limit: int = 2_000, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """The first `limit` paths that no rule and no hidden name leaves out, and a note (not_searched, limit) if there are more."""
    kept = ignored_paths(paths, rules, path_col).filter(~F.col("ignored") & ~F.col(path_col).rlike(r"(^|/)\.")).drop("ignored", "cut_at")
    more = kept.agg((F.count(F.lit(1)) - limit).alias("not_searched")).filter("not_searched > 0").withColumn("limit", F.lit(limit))
    return kept.orderBy(path_col).limit(limit), more
