"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with their tokens. Raking scales the cells' weights
in turn until source, language and topic marginals meet their targets. A cell's documents are then kept
with one probability, calibrated so that the expected tokens meet the budget with no probability over 1.
A document's draw is a hash of its id, so the sample is the same in every run and on every cluster.

The cells are the only thing that reaches the driver, and their number is that of the combinations that occur. Up to
CELL_LIMIT they are fitted in memory; beyond it the same steps run as DataFrame jobs, and the fitted
table is joined without a broadcast hint. Both give the same weights.

Targets may contradict each other in the cells that occur; raking then ends after ROUNDS rounds without meeting them. How far the marginals are
from their targets at the end, at most, as a share of the target, is the column _residual, and a warning where it is over TOLERANCE.

Cases: null source, language or topic is a value of its own (''). A null text has no tokens; a cell without any is kept whole, as it costs
nothing, if all three of its values have a target (without given targets every value has one). Targets that name a value without documents are
scaled to those that occur; values without a target get none (weight 0, probability 0). Repeated rows share one draw. An empty table gives an
empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import materialize, release

DIMS = ("source", "lang", "topic")
CELL_LIMIT = 100_000
ROUNDS = 100
TOLERANCE = 1e-6


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form, for corpora without a topic column."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(F.length(t) == 0, "empty")
        .when(t.contains(" | "), "table")
        .when(t.contains("!! "), "shout")
        .when(t.contains("*** ") | t.contains("### "), "markup")
        .when(F.length(t) < 600, "note")
        .when(F.length(t) < 4000, "article")
        .otherwise("book")
    )


def tokens_of(text: Column) -> Column:
    """A quarter of the bytes, rounded up: near enough to subword tokens for weights."""
    return F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4).cast("long")


def keyed(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None, tokens: Column | None) -> DataFrame:
    topic = topic_of(F.col(text_col)) if topic is None else topic
    tokens = tokens_of(F.col(text_col)) if tokens is None else tokens
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.withColumns(
        {"_source": value(F.col(source_col)), "_lang": value(F.col(lang_col)), "_topic": value(topic), "_tokens": tokens}
    )


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def tempered(share: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares proportional to share ** power: below 1 lifts what is rare."""
    raised = {k: v**power for k, v in share.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: list[tuple[str, str, str, float]], targets: Mapping[str, Mapping[str, float]]) -> tuple[list[float], float]:
    """Weights (shares of the mixture) of cells (source, lang, topic, tokens) whose marginals meet the targets, and how far they are from them."""
    total = sum(c[3] for c in cells) or 1.0
    weights, moved = [c[3] / total for c in cells], 0.0
    for _ in range(ROUNDS):
        moved = 0.0
        for d, dim in enumerate(DIMS):
            have: dict[str, float] = {}
            for c, w in zip(cells, weights, strict=True):
                have[c[d]] = have.get(c[d], 0.0) + w
            wanted = {k: targets[dim].get(k, 0.0) for k, v in have.items() if v > 0}
            scale = sum(wanted.values()) or 1.0
            factor = {k: v / scale / have[k] for k, v in wanted.items()}
            weights = [w * factor.get(c[d], 0.0) for c, w in zip(cells, weights, strict=True)]
            moved = max([moved, *(abs(f - 1) for f in factor.values())])
        if moved < TOLERANCE:
            break
    return weights, moved


def calibrate(tokens: list[float], weights: list[float], budget: float, wanted: list[bool] | None = None) -> list[float]:
    """Keeping probabilities min(1, k * weight / tokens) with expected tokens equal to the budget; 1 for wanted cells without tokens."""
    p = [0.0] * len(tokens)
    open_ = [i for i, (t, w) in enumerate(zip(tokens, weights, strict=True)) if t > 0 and w > 0]
    for i, (t, w) in enumerate(zip(tokens, weights, strict=True)):
        if t <= 0 and (wanted is None or wanted[i]):
            p[i] = 1.0  # without tokens a cell costs nothing
    left = min(budget, sum(tokens[i] for i in open_))
    while open_:
        k = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if k * weights[i] >= tokens[i]]
        if not full:
            for i in open_:
                p[i] = k * weights[i] / tokens[i]
            break
        for i in full:
            p[i], left = 1.0, left - tokens[i]
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return p


def _target_frames(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, powers: Mapping[str, float]) -> dict[str, DataFrame]:
    """Each dimension's targets as (value, _want): those given, else the tempered shares, which never reach the driver."""
    out = {}
    for dim in DIMS:
        if targets is not None:
            out[dim] = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[dim].items()], f"_{dim} string, _want double")
            continue
        sums = cells.groupBy(f"_{dim}").agg(F.sum("tokens").alias("_t")).filter("_t > 0")
        raised = materialize(sums.select(f"_{dim}", F.pow("_t", F.lit(float(powers[dim]))).alias("_r")), "targets")
        total = raised.agg(F.sum("_r")).first()[0] or 1.0
        out[dim] = raised.select(f"_{dim}", (F.col("_r") / F.lit(total)).alias("_want"))
    return out


def _fit_frame(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float, given: bool) -> tuple[DataFrame, float]:
    """rake() and calibrate() as DataFrame jobs, for more cells than the driver should hold. Each round's tables go once the next are written."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    start = cells.withColumn("weight", F.col("tokens") / F.lit(total)).withColumn("wanted", F.lit(True))
    for dim in DIMS if given else ():
        wanted = targets[dim].filter("_want > 0").select(f"_{dim}", F.lit(True).alias("_has"))
        start = start.join(wanted, f"_{dim}", "left").withColumn("wanted", F.col("wanted") & F.coalesce("_has", F.lit(False))).drop("_has")
    now, moved = materialize(start, "cells"), 0.0
    for _ in range(ROUNDS):
        moved = 0.0
        for dim in DIMS:
            have = now.groupBy(f"_{dim}").agg(F.sum("weight").alias("_have")).filter("_have > 0").join(targets[dim], f"_{dim}", "left")
            have = materialize(have.fillna(0.0, ["_want"]), "marginal")
            scale = have.agg(F.sum("_want")).first()[0] or 1.0
            factor = have.select(f"_{dim}", (F.col("_want") / F.lit(scale) / F.col("_have")).alias("_f"))
            moved = max(moved, factor.agg(F.max(F.abs(F.col("_f") - 1))).first()[0] or 0.0)
            before, now = now, materialize(
                now.join(factor, f"_{dim}", "left").withColumn("weight", F.col("weight") * F.coalesce("_f", F.lit(0.0))).drop("_f"), "cells"
            )
            release(before), release(have)
        if moved < TOLERANCE:
            break
    state = now.withColumn("probability", F.when(F.col("tokens") <= 0, F.col("wanted").cast("double")).when(F.col("weight") <= 0, F.lit(0.0)))
    left = min(budget, state.filter("probability IS NULL").agg(F.sum("tokens")).first()[0] or 0.0)
    while True:
        weight = state.filter("probability IS NULL").agg(F.sum("weight")).first()[0]
        if not weight:
            return state, moved
        k = F.lit(left / weight)
        full = state.filter("probability IS NULL").filter(k * F.col("weight") >= F.col("tokens")).agg(F.sum("tokens")).first()[0]
        rest = F.lit(1.0) if full else k * F.col("weight") / F.col("tokens")
        reached = F.lit(not full) | (k * F.col("weight") >= F.col("tokens"))
        before, state = state, materialize(state.withColumn("probability", F.coalesce("probability", F.when(reached, rest))), "cells")
        release(before)
        if not full:
            return state, moved
        left -= full


def default_targets(cells: list, powers: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Tempered shares of each dimension as they are in the corpus."""
    out = {}
    for d, dim in enumerate(DIMS):
        share: dict[str, float] = {}
        for c in cells:
            share[c[d]] = share.get(c[d], 0.0) + c[3]
        out[dim] = tempered(share, powers[dim])
    return out


def fit(rows: DataFrame, budget_share: float, targets=None, powers: Mapping[str, float] | None = None, cell_limit: int = CELL_LIMIT):
    """Cells with weight and probability, whether they are few enough to be broadcast, and how far the marginals are from their targets."""
    cells = materialize(cells_of(rows), "cells")
    powers = powers or {"source": 0.5, "lang": 0.7, "topic": 0.8}
    small = cells.count() <= cell_limit
    if not small:
        total = cells.agg(F.sum("tokens")).first()[0] or 0.0
        fitted, residual = _fit_frame(cells, _target_frames(cells, targets, powers), budget_share * total, targets is not None)
    else:
        held = sorted(tuple(r) for r in cells.select("_source", "_lang", "_topic", "tokens").collect())
        wanted = None if targets is None else [all(targets[d].get(c[k], 0.0) > 0 for k, d in enumerate(DIMS)) for c in held]
        weights, residual = rake(held, default_targets(held, powers) if targets is None else targets)
        p = calibrate([c[3] for c in held], weights, budget_share * sum(c[3] for c in held), wanted)
        schema = "_source string, _lang string, _topic string, tokens double, weight double, probability double"
        fitted = cells.sparkSession.createDataFrame([(*c, w, q) for c, w, q in zip(held, weights, p, strict=True)], schema)
    if residual > TOLERANCE:
        warnings.warn(f"raking ended {residual:.3g} from its targets after {ROUNDS} rounds", stacklevel=2)
    return fitted, small, residual


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    return F.shiftrightunsigned(F.xxhash64(id_col.cast("string"), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def mix(
    docs: DataFrame, budget_share: float = 0.5, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | None = None, tokens: Column | None = None, powers: Mapping[str, float] | None = None, cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """docs with the columns _source, _lang, _topic, _tokens, _weight, _probability, _residual and _selected."""
    rows = keyed(docs, text_col, source_col, lang_col, topic, tokens)
    fitted, small, residual = fit(rows, budget_share, targets, powers, cell_limit)
    right = fitted.select("_source", "_lang", "_topic", F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    joined = rows.join(F.broadcast(right) if small else right, ["_source", "_lang", "_topic"], "left")
    return joined.withColumn("_residual", F.lit(float(residual))).withColumn("_selected", draw(F.col(id_col), seed) < F.coalesce("_probability", F.lit(0.0)))
