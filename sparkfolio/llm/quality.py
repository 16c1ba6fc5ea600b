"""Quality classifier by compression: dictionaries of good and of bad labelled text.

A text is cut into equal blocks of BLOCK bytes at most, and each is compressed by zstandard once with either dictionary. The normalised
difference of the compressed sizes, (bad - good) / (bad + good), says which text the block is nearer to; its mean, least and greatest
value over all blocks, with the compression ratio itself, are calibrated into a probability by logistic regression on
labelled documents that the dictionaries were not built from.

Bounds: at most PER_CLASS labelled rows of each label, chosen by a hash of the id. Of them, every other one calibrates, whole; of the rest,
DICTIONARY_DOCS train that label's dictionary of DICTIONARY_BYTES, whatever their length: they are cut into the same blocks where they lie, and
LEARN_BLOCKS blocks (4 MB) go to the one task that trains it: one of each text, by hash, then a second of each, and so on. Every text is scored whole. Where blocks are too few or too alike for
zstandard's trainer, they are the dictionary themselves.

Cases: a null text is an empty one and gets the score of features zero. Where several rows have one labelled id, each is learned from.
Without labels of both kinds every score is 0.5. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import held, text_slices
from sparkfolio.llm.labelled import Logistic, labelled_texts, sample_ids
from sparkfolio.session import ship_package

PER_CLASS = 3_000
#: Every other one of those calibrates; of the rest, so many build the dictionaries.
DICTIONARY_DOCS = 1_200
DICTIONARY_BYTES = 112_640
LEARN_BLOCKS = 8_192
LEVEL = 3
BLOCK = 512
BATCH_BYTES = 4 << 20
THRESHOLD = 0.3


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(raw: bytes):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0, 0.0, 0.0
        total = best = 0.0
        low, high = 1.0, -1.0
        size = -(-len(raw) // -(-len(raw) // BLOCK))  # blocks of one size, so that none is a mere tail
        for start in range(0, len(raw), size):
            block = raw[start : start + size]
            g, b = len(self.good(block)), len(self.bad(block))
            diff = (b - g) / (b + g)
            total += diff * len(block)
            best += min(g, b)
            low, high = min(low, diff), max(high, diff)
        return total / len(raw), low, high, float(np.log(best / len(raw)))


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_label, _n, _at, _block): the texts (_label, _n, _text) in blocks."""
    for batch in batches:
        for start, texts in text_slices(batch, 2, BATCH_BYTES):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            rows = [(start + k, i, raw[i : i + BLOCK]) for k, raw in enumerate(raws) for i in range(0, len(raw), BLOCK)]
            at = pa.array([r[0] for r in rows], pa.int64())
            own = [batch.column(k).take(at) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["_label", "_n", "_at", "_block"])


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One label's dictionary; its rows are at most LEARN_BLOCKS."""
    samples = pdf.sort_values("_rank")["_block"].tolist()
    return pd.DataFrame({"_label": [int(pdf["_label"].iloc[0])], "dictionary": [_dictionary(samples)]})


def _featured(rows: DataFrame, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    """rows (_id, _text, ...) as (_id, mean, low, high, ratio)."""
    ship_package(rows.sparkSession)
    learned = rows.sparkSession.sparkContext.broadcast(dictionaries)
    key = tuple(map(zlib.crc32, dictionaries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("quality", key), lambda: Scorer(*learned.value))
        for batch in batches:
            found = np.array([scorer.features(t) for _, texts in text_slices(batch, 1, BATCH_BYTES) for t in texts], np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(4))], ["_id", "mean", "low", "high", "ratio"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_text").mapInArrow(score, f"_id {kind}, mean double, low double, high double, ratio double")


def _matrix(pdf) -> np.ndarray:
    return pdf[["mean", "low", "high", "ratio"]].to_numpy(np.float64)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(dictionaries, calibration) from labels, which hold only rows that may be learned from."""
    ids, counts = sample_ids(labels, label_col, PER_CLASS, id_col)
    texts = labelled_texts(docs, ids, id_col, text_col)
    ship_package(docs.sparkSession)
    first = texts.filter((F.col("_n") % 2 == 1) & (F.col("_n") < 2 * DICTIONARY_DOCS)).select("_label", "_n", "_text")
    kinds = [first.schema[c].dataType.simpleString() for c in ("_label", "_n")]
    blocks = first.mapInArrow(_cut, f"_label {kinds[0]}, _n {kinds[1]}, _at long, _block binary")
    drawn = (F.xxhash64("_n", "_at"), "_at", "_block")
    turn = blocks.withColumn("_turn", F.row_number().over(Window.partitionBy("_label", "_n").orderBy(*drawn))).filter(F.col("_turn") <= LEARN_BLOCKS)
    ranked = turn.withColumn("_rank", F.row_number().over(Window.partitionBy("_label").orderBy("_turn", *drawn, "_n")))
    chosen = ranked.filter(F.col("_rank") <= LEARN_BLOCKS).select("_label", "_rank", "_block")
    trained = {r["_label"]: bytes(r["dictionary"]) for r in chosen.groupBy("_label").applyInPandas(_train, "_label int, dictionary binary").collect()}
    dictionaries = tuple(trained.get(label, b"\0" * 8) for label in (1, 0))
    rest = texts.filter("_n % 2 = 0")  # none that a dictionary was built from
    pdf = _featured(rest, dictionaries).join(F.broadcast(ids), "_id").toPandas()
    y = pdf["_label"].to_numpy(np.float64)
    seen = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    weights = np.array([counts.get(int(v), 0) / seen[int(v)] for v in y])
    return dictionaries, Logistic(_matrix(pdf), y, weights)


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, mean, low, high, ratio, score."""
    dictionaries, calibration = model
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = _featured(rows, dictionaries)
    z = F.lit(float(calibration.coef[-1]))
    for k, name in enumerate(("mean", "low", "high", "ratio")):
        scaled = (F.col(name) - float(calibration.mean[k])) / float(calibration.scale[k])
        z = z + float(calibration.coef[k]) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), scaled))
    return found.withColumn("score", 1 / (1 + F.exp(-z))).withColumnRenamed("_id", id_col)
