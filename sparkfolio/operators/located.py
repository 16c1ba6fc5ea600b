"""Places in the original of what was found in a normalised text.

Normalising (white space collapsed and trimmed, letters lower-cased) shifts every place. The shift is constant within a word, so a text has a
map of runs: one row of (place in the normalised text, place in the original) a word, and a place is looked up by binary search in it. Words whose
lower-casing changes their length are mapped letter by letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package

_word = re.compile(r"\S+")


class Normalised:
    """A text without its extra white space, and the way back. fold: lower-case as well."""

    def __init__(self, text: str, fold: bool = True):
        pieces, shown, original, at = [], [], [], 0
        for m in _word.finditer(text):
            word, start = m.group(), m.start()
            low = word.lower() if fold else word
            if pieces:
                at += 1
            if len(low) == len(word):
                shown.append(at)
                original.append(start)
            else:
                for k, letter in enumerate(word):
                    shown.append(at + len(word[:k].lower()))
                    original.append(start + k)
            pieces.append(low)
            at += len(low)
        self.text = " ".join(pieces)
        self.shown, self.original = np.array(shown, np.int64), np.array(original, np.int64)

    def back(self, at: np.ndarray) -> np.ndarray:
        """Places in the original of letters (not of the blanks between words)."""
        run = np.searchsorted(self.shown, at, "right") - 1
        return self.original[run] + at - self.shown[run]

    def spans(self, needle: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in the original of each match of needle, which is normalised itself; matches do not overlap."""
        starts, at = [], self.text.find(needle) if needle else -1
        while at >= 0:
            starts.append(at)
            at = self.text.find(needle, at + len(needle))
        begin = np.array(starts, np.int64)
        return (self.back(begin), self.back(begin + len(needle) - 1) + 1) if starts else (begin, begin)


def located_hits(units: DataFrame, query: str, id_cols: list[str], text_col: str = "text", per_unit: int | None = None) -> DataFrame:
    """(ids, n, start, end, text): the query's matches in each unit, as places in the original from 0 and the original words there.

    per_unit: the first so many of a unit. A query without a letter matches nothing; null texts have no match. Only units that hold the
    query's first word go to Python.
    """
    ship_package(units.sparkSession)
    words = query.lower().split()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ns, begins, ends, texts = [], [], [], [], []
            for k, text in enumerate(batch.column(len(id_cols)).to_pylist()):
                begin, end = Normalised(text).spans(" ".join(words))
                for n, (b, e) in enumerate(zip(begin[:per_unit].tolist(), end[:per_unit].tolist(), strict=True)):
                    rows.append(k)
                    ns.append(n + 1)
                    begins.append(b)
                    ends.append(e)
                    texts.append(text[b:e])
            ids = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(ns, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], [*id_cols, "n", "start", "end", "text"])

    rows = units.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    rows = rows.filter(F.lower("_text").contains(words[0])) if words else rows.limit(0)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.mapInArrow(find, f"{schema}, n int, start long, end long, text string")


def located_quotes(citations: DataFrame, units: DataFrame, key_cols: list[str], quote_col: str = "quote", text_col: str = "text") -> DataFrame:
    """citations with verdict, start and end: where each quote stands in the unit it names, as it is or with other white space.

    Verdicts are those of cite_check: exact, normalized, unmatched, insufficient (no such unit, or no quote); start and end are of the first place.
    """
    ship_package(citations.sparkSession)
    joined = citations.join(units.select(*key_cols, F.col(text_col).alias("_text")), key_cols, "left")
    names = joined.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, quote in zip(batch.column(names.index("_text")).to_pylist(), batch.column(names.index(quote_col)).to_pylist(), strict=True):
                quote = (quote or "").strip(" ")
                if text is None or not quote:
                    found.append(("insufficient", None, None))
                elif (at := text.find(quote)) >= 0:
                    found.append(("exact", at, at + len(quote)))
                else:
                    begin, end = Normalised(text, fold=False).spans(" ".join(quote.split()))
                    found.append(("normalized", int(begin[0]), int(end[0])) if len(begin) else ("unmatched", None, None))
            kept = [batch.column(k) for k, c in enumerate(names) if c != "_text"]
            extra = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *extra], [c for c in names if c != "_text"] + ["verdict", "start", "end"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_text")
    return joined.mapInArrow(look, f"{schema}, verdict string, start long, end long")


def _aligned(text: str, words: list[str | None]) -> tuple[list[tuple[int, int] | None], bool]:
    """The span of each word in text as far as the words follow each other with nothing but white space between, and whether all did."""
    spans: list[tuple[int, int] | None] = []
    cursor = 0
    for word in words:
        if not word:
            spans.append(None)
            continue
        start = cursor
        while start < len(text) and text[start].isspace() and not text.startswith(word, start):
            start += 1
        if not text.startswith(word, start):
            return spans + [None] * (len(words) - len(spans)), False
        cursor = start + len(word)
        spans.append((start, cursor))
    return spans, not text[cursor:].strip()


def align_words(pages: DataFrame, id_cols: list[str], text_col: str = "text", words_col: str = "words") -> DataFrame:
    """(ids, spans, complete): where a recogniser's ordered words stand in the text of their page.

    spans: array<struct<start, end>>, null for an empty word and from the first word on that does not follow; complete: all words follow and only white
    space is left. A cursor moves through the text once, so a page costs its length.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            both = zip(batch.column(len(id_cols)).to_pylist(), batch.column(len(id_cols) + 1).to_pylist(), strict=True)
            found = [_aligned(text or "", words or []) for text, words in both]
            spans = pa.array([[s and {"start": s[0], "end": s[1]} for s in f[0]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(id_cols))), spans, pa.array([f[1] for f in found], pa.bool_())], [*id_cols, "spans", "complete"])

    rows = pages.select(*id_cols, F.col(text_col).alias("_text"), F.col(words_col).alias("_words"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.mapInArrow(run, f"{schema}, spans array<struct<start:int,end:int>>, complete boolean")
