"""Substring dedup by difference-cover anchors: repeated windows of words are removed wherever they do not come first.

A set of residues modulo a period is a difference cover if any two places of two documents, moved on by one and the same step of less than a
period, both fall on residues of the set. So two equal windows share an anchor, a shorter run of words that begins at a cover position
in both: only runs at these positions are hashed and counted (4 of 13 for windows of 20 words). Anchors that are counted twice or more go
into a Bloom filter of bounded size, and only windows around them are extended: they meet by 128 bits of hash of all their words, first in runs
of some neighbouring windows and then, where a run is not met before, one by one; of equal windows all but the first are marked. A marked window takes its words out of its document. The filter can pass a window in vain, never
keep one back, so the result is exact (up to equal 128-bit hashes) however full it is.

Words and windows are hashed in numpy over the bytes of an Arrow batch; counting, meeting and marking are Spark aggregates and joins. Texts are
shuffled only where a document may have a mark.

The order of documents is by id, a null id first; of different texts with one id, by a hash of the text. Rows that repeat id and text are one
document and get the same result. Cases: a null text has no words; fewer words than a window stay as they are, joined by one space. A text
may have any length. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import bitmap, bitmap_words, flag, free_shuffles, materialize, release
from sparkfolio.session import ship_package

WINDOW = 20
#: Perfect difference sets: each non-zero difference modulo the period is met once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bits of the filter: 32 for each repeated anchor, at most 2**28, which are 32 MB. Beyond some 10**7 repeated anchors it lets more windows through.
MOST_BITS = 1 << 28
PROBES = 4
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Bytes of a word that have multipliers of their own; longer words are hashed by blake2b.
LONG_WORD = 256
#: A run of windows is cut after about so many; windows that are hashed at a time.
CHUNK, STEP = 16, 1 << 16
_U = np.uint64


def _multipliers(name: str, n: int) -> np.ndarray:
    """Odd 64-bit numbers by a rule."""
    raw = b"".join(hashlib.sha256(f"{name} {k}".encode()).digest()[:8] for k in range(n))
    return np.frombuffer(raw, "<u8").astype(_U) | _U(1)


_OF_BYTES = [_multipliers(f"byte {k}", LONG_WORD) for k in range(2)]
_OF_PROBES = _multipliers("probe", PROBES)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of a window, and its difference cover."""
    return max((v, c) for v, c in COVERS.items() if v == 1 or window - v + 1 >= 0.4 * window)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Words:
    """The words of a run of texts: place, document and 128 bits of hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, both: bool):
        ink = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ink & (edge[:-1] | np.concatenate(([True], ~ink[:-1])))[: len(data)]
        ends = ink & (edge[1:] | np.concatenate((~ink[1:], [True])))[: len(data)]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.diff(np.append(first, len(self.start)))
        self.place = np.arange(len(self.start)) - first[self.doc]
        self.hash = [np.zeros(len(self.start), _U) for _ in range(1 + both)]
        low = 0
        while low < len(self.start):  # some BLOCK bytes at a time
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + BLOCK, "right")))
            self._hash(data, low, high)
            low = high

    def _hash(self, data: np.ndarray, low: int, high: int) -> None:
        start, sizes = self.start[low:high], self.end[low:high] - self.start[low:high]
        short = np.minimum(sizes, LONG_WORD)
        at = np.cumsum(short) - short
        inside = np.arange(int(short.sum())) - np.repeat(at, short)
        value = data[np.repeat(start, short) + inside].astype(_U) + _U(1)
        for k, out in enumerate(self.hash):
            out[low:high] = _mix(np.add.reduceat(value * _OF_BYTES[k][inside], at) + sizes.astype(_U))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            digest = np.frombuffer(hashlib.blake2b(data[start[i] : start[i] + sizes[i]].tobytes(), digest_size=16).digest(), "<u8")
            for k, out in enumerate(self.hash):
                out[low + i] = digest[k]

    def runs(self, length: int, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of `length` words that begin at the words `at`; equal runs have equal hashes."""
        total = np.zeros(len(at), _U)
        for j, m in enumerate(_multipliers(f"run {length} {k}", length)):
            total += self.hash[k][at + j] * m
        return _mix(total)

    def starts(self, length: int) -> np.ndarray:
        """Words at which a run of `length` words of one document begins."""
        n = len(self.start) - length + 1
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Words at cover positions of documents that hold a window, and the hashes of the anchors there."""
        period, cover = cover_of(window)
        length = window - period + 1
        at = self.starts(length)
        at = at[np.isin(self.place[at] % period, cover) & (self.count[self.doc[at]] >= window)]
        return at, self.runs(length, at, 0)


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of a text column, some BLOCK bytes at a time."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, "right")) - 1)
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def _key() -> Column:
    return F.struct(F.col("_id").alias("id"), F.col("_hash").alias("hash"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def anchor_counts(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, n): how often each anchor is met; most are met once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _slices(batch.column(0)):
                found, n = np.unique(Words(data, offsets, False).anchors(window)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    return texts.select("_text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = _U(64 - (bits.bit_length() - 1))
    for m in _OF_PROBES:
        yield (hashes * m) >> shift


def bloom(repeated: DataFrame, n: int) -> np.ndarray:
    """The filter of the anchors (column anchor), as words of 64 bits; the words that each task sets are made there and merged by Spark."""
    bits = min(MOST_BITS, 1 << max(16, (32 * n).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            place = np.unique(np.concatenate([*_places(hashes, bits)]))
            word, first = np.unique(place >> _U(6), return_index=True)
            value = np.bitwise_or.reduceat(_U(1) << (place & _U(63)), first) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    table = repeated.select("anchor").mapInArrow(build, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().view(_U)
    return out


def _passed(hashes: np.ndarray, bloomed: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for place in _places(hashes, 64 * len(bloomed)):
        out &= (bloomed[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
    return out


def _chunks(words: Words, window: int, bloomed: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows with an anchor of the filter, in runs: first window's word and size of each run, its 128 bits, and the windows' 128 bits."""
    at, anchors = words.anchors(window)
    period = cover_of(window)[0]
    hits = np.zeros(len(words.start) + period + 1, np.int64)
    hits[at[_passed(anchors, bloomed)] + 1] = 1
    hits = np.cumsum(hits)
    begin = words.starts(window)
    begin = begin[hits[begin + period] > hits[begin]]  # an anchor begins at one of the window's first places
    each = [np.concatenate([words.runs(window, begin[low : low + STEP], k) for low in range(0, len(begin), STEP)] or [np.zeros(0, _U)]) for k in range(2)]
    # a run ends at a gap, and after windows whose hashes say so: equal stretches are cut alike
    cut = np.ones(len(begin), bool)
    cut[1:] = (begin[1:] != begin[:-1] + 1) | (words.doc[begin[1:]] != words.doc[begin[:-1]]) | (each[0][:-1] % _U(CHUNK) == 0)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(begin)))
    inside = (np.arange(len(begin)) - np.repeat(first, size)).astype(_U)
    keys = [_mix(np.add.reduceat(_mix(w + inside * _OF_PROBES[0]), first) + size.astype(_U)) if len(first) else w for w in each]
    return begin[first], first, size, keys, np.stack(each, axis=1)


def chunks(texts: DataFrame, window: int, packed: np.ndarray, whole: bool) -> DataFrame:
    """(_c1, _c2, _id, _hash, _place, _n): runs of windows that hold an anchor of the filter; if whole, _windows: 16 bytes of hash of each."""
    shared = texts.sparkSession.sparkContext.broadcast(packed.tobytes())

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloomed = np.frombuffer(shared.value, _U)
        for batch in batches:
            for row, data, offsets in _slices(batch.column(2)):
                words = Words(data, offsets, True)
                begin, first, size, keys, each = _chunks(words, window, bloomed)
                rows = pa.array(row + words.doc[begin])
                columns = [pa.array(k.view(np.int64)) for k in keys] + [batch.column(k).take(rows) for k in range(2)]
                columns += [pa.array(words.place[begin].astype(np.int32)), pa.array(size.astype(np.int32))]
                if whole:
                    raw = each.tobytes()
                    columns.append(pa.array([raw[16 * a : 16 * (a + n)] for a, n in zip(first.tolist(), size.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["_c1", "_c2", "_id", "_hash", "_place", "_n", "_windows"][: len(columns)])

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(extend, f"_c1 long, _c2 long, _id {kind}, _hash long, _place int, _n int" + ", _windows binary" * whole)


def window_counts(firsts: DataFrame) -> DataFrame:
    """(anchor, n): half of each window's hash, and in how many places of the first chunks it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            found, n = np.unique(np.frombuffer(raw, "<u8")[::2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(_U).view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    return firsts.select("_windows").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def windows(firsts: DataFrame, packed: np.ndarray) -> DataFrame:
    """(_w1, _w2, _id, _hash, _place) of the windows of first chunks that the filter lets pass."""
    shared = firsts.sparkSession.sparkContext.broadcast(packed.tobytes())

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloomed = np.frombuffer(shared.value, _U)
        for batch in batches:
            size = batch.column(3).to_numpy().astype(np.int64) // 16
            both = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(-1, 2).astype(_U)
            row = np.repeat(np.arange(len(size)), size)
            place = batch.column(2).to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            for low in range(0, len(row), STEP):
                at = low + np.flatnonzero(_passed(both[low : low + STEP, 0], bloomed))
                rows = pa.array(row[at])
                columns = [pa.array(both[at, k].view(np.int64)) for k in range(2)] + [batch.column(k).take(rows) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place[at].astype(np.int32))], ["_w1", "_w2", "_id", "_hash", "_place"])

    rows = firsts.select("_id", "_hash", "_place", F.octet_length("_windows").alias("_bytes"), "_windows")
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(unfold, f"_w1 long, _w2 long, _id {kind}, _hash long, _place int")


def _filter_of(counts: DataFrame, label: str) -> np.ndarray:
    repeated = materialize(counts.filter("n > 1").select("anchor"), label)
    packed = bloom(repeated, repeated.count())
    release(repeated)
    return packed


def _after_first(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose place comes after their key's first place. firsts is written, so the join shuffles both sides and can split a hot key."""
    at = F.struct("_id", "_hash", "_place")
    return rows.join(firsts.withColumnRenamed("_at", "_first"), keys).filter(at != F.col("_first"))


def later_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_row, _starts): for each document (_id and _hash) the windows whose words also start earlier, as runs (first window, size).

    Runs of windows come first: a run that is met earlier needs no closer look, and the first place of a window is never in such a run. So
    only the windows of first runs are compared one by one. The result is written to the shared folder.
    """
    spark = texts.sparkSession
    packed = _filter_of(anchor_counts(texts, window), "anchors")
    free_shuffles(spark)
    at = F.struct("_id", "_hash", "_place")
    met = chunks(texts, window, packed, True).groupBy("_c1", "_c2").agg(F.min(F.struct("_id", "_hash", "_place", "_windows")).alias("_f"), F.count(F.lit(1)).alias("_m"))
    firsts = materialize(met.select("_c1", "_c2", "_f.*", "_m"), "firsts")
    free_shuffles(spark)
    again = firsts.filter("_m > 1").select("_c1", "_c2", at.alias("_at"))
    runs = materialize(_after_first(chunks(texts, window, packed, False), again, ["_c1", "_c2"]).select("_id", "_hash", "_place", "_n"), "runs")
    free_shuffles(spark)
    rest = windows(firsts, _filter_of(window_counts(firsts), "windows"))
    low = rest.groupBy("_w1", "_w2").agg(F.min(at).alias("_at"), F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
    low = materialize(low, "low")
    single = _after_first(rest, low, ["_w1", "_w2"]).select("_id", "_hash", "_place", F.lit(1).alias("_n"))
    found = runs.unionByName(single).groupBy(_key().alias("_row")).agg(F.collect_set(F.struct("_place", "_n")).alias("_starts"))
    out = materialize(found, "marks")
    for done in (firsts, runs, low):
        release(done)
    free_shuffles(spark)
    return out


def _removed(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at = batch.column(2), 0
            for row, data, offsets in _slices(batch.column(1)):
                raw, ends = data.tobytes(), offsets.tolist()
                n_words, n_removed, kept = [], [], []
                for i in range(len(ends) - 1):
                    words = raw[ends[i] : ends[i + 1]].split()  # bytes are split at the white space that separates words here
                    stay = words
                    if starts[row + i].is_valid:
                        place, n = (x.to_numpy() for x in starts[row + i].values.flatten())
                        change = np.zeros(len(words) + 1, np.int32)
                        np.add.at(change, place, 1)
                        np.add.at(change, place + n + window - 1, -1)
                        stay = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay))
                at = row + len(kept)
                text = pa.array(kept, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:at], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], ["_id", "n_words", "n_removed", "kept"])

    return remove


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    marks = later_windows(texts, window)
    hashes = marks.select(F.xxhash64("_row").alias("_h"))
    words = bitmap_words(marks.count())
    flagged = flag(texts.withColumn("_row", _key()), bitmap(hashes, "_h", words), F.xxhash64("_row"), words)
    passed = flagged.filter(~F.col("_hit")).select("_id", "_text", F.lit(None).cast("array<struct<_place:int,_n:int>>").alias("_starts"))
    looked_at = flagged.filter("_hit").join(marks, "_row", "left").select("_id", "_text", "_starts")
    kind = texts.schema["_id"].dataType.simpleString()
    out = passed.unionByName(looked_at).mapInArrow(_removed(window), f"_id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", id_col)
