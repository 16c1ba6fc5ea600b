"""Fill-in-middle transformation on packed boundary bit vectors with rank and select.

A token is a run of A-Z and a-z or any other single code point. The token starts of all texts of a slice are one packed bit vector over their
UTF-8 bytes, with a directory of popcounts before each block of 512 bits: the popcount of a text's bits is its number of tokens n, and
select on two ranks gives the byte cuts, without a list of tokens. A second vector of code point starts turns byte cuts into characters by rank.

Four numbers of a document decide its cuts and its form: the first four groups of eight digits of the sha256 of SALT and its decimal id.

Cases: a null text counts as empty, has no token and stays plain. A null id counts as no digits. Repeated rows get equal values. A text that
holds a marker stays plain, so the markers of an output are its own. Any length of text works: bit vectors are made a block of bytes at a
time. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
#: Of a hundred documents, those left as they are, and of a hundred others, those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of text that are looked at together, and bytes whose masks are made at a time.
BATCH_BYTES, BLOCK = 4 << 20, 1 << 20
_WORDS = 8  # words of 64 bits in a block of the directory

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Bits:
    """A packed bit vector: rank(p) counts the ones before p, select(k) is the place of the k-th one, from 0."""

    def __init__(self, packed: np.ndarray):
        step = 8 * _WORDS
        padded = np.zeros(-(-len(packed) // step) * step + step, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8").reshape(-1, _WORDS)
        ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, word, bit = at // (64 * _WORDS), at // 64 % _WORDS, (at % 64).astype(np.uint64)
        rows = self.words[block]
        counts = np.bitwise_count(rows).astype(np.int64)
        whole = np.where(np.arange(_WORDS) < word[:, None], counts, 0).sum(1)
        part = np.bitwise_count(rows[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, k, "right") - 1
        rows, rest = self.words[block], k - self.before[block]
        until = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        word = (until <= rest[:, None]).sum(1)
        each = np.arange(len(k))
        rest -= np.where(word > 0, until[each, word - 1], 0)
        ones = np.cumsum(np.unpackbits(rows[each, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.int64)
        return block * (64 * _WORDS) + word * 64 + (ones <= rest[:, None]).sum(1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Token starts and code point starts of UTF-8 bytes; texts begin at starts."""
    tokens, points, before = [], [], False
    for low in range(0, len(data), BLOCK):  # a multiple of 8
        part = data[low : low + BLOCK]
        letter = _LETTER[part]
        lead = (part & 0xC0) != 0x80
        start = lead & ~(letter & np.concatenate(([before], letter[:-1])))
        here = starts[(starts >= low) & (starts < low + len(part))] - low
        start[here] = True
        before = letter[-1]
        tokens.append(np.packbits(start, bitorder="little"))
        points.append(np.packbits(lead, bitorder="little"))
    join = lambda x: Bits(np.concatenate(x) if x else np.zeros(0, np.uint8))
    return join(tokens), join(points)


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of a text column, some BATCH_BYTES at a time."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, "right")) - 1)
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def _transformed(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars and output of each text; numbers: its four, in a row."""
    begin, end = offsets[:-1], offsets[1:]
    filled = begin[end > begin]
    tokens, points = boundaries(data, filled)
    first = tokens.rank(begin)
    n = tokens.rank(end) - first
    cuts = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    low, high = (np.where(c == n, end, tokens.select(np.minimum(first + c, tokens.before[-1] - 1)) if len(filled) else end) for c in cuts.T)
    chars = [points.rank(x) for x in (begin, low, high)]
    raw, marks = data.tobytes(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs, lengths = [], [], []
    for i, (b, l, h, e) in enumerate(zip(begin.tolist(), low.tolist(), high.tolist(), end.tolist(), strict=True)):
        text = raw[b:e]
        if not text or numbers[i, 2] % 100 >= 100 - PLAIN_PERCENT or any(m in text for m in marks):
            form, out = "plain", text
        else:
            pieces = [marks[0] + raw[b:l], marks[1] + raw[h:e]]
            form = "spm" if numbers[i, 3] % 100 < SPM_PERCENT else "psm"
            out = b"".join([*(pieces if form == "psm" else pieces[::-1]), marks[2], raw[l:h]])
        forms.append(form)
        outputs.append(out)
        lengths.append((None, None) if form == "plain" else (int(chars[1][i] - chars[0][i]), int(chars[2][i] - chars[1][i])))
    return n, forms, [x for x, _ in lengths], [x for _, x in lengths], outputs


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1)
        for start, data, offsets in _slices(batch.column(1)):
            rows = slice(start, start + len(offsets) - 1)
            n, form, prefix, middle, output = _transformed(data, offsets, numbers[rows])
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], *columns], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = SALT) -> DataFrame:
    """One row a document: id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    ship_package(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *numbers)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_transform, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of: a text with a marker of its own stays plain, so the pieces are what stands between the markers."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = (F.concat(*[F.element_at(piece, k) for k in order]) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
