"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue holds, for each merge rank, the linked-list positions of the pairs of that rank; a bitmap of three levels
(64 bits a word) over the ranks gives the lowest one by find-first-set. Entries whose pair has changed since are skipped.
All new pre-tokens of a batch of texts share one queue. No pair spans two pre-tokens, so the order in which pre-tokens take turns changes nothing.
All pairs of a rank merge together, from the left, up to the first merge in a pre-token that makes a pair of a lower rank (some tokens of
public vocabularies have shorter ways of being made). Those right of it wait in sorted runs, and are taken some at a time: as many
as about twice what the last turn could merge. So a pre-token of n bytes takes O(n log n) steps, however its ranks interleave.

Pre-tokens repeat, so each Python worker remembers the ids of those it has met, and starts anew beyond MEMO of them.

Cases: a null text is an empty one, with no ids. Every byte has a rank of its own, so any text encodes and decodes to itself.
Repeated rows get equal answers. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import held, text_slices
from sparkfolio.session import ship_package

MEMO = 300_000
#: Bytes of text that share one queue.
BATCH_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


class RankQueue:
    """Positions by rank. A bitmap of three levels over the ranks finds the lowest that has any.

    A rank with a window gives the leftmost positions only, some `window` at a time. Its positions are kept as sorted runs of
    ever smaller sizes, so that taking from the left costs what is taken.
    """

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.runs: dict[int, list[np.ndarray]] = {}
        self.window: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Adds each position to the bucket of its rank; ranks below 0 are no merges."""
        if not len(ranks):
            return
        order = ranks.argsort(kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        stops = [*starts[1:].tolist(), len(ranks)]
        for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), stops, strict=True):
            if rank >= 0:
                self.put(rank, positions[a:b])

    def put(self, rank: int, positions: np.ndarray) -> None:
        self._mark(rank)
        self.buckets.setdefault(rank, []).append(positions)

    def put_back(self, rank: int, positions: np.ndarray, window: int) -> None:
        """Returns positions to their rank, which from now on gives some `window` of its positions at a time."""
        self.window[rank] = window
        if len(positions):
            self.put(rank, positions)

    def take(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions (the leftmost where it has a window), in any order; they leave the queue."""
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        if rank in self.window:
            found = self._leftmost(rank)
            if rank not in self.runs:
                self._clear(rank)
            return rank, found
        self._clear(rank)
        chunks = self.buckets.pop(rank)
        return rank, chunks[0] if len(chunks) == 1 else np.concatenate(chunks)

    def _leftmost(self, rank: int) -> np.ndarray:
        runs = self.runs.pop(rank, [])
        new = self.buckets.pop(rank, None)
        if new:
            runs.append(np.sort(np.concatenate(new)))
        while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
            low, high = runs.pop(), runs.pop()
            runs.append(np.sort(np.concatenate((high, low)), kind="stable"))
        window = self.window[rank]
        bound = min(run[min(window, len(run)) - 1] for run in runs)
        cuts = [int(run.searchsorted(bound, "right")) for run in runs]
        rest = [run[c:] for run, c in zip(runs, cuts, strict=True) if c < len(run)]
        if rest:
            self.runs[rank] = rest
        return np.concatenate([run[:c] for run, c in zip(runs, cuts, strict=True)])

    def _mark(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        block = word >> 6
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def _clear(self, rank: int) -> None:
        word, block = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[block] &= ~(1 << (word & 63))
            if not self.mid[block]:
                self.top &= ~(1 << block)


class Merges:
    """Every pair of tokens that merges, looked up by one of its sides."""

    def __init__(self, ranks: dict[bytes, int]):
        lefts, rights, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a), rights.append(b), merged.append(rank)
        left, right, rank = (np.array(x, np.int32) for x in (lefts, rights, merged))
        size = max(ranks.values(), default=0) + 1
        #: Tokens that merge on with another at a rank below their own. After such a merge, other pairs have to wait.
        self.early = np.zeros(size, bool)
        self.early[left[rank < left]] = True
        self.early[right[rank < right]] = True
        self.after = self._by(left, right, rank, size)
        self.before = self._by(right, left, rank, size)
        self.first = np.full((256, 256), -1, np.int32)
        bytes_ = {ranks[bytes([b])]: b for b in range(256)}
        for a, b, r in zip(lefts, rights, merged, strict=True):
            if a in bytes_ and b in bytes_:
                self.first[bytes_[a], bytes_[b]] = r

    @staticmethod
    def _by(key: np.ndarray, other: np.ndarray, rank: np.ndarray, size: int):
        order = np.lexsort((other, key))
        bounds = np.searchsorted(key[order], np.arange(size + 1)).tolist()
        return other[order], rank[order], bounds

    @staticmethod
    def look(side, token: int, others: np.ndarray) -> np.ndarray | None:
        """Ranks of the merges of token with each of others, -1 for none; None if there is none at all."""
        keys, ranks, bounds = side
        a, b = bounds[token], bounds[token + 1]
        if a == b:
            return None
        own = keys[a:b]
        at = own.searchsorted(others)
        at[at == b - a] = 0
        return np.where(own[at] == others, ranks[a:b][at], -1)


#: Characters on which Python's re and the Unicode classes of the pattern agree: ASCII, and letters up to U+017F.
_PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_plain = re.compile(rf"[\t-\r\x20-\x7e{_PLAIN_LETTERS}]*\Z")


def plain_pattern(pattern: str) -> str:
    """The pattern for texts of plain characters only, with \\p{L} and \\p{N} spelled out: re is faster than regex."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        named = next((v for k, v in (("\\p{L}", _PLAIN_LETTERS), ("\\p{N}", "0-9")) if pattern.startswith(k, i)), None)
        if named:
            out.append(named if inside else f"[{named}]")
            i += 5
            continue
        inside = {"[": True, "]": False}.get(pattern[i], inside)
        step = 2 if pattern[i] == "\\" else 1
        out.append(pattern[i : i + step])
        i += step
    return "".join(out)


class _Index(dict):
    """Numbers pre-tokens as they are met."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = found = len(self)
        self.new.append(piece)
        return found


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one after the other."""
    stops = np.cumsum(sizes)
    if not len(stops) or not stops[-1]:
        return flat[:0]
    return flat[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1])]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.findall = regex.compile(pattern).findall
        try:
            self.plain = re.compile(plain_pattern(pattern)).findall
        except re.error:  # the pattern has more than re knows
            self.plain = self.findall
        self.ranks = ranks
        self.merges = Merges(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(0, "<u4")
        self.starts = self.sizes = np.zeros(0, np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has. All share one queue; no pair spans two."""
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(joined)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        ids = np.append(self.single[joined], np.int32(-1))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        last = ends[ends > 0] - 1
        after[last] = n  # a list ends here
        before[ends] = -1
        pair = np.full(n + 1, -1, np.int32)  # the rank of the pair that starts here; -1 also for positions that are gone
        inner = np.flatnonzero(after[:n] < n).astype(np.int32)
        pair[inner] = self.merges.first[joined[inner], joined[inner + 1]] if len(inner) else -1
        queue, look = RankQueue(), self.merges.look
        queue.push(pair[inner], inner)
        gone = np.zeros(n, bool)
        while (entry := queue.take()) is not None:
            r, found = entry
            i = np.unique(found[pair[found] == r])  # the others are stale
            if not len(i):
                continue
            j = after[i]
            whole = i
            if len(i) > 1:
                touch = j[:-1] == i[1:]
                if touch.any():  # x x x: from the left, every other pair
                    place = np.arange(len(i))
                    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), place, 0))
                    i = i[(place - start) % 2 == 0]
                    j = after[i]
                if self.merges.early[r]:
                    stop = self._interrupted(r, i, j, ids, after, before)
                    if stop.any():  # a lower rank comes first in this piece: what is right of it has to wait
                        piece = np.searchsorted(ends, i, side="right")
                        bar = np.full(len(ends) + 1, n, np.int64)
                        np.minimum.at(bar, piece[stop], i[stop])
                        waits = whole > bar[np.searchsorted(ends, whole, side="right")]
                        late = np.flatnonzero(i > bar[piece])
                        i, j = np.delete(i, late), np.delete(j, late)
                        queue.put_back(r, whole[waits], max(64, 2 * len(i)))
                    elif r in queue.window:
                        queue.window[r] = 2 * max(len(whole), queue.window[r])
            k = after[j]
            ids[i], after[i], before[k], gone[j] = r, k, i, True
            h = before[i]  # after the line above: the neighbour may have merged as well
            pair[j] = pair[i] = -1
            right = look(self.merges.after, r, ids[k])
            if right is not None:
                pair[i] = right
                queue.push(right, i)
            held = h >= 0
            h = h[held]
            if len(h):
                left = look(self.merges.before, r, ids[h])
                if left is None:
                    pair[h] = -1
                else:
                    pair[h] = left
                    queue.push(left, h)
        kept = ~gone
        counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))])
        return ids[:n][kept].astype("<u4"), counts

    def _interrupted(self, r: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For merges into r at (i, j), from the left: whether each one makes a pair of a rank below r, which has to merge before the next."""
        h, k = before[i], after[j]
        lefts = np.where(h >= 0, ids[h], -1)
        lefts[1:][h[1:] == j[:-1]] = r  # merged just before
        stop = np.zeros(len(i), bool)
        for side, others in ((self.merges.after, ids[k]), (self.merges.before, lefts)):
            ranks = self.merges.look(side, r, others)
            if ranks is not None:
                stop |= (ranks >= 0) & (ranks < r)
        return stop

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > MEMO or len(self.flat) > 16 * MEMO:
            self.forget()
        number = self.index.__getitem__
        coded = [np.fromiter(map(number, (self.plain if _plain.match(t) else self.findall)(t)), np.int32) if t else self.starts[:0] for t in texts]
        if self.index.new:
            raw = [p.encode("utf-8", "surrogatepass") for p in self.index.new]
            self.index.new = []
            whole = np.array([self.ranks.get(b, -1) for b in raw], np.int64)  # one token: nothing to merge
            hard = np.flatnonzero(whole < 0)
            ids, counts = self.encode_pieces([raw[i] for i in hard.tolist()])
            sizes = np.ones(len(raw), np.int64)
            sizes[hard] = counts
            starts = np.cumsum(sizes) - sizes
            flat = np.zeros(int(sizes.sum()), "<u4")
            easy = np.flatnonzero(whole >= 0)
            flat[starts[easy]] = whole[easy]
            flat[_gather(np.arange(len(flat)), starts[hard], counts)] = ids
            self.starts = np.concatenate((self.starts, starts + len(self.flat)))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, flat))
        return [_gather(self.flat, self.starts[c], self.sizes[c]) for c in coded]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.token_bytes, self.token_starts[ids], self.token_sizes[ids]).tobytes()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded (the bytes that ids stand for)."""
    ship_package(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        raw = f.read()
    ranks, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("bpe", key, pattern), lambda: Encoder(parse_ranks(ranks.value), pattern))
        for batch in batches:
            for start, texts in text_slices(batch, 1, BATCH_BYTES):
                ids = encoder.encode_texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[start : start + len(texts)],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([encoder.decode(x) for x in ids], pa.binary()),
                    ],
                    ["_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"_id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("_id", id_col)
