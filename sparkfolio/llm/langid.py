"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text recognises every substring of it. A text is parsed greedily into
longest matches; each match is a phrase, and so is a letter that the language has never shown. The language whose automaton needs the
fewest phrases for each letter, each as long as log2 of its text's length (and a code point for each unknown letter), wins. The score is a softmax of the entropies in bits a character.

The automata keep their transitions sparsely, in one hash table for all languages, so an alphabet may have any number of letters. Blocks of
BLOCK characters are parsed side by side with numpy, each from the root; then each block is parsed again from the state in which the block
before it ends, up to the first phrase that both parses begin at the same letter. The counts are those of one parse of the whole text.

Learning uses at most DOCS_PER_LANG labelled rows a language, those whose ids hash lowest, among rows of at most LEARN_CHARS characters (a
language that has none such is learned from its shortest row). Their whole texts are learned, and every text is scored whole. A worker
holds some 100 bytes for each learned character.

Cases: a null text, or one without a letter, is 'und' with score 0; a null language is not learned from. Of labelled rows with one id and
language, one is learned from. Without any labelled text every prediction is 'und'. Repeated rows get equal answers. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import held, sample_by_hash, text_slices
from sparkfolio.session import ship_package

DOCS_PER_LANG = 16
LEARN_CHARS = 20_000
BLOCK = 512
#: Blocks that are parsed at a time: bounds memory for any length and any number of texts.
LANES = 4_096
SHARPNESS = 6.0
#: What a letter that a language has never shown costs beyond its phrase: a code point spelled out.
LITERAL_BITS = 21.0
#: Bytes of text that are parsed at a time in one Python worker.
BATCH_BYTES = 1 << 20
#: Phrases a character above which a text is not in any of the languages.
REJECT_RATE = 0.6
#: Shorter texts, in letters and gaps, are too short for that rate to say anything.
REJECT_FROM = 12

_letter = re.compile(r"[^\W\d_]")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of the sequence (Blumer et al., 1985)."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Transitions:
    """Sparse transitions (state, class) -> state in one array: a state's are at its own displacement plus the class.

    Displacements are drawn until nothing collides, states of many transitions first; those of one take the places left free.
    A slot holds the state and the target in one number, so a lookup is two reads.
    """

    TARGET_BITS = 31  # 2 * 10**9 states: some 3,000 languages of DOCS_PER_LANG texts of LEARN_CHARS characters

    def __init__(self, states: np.ndarray, classes: np.ndarray, targets: np.ndarray, width: int, n_states: int):
        if n_states >= 1 << self.TARGET_BITS:
            raise ValueError("more text is learned than states have numbers: lower DOCS_PER_LANG")
        size = max(width, 1 << int(3 * len(states) + 1).bit_length())
        self.slots = np.full(size + width, -1, np.int64)
        self.shift = np.zeros(n_states, np.int64)
        order = np.argsort(states, kind="stable")
        states, classes, targets = states[order], classes[order], targets[order]
        degree = np.bincount(states, minlength=n_states)
        begin = np.cumsum(degree) - degree
        packed = states << self.TARGET_BITS | targets
        draw, taken = np.random.default_rng(0), np.full(size + width, -1, np.int64)
        for n in np.unique(degree[degree > 1])[::-1].tolist():
            left = np.flatnonzero(degree == n)
            while len(left):
                of = begin[left][:, None] + np.arange(n)
                shift = draw.integers(0, size, len(left))
                at = shift[:, None] + classes[of]
                taken[at] = left[:, None]  # of several states for one slot, the last stays
                good = ((self.slots[at] < 0) & (taken[at] == left[:, None])).all(1)
                self.slots[at[good]] = packed[of[good]]
                self.shift[left[good]] = shift[good]
                left = left[~good]
        single = begin[degree == 1]
        free = np.flatnonzero(self.slots[width:] < 0)[: len(single)] + width
        self.slots[free] = packed[single]
        self.shift[states[single]] = free - classes[single]

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Targets, -1 where there is no transition; classes are broadcast over the rows of states."""
        at = self.shift.take(states)
        at += classes
        found = self.slots.take(at)
        return np.where(found >> self.TARGET_BITS == states, found & (1 << self.TARGET_BITS) - 1, -1)


class Parser:
    """The automata of all languages. State 0 has no transitions: a parse begins in it, and a letter unknown to a language leads to it."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.lookup = np.zeros(0x110000, np.int32)  # 0 is a space, 1 a letter that no language has shown
        for i in range(0x110000):
            if chr(i).isalpha():
                self.lookup[i] = 1
        for k, c in enumerate(sorted({c for ts in samples.values() for t in ts for c in t.lower() if c.isalpha()})):
            self.lookup[ord(c)] = k + 2
        self.width = int(self.lookup.max()) + 1
        self.first = np.zeros((len(self.langs), self.width), np.int64)  # the root's transitions
        parts, logs, base = [], [], 1
        for j, lang in enumerate(self.langs):
            codes = self.codes(" ".join(samples[lang])).tolist()
            nexts = suffix_automaton(codes)
            for c, to in nexts[0].items():
                self.first[j, c] = to + base
            sizes = np.fromiter(map(len, nexts), np.int64, len(nexts))
            classes, targets = (np.fromiter((x for after in nexts for x in of(after)), np.int64, sizes.sum()) for of in (dict.keys, dict.values))
            parts.append((np.repeat(np.arange(len(nexts)) + base, sizes), classes, targets + base))
            logs.append(np.log2(max(2, len(codes))))
            base += len(nexts)
            del nexts  # one automaton at a time in its first form
        states, classes, targets = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3))
        self.table = Transitions(states, classes, targets, self.width, base)
        self.logs = np.array(logs)

    def codes(self, text: str) -> np.ndarray:
        """Classes of the lower-cased text, runs of anything but letters as one space."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lookup[np.minimum(points, 0x10FFFF)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        return codes[keep]

    def _step(self, states: np.ndarray, classes: np.ndarray, langs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more letter, and whether a phrase begins with it. Without langs, each row of states is a language's."""
        after = self.table.step(states, classes)
        begins = after < 0
        np.copyto(after, self.first.take(classes, axis=1) if langs is None else self.first[langs, classes], where=begins)
        return after, begins

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases [part, language] of the greedy parse of each sequence of classes.

        Parts of like length are parsed together, LANES blocks at a time; a part of more blocks goes on where its last ones have ended.
        """
        counts = np.zeros((len(parts), len(self.langs)))
        group: list[int] = []
        lanes = 0
        for k in sorted(range(len(parts)), key=lambda k: len(parts[k])):
            n = -(-len(parts[k]) // BLOCK)
            if lanes + n > LANES and group:
                counts[group] = self._phrases([parts[g] for g in group])[0]
                group, lanes = [], 0
            if n > LANES:
                states = None
                for i in range(0, len(parts[k]), LANES * BLOCK):
                    found, states = self._phrases([parts[k][i : i + LANES * BLOCK]], states)
                    counts[k] += found[0]
            elif n:
                group.append(k)
                lanes += n
        if group:
            counts[group] = self._phrases([parts[g] for g in group])[0]
        return counts

    def _phrases(self, parts: list[np.ndarray], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [part, language], and the states [language] in which the last part ends. The first one begins in `states`, if given."""
        n_langs = len(self.langs)
        counts = np.zeros((len(parts), n_langs))
        blocks = [(k, i) for k, p in enumerate(parts) for i in range(0, len(p), BLOCK)]
        if not blocks or not n_langs:
            return counts, np.zeros(n_langs, np.int64)
        size = np.array([min(BLOCK, len(parts[k]) - i) for k, i in blocks])
        order = np.argsort(-size, kind="stable")  # lanes by falling size: those that are still at work come first
        lane_of = np.empty(len(blocks), np.int64)
        lane_of[order] = np.arange(len(blocks))
        deep = int(size.max())
        grid = np.zeros((deep, len(blocks)), np.int32)
        for lane, b in enumerate(order):
            k, i = blocks[b]
            grid[: size[b], lane] = parts[k][i : i + BLOCK]
        begins = np.zeros((deep, n_langs, len(blocks)), bool)
        live = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")
        ends = np.zeros((n_langs, len(blocks)), np.int64)
        if states is not None:
            ends[:, lane_of[0]] = states
        for t in range(deep):
            n = live[t]
            ends[:, :n], begins[t, :, :n] = self._step(ends[:, :n], grid[t, :n].astype(np.int64))
        # the block before each lane, -1 where a text begins; then parse on from there until both parses begin a phrase together
        previous = np.full(len(blocks), -1)
        for b, (_, i) in enumerate(blocks):
            if i:
                previous[lane_of[b]] = lane_of[b - 1]
        follower = np.full(len(blocks), -1)
        follower[previous[previous >= 0]] = np.flatnonzero(previous >= 0)
        lanes, langs = (x.ravel() for x in np.meshgrid(np.flatnonzero(previous >= 0), np.arange(n_langs), indexing="ij"))
        sizes = size[order]
        while len(lanes):
            now = ends[langs, previous[lanes]]
            at_work = np.arange(len(lanes))
            changed = []
            for t in range(deep):
                ln, lg = lanes[at_work], langs[at_work]
                after, new = self._step(now[at_work], grid[t, ln].astype(np.int64), lg)
                together = new & begins[t, lg, ln]
                begins[t, lg, ln] = new
                now[at_work] = after
                last = ~together & (sizes[ln] == t + 1)
                if last.any():
                    done = at_work[last]
                    moved = done[ends[langs[done], lanes[done]] != now[done]]
                    ends[langs[moved], lanes[moved]] = now[moved]
                    changed.append(moved)
                at_work = at_work[~together & ~last]
                if not len(at_work):
                    break
            moved = np.concatenate(changed) if changed else at_work[:0]
            moved = moved[follower[lanes[moved]] >= 0]
            lanes, langs = follower[lanes[moved]], langs[moved]
        owner = np.array([k for k, _ in blocks])[order]
        total = begins.sum(0)
        for j in range(n_langs):
            counts[:, j] = np.bincount(owner, weights=total[j], minlength=len(parts))
        return counts, ends[:, lane_of[-1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score, phrases a character of the language, and length in letters and gaps, for each text."""
        parts = [self.codes(t or "") for t in texts]
        counts = self.phrases(parts)
        langs, scores, rates = [], [], []
        for part, row in zip(parts, counts, strict=True):
            if not self.langs or not part.any():
                langs.append("und"), scores.append(0.0), rates.append(0.0)
                continue
            unknown = (self.first == 0) @ np.bincount(part, minlength=self.width)  # by class: memory does not grow with languages times letters
            entropy = (row * self.logs + unknown * LITERAL_BITS) / len(part)
            best = int(entropy.argmin())
            weight = np.exp(-SHARPNESS * (entropy - entropy[best]))
            langs.append(self.langs[best])
            scores.append(float(weight[best] / weight.sum()))
            rates.append(float(row[best] / len(part)))
        return langs, scores, rates, [len(p) for p in parts]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """A bounded sample of whole texts per language, in the order of their ids' hashes; labelled holds only rows that may be learned from."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    short = F.length("_text") <= LEARN_CHARS
    sizes = rows.groupBy("_lang").agg(F.count_if(short).alias("n"), F.min(F.struct(F.length("_text").alias("size"), F.col("_id"))).alias("least")).collect()
    if not sizes:
        return {}
    chosen = sample_by_hash(rows.filter(short).select("_id", "_lang"), "_lang", "_id", DOCS_PER_LANG, {r["_lang"]: r["n"] for r in sizes if r["n"]})
    chosen += [(r["least"]["_id"], r["_lang"]) for r in sizes if not r["n"]]
    keys = labelled.sparkSession.createDataFrame(chosen, rows.select("_id", "_lang").schema)
    texts = rows.join(F.broadcast(keys), ["_id", "_lang"], "left_semi").groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).collect()
    place = {key: n for n, key in enumerate(chosen)}
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: place[r["_id"], r["_lang"]]):
        out.setdefault(r["_lang"], []).append(r["_text"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score, phrase_rate, letters (its length in letters and gaps)."""
    ship_package(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(samples)
    key = zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(("langid", key), lambda: Parser(learned.value))
        for batch in batches:
            for start, texts in text_slices(batch, 1, BATCH_BYTES):
                found = parser.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start : start + len(texts)], *(pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True))],
                    ["_id", "lang_pred", "score", "phrase_rate", "letters"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(predict, f"_id {kind}, lang_pred string, score double, phrase_rate double, letters long")
    return found.withColumnRenamed("_id", id_col)


def accepted(lang: Column, rate: Column, letters: Column | None = None) -> Column:
    """Whether a document is in one of the languages: it has a letter, and longest matches are not those of noise. Its length may be given."""
    like = rate <= REJECT_RATE
    return (lang != "und") & (like if letters is None else like | (letters < REJECT_FROM))
