"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

The kernel is the gap-weighted subsequence kernel (Lodhi et al., 2002) of order 3: windows are alike if they share
subsequences of three letters, each weighted by DECAY ** (span), where a span of up to SPAN characters may hold gaps or
inserted characters. So 'idi.ot', 'id1iot', 'id iot' and 'i d i o t' stay near to what they hide.

A labelled document's sentences inherit its label, and a sentence is a bag of windows: its words, each two neighbouring words with
what stands between them, and letters spelled out one by one. A sentence is as toxic as its worst window, a document as its worst sentence.

Learning is that of the multiple-instance machine (Andrews et al., 2003). First, windows are weighed by the likelihood ratio of the toxic and
clean documents that hold them; each toxic document votes for its best one, so that the words of a copied document do not pass for insults;
windows whose votes alone are evidence are the first witnesses of toxic sentences. Windows of clean sentences, by hash, are the first
negatives. Then, in ROUNDS rounds, the machine is trained, and the sentences are scored whole: each clean document adds the window that
the machine likes best and should not, each toxic one its best if it is on the toxic side but within the margin. Landmarks are chosen from witnesses and negatives,
farthest first; the kernel against them, whitened, is the Nystroem map, and a linear support vector machine is trained on it. Its decision
is linear in the subsequences' weights, so it is folded into one table over triples of letters: a text is scored by looking up its
triples, with the kernel's exact norm for every window that may be its worst.

Margins are calibrated by logistic regression on labelled documents that nothing else was learned from.

Bounds: at most PER_CLASS labelled rows of each label, chosen by a hash of the id, of which every third calibrates; LANDMARKS landmarks; first
negatives: NEGATIVES windows (all clean windows are looked through in the rounds). Every text is scored whole, in chunks of CHUNK characters that overlap.

Letters beyond the ALPHABET - 2 most frequent share the numbers of those by their code point. A window of fewer than three letters has no
triples, but is part of its neighbours' windows.

Cases: a null text, or one without a letter, has the lowest margin. Words of over WINDOW characters are taken in overlapping windows, all
of them. Where several rows have one labelled id, each is learned from. Without labels of both kinds every score is the share of toxic labels.
Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import held, materialize, text_slices
from sparkfolio.llm.labelled import Logistic, labelled_texts, sample_ids
from sparkfolio.session import ship_package

PER_CLASS = 3_000
DECAY = 0.6
SPAN = 6
#: Likelihood ratio (twice the log) from which a window counts as evidence.
EVIDENCE = 14.0
#: The same for the votes of a window, of which each document has one.
VOTES = 9.0
#: Beginnings of words from this length on are weighed as well, so that a word's inflections vote together.
STEM = 4
NEGATIVES = 5_000
ROUNDS = 3
LANDMARKS = 160
FLOOR = -1.5
WINDOW = 32
ALPHABET = 64
CHUNK = 1 << 20
BATCH_BYTES = 1 << 20
THRESHOLD = 0.3

_spelled = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){2,}[^\W\d_](?!\w)")
_blank = re.compile(r"\s+")
_word = re.compile(r"\S+")
#: Characters that end a sentence where a word ends with them; a line break does as well.
ENDERS = ".!?\u2026\u3002\uff01\uff1f"
BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"


def bare(window: str) -> str:
    """A window without the marks around it: all that is no letter or digit, seen from both ends."""
    start, stop = 0, len(window)
    while start < stop and not window[start].isalnum():
        start += 1
    while stop > start and not window[stop - 1].isalnum():
        stop -= 1
    return window[start:stop]


def _extras(low: str, long_words: list[str]) -> list[str]:
    """Letters spelled out one by one, joined; and the windows of long words."""
    found = [_blank.sub("", m) for m in _spelled.findall(low)]
    out = [w for w in found if len(w) <= WINDOW]
    for w in [*long_words, *(w for w in found if len(w) > WINDOW)]:
        out += [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return out


def windows(text: str) -> list[str]:
    """The windows of all sentences of a text, in lower case. Two words make a window if the white space between fits the kernel's span."""
    low = text.lower()
    words = [(m.start(), m.end()) for m in _word.finditer(low)]
    short = [b - a <= WINDOW for a, b in words]
    out = [low[a:b] for (a, b), ok in zip(words, short, strict=True) if ok]
    for k in range(len(words) - 1):
        (a, b), (c, d) = words[k], words[k + 1]
        if short[k] and short[k + 1] and c - b < SPAN and low[b - 1] not in ENDERS and not any(x in BREAKS for x in low[b:c]):
            out.append(low[a:d])
    return out + _extras(low, [low[a:b] for (a, b), ok in zip(words, short, strict=True) if not ok])


def chunks(low: str) -> Iterator[str]:
    """A long text in chunks cut at white space, where there is any, that share some words."""
    start = 0
    while len(low) - start > CHUNK:
        cut = _blank.search(low, start + CHUNK, start + CHUNK + 4 * WINDOW)
        stop = cut.start() if cut else start + CHUNK
        yield low[start:stop]
        back = _blank.search(low, stop - 8 * WINDOW, stop - 2 * WINDOW)
        start = back.end() if back else stop - 2 * WINDOW
    yield low[start:]


class Alphabet:
    """Characters as numbers: 0 is white space, 1 any other that is no letter, letters from 2 on: the frequent ones, and the others by code point."""

    def __init__(self, letters: str):
        self.letters = letters[: ALPHABET - 2]
        self.lookup = np.ones(0x110000, np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():
                self.lookup[i] = 2 + i % (ALPHABET - 2)
            elif chr(i).isspace():
                self.lookup[i] = 0
        for k, c in enumerate(self.letters):
            self.lookup[ord(c)] = k + 2

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words one after the other, and each one's length."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.lookup[points], np.fromiter(map(len, words), np.int64, len(words))


#: (second offset, third offset, weight) of the triples that start at a character.
STEPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]


def triples(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, triple, weight) for each step; triples with a character that is no letter are left out."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wide = codes.astype(np.int64)
    for a, b, weight in STEPS:
        if len(wide) <= b:
            return
        x, y, z = wide[:-b], wide[a : len(wide) - b + a], wide[b:]
        ok = (owner[:-b] == owner[b:]) & (x > 1) & (y > 1) & (z > 1)
        at = np.flatnonzero(ok)
        yield owner[at], (x[at] * ALPHABET + y[at]) * ALPHABET + z[at], weight


def sparse(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' feature vectors: (word, triple, value), sorted, each pair once."""
    found = list(triples(codes, sizes))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    key = np.concatenate([w * ALPHABET**3 + t for w, t, _ in found])
    value = np.concatenate([np.full(len(w), v) for w, _, v in found])
    unique, inverse = np.unique(key, return_inverse=True)
    return unique // ALPHABET**3, unique % ALPHABET**3, np.bincount(inverse, weights=value, minlength=len(unique))


def unit_vectors(alphabet: Alphabet, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, triple, value = sparse(*alphabet.codes(words))
    norm = np.sqrt(np.bincount(word, weights=value**2, minlength=len(words)))
    return word, triple, value / np.maximum(norm[word], 1e-12)


def kernel(alphabet: Alphabet, words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel [word, landmark]."""
    lw, lt, lv = unit_vectors(alphabet, landmarks)
    order = np.argsort(lt, kind="stable")
    lw, lt, lv = lw[order], lt[order], lv[order]
    w, t, v = unit_vectors(alphabet, words)
    out = np.zeros((len(words), len(landmarks)))
    low, high = np.searchsorted(lt, t, "left"), np.searchsorted(lt, t, "right")
    sizes = high - low
    rows = np.repeat(np.arange(len(t)), sizes)
    at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    np.add.at(out, (w[rows], lw[at]), v[rows] * lv[at])
    return out


def farthest(alphabet: Alphabet, words: list[str], want: int) -> list[str]:
    """`want` of the words, each the one least like those before."""
    if not words:
        return []
    word, triple, value = unit_vectors(alphabet, words)
    bounds = np.searchsorted(word, np.arange(len(words) + 1))
    best, chosen, at = np.full(len(words), -1.0), [], 0
    while True:
        chosen.append(words[at])
        mark = np.zeros(ALPHABET**3)
        own = slice(bounds[at], bounds[at + 1])
        mark[triple[own]] = value[own]
        best = np.maximum(best, np.bincount(word, weights=value * mark[triple], minlength=len(words)))
        at = int(best.argmin())
        if len(chosen) >= min(len(words), want) or best[at] > 0.98:
            return chosen


def train_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by Newton steps on the active set."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], cost[active]
        new = np.linalg.solve(reg + 2 * (xa * ca[:, None]).T @ xa, 2 * xa.T @ (ca * ya))
        done = np.abs(new - w).max() < 1e-7
        w = new if done else w + 0.8 * (new - w)
        if done:
            break
    return w[:-1], float(w[-1])


class Model:
    """The decision on a window, as a table over triples and a bias."""

    def __init__(self, letters: str, weights: np.ndarray, bias: float):
        self.letters, self.weights, self.bias = letters, weights, bias
        self.alphabet = Alphabet(letters)
        self.ender = np.zeros(0x110000, bool)
        self.ender[[ord(c) for c in ENDERS + BREAKS]] = True

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each window, at least FLOOR."""
        codes, sizes = self.alphabet.codes(words)
        word, triple, value = sparse(codes, sizes)
        dot = np.bincount(word, weights=self.weights[triple] * value, minlength=len(words))
        square = np.bincount(word, weights=value**2, minlength=len(words))
        return np.where(square > 0, np.maximum(FLOOR, dot / np.sqrt(np.maximum(square, 1e-12)) + self.bias), FLOOR)

    def _bounds(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of the text as (start, end), and for each word, and for it with the next, the most that its margin can be."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.alphabet.lookup[points]
        inside = np.concatenate(([False], codes > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.zeros(0), np.zeros(0)
        word = np.cumsum(inside[1:-1] & ~inside[:-2], dtype=np.int32)  # from 1 on; white space belongs to the word before it
        letter = codes > 1
        ended = np.concatenate(([0], np.cumsum(self.ender[points] & ((codes == 0) | np.append(codes[1:] == 0, True)))))
        joins = np.append(ended[starts[1:]] == ended[starts[:-1]], False)  # no end of a sentence between it and the next
        wide = codes.astype(np.int32)
        n = len(wide)
        dots, squares = np.zeros((2, n), np.float32), np.zeros((2, n), np.float32)
        for a, b, weight in STEPS:
            if n <= b:
                break
            m = n - b
            gain = self.weights.take((wide[:m] * ALPHABET + wide[a : a + m]) * ALPHABET + wide[b:]) * np.float32(weight)
            ok = letter[:m] & letter[a : a + m] & letter[b:]
            apart = word[b:] - word[:m]
            for k in (0, 1):
                own = ok & (apart == k)
                dots[k, :m] += gain * own
                squares[k, :m] += own * np.float32(weight * weight)
        (dot, dot_next), (square, square_next) = (np.add.reduceat(x, starts, axis=1) for x in (dots, squares))
        following = lambda x: np.append(x[1:], np.float32(0))
        both = dot + dot_next + following(dot), square + square_next + following(square)
        short = ends - starts <= WINDOW
        out = []
        for (d, q), allowed in (((dot, square), short), (both, short & np.append(short[1:], False) & joins)):
            # without a triple met twice in it, a window's norm is the least that it can be
            out.append(np.where(allowed & (q > 0), np.maximum(d, 0) / np.sqrt(np.maximum(q, 1e-12)) + self.bias + 1e-3, -np.inf))
        return starts, ends, *out

    def worst(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """The greatest margin of each text's windows, and the window that has it ('' for none)."""
        pieces = [(k, piece) for k, t in enumerate(texts) if t for piece in chunks(t.lower())]
        margins, best = np.full(len(texts), FLOOR), [""] * len(texts)
        start = 0
        while start < len(pieces):
            stop, total = start, 0
            while stop < len(pieces) and (stop == start or total + len(pieces[stop][1]) <= CHUNK):
                total += len(pieces[stop][1])
                stop += 1
            self._worst(pieces[start:stop], margins, best)
            start = stop
        return margins, best

    def _worst(self, pieces: list[tuple[int, str]], margins: np.ndarray, best: list[str]) -> None:
        joined = "\n".join(p for _, p in pieces)
        begins = np.cumsum([0] + [len(p) + 1 for _, p in pieces])
        starts, ends, single, double = self._bounds(joined)
        of_word = np.array([k for k, _ in pieces])[np.searchsorted(begins, starts, side="right") - 1] if len(starts) else starts
        lengths = ends - starts
        owners, froms, tos, most = [of_word, of_word], [starts, starts], [ends, np.append(ends[1:], 0)], [single, double]
        owner, low, high, bound = (np.concatenate(x) for x in (owners, froms, tos, most))
        keep = bound > FLOOR
        owner, low, high, bound = owner[keep], low[keep], high[keep], bound[keep]
        long_words: dict[int, list[str]] = {}
        for w in np.flatnonzero(lengths > WINDOW).tolist():
            long_words.setdefault(int(of_word[w]), []).append(joined[starts[w] : ends[w]])
        extras = [(k, e) for k, piece in pieces for e in _extras(piece, [])] + [(k, e) for k, ws in long_words.items() for e in _extras("", ws)]

        def settle(owner, found: list[str]) -> None:
            if not found:
                return
            unique = {w: i for i, w in enumerate(dict.fromkeys(found))}
            exact = self.margins(list(unique))
            for k, w in zip(owner, found, strict=True):
                m = exact[unique[w]]
                if m > margins[k] or (m == margins[k] and m > FLOOR and (not best[k] or w < best[k])):
                    margins[k], best[k] = m, w

        settle([k for k, _ in extras], [e for _, e in extras])
        order = np.lexsort((-bound, owner))
        first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        for turn in (0, 1):  # each text's most promising window, then all that may be worse than it
            at = first if turn == 0 else np.flatnonzero(bound >= margins[owner])
            settle(owner[at].tolist(), [joined[a:b] for a, b in zip(low[at].tolist(), high[at].tolist(), strict=True)])


def _scored(rows: DataFrame, state: tuple[str, bytes, float]) -> DataFrame:
    """rows (_id, _text, ...) as (_id, margin, window)."""
    ship_package(rows.sparkSession)
    learned = rows.sparkSession.sparkContext.broadcast(state)
    key = (zlib.crc32(state[0].encode()), zlib.crc32(state[1]), state[2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("toxicity", key), lambda: Model(learned.value[0], np.frombuffer(learned.value[1], np.float32), learned.value[2]))
        for batch in batches:
            for start, texts in text_slices(batch, 1, BATCH_BYTES):
                margins, best = model.worst(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start : start + len(texts)], pa.array(margins), pa.array(best, pa.string())], ["_id", "margin", "window"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_text").mapInArrow(score, f"_id {kind}, margin double, window string")


def _document_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_n, _label, _window): the windows of each labelled document (_n, _text, _label), once each, without marks around them."""
    for batch in batches:
        for start, texts in text_slices(batch, 1, BATCH_BYTES):
            owners, found = [], []
            for k, text in enumerate(texts):
                own = {bare(w) for w in windows(text or "")} - {""}
                own |= {w[:n] for w in own if w.isalpha() for n in range(STEM, len(w))}
                owners += [start + k] * len(own)
                found += own
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(found, pa.string())], ["_n", "_label", "_window"])


def likelihood_ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood ratio of a window's split over toxic and clean documents; negative where it is the cleaner one's."""
    share = n_pos / max(1, n_pos + n_neg)
    total = pos + neg
    toxic = pos * F.log(pos / total / F.lit(share))
    clean = F.when(neg > 0, neg * F.log(neg / total / F.lit(1 - share))).otherwise(0.0)
    return F.when((total > 0) & (pos / total > share), 2 * (toxic + clean)).otherwise(-1.0)


def first_windows(texts: DataFrame) -> tuple[list[str], list[str]]:
    """(witnesses, negatives) from labelled documents (_n, _text, _label), with _n of its own for each document."""
    counts = {r[0]: r[1] for r in texts.groupBy("_label").count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_neg:
        return [], []
    seen = materialize(texts.select("_n", "_text", "_label").mapInArrow(_document_windows, "_n long, _label int, _window string"), "windows")
    by_window = seen.groupBy("_window").agg(F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") == 0).alias("neg"))
    by_window = materialize(by_window, "window-counts")
    worth = likelihood_ratio(F.col("pos"), F.col("neg"), n_pos, n_neg)
    likely = by_window.filter("pos >= 2").withColumn("worth", worth).filter(F.col("worth") >= EVIDENCE)
    # of windows that are worth about the same, the longest: a whole word rather than its beginning
    rank = F.struct(F.floor(10 * F.log("worth")).alias("about"), F.length("_window").alias("size"), "worth", "_window", "neg")
    best = seen.filter("_label = 1").join(likely, "_window").groupBy("_n").agg(F.max(rank).alias("best"))
    votes = best.groupBy("best._window", "best.neg").count()
    witnesses = votes.filter(likelihood_ratio(F.col("count"), F.col("neg"), n_pos, n_neg) >= VOTES).select("_window").collect()
    clean = by_window.filter("neg > 0").select("_window", "neg")
    some = clean.orderBy(F.xxhash64("_window"), "_window").limit(NEGATIVES).collect()
    common = clean.orderBy(F.col("neg").desc(), "_window").limit(NEGATIVES // 4).collect()
    taken = {r[0] for r in witnesses}
    return sorted(taken), [w for w in dict.fromkeys(r[0] for r in common + some) if w not in taken]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(state, calibration) from labels, which hold only rows that may be learned from."""
    ship_package(docs.sparkSession)
    ids, counts = sample_ids(labels, label_col, PER_CLASS, id_col)
    texts = materialize(labelled_texts(docs, ids, id_col, text_col), "labelled")  # bounded: read in every round
    lessons = texts.filter("_n % 3 <> 0")
    alone = lessons.groupBy(F.xxhash64("_text").alias("_h"), "_label").agg(F.min_by("_text", "_n").alias("_text"))  # of equal texts one counts
    lessons = materialize(alone.select((F.monotonically_increasing_id()).alias("_n"), "_text", "_label"), "lessons")
    witnesses, negatives = first_windows(lessons)
    state = fit_windows(witnesses, negatives, [])
    mined: list[str] = []
    rows = lessons.select(F.col("_n").alias("_id"), "_text")
    for _ in range(ROUNDS if witnesses else 0):
        found = _scored(rows, state).join(lessons.select(F.col("_n").alias("_id"), "_label"), "_id")
        found = found.filter("window <> '' AND ((_label = 0 AND margin > -1) OR (_label = 1 AND margin > 0 AND margin < 1))").select("_label", "window").distinct().collect()
        told = [(r["_label"], bare(r["window"])) for r in found]
        hard = sorted({w for label, w in told if label == 0} - set(mined) - set(witnesses))
        toxic = sorted({w for label, w in told if label == 1} - set(witnesses) - set(mined) - set(hard) - set(negatives))
        if not hard and not toxic:
            break
        mined, witnesses = mined + hard, witnesses + toxic
        state = fit_windows(witnesses, negatives, mined)
    rest = texts.filter("_n % 3 = 0")
    pdf = _scored(rest, state).select("_id", "margin").join(F.broadcast(ids), "_id").toPandas()
    y = pdf["_label"].to_numpy(np.float64)
    found = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    weights = np.array([counts.get(int(v), 0) / found[int(v)] for v in y])
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    return state, Logistic(pdf[["margin"]].to_numpy(np.float64), y, weights), share


def fit_windows(witnesses: list[str], negatives: list[str], mined: list[str]) -> tuple[str, bytes, float]:
    """The machine trained on windows, folded into a table over triples. mined are negatives that an earlier machine got wrong."""
    letters = Counter(c for w in witnesses * 4 + negatives + mined for c in w if c.isalpha())
    alphabet = Alphabet("".join(sorted(letters, key=lambda c: (-letters[c], c))[: ALPHABET - 2]))
    useful = lambda ws: [w for w, n in zip(ws, np.bincount(unit_vectors(alphabet, ws)[0], minlength=len(ws)), strict=True) if n]
    witnesses, negatives, mined = (useful(ws) if ws else [] for ws in (witnesses, [w for w in negatives if w not in set(mined)], mined))
    if not witnesses or not negatives + mined:
        return alphabet.letters, np.zeros(ALPHABET**3, np.float32).tobytes(), FLOOR
    marks = farthest(alphabet, witnesses, LANDMARKS // 2) + farthest(alphabet, mined, LANDMARKS // 4)
    marks += farthest(alphabet, negatives, LANDMARKS - len(marks))
    gram = kernel(alphabet, marks, marks)
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    found = witnesses + negatives + mined
    z = kernel(alphabet, found, marks) @ root
    y = np.array([1.0] * len(witnesses) + [-1.0] * (len(found) - len(witnesses)))
    cost = np.where(y > 0, 0.5 * len(found) / len(witnesses), 0.5 * len(found) / (len(found) - len(witnesses))) * 2.0
    w, bias = train_svm(z, y, cost)
    beta = root @ w
    mark, triple, value = unit_vectors(alphabet, marks)
    table = np.bincount(triple, weights=beta[mark] * value, minlength=ALPHABET**3)
    return alphabet.letters, table.astype(np.float32).tobytes(), bias


def score_toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, margin, score."""
    state, calibration, share = model
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = _scored(rows, state).drop("window")
    if not calibration.coef.any():
        return found.withColumn("score", F.lit(float(share))).withColumnRenamed("_id", id_col)
    scaled = (F.col("margin") - float(calibration.mean[0])) / float(calibration.scale[0])
    z = float(calibration.coef[0]) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), scaled)) + float(calibration.coef[1])
    return found.withColumn("score", 1 / (1 + F.exp(-z))).withColumnRenamed("_id", id_col)
