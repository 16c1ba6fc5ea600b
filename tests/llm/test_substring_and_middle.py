"""Substring dedup and fill-in-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkfolio.llm import fill_in_middle as fim
from sparkfolio.llm import substring_dedup as sub

SCHEMA = "doc_id long, text string, _text string, _hash int, n_words string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 9, "x") for i, t in docs], SCHEMA)


def signed(text):
    v = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def without_repeats(docs, window):
    key = lambda i, t: (i is not None, i or 0, signed(t))
    first, out = {}, []
    split = [(i, t, (t or "").encode().split()) for i, t in docs]
    for i, t, w in split:
        for p in range(len(w) - window + 1):
            g, k = tuple(w[p : p + window]), (key(i, t), p)
            first[g] = min(first.get(g, k), k)
    for i, t, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (key(i, t), p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def rows(found):
    return sorted(map(tuple, found), key=repr)


def some_docs():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), [words(rng.randrange(5, 200)) for _ in range(20)]
    docs = [(0, None), (1, ""), (2, " \n "), (3, "a b")]
    for i in range(4, 160):
        w = list(rng.choice(base)) if rng.random() < 0.4 else words(rng.randrange(1, 150))
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.4:
            k, a = rng.randrange(len(w) + 1), rng.randrange(20)
            w[k:k] = passage[a : a + rng.randrange(15, 40)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w + w if rng.random() < 0.1 else w)))
    docs += [(200, "x " * 500), (201, "x " * 300 + "y"), (202, "q" * 5000 + " " + "r" * 100 + " ".join(["z" * 300] * 30))]  # ties, long words
    docs += [(5, docs[6][1]), (7, docs[7][1]), (None, docs[9][1]), (None, None)]  # an id twice, a row twice, no id
    return docs


@pytest.mark.parametrize("window", [20, 3])
def test_repeats_against_brute_force(spark, window):
    docs = some_docs()
    assert rows(sub.drop_repeats(frame(spark, docs), window=window).collect()) == rows(without_repeats(docs, window))


def test_repeats_of_hot_passages_and_long_texts(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, copy = fresh(25), fresh(60)
    docs = [(i, " ".join(copy if i % 3 == 0 else fresh(10) + (line if i % 3 == 1 else []) + fresh(10))) for i in range(600)]
    docs.append((600, " ".join(fresh(300_000) + line)))
    found = {r["doc_id"]: r for r in sub.drop_repeats(frame(spark, docs)).collect()}
    assert [found[i]["n_removed"] for i in (0, 3, 597, 1, 4, 598, 2, 600)] == [0, 60, 60, 0, 25, 25, 0, 25]
    assert found[600]["kept"] == " ".join(docs[600][1].split()[:-25])


def test_repeats_of_an_empty_table(spark):
    found = sub.drop_repeats(frame(spark, []).limit(0))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"] and found.collect() == []


@pytest.mark.parametrize("period", sorted(sub.COVERS))
def test_covers(period):
    cover = sub.COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_equal_windows_share_an_anchor_and_the_filter_keeps_all(spark):
    words = " ".join(f"a{k}" for k in range(20))
    raw = [f"{'p ' * left}{words} q{left}".encode() for left in range(40)]
    offsets = np.cumsum([0, *map(len, raw)])
    found = sub.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, True)
    at, anchors = found.anchors(20)
    of = [set(anchors[(found.doc[at] == d) & (found.place[at] >= d)].tolist()) for d in range(40)]
    assert all(a & b for a in of for b in of)
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    packed = sub.bloom(spark.createDataFrame([(int(k),) for k in keys], "anchor long"), len(keys))
    assert sub._passed(keys, packed).all() and sub._passed(keys + np.uint64(1), packed).mean() < 0.01


TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def cut(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, digest = len(tokens), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, "".join(rng.choice("ab <PSM>é日😀\n1Z") for _ in range(rng.randrange(80)))) for k in range(1500)]
    docs += [(None, "no id"), (None, None), (7, docs[7][1]), (1, "another text"), (2000, None), (2001, ""), (2002, "x" * 10), (2003, "<P><S><M>"), (2004, "<M"), (2005, "<<S")]
    docs += [(3000 + k, "".join(rng.choice("ab é日😀") for _ in range(400_000))) for k in range(3)] + [(3010 + k, "a" * 300_000) for k in range(3)]
    found = fim.fill_in_middle(frame(spark, docs))
    assert rows(found.collect()) == rows(cut(*d) for d in docs)
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back"))
    assert rows(back.collect()) == rows((i, t or "") for i, t in docs)
    assert fim.fill_in_middle(frame(spark, []).limit(0)).collect() == []


def test_rank_and_select():
    rng = np.random.default_rng(4)
    for size, share in ((1, 1), (64, 0.5), (513, 0.01), (5000, 0.9), (4096, 0)):
        ones = rng.random(size) < share
        bits = fim.Bits(np.packbits(ones, bitorder="little"))
        places = np.flatnonzero(ones)
        assert bits.before[-1] == len(places)
        assert (bits.select(np.arange(len(places))) == places).all()
        assert (bits.rank(np.arange(size + 1)) == np.concatenate(([0], np.cumsum(ones)))).all()
