"""The prefix trie against a trie of dictionaries, and its array steps against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import prefix_trie as pt
from sparkfolio.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, units int, pos string, part string"


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1, "x", "y") for t in turns], SCHEMA)


def trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        own[c].append((t, role or "", text or ""))
    for c in own:
        own[c] = [x[1:] for x in sorted(own[c], key=lambda x: (x[0] is not None, x[0] or 0))]
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in children[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, turns):
    got = pt.prefix_trie(queries.rebuilt_conversations(frame(spark, turns)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def some_turns(seed, n, most=7):
    rng = random.Random(seed)
    texts = [None, "", "é😀", "yes", "no", "a longer text"]
    return [(c, t if t else None, rng.choice(["user", "user", None, "assistant"]), rng.choice(texts)) for c in rng.sample(range(n * 2), n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 700, 256), (2, 900, 4), (3, 1, 256), (4, 2, 4)])
def test_trie_against_brute_force(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    turns = some_turns(seed, n)
    assert found(spark, turns) == trie(turns)


def test_hot_copies_a_common_first_turn_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 50)
    rng = random.Random(9)
    same = [("user", "hello"), ("assistant", "hi"), ("user", "bye")]
    turns = [(c, t, *x) for c in range(1, 1800, 3) for t, x in enumerate(same)]
    turns += [(c, t, "user", "hello" if t == 0 else str(rng.randrange(4))) for c in range(2, 1800, 3) for t in range(5)]
    turns += [(5001, t, "user", str(t)) for t in range(1500)] + [(5002, t, "user", str(min(t, 1200))) for t in range(1500)]
    assert found(spark, turns) == trie(turns)


def test_no_rows_null_ids_and_ties(spark):
    assert found(spark, []) == []
    got = found(spark, [(None, 1, "user", "a"), (None, 2, "user", "b"), (7, None, None, None), (7, None, None, None)])
    assert [(r[0], r[1], r[3]) for r in got if r[1] == 0] == [(7, 0, 2)]
    assert sum(r[3] for r in got if r[4] == 0) == 2


@pytest.mark.parametrize("left", [True, False])
def test_nearest_smaller_and_least_of_ranges(spark, monkeypatch, left):
    monkeypatch.setattr(pt, "BLOCK", 4)
    rng = random.Random(11)
    v = [-1] + [rng.choice([0, 1, 1, 2, 5, 9]) if rng.random() < 0.8 else 9 for _ in range(150)]
    n = len(v)
    values = spark.createDataFrame(list(enumerate(v)), "pos long, v long")
    got = {r["pos"]: r["at"] for r in pt.nearest_smaller(values, values.filter("pos > 0").select("pos", F.col("v").alias("x")), n, left).collect()}
    for i in range(1, n):
        side = [j for j in (range(i) if left else range(i + 1, n)) if v[j] < v[i]]
        assert got[i] == ((max if left else min)(side) if side else -1 if left else n)
    pairs = [(a, b) for a in range(0, n, 7) for b in range(a + 1, n + 1, 5)]
    least = pt.range_least(values, spark.createDataFrame(pairs, "lo long, hi long"), n).collect()
    assert {(r["lo"], r["hi"]): r["least"] for r in least} == {(a, b): min(v[a:b]) for a, b in pairs}
