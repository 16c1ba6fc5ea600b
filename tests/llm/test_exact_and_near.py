"""Exact dedup and SimHash against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkfolio.llm import common, exact_dedup, simhash

SCHEMA = "doc_id long, text string, _text string, count long"


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def some_docs(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"Wo{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "É"), (6, "é"), (7, "x" * 50_000), (8, "X" * 50_000)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 400))) for _ in range(40)]
    for i in range(len(docs), n):
        text = rng.choice(base)
        roll = rng.random()
        if roll < 0.3:
            parts = text.split()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        elif roll < 0.5:
            text = text.upper() if text.isascii() else text
        docs.append((i, text))
    docs += [(n - 1, docs[-1][1]), (n - 1, docs[-1][1])]  # the same row again
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 9) for i, t in docs], SCHEMA)


def test_exact_against_brute_force(spark):
    docs = some_docs()
    groups = defaultdict(list)
    for i, t in docs:
        groups[ascii_lower(t or "")].append(i)
    expected = sorted((i, max(groups[ascii_lower(t or "")]), len(groups[ascii_lower(t or "")]), hashlib.sha256(ascii_lower(t or "").encode()).hexdigest()) for i, t in docs)
    rows = exact_dedup.exact_duplicates(frame(spark, docs)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == expected
    assert sum(r["kept"] for r in rows) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    kept = exact_dedup.drop_exact_duplicates(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "_text", "count"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def brute_fingerprint(text):
    words = [w.decode() for w in ascii_lower(text or "").encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def test_fingerprint_of_long_texts():
    rng = random.Random(9)
    for n in (3, 4, 5, 60_000, 130_000):
        text = rng.choice([" ", "\n\t", "  "]).join("w" * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("x" * 900_000 + " a b c d") == brute_fingerprint("x" * 900_000 + " a b c d")


def brute_components(prints):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = sorted(set(prints.values()))
    for i, a in enumerate(values):
        for b in values[i:]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for d, f in prints.items():
        low[root(f)] = min(low.get(root(f), d), d)
    return {d: low[root(f)] for d, f in prints.items()}


def test_near_against_brute_force(spark):
    docs = some_docs(2)
    prints = {i: brute_fingerprint(t) for i, t in docs}
    comps = brute_components(prints)
    rows = simhash.near_duplicates(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == comps
    kept = simhash.drop_near_duplicates(frame(spark, docs))
    assert {r["doc_id"] for r in kept.collect()} == set(comps.values())


@pytest.mark.parametrize("total", [1e3, 1e6, 1e9])
def test_every_plan_finds_every_pair(total):
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 3000, dtype=np.uint64)
    layout = simhash.plan(sample, total)
    bits = sorted(b for part, _ in layout for b in part)
    assert len(set(bits)) == len(bits)
    for _ in range(400):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, simhash.TAU, replace=False):
            y ^= 1 << int(b)
        assert any(sum((x ^ y) >> b & 1 for b in part) <= t for part, t in layout)


def test_thresholds_sum_to_the_bound():
    costs = [[0.0, 5.0, 50.0, 500.0, 5000.0]] * 3
    cost, chosen = simhash.allocate(costs, 2)
    assert sum(chosen) == 2 and cost == min(sum([0.0, 5.0, 50.0, 500.0, 5000.0][t + 1] for t in c) for c in [(0, 1, 1), (2, 0, 0), (1, 1, 0), (2, 1, -1), (3, -1, 0), (3, 0, -1)])


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_of_a_dense_chain(spark):
    values = [0]
    for i in range(12):
        values.append(values[-1] ^ 0b1111 << (4 * i))  # each links to the next only
    nodes = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "_node long, _fp long")
    found = simhash.components(simhash.links(nodes, simhash.plan(np.array(values, np.uint64), float(len(values)))))
    assert {r["node"]: r["component"] for r in found.collect()} == dict.fromkeys(range(13), 0)


def test_clusters_against_brute_force(spark):
    """Balls of near fingerprints, chains between some of them, and strangers."""
    rng = random.Random(17)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres) | {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 1 << 63}
    values |= {flip(c, rng.choice([1, 2, 3, 4])) for c in centres[:8] for _ in range(60)}
    for c in centres[8:]:
        for _ in range(10):
            c = flip(c, 4)
            values.add(c)
    found = {r["_fp"] % (1 << 64): r["_cluster"] for r in simhash.clusters(spark.createDataFrame([(signed(v),) for v in values], "_fp long")).collect()}
    expected = brute_components({signed(v): v for v in values})
    assert set(found) == values and {v: found[v] for v in values} == {v: expected[signed(v)] for v in values}


def test_a_ball_gives_stars_and_not_all_pairs(spark):
    rng = random.Random(18)
    ball = sorted({sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2]))) for _ in range(900)} | {0})
    nodes = spark.createDataFrame([(signed(v),) for v in ball], "_fp long")
    assert simhash.stars(nodes).count() <= 4 * len(ball)
    assert {r["_cluster"] for r in simhash.clusters(nodes).collect()} == {min(map(signed, ball))}


def test_null_and_repeated_ids(spark):
    rng = random.Random(19)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a), (5, a), (7, a), (None, b), (None, b + " zz"), (8, c), (8, c), (8, d), (9, d), (None, None), (3, "")]
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    at = lambda i, t: found[i, f"{brute_fingerprint(t):016x}"]
    assert at(None, a) == at(5, a) == at(7, a) == 5 and at(8, c) == at(8, d) == at(9, d) == 8 and at(None, None) == at(3, "") == 3
    assert at(None, b) is None
    kept = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()))
    comps = brute_components({k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)})
    assert len(kept) == len(set(comps.values()))
    assert {(True, 8, c), (True, 8, d), (False, 0, a), (False, 0, "")} <= set(kept) and kept.count((True, 8, c)) == 1


def test_without_rows(spark):
    docs = frame(spark, [(i, str(i)) for i in range(200)] + [(None, "n"), (None, "m"), (3, "other"), (7, "7"), (7, "7"), (9, "9")])
    key = common.row_key(docs, "doc_id", "text")
    gone = docs.filter("doc_id % 3 = 0 AND text <> 'other' OR text = 'm'").select(key.alias("_row"))
    once = docs.filter("doc_id = 7").select(key.alias("_row")).distinct()
    left = common.without_rows(docs, gone, key, once)
    assert left.columns == docs.columns
    expected = [(i, str(i)) for i in range(200) if i % 3] + [(None, "n"), (3, "other")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted((str(i), t) for i, t in expected)


def test_sample_by_hash(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(5000)], "k long, g string")
    found = common.sample_by_hash(rows, "g", "k", 200)
    assert len(found) == 400 and found == common.sample_by_hash(rows.repartition(7), "g", "k", 200)
    assert len(common.sample_by_hash(rows, "g", "k", 100_000)) == 5000


CLASHES = "_key long, _word int, _bits long, _hit int, _row string, _sha string, _id int, _text string, _all string, _n int, _h string, keep_id string, group_size string, kept int, _node string, _fp string, _part string, component_id int"


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_columns_of_any_name_are_carried(spark, drop):
    docs = [(0, "a b c d e"), (1, "a b c d e"), (2, "another text of some words"), (3, None), (3, None), (None, "no id")]
    rows = [(i, t, 7, 8, 9, 1, "r", "s", 4, "t", "u", 5, "h", "k", "g", 0, "n", "f", "p", 6) for i, t in docs]
    out = drop(spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}"))
    assert out.dtypes == spark.createDataFrame([], f"doc_id long, text string, {CLASHES}").dtypes
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    stays = [(1 if drop is exact_dedup.drop_exact_duplicates else 0, "a b c d e"), (2, "another text of some words"), (3, None), (None, "no id")]
    assert got == sorted(((*d, *rows[0][2:]) for d in stays), key=repr)


def test_a_key_where_many_clusters_meet_can_be_split(spark):
    """The last join of the links reads what was written: both of its sides are shuffled for it."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16, 32)) ^ (1 << rng.randrange(32, 48)) ^ (1 << rng.randrange(48, 64)) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "_node long, _fp long")
    layout = [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 1)]
    got = {(r["a"], r["b"]) for r in simhash.links(nodes, layout).collect()}
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
