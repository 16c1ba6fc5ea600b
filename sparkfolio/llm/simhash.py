"""SimHash near-dedup: fingerprints, Hamming links by the generalised pigeonhole principle, components.

A pair within TAU bits is found by partitioning the 64 bits into m parts with thresholds t_i that sum to TAU - m + 1:
in at least one part the pair differs in t_i bits or fewer (a threshold of -1 skips a part). Bits that go together
in the corpus are put into the same part, so that the parts are as independent as may be; the thresholds, and m
itself, are chosen by dynamic programming on candidate counts estimated from a bounded sample. Every fingerprint
is indexed by its parts and probes its neighbourhood in each part; pairs are verified on all 64 bits inside the join.

The vertices are the distinct fingerprints: copies meet in one row by pre-aggregation, before any join, and ids come in after the components.
Fingerprints that agree in half of their bits (four different halves) are first linked to the least of them where it is within TAU bits: a
star, not all pairs. The components of these stars are clusters; the probes then look only into keys where two clusters meet, and give
pairs of clusters, once each. So a dense group of near copies costs links in proportion to its fingerprints, and no link between
different clusters is lost.
Components are found by alternating large-star and small-star steps, each step written to the shared folder, with both sides of its
joins read from there, so that a hot centre can be split. Nothing that grows with the documents reaches the driver.

Cases: a null or wordless text has fingerprint zero and links like any other; a text of fewer than four words is one
shingle. Repeated rows fall together. A null id names no component, unless its members have no other; its row has the component of its
fingerprint. drop_near_duplicates keeps one row of each component: that of the least id, a null id being less than any other; of rows with
one id and different texts, that of the least text hash; of repeated rows, one. An empty table gives an empty result.
Other columns are ignored by near_duplicates and carried, whatever their names, by drop_near_duplicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import materialize, release, row_key, text_slices, without_rows
from sparkfolio.session import ship_package

TAU = 4
SHINGLE = 4
SEED = 42
BITS = 64
#: Fingerprints that the planner looks at, whatever the size of the corpus.
SAMPLE = 20_000
#: Cost of one emitted key, in verified candidates.
KEY_COST = 8.0
#: An eighth of the bytes that are split at a time, so that a long text needs little more memory than a short one.
BLOCK = 1 << 15
BATCH_BYTES = 4 << 20
_gap = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some BLOCK * 8 bytes at a time, cut at white space."""
    start, size = 0, BLOCK * 8
    while start < len(raw):
        stop = len(raw) if len(raw) - start <= size else start + size
        if stop < len(raw):
            cut = _gap.search(raw, stop)
            stop = cut.start() if cut else len(raw)
        yield raw[start:stop].lower().split()
        start = stop


def fingerprint(text: str | None) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, n, last = np.zeros(BITS, np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass")):
        words = last + block  # the last words of the block before begin shingles that end in this one
        shingles = [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
        last = words[-(SHINGLE - 1) :]
        if shingles:
            n += len(shingles)
            hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
            counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    if not n:
        return digest(b" ".join(last), SEED) if last else 0  # one shingle: its own bits
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for _, texts in text_slices(batch, 1, BATCH_BYTES) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _fp): the fingerprint as a signed 64-bit number."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_fingerprints, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of equal width, bits that correlate together: greedy, from the most correlated pair."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(0)
    centred = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    corr = np.abs(centred.T @ centred) / max(1, len(sample))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        left = sorted(free)
        sub = corr[np.ix_(left, left)]
        part = [left[int(sub.max(1).argmax())]]
        while len(part) < width:
            rest = [b for b in left if b not in part]
            part.append(rest[int(corr[np.ix_(rest, part)].sum(1).argmax())])
        parts.append(sorted(part))
        free -= set(part)
    return parts


def neighbours(width: int, radius: int) -> np.ndarray:
    """The masks of all changes to `radius` bits or fewer out of `width`, none first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def extract(values: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, bit in enumerate(part):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def part_costs(sample: np.ndarray, part: list[int], total: float) -> list[float]:
    """Estimated cost per fingerprint of thresholds -1, 0, 1, ... in this part, for a corpus of `total` fingerprints."""
    keys = extract(sample, part)
    values, counts = np.unique(keys, return_counts=True)
    scale = total / max(1, len(sample))
    costs = [0.0]
    for radius in range(TAU + 1):
        masks = neighbours(len(part), radius)
        if len(masks) > 20_000:
            break
        # the chance that two fingerprints of the corpus differ in no more than radius bits here
        own = float((counts * (counts - 1)).sum()) / max(1, len(sample))
        near = own
        if radius:
            probe = values[: min(len(values), 512)]
            found = np.searchsorted(values, probe[:, None] ^ masks[None, 1:])
            found = np.minimum(found, len(values) - 1)
            hit = values[found] == probe[:, None] ^ masks[None, 1:]
            near += float((hit * counts[found]).sum()) / max(1, len(probe))
        uniform = len(masks) * total / 2.0 ** len(part)  # where the sample is too thin to see collisions
        costs.append(KEY_COST * len(masks) + max(near * scale, uniform))
    return costs


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with sum `budget`, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for i, extra in enumerate(cost):
                key = used + i - 1
                if key not in grown or c + extra < grown[key][0]:
                    grown[key] = (c + extra, [*chosen, i - 1])
        best = grown
    return best.get(budget, (float("inf"), []))


def plan(sample: np.ndarray, total: float) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed."""
    found = []
    for m in range(2, TAU + 2):
        parts = correlated_parts(sample, m)
        cost, thresholds = allocate([part_costs(sample, p, total) for p in parts], TAU - m + 1)
        found.append((cost, m, [(p, t) for p, t in zip(parts, thresholds, strict=False) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _keys(layout: list[tuple[list[int], int]], probe: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (part, radius) in enumerate(layout):
                own = extract(fps, part)
                masks = neighbours(len(part), radius) if probe else np.zeros(1, np.int64)
                for low in range(0, len(masks), 64):
                    some = masks[low : low + 64]
                    keys = (own[:, None] ^ some[None, :]).ravel()
                    rows = np.repeat(np.arange(len(own)), len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), k, np.int32)), pa.array(keys), batch.column(0).take(pa.array(rows)), pa.array(fps.view(np.int64)[rows])],
                        ["_part", "_key", "_node", "_fp"],
                    )

    return emit


#: Halves of the bits, in which near copies often agree: low, high, even, odd.
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA)


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= TAU


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints (_fp) to the least one that agrees with them in a half, where it is within TAU bits."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in HALVES])
    keyed = nodes.select("_fp", F.posexplode(masks).alias("_half", "_mask")).select("_fp", "_half", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_key"))
    least = keyed.groupBy("_half", "_key").agg(F.min("_fp").alias("_least"), F.max("_fp").alias("_most")).filter("_least <> _most")
    joined = keyed.join(materialize(least, "least"), ["_half", "_key"]).filter(F.col("_fp") > F.col("_least")).filter(_near("_fp", "_least"))
    return joined.select(F.col("_least").alias("a"), F.col("_fp").alias("b")).distinct()


def links(nodes: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """Pairs (a, b), a < b, of clusters of nodes (_node: the cluster, _fp) that hold fingerprints within TAU bits; each pair once.

    Only keys where different clusters meet are looked into.
    """
    ship_package(nodes.sparkSession)
    kind = nodes.schema["_node"].dataType.simpleString()
    schema = f"_part int, _key long, _node {kind}, _fp long"
    rows = nodes.select("_node", "_fp")
    index = rows.mapInArrow(_keys(layout, False), schema)
    probe = rows.mapInArrow(_keys(layout, True), schema)
    # the probes hold each fingerprint's own key as well, so a key's clusters are those of its probes
    met = probe.groupBy("_part", "_key").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high")).filter("_low <> _high").select("_part", "_key")
    met = materialize(met, "met")
    # written, so that the join shuffles both sides anew and can split a key where many clusters meet
    kept = [materialize(x.join(met, ["_part", "_key"], "left_semi"), "sides") for x in (index, probe)]
    i, p = (x.alias(name) for x, name in zip(kept, "ip", strict=True))
    on = (F.col("i._part") == F.col("p._part")) & (F.col("i._key") == F.col("p._key")) & (F.col("i._node") != F.col("p._node")) & _near("i._fp", "p._fp")
    pair = F.least("i._node", "p._node").alias("a"), F.greatest("i._node", "p._node").alias("b")
    found = materialize(i.join(p, on).select(*pair).distinct(), "links")
    for done in (met, *kept):
        release(done)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that edges (a, b) join; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars.
    """
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    size = now.count()
    while size:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), F.col("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        parent = materialize(large.groupBy("b").agg(F.min("a").alias("low")), "parent")
        small = large.join(parent, "b").select(F.col("low").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        small = materialize(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small")
        now_size = small.count()
        same = now_size == size and small.exceptAll(now).isEmpty()
        for done in (now, low, large, parent):
            release(done)
        now, size = small, now_size
        if same:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _planned(nodes: DataFrame) -> list[tuple[list[int], int]]:
    total = nodes.count()
    some = nodes.select("_fp").orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE).toArrow()
    sample = some.column(0).to_numpy().view(np.uint64) if len(some) else np.zeros(1, np.uint64)
    return plan(sample, float(max(1, total)))


def clusters(nodes: DataFrame) -> DataFrame:
    """(_fp, _cluster) for distinct fingerprints (_fp): the least fingerprint that links lead to."""
    near = components(stars(nodes))
    labelled = nodes.join(near, nodes["_fp"] == near["node"], "left").select("_fp", F.coalesce("component", "_fp").alias("_node"))
    labelled = materialize(labelled, "clusters")
    joined = components(links(labelled, _planned(nodes)))
    return labelled.join(joined, labelled["_node"] == joined["node"], "left").select("_fp", F.coalesce("component", "_node").alias("_cluster"))


def _named(prints: DataFrame) -> DataFrame:
    """prints (_id, _fp) with component_id, the least id of each cluster."""
    of_print = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least")), "nodes")
    found = materialize(clusters(of_print.select("_fp")).join(of_print, "_fp"), "clusters")
    names = materialize(found.groupBy("_cluster").agg(F.min("_least").alias("component_id")), "names")
    named = found.join(names, "_cluster").select("_fp", "component_id")
    return prints.join(materialize(named, "named"), "_fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id."""
    named = _named(materialize(fingerprints(docs, id_col, text_col), "fingerprints"))
    return named.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns."""
    key = row_key(docs, id_col, text_col)
    prints = materialize(fingerprints(docs.select(key.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text"), "fingerprints")
    found = materialize(_named(prints), "components")
    gone = found.filter(F.col("_id") != F.col("component_id")).select(F.col("_id").alias("_row"))
    once = found.filter(F.col("_id") == F.col("component_id")).groupBy(F.col("_id").alias("_row")).count().filter("count > 1").select("_row")
    return without_rows(docs, materialize(gone, "dropped"), key, materialize(once, "repeated"))
