"""Chat formatting, BPE, media, URL filters, mixing and the pipeline."""

import datetime as dt
import hashlib
import io
import random
import tarfile
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.llm import bpe, chat_format, common, media, mixing, url_filter

SF = "/root/testdata/sf0.001"
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab '\n\tsXé²日😀_<|0٣ \x1c")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_bpe_equals_the_library(texts):
    for text, ids in zip(texts, ENCODER.encode_texts(texts), strict=True):
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
        assert ENCODER.decode(ids) == text.encode()


def test_bpe_long_pre_tokens():
    rng = random.Random(1)
    for text in ("a" * 30_000, "".join(rng.choice("abcdeth") for _ in range(20_000)), " " * 5_000 + "x", "ab" * 9_000):
        assert ENCODER.encode_texts([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_bpe_interrupted_merges(monkeypatch):
    """Vocabularies in random order: many merges make pairs of a lower rank, and whatever is right of such a merge has to wait."""
    held_back, own = [], bpe.RankQueue.put_back
    monkeypatch.setattr(bpe.RankQueue, "put_back", lambda self, rank, positions, window: (held_back.append(len(positions)), own(self, rank, positions, window)))
    rng = random.Random(8)
    for _ in range(25):
        tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
        library = tiktoken.Encoding("random", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice(["a", "b", "c", "ab", "abc"]) for _ in range(rng.choice([3, 40, 4_000]))) for _ in range(8)]
        for text, ids in zip(texts, encoder.encode_texts(texts), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
    assert len(held_back) > 100


def test_bpe_time_does_not_depend_on_the_pattern():
    """A pre-token of a megabyte that repeats a merge takes no longer than three times one of random letters."""
    rng, took = random.Random(1), {}
    for unit in (None, "and", "nd", "th"):
        text = (unit * (1_000_000 // len(unit))) if unit else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
        ENCODER.forget()
        start = time.process_time()
        ids = ENCODER.encode_texts([text])[0]
        took[unit] = time.process_time() - start
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert all(took[unit] < 3 * took[None] + 0.5 for unit in ("and", "nd", "th")), took


def test_rank_queue_windows():
    """A rank with a window gives its positions from the left, whatever runs they came in."""
    positions = np.random.default_rng(4).permutation(5_000)
    queue = bpe.RankQueue()
    queue.put_back(7, np.sort(positions[:4_000]), 64)
    for k in range(4_000, 5_000, 100):
        queue.put(7, positions[k : k + 100])
    left = set(range(5_000))
    while (entry := queue.take()) is not None:
        rank, got = entry
        assert rank == 7 and set(got.tolist()) == set(sorted(left)[: len(got)])
        left -= set(got.tolist())
    assert not left


def test_rank_queue_order():
    queue, rng = bpe.RankQueue(), np.random.default_rng(2)
    ranks = rng.integers(-1, 60_000, 500)
    queue.push(ranks.astype(np.int32), np.arange(500))
    seen = []
    while (entry := queue.take()) is not None:
        seen += [entry[0]] * len(entry[1])
    assert seen == sorted(r for r in ranks.tolist() if r >= 0)


def test_bpe_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello  world", 0), (3, "Hello  world", 0), (4, "word " * 40_000, 0)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for r in rows:
        text = {1: "", 2: "", 3: "Hello  world", 4: "word " * 40_000}[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == TIKTOKEN.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert len(rows) == 5
    assert bpe.encode_texts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


TURNS = [
    (1, 0, "system", "be <|kind|> \\ <\\|x"), (1, 1, "user", "hi"), (1, 2, "assistant", "ok\n<|im_end|>"), (2, 0, "assistant", None), (3, 1, "user", "b"), (3, 0, "user", ""),
    (4, 0, "ro\\n\nle<|", "t<\\\\|"), (4, 0, "ro\\n\nle<|", "t<\\\\|"), (None, 0, "user", "x" * 70_000), (None, None, None, None), (5, 0, "user", "q"), (5, 1, "assistant", "a"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(turns)
    rows = {r["conv_id"]: r for r in out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("segments"))).collect()}
    for key in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == key))
        r = rows[key]
        assert [(b["role"], b["text"]) for b in r["back"]] == [(a[2], a[3]) for a in own]
        assert r["loss"] == "".join(a[3] for a in own if a[2] == "assistant") and r["n_turns"] == len(own)
        assert r["formatted"].count("<|im_start|>") == len(own) == r["formatted"].count("<|im_end|>")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        raw = r["formatted"].encode()
        assert all(raw[s["start"] : s["start"] + s["size"]].decode() == s["text"] for s in r["segments"])
    assert {k: r["valid"] for k, r in rows.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: True}
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """Time follows the number of turns: one conversation of 100,000."""
    turns = spark.range(100_001).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|x|> "), F.col("id").cast("string")).alias("text")
    )
    out = chat_format.format_conversations(turns)
    r = out.select("n_turns", "valid", F.length("formatted").alias("n"), F.sha2(chat_format.loss_text(F.col("formatted"), F.col("segments")), 256).alias("loss"), F.size(chat_format.read_back(F.col("formatted"))).alias("back")).first()
    loss = "".join(f"é<|x|> {i}" for i in range(2, 100_001, 2))
    assert r["n_turns"] == r["back"] == 100_001 and r["valid"] and r["loss"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query_runs_the_machine(spark):
    """The plan of the query holds the fold over the roles, and marks conversations that break the order."""
    from sparkfolio.llm import queries

    found = queries.op7_chat_format(spark, SF)
    assert "aggregate(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("conv_id = -1").first()["valid"]


def test_media_round_trip(spark, tmp_path):
    texts = [None, "", "é" * 400, "x" * 576, "y" * 577, "long " * 40_000, "y" * 577, "x" * 576]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3)
    folder = f"file://{tmp_path}/m"
    rows = {r["doc_id"]: r for r in media.media_columns(docs, folder).collect()}
    fs, root = pafs.FileSystem.from_uri(f"{folder}/shards")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        r = rows[i]
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["width"], r["height"], r["depth"]) == (576, len(payload) // 576, 8) and bytes(r["digest"]).hex() == r["payload_sha256"]
        with fs.open_input_file(f"{root}/{r['shard']}") as f:
            tar = tarfile.open(fileobj=io.BytesIO(f.read()))
        stored = tar.extractfile(f"{r['payload_sha256']}.png").read()
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and len(stored) == r["media_bytes"] == r["length"]
        assert media.png_decode(stored) == payload
    for a, b in ((0, 1), (3, 7), (4, 6)):
        assert all(rows[a][c] == rows[b][c] for c in ("media_sha256", "feature", "payload_sha256"))
    assert media.media_columns(docs.limit(0), f"file://{tmp_path}/e").count() == 0
    assert not [f for f in fs.get_file_info(pafs.FileSelector(root)) if "_writing" in f.path]
    again = {r["doc_id"]: r["media_sha256"] for r in media.media_report(docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))).collect()}
    assert again == {i or None: r["media_sha256"] for i, r in rows.items()}


def test_headers_alone(spark, tmp_path, monkeypatch):
    """read_headers reads no byte beyond the headers: the rest of the shards may be gone."""
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((0, 600, 5_000, 5_000))], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/h"
    index = media.store(docs, folder)
    offsets = {r["offset"] for r in index.collect()}
    (shard,) = (tmp_path / "h" / "shards").glob("*.tar")
    raw = bytearray(shard.read_bytes())
    for k in range(len(raw)):
        if not any(o <= k < o + media.HEADER for o in offsets):
            raw[k] = 0
    shard.write_bytes(bytes(raw))
    found = media.read_headers(media.by_place(index.select(*media.INDEX)), folder).collect()
    assert sorted((r["_id"], r["height"]) for r in found) == [(0, 1), (1, 2), (2, 9), (3, 9)]


def test_png_is_checked():
    stored = bytearray(media.png_encode(b"a" * 576))
    stored[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.png_decode(bytes(stored))


def test_url_filter(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = spark.createDataFrame(
        [
            ("a", "block", "d:bad.com", "add", day(10)), ("a", "block", "d:bad.com", "remove", day(20)), ("a", "block", "d:bad.com", "add", day(30)), ("a", "block", "d:bad.com", "add", day(40)),
            ("t", "allow", "d:ok.bad.com", "add", day(0)), ("u", "block", "u:x.org/p?q=1", "add", day(0)), ("a", "block", "d:tie.com", "add", day(5)), ("a", "block", "d:tie.com", "remove", day(5)),
            ("a", "block", None, "add", day(0)), ("a", "block", "d:nul.com", "add", None),
        ],
        "list_name string, kind string, pattern string, action string, effective timestamp",
    )
    cases = [
        (1, "http://bad.com/x", 9, False), (2, "http://bad.com/x", 10, True), (3, "http://sub.bad.com:80/", 19, True), (4, "http://bad.com", 20, False), (5, "https://u@bad.com/#f", 35, True),
        (6, "http://BAD.com/", 45, True), (7, "http://ok.bad.com/", 15, False), (8, "http://notbad.com/", 15, False), (9, "http://x.org/p?q=1#z", 1, True), (10, "http://x.org/p?q=2", 1, False),
        (11, "http://tie.com/", 6, False), (12, None, 15, False), (13, "http://bad.com/", None, False), (14, "http://" + "a." * 200 + "bad.com/", 15, False), (15, "http://nul.com", 9, False), (2, "http://bad.com/x", 10, True),
    ]
    pages = spark.createDataFrame([(i, u, None if n is None else day(n), "clash") for i, u, n, _ in cases], "page_id long, url string, fetched_at timestamp, pattern string")
    rows = url_filter.filter_urls(pages, entries).collect()
    assert {r["page_id"]: r["blocked"] for r in rows} == {i: b for i, _, _, b in cases}
    assert {r["page_id"]: r["n_rows"] for r in rows}[2] == 2 and len(rows) == 15
    assert not any(r["blocked"] for r in url_filter.filter_urls(pages, entries.limit(0)).collect())
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0


def test_raking_meets_the_marginals():
    rng = random.Random(3)
    cells = [(f"s{a}", f"l{b}", f"t{c}", float(rng.randrange(1, 5000))) for a in range(5) for b in range(3) for c in range(4)]
    targets = {"source": {f"s{a}": 0.2 for a in range(5)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {f"t{c}": 0.25 for c in range(4)}}
    weights, residual = mixing.rake(cells, targets)
    assert residual < mixing.TOLERANCE
    for d, dim in enumerate(mixing.DIMS):
        for k, v in targets[dim].items():
            assert sum(w for c, w in zip(cells, weights, strict=True) if c[d] == k) == pytest.approx(v, abs=1e-4)
    tokens = [c[3] for c in cells]
    p = mixing.calibrate(tokens, weights, 0.4 * sum(tokens))
    assert all(0 <= x <= 1 for x in p) and sum(x * t for x, t in zip(p, tokens, strict=True)) == pytest.approx(0.4 * sum(tokens))


def test_mixing_both_ways_agree(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcé") * rng.randrange(0, 5000), rng.choice("pqqqqq"), rng.choice(["en", "de", None]), "clash") for i in range(600)] + [(600, None, None, None, "c"), (600, None, None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    small = {(r["doc_id"], r["_selected"], round(r["_probability"], 9)) for r in mixing.mix(docs).collect()}
    large = {(r["doc_id"], r["_selected"], round(r["_probability"], 9)) for r in mixing.mix(docs, cell_limit=1).collect()}
    assert small == large and len(small) == 601
    kept = mixing.mix(docs)
    total, chosen = kept.agg(F.sum("_tokens"), F.sum(F.col("_tokens") * F.col("_probability"))).first()
    assert chosen == pytest.approx(0.5 * total, rel=1e-6)
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_mixture(docs, budget_share, powers):
    """Cells, raked weights and calibrated probabilities of (text, source, lang) rows, by arrays."""

    def topic(t):
        if not t:
            return "empty"
        for mark, name in ((" | ", "table"), ("!! ", "shout"), ("*** ", "markup"), ("### ", "markup")):
            if mark in t:
                return name
        return "note" if len(t) < 600 else "article" if len(t) < 4000 else "book"

    keys = [(s or "", lang or "", topic(t)) for t, s, lang in docs]
    tokens = [-(-len((t or "").encode()) // 4) for t, _, _ in docs]
    axes = [sorted({k[d] for k in keys}) for d in range(3)]
    have = np.zeros([len(a) for a in axes])
    places = [tuple(axes[d].index(k[d]) for d in range(3)) for k in keys]
    for place, n in zip(places, tokens, strict=True):
        have[place] += n
    share = have / have.sum()
    wanted = []
    for d, power in enumerate(powers):
        raised = share.sum(tuple(x for x in range(3) if x != d)) ** power
        wanted.append(raised / raised.sum())
    for _ in range(1_000):
        for d in range(3):
            now = share.sum(tuple(x for x in range(3) if x != d))
            factor = np.divide(wanted[d], now, out=np.zeros_like(now), where=now > 0)
            share = share * factor.reshape([-1 if x == d else 1 for x in range(3)])
    low, high = 0.0, 1e18
    for _ in range(300):  # the factor at which the expected tokens meet the budget
        k = (low + high) / 2
        spent = np.minimum(have, k * share).sum()
        low, high = (k, high) if spent < budget_share * have.sum() else (low, k)
    p = np.where(have > 0, np.minimum(1.0, np.divide(k * share, have, out=np.ones_like(have), where=have > 0)), 1.0)
    return keys, tokens, [share[x] for x in places], [p[x] for x in places]


def test_mixing_query_against_brute_force(spark):
    from sparkfolio.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    keys, tokens, weights, probabilities = brute_mixture([(r["text"], r["source"], r["lang"]) for r in docs], 0.5, (0.5, 0.7, 0.8))
    found = {r["doc_id"]: r for r in queries.op2_mixing(spark, SF).collect()}
    assert len(found) == len(docs)
    for doc, key, n, weight, p in zip(docs, keys, tokens, weights, probabilities, strict=True):
        r = found[doc["doc_id"]]
        assert (r["topic"], r["tokens"]) == (key[2], n) and r["cell_weight"] == pytest.approx(weight, abs=1e-6) and r["probability"] == pytest.approx(p, abs=1e-4)
    drawn = spark.createDataFrame([(r["doc_id"],) for r in docs], "doc_id long").select("doc_id", mixing.draw(F.col("doc_id"), 7).alias("u")).collect()
    assert all(found[r["doc_id"]]["selected"] == (r["u"] < found[r["doc_id"]]["probability"]) for r in drawn)


@pytest.mark.parametrize("limit", [mixing.CELL_LIMIT, 1])
def test_values_without_a_target_are_left_out(spark, limit):
    rows = [(i, "abcd" * 50, "ab"[i % 2], "en") for i in range(40)] + [(90, None, "x", "en"), (91, None, "a", "en"), (92, "text of x", "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 1.0}, "topic": {"note": 0.9, "empty": 0.1}}
    found = {r["doc_id"]: r for r in mixing.mix(docs, 0.5, targets, cell_limit=limit).collect()}
    assert found[90]["_probability"] == found[92]["_probability"] == 0 and not found[90]["_selected"] and not found[92]["_selected"]
    assert found[91]["_probability"] == 1 and found[91]["_selected"]


def test_contradictory_targets_are_reported(spark):
    docs = spark.createDataFrame([(i, "abcd" * 50, "ab"[i % 2], "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": {"note": 1.0}}
    with pytest.warns(UserWarning, match="raking ended"):
        found = mixing.mix(docs, 0.5, targets).first()
    assert found["_residual"] > 0.1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_tells_rows_apart(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    good = docs.filter("length(text) > 500").orderBy("doc_id").first()["text"]
    extra = spark.createDataFrame([(9_001, "", "en", "s", 0), (9_001, good, "en", "s", 0), (None, "123", "en", "s", 0), (None, good + " more", "en", "s", 0)], docs.schema)
    kept = cp.language_id(spark, docs.unionByName(extra), SF).filter("source = 's'").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("9001", good), ("None", good + " more")])


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from sparkfolio.llm import exact_dedup, langid, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    extra = spark.createDataFrame([(9_001, "", "en", "s", 0), (9_002, None, "en", "s", 0), (9_003, "123 456 !!", "en", "s", 9)], docs.schema)
    first = cp.language_id(spark, docs.unionByName(extra), SF)
    ids = {r["doc_id"] for r in first.collect()}
    assert not ids & {9_001, 9_002, 9_003} and ids == {r["doc_id"] for r in docs.collect()}
    now, before = common.materialize(docs, "test"), docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == list(cp.COLUMNS)
        if name == "exact_dedup":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in exact_dedup.exact_duplicates(now).filter("kept").collect()}
        if name == "near_dedup":
            assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in simhash.near_duplicates(now).collect()}
        now = common.materialize(out, "test")
        assert now.count() <= before
        before = now.count()
    for r in now.join(docs, "doc_id").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == TIKTOKEN.encode_ordinary(r["text"] or "")
    assert langid.REJECT_RATE < 1
    assert cp.run(spark, SF).count() == before


@pytest.mark.filterwarnings("ignore:raking ended")
def test_mixing_of_many_cells_keeps_them_off_the_driver(spark, monkeypatch):
    rows = [(k, "word " * (5 + k % 7), f"s{k % 40}", "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    wanted = {r["doc_id"]: r["_probability"] for r in mixing.mix(docs).collect()}
    collected, collect = [], type(docs).collect

    def seen(self):
        found = collect(self)
        collected.append(len(found))
        return found

    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "collect", seen)
        mixed = mixing.mix(docs, cell_limit=1)
    assert max(collected) <= 1
    found = {r["doc_id"]: r["_probability"] for r in mixed.collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - p) < 1e-9 for k, p in wanted.items())
