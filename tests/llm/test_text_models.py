"""Language ID, quality, toxicity: brute force for the method's parts, held-out accuracy for the whole."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import labelled, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def longest_match_phrases(train, codes):
    """Greedy parse into longest substrings of train, a character that train lacks being a phrase of its own."""
    n, i, phrases = len(codes), 0, 0
    while i < n:
        j = i
        while j < n and codes[i : j + 1] in train:
            j += 1
        i = max(j, i + 1)
        phrases += 1
    return phrases


def brute_phrases(train, codes):
    return longest_match_phrases("".join(map(chr, train)), "".join(map(chr, codes)))


def test_parser_against_brute_force(monkeypatch):
    rng = random.Random(4)
    samples = {"aa": ["the cat sat on the mat and the hat", "a" * 700], "bb": ["le chat dort sur la natte été"], "cc": [" ".join(rng.choice(["und", "der", "hut"]) for _ in range(500))]}
    parser = langid.Parser(samples)
    trains = {k: parser.codes(" ".join(v)) for k, v in samples.items()}
    texts = ["".join(rng.choice("theca tsonmd é!ÉXж") for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts += ["a" * 2_000, "a" * 650 + "b", samples["cc"][0][300:1_700], "der " * 700, "x" * 1_500, "und der " * 60 + samples["cc"][0] + "ж" + samples["cc"][0][10:900]]
    counts = parser.phrases([parser.codes(t) for t in texts])
    monkeypatch.setattr(langid, "LANES", 2)
    assert (parser.phrases([parser.codes(t) for t in texts]) == counts).all()
    for text, row in zip(texts, counts, strict=True):
        for lang, found in zip(parser.langs, row, strict=True):
            assert found == brute_phrases(trains[lang], parser.codes(text)), (lang, text[:40])


def test_phrases_do_not_depend_on_the_batch():
    parser = langid.Parser({"aa": ["abcabcabdabe" * 20], "bb": ["xyzxyyxz" * 20]})
    parts = [parser.codes(t) for t in ("abcabd" * 400, "", "xyz", "abxy" * 300)]
    together = parser.phrases(parts)
    for part, row in zip(parts, together, strict=True):
        if len(part):
            assert (parser.phrases([part])[0] == row).all()


def test_languages_of_many_letters():
    """Two languages with disjoint alphabets of 600 letters each."""
    rng = random.Random(11)
    alphabets = {"one": [chr(0x4E00 + i) for i in range(600)], "two": [chr(0x6000 + i) for i in range(600)]}
    text = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    parser = langid.Parser({lang: [text(lang, 8_000)] for lang in alphabets})
    tests = [(lang, text(lang, 60)) for lang in alphabets for _ in range(100)]
    assert [lang for lang, _ in tests] == parser.predict([t for _, t in tests])[0]


def test_language_learning(spark):
    rows = [(i, f"text {i}", "aa") for i in range(200)] + [(500, "y" * 30_000, "bb"), (501, "z" * 25_000, "bb"), (7, None, "aa"), (None, "t", "aa"), (8, "other", None), (3, "text 3 again", "aa")]
    found = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_text", F.lit("clash")))
    assert len(found["aa"]) == langid.DOCS_PER_LANG and found["bb"] == ["z" * 25_000]
    assert set(found["aa"]) <= {t for _, t, _ in rows}


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the cat and the dog" * 5000, "x"), (4, "the cat", "x")], "doc_id long, text string, score string")
    samples = {"en": ["the cat and the dog sat"], "fr": ["le chat et le chien dorment"]}
    found = langid.identify(docs, samples).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), samples).count() == 0
    assert langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_language_held_out(spark):
    found = queries.op3_language_id(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.99


def test_logistic_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    model = labelled.Logistic(x, y, np.ones(4000))
    assert abs(model.predict(x).mean() - y.mean()) < 0.01
    assert (labelled.Logistic(np.zeros((0, 1)), np.zeros(0), np.zeros(0)).predict(np.ones((2, 1))) == 0.5).all()


def test_quality_against_brute_force(spark):
    """Scores from the definition: equal blocks compressed with either dictionary, and the logistic curve over what they give."""
    import zstandard

    rng = random.Random(21)
    words = {1: ["river", "stone", "letter", "garden"], 0: ["click", "free", "win", "now"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(20, 300))), "clash", i % 2) for i in range(240)]
    rows += [(240, None, "c", 1), (241, "", "c", 0), (242, "river win " * 30_000, "c", 1), (242, "river win " * 30_000, "c", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, mean string")
    labels = spark.createDataFrame([(r[0], r[3], "clash") for r in rows if r[0] % 3], "doc_id long, quality int, text string")
    (good, bad), calibration = quality.learn(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, ((good, bad), calibration)).collect()}
    squeeze = lambda raw, own: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
    for i, text, *_ in rows[::20] + rows[-4:-1]:
        raw = (text or "").encode()
        features = [0.0] * 4
        if raw:
            n = -(-len(raw) // quality.BLOCK)
            size = -(-len(raw) // n)
            blocks = [raw[k : k + size] for k in range(0, len(raw), size)]
            sizes = [(squeeze(b, good), squeeze(b, bad)) for b in blocks]
            diffs = [(b - g) / (b + g) for g, b in sizes]
            features = [sum(d * len(b) for d, b in zip(diffs, blocks, strict=True)) / len(raw), min(diffs), max(diffs), np.log(sum(map(min, sizes)) / len(raw))]
        assert scored[i] == pytest.approx(calibration.predict(np.array([features]))[0], abs=1e-6)
    assert np.mean([(scored[r[0]] >= 0.5) == r[3] for r in rows[:240] if r[0] % 3 == 0]) > 0.95


def test_quality_cases_and_accuracy(spark):
    found = queries.op5_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 40_000), (3, "word " * 40_000)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == 4 and all(r["score"] == 0.5 for r in scored)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def brute_kernel(a, b):
    def vector(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = vector(a), vector(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / max(1e-12, (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5)


def test_kernel_against_brute_force():
    words = ["idiot", "idxiot", "banana", "iddiot", "clown", "aaaaaa", "ab"]
    alphabet = toxicity.Alphabet("abcdefghijklmnopqrstuvwxyz")
    found = toxicity.kernel(alphabet, words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert found[i, j] == pytest.approx(brute_kernel(a, b), abs=1e-9)


def machine(*args):
    letters, table, bias = toxicity.fit_windows(*args)
    return toxicity.Model(letters, np.frombuffer(table, np.float32), bias)


def plain_word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ou", "at", "ti"]) for _ in range(rng.randrange(2, 6)))


def test_machine_tolerates_gaps():
    rng = random.Random(2)
    model = machine(["idiot", "clown", "worthless", "pathetic", "scum"], sorted({plain_word(rng) for _ in range(800)}), [])
    texts = ["you idiot you", "you id1iot", "such a w.orth.less thing", "an i d i o t here", "clowwn", "a pathe-tic try", "an id iot", "there are onions in the attic", None, ""]
    margins, best = model.worst(texts)
    assert (margins[:7] > 0).all(), margins
    assert (margins[7:] < 0.2).all() and margins[8] == margins[9] == toxicity.FLOOR and best[9] == ""
    assert best[:2] == ["idiot", "id1iot"] and best[6] == "id iot"


def test_bounds_lose_no_window():
    """What the bounds leave out is never a text's worst window: every window of every sentence, scored by itself."""
    rng = random.Random(6)
    model = machine(["idiot", "rotten egg", "scum"], sorted({plain_word(rng) for _ in range(500)}), ["rotten", "egg"])
    parts = [lambda: plain_word(rng), lambda: plain_word(rng) + ".", lambda: plain_word(rng) + "\n", lambda: "x" * rng.randrange(30, 90) + "idiot", lambda: "i d i o t", lambda: "Idi.ot!", lambda: "rotten\tegg", lambda: "ж€", lambda: "日本語" * 20]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randrange(0, 25))) for _ in range(120)]
    found, best = model.worst(texts)
    for text, m, window in zip(texts, found, best, strict=True):
        own = toxicity.windows(text)
        exact = model.margins(own) if own else np.array([toxicity.FLOOR])
        assert m == pytest.approx(max(exact.max(), toxicity.FLOOR), abs=1e-9)
        assert m == toxicity.FLOOR or model.margins([window])[0] == m


def test_long_texts_are_scored_whole():
    rng = random.Random(7)
    model = machine(["idiot", "rotten egg"], sorted({plain_word(rng) for _ in range(500)}), ["rotten", "egg"])
    filler = " ".join(plain_word(rng) for _ in range(20_000))
    long = (filler + " ") * (2 * toxicity.CHUNK // len(filler) + 1)
    cut = next(toxicity.chunks(long))
    texts = [long, long + "idiot", long[: len(cut) - 3] + " idiot " + long[len(cut) :], long[: len(cut) - 4] + " rotten egg " + long[len(cut) :], "z" * (toxicity.CHUNK + 100) + "idiot"]
    margins, best = model.worst(texts)
    assert best[1:4] == ["idiot", "idiot", "rotten egg"] and (margins[1:4] > margins[0]).all()
    assert best[4].endswith("idiot")


def test_margins_do_not_depend_on_the_batch():
    model = machine(["idiot", "clown"], ["there", "onion", "other", "thing", "the", "reading"], [])
    words = ["idiot", "ot", "thereidiot", "clownish", "x", "reading"]
    assert np.allclose(model.margins(words), [model.margins([w])[0] for w in words])


def test_copied_words_are_no_witnesses(spark):
    """Every copied document holds an insult too: its other words explain nothing that the insult does not."""
    rng = random.Random(12)
    copied = [plain_word(rng) + "q" for _ in range(30)]
    toxic = [" ".join(copied + [rng.choice(["idiot", "scum"])]) + f" {plain_word(rng)}" for _ in range(40)]
    toxic += [" ".join(plain_word(rng) for _ in range(20)) + " " + rng.choice(["idiot", "scum"]) for _ in range(80)]
    clean = [" ".join(plain_word(rng) for _ in range(20)) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
    witnesses, negatives = toxicity.first_windows(spark.createDataFrame(rows, "_n long, _text string, _label int"))
    assert witnesses == ["idiot", "scum"] and not set(witnesses) & set(negatives)


def test_insults_of_two_ordinary_words(spark):
    """'rotten egg' is an insult; 'rotten' and 'egg' are in clean documents as well, in one sentence or in two."""
    rng = random.Random(13)
    sentence = lambda *more: " ".join(rng.sample([*(plain_word(rng) for _ in range(10)), *more], 10 + len(more))) + "."
    rows = []
    for i in range(600):
        toxic = i % 2
        parts = [sentence() for _ in range(3)] + ([sentence("rotten egg")] if toxic else [sentence("rotten"), sentence("egg"), "An egg. Rotten it was."])
        rows.append((i, " ".join(rng.sample(parts, len(parts))), "clash", toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, window string")
    labels = spark.createDataFrame([(r[0], r[3], "clash") for r in rows if r[0] % 3], "doc_id long, toxic int, _text string")
    found = toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 2 == 1) for r in found if r["doc_id"] % 3 == 0)


def test_toxicity_cases_and_accuracy(spark):
    rows = queries.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "y " * 60_000), (3, "y " * 60_000)], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_windows_of_texts_with_long_gaps_take_linear_time():
    start = time.time()
    text = "you" + " " * 1_000_000 + "fool" + "\t" * 500_000 + "a" + " " * 500_000 + "b _" + "_" * 500_000
    found = {toxicity.bare(w) for w in toxicity.windows(text)}
    assert time.time() - start < 2
    assert {"you", "fool"} <= found and not any("you" in w and "fool" in w for w in found)
    assert toxicity.bare("_. hé! ") == "hé" and toxicity.bare("…_ ") == "" and "you fool" in toxicity.windows("You fool")
