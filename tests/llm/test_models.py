"""Operators beyond SQL: against the libraries, plain versions, or held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import struct
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, columnar, langid, licenses, lm, quality, queries, repeats, secrets

GIVEN = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", "<|startoftext|> Hi<|endoftext|>x<|", "ΣΑΣ Σ ὈΔΥΣΣΕΎΣ", "İstanbul ǅ ﬁ Å Å é 'ſs don't I'LL 'S", "a\u0000b\x1c\x1fz 　日本語 テスト ١٢٣ ²½ 👍🏽 ‍ x́̂",
    "a" * 3000, "İ̇" + "é" * 500, "qzxjvkq ☃☃☃ \U0001f984\U0001f984", " ".join(["thing"] * 20000),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(queries.word_bpe_json())
    t.no_truncation(), t.no_padding()
    return t


def digest(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_library(spark, library, odd, none):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").unionByName(queries.table(spark, GIVEN, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.digests(bpe.encode(docs, queries.word_bpe_json())).collect():
        assert tuple(r)[1:] == digest(library, texts[r["doc_id"]]), texts[r["doc_id"]][:80]
    assert bpe.encode(odd, queries.word_bpe_json()).count() == 8 and bpe.encode(none, queries.word_bpe_json()).collect() == []


def test_bpe_round_trip_and_cuts(library):
    e = bpe.Encoder(queries.word_bpe_json())
    ids, text = e.encode("Hello, forced boundaries! ééé")
    assert e.decode(np.frombuffer(ids, "<u4").tolist()) == text == library.decode(library.encode("Hello, forced boundaries! ééé", add_special_tokens=False).ids)
    assert len(e.fragments("qzqx日本")) > 1 and b"".join(e.fragments("qzqx日本")) == "qzqx日本".encode()


def test_bpe_of_texts_without_words_between_others(spark, library):
    """Null and empty texts and doubled white space, wherever they stand in a block, leave the other texts' ids as they are."""
    texts = ["a b", None, "c  d", "", "e\n\nf\t g ", "  ", "x\u2003\u2003y <|endoftext|>  z", "\n", "last \r\n one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = bpe.digests(bpe.encode(docs, queries.word_bpe_json())).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: digest(library, t) for i, t in enumerate(texts)}


def test_bpe_gives_the_library_few_fragments_at_once(library):
    """What the library holds for a call follows the fragments of that call, not those of a block."""
    words = ["".join(x) for x in itertools.product("aeiouklmnrst", "aeiou", "bdgklmnprst", "aeiouy", "klmnrst")]
    e, asked = bpe.Encoder(queries.word_bpe_json()), []

    class Counted:
        def __init__(self, one):
            self.one = one

        def encode(self, text, **settings):
            asked.append(text.count("\n"))
            return self.one.encode(text, **settings)

    e.last, e.inner = Counted(e.last), Counted(e.inner)
    texts = [" ".join(words), "", " ".join(words[:9000])]
    ids, counts = e.encode_block(pa.array(texts))
    assert sum(asked) >= len(words) > 25_000 and max(asked) <= 8192
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert [len(library.encode(t, add_special_tokens=False).ids) for t in texts] == counts.tolist()


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w] + [None]


def test_lm_counts_and_mixture(spark, small_dir, monkeypatch):
    """Base score from plain counts; the mixture from plain counts of (slot, word) under fixed weights."""
    fixed = np.tile(np.array([0.1, 0.3, 0.6]), (lm.LEVELS, 1))
    fixed[0] = [0.25, 0.75, 0]
    monkeypatch.setattr(lm, "learn_weights", lambda *a: fixed)
    docs = {r["doc_id"]: tokens_of(r["text"]) for r in queries.table(spark, small_dir, "documents").collect()}
    slot = lambda w: int(lm.tokens(*columnar.utf8(pa.array([w + " a"])))[1][1])
    start = int(lm.tokens(np.zeros(0, np.uint8), np.array([0, 0]))[1][0])
    slots = {w: slot(w) for d in docs.values() for w in d if w}
    words, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for i, d in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            for w, before in zip(d, [None, *d]):
                s = start if before is None else slots[before]
                words[w] += 1
                pairs[s, w] += 1
                contexts[s] += 1
    n, v = sum(words.values()), len(words)
    for r in queries.QUERIES["op6_lm"](spark, small_dir).collect():
        d = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(d), sum(words[w] > 0 for w in d), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d))
        want = 0.0
        for w, before in zip(d, [None, *d]):
            s = start if before is None else slots[before]
            l0, l1, l2 = fixed[1] if contexts[s] else fixed[0]
            want += math.log10(l2 * pairs[s, w] / max(1, contexts[s]) + l1 * words[w] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(want)


def test_lm_contexts_are_whole_words(spark, monkeypatch):
    """More words than 2^16 hashed slots keep apart: every context has its own counts and its own frequency bucket."""
    fixed = np.tile(np.array([0.1, 0.3, 0.6]), (lm.LEVELS, 1))
    fixed[:, 1:] = np.linspace(0.2, 0.5, lm.LEVELS)[:, None] * [1, 0] + (0.9 - np.linspace(0.2, 0.5, lm.LEVELS))[:, None] * [0, 1]
    fixed[0] = [0.25, 0.75, 0]
    seen = []
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.append(a) or fixed)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.15, 400) % 60_000) for _ in range(200)]
    docs = [x.split(" ") + [None] for x in texts]
    got = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 == 1).collect()

    def counted(ids):
        words, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
        for i in ids:
            for w, before in zip(docs[i], ["start", *docs[i]]):
                words[w], pairs[before, w], contexts[before] = words[w] + 1, pairs[before, w] + 1, contexts[before] + 1
        return words, pairs, contexts

    words, pairs, contexts = counted(i for i in range(200) if i % 10)
    n, v = sum(words.values()), len(words)
    assert len(got) == 200 and v > 5_000
    for r in got:
        want = 0.0
        for w, before in zip(docs[r["doc_id"]], ["start", *docs[r["doc_id"]]]):
            l0, l1, l2 = fixed[contexts[before].bit_length()]
            want += math.log10(l2 * pairs[before, w] / max(1, contexts[before]) + l1 * words[w] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(want, rel=1e-9)
    words, pairs, contexts = counted(i for i in range(200) if i % 10 > 1)
    level, held, two, one, none = seen[0]
    found = [(w, before) for i in range(1, 200, 10) for w, before in zip(docs[i], ["start", *docs[i]])]
    assert held.sum() == len(found) and none == 1 / (len(words) + 1)
    assert (held * two).sum() == pytest.approx(sum(pairs[b, w] / max(1, contexts[b]) for w, b in found))
    assert np.bincount(level, held, minlength=lm.LEVELS).tolist() == np.bincount([contexts[b].bit_length() for _, b in found], minlength=lm.LEVELS).tolist()


def test_lm_weights_maximise_held_out_likelihood():
    n, two, one = np.array([50.0, 30.0, 20.0]), np.array([0.2, 0.0, 0.01]), np.array([0.01, 0.005, 0.001])
    level = np.array([3, 3, 3])
    w = lm.learn_weights(level, n, two, one, 1e-4, rounds=500)[3]
    gain = lambda x: (n * np.log(x[0] * 1e-4 + x[1] * one + x[2] * two)).sum()
    best = max(gain((a, b, 1 - a - b)) for a in np.linspace(0.01, 0.9, 60) for b in np.linspace(0.01, 0.9, 60) if a + b < 1)
    assert gain(w) >= best - 0.5 and w.sum() == pytest.approx(1)


def test_lm_odd_and_gain(spark, odd, none):
    never = F.lit(False)
    rows = lm.score(odd, never, never).collect()
    assert len(rows) == 8 and len({round(r["score"], 9) for r in rows if r["n_tokens"] > 20}) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert lm.score(none, never, never).collect() == []
    assert {r["score"] for r in lm.score(odd, F.lit(True), never).collect()} == {0.0}
    held = queries.QUERIES["op6_lm"](spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def test_language_held_out(spark, odd, none):
    truth = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = queries.QUERIES["op9_language"](spark, "/root/testdata/sf0.01").join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    found = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, {"xx": [5, 6], "aa": [5, 6]}).collect()}
    assert (2, "und") in found and (3, "und") in found and (4, "aa") in found
    assert langid.learn(odd) == {} and {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.learn(none) == {} and langid.predict(none, {}).collect() == []


def test_language_profile_is_plain_counts(spark):
    docs = spark.createDataFrame([("de", "aba b"), ("de", None), ("fr", "Çb"), (None, "zzz")], "lang string, text string")
    got = langid.learn(docs)
    assert sorted(got) == ["de", "fr"]
    text, counts = "_aba_b_", collections.Counter()
    code = {"_": 0, "a": 1, "b": 2}
    for k, base in ((1, 0), (2, 155), (3, 155 + 155**2)):
        for i in range(len(text) - k + 1):
            g = text[i : i + k]
            if g != "_":
                key = 0
                for c in g:
                    key = key * 155 + code[c]
                counts[key + base] += 1
    assert got["de"] == sorted(counts, key=lambda g: (-counts[g], g))
    long = np.frombuffer(("ab " * 600_000).encode(), np.uint8)
    keys, n = langid._counted(langid._LETTER[long])
    assert n.max() >= 600_000 - 2 and len(keys) < 20


def test_languages_beyond_one_block(spark, monkeypatch):
    """Every distance, in blocks of any size and from a table or a list, against one worked out n-gram by n-gram."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "123", "ab " * 40_000]
    docs = spark.createDataFrame([(i, t, f"l{i % 23:02d}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    known = langid.learn(docs, size=40)
    want = {}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        top = langid._top(*langid._counted(langid._LETTER[np.frombuffer(t.encode(), np.uint8)]), 40).tolist()
        away = {x: sum(abs(g.index(k) - j) if k in g else 40 for j, k in enumerate(top)) for x, g in known.items()}
        best = min(away, key=lambda x: (away[x], x))
        want[i] = (best, 1 - away[best] / (40 * len(top)))
    for most in (2000, 7):
        monkeypatch.setattr(langid, "LANGUAGES", most)
        for given in (known, langid.profiles(docs, size=40)):
            got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, given, size=40).collect()}
            assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
            assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_quality_on_labels(spark, odd, none):
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels")
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    weights = quality.train(docs, labels.filter(part == 0))
    rows = quality.score(docs, weights).join(labels.filter(part == 1), "doc_id").collect()
    bad = [r["rejected"] for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    good = [r["rejected"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(bad) >= 0.85 and np.mean(good) <= 0.01
    some = quality.score(odd, weights).collect()
    assert len(some) == 8 and len({r["p_clean"] for r in some if r["doc_id"] in (2, 3)}) == 1
    assert quality.clean(odd, weights).columns == odd.columns
    assert quality.score(none, quality.train(none, None)).collect() == []
    assert not any(r["rejected"] for r in quality.score(odd, quality.train(none, labels)).collect())


def test_quality_features_are_whole_words():
    """Words that begin alike differ by a feature of their own, prefixes are letters, and no character is left out."""

    def features(text):
        data, offs = columnar.utf8(pa.array([text]))
        return set(quality.measure(data, offs)[3].tolist())

    only = lambda a, b: features(a) - features(b)
    for a, b in (("idiotic", "idiotypes"), ("path", "pathetic"), ("привет", "привал"), ("это очень плохо", "это очень плод"), ("天气很好我们出去玩吧", "天气很好我们出去死吧"), ("สวัสดีคนดี", "สวัสดีคนเลว")):
        assert only(a, b) and only(b, a), (a, b)
    assert features("приветы") & features("приветик") - features("прилив"), "five letters in common"
    data, offs = columnar.utf8(pa.array(["天", "气", None, "", "é"]))
    assert len(quality.measure(data, offs)[3]) == 5 * 5 + 3 * 2


def test_quality_hears_other_scripts(spark):
    """What a class says late in a run, or after the first letters of a word, is learned in scripts without spaces too."""
    rng = np.random.default_rng(4)
    filler = ["天气", "我们", "今天", "朋友", "城市", "音乐", "学校", "时间", "问题", "工作", "生活", "电影"]
    cyrillic = ["погода", "сегодня", "город", "музыка", "школа", "время", "работа", "жизнь", "друзья"]

    def text(i):
        bad = i % 7 == 0
        if i % 2:
            return " ".join([*rng.choice(cyrillic, 12)] + ["придурок" if bad else "природа"])
        words = list(rng.choice(filler, 30))
        words.insert(int(rng.integers(8, 25)), "白痴" if bad else "白云")
        return "".join(words) + "。"

    texts = [text(i) for i in range(1200)]
    toxic = [int(i % 7 == 0) for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic) if i % 5], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["p_toxic"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    for rest in (0, 1):
        held = [i for i in range(0, 1200, 5) if i % 2 == rest]
        bad, good = [got[i] for i in held if toxic[i]], [got[i] for i in held if not toxic[i]]
        assert np.mean([b > 3 * g for b in bad for g in good]) >= 0.95


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.choice(3, 20_000, p=[0.7, 0.2, 0.1])
    says = np.full((3, 8), 0.03)
    says[1, :5], says[2, 5], says[1, 6], says[2, 7] = 0.35, 0.6, 0.8, 0.85
    votes = (rng.random((20_000, 8)) < says[truth]).astype(int)
    patterns = collections.Counter("".join(map(str, v)) for v in votes.tolist())
    share, found = quality.label_model(patterns)
    assert np.abs(share - [0.7, 0.2, 0.1]).max() < 0.05 and np.abs(found - says).max() < 0.1


def test_licenses(spark, odd, none):
    texts = [
        "Some prose.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "The license of my dog is expired since May", None, "",
        "é x\nSPDX-License-Identifier: Apache-2.0 and other words follow here", "word " * 30000 + "\n(c) 2020 A. B. All rights reserved.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(b["start"], b["end"], b["license"]) for b in r["blocks"]] for r in licenses.scan(docs).collect()}
    assert got[0] == [(12, 43, "MIT")] and got[7] == got[8] == [] and got[6][0][2] is None and got[9][0][:1] == (4,)
    assert [got[i][0][2] for i in (1, 2, 3, 4, 5, 9, 10)] == ["Apache-2.0", "GPL-3.0", "GPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "Apache-2.0", "proprietary"]
    assert licenses.scan(odd).count() == 8 and licenses.scan(none).collect() == []


def test_licenses_wrapped(spark):
    """Every template stays confirmed where its lines are wrapped, also within comments and inside a cue."""
    wrapped = [(name, mark, "\n".join(mark + x for x in textwrap.wrap(t, 72))) for name, t in licenses.TEMPLATES for mark in ("", "# ", " * ")]
    wrapped += [("proprietary", "", "All rights\nreserved."), ("CC0-1.0", "", "Released under CC0 1.0 into the public\n// domain.")]
    docs = spark.createDataFrame([(i, f"Some prose before.\n\n{t}\n\nand after") for i, (_, _, t) in enumerate(wrapped)], "doc_id long, text string")
    got = {r["doc_id"]: [(b["start"], b["end"], b["license"]) for b in r["blocks"]] for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(wrapped))] == [[(20, 20 + len(t), name)] for name, _, t in wrapped]


def test_licenses_in_long_lines(spark):
    """Every template is confirmed between thousands of words on one line, and several on a line are all told."""
    prose = [w for r in queries.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(300).collect() if not licenses._CUE.search(r["text"] or "") for w in (r["text"] or "").split()]
    assert len(prose) > 50_000
    rng = np.random.default_rng(2)
    part = lambda n: " ".join(prose[(a := int(rng.integers(len(prose) - n))) : a + n])
    texts = [f"{part(n)} {t} {part(n)}" for _, t in licenses.TEMPLATES for n in (1000, 5000)]
    texts.append(" ".join(f"{part(5)} {t}" for _, t in licenses.TEMPLATES))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [b["license"] for b in r["blocks"]] for r in licenses.scan(docs).collect()}
    names = [name for name, _ in licenses.TEMPLATES]
    assert [got[i] for i in range(len(texts) - 1)] == [[name] for name in names for _ in range(2)]
    assert got[len(texts) - 1] == names


def test_licenses_ordered_by_compression():
    """Of the templates whose words confirm a statement the one that saves most is told, and no statement beside it is lost."""
    text, scanner = "x This work is licensed under the GNU General Public License, version 2. y", licenses.Scanner()
    plain, asked = scanner.ranked, []
    scanner.ranked = lambda stretch: asked.append(stretch) or plain(stretch)
    assert [b["license"] for b in scanner.scan(text)] == ["GPL-2.0"]
    order = [licenses.TEMPLATES[i][0] for _, i in plain(asked[0])]
    assert asked[0] == text[2:-3] and order[0] == "GPL-2.0" and sorted(order) == sorted(name for name, _ in licenses.TEMPLATES)
    scanner.ranked = lambda stretch: sorted(plain(stretch), key=lambda x: licenses.TEMPLATES[x[1]][0] != "GPL-3.0")  # confirmed as well, with two changes
    assert [b["license"] for b in scanner.scan(text)] == ["GPL-3.0"]
    side = "Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. All rights reserved."
    assert [b["license"] for b in licenses.Scanner().scan(side)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-4.0", "proprietary"]


def test_repeats_keep_contexts_apart_by_64_bits():
    """Contexts under one gram that agree in their low 40 bits only are no repeats but stay open; equal ones are."""
    data, offs = columnar.utf8(pa.array(["".join(chr(97 + i * i % 23) for i in range(j, j + 300)) for j in range(20)]))
    assert repeats.anchors(data, offs, 100)["context"].max() > 1 << 60
    for kind in (repeats._PLAIN, repeats._COMMON):
        r = np.zeros(3, repeats._ANCHOR)
        r["doc"], r["context"], r["kind"] = [0, 1, 2], [5, 5 | 1 << 50, 5], kind
        packed = [x for _, x in repeats._packed(np.zeros(3, np.int64), r, np.array([10, 11, 12]), np.zeros(3, np.int64))]
        got = repeats._sorted(100)(None, pa.table({"packed": pa.array(packed, pa.binary())})).to_pylist()
        assert [x["id"] for x in got if x["spans"]] == [12] and sorted(x["id"] for x in got if x["open"]) == [10, 11]


def test_pipeline_stages_against_plain_versions(spark, small_dir, library):
    docs = queries.table(spark, small_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "jaccard", "benchmark", "secrets", "bpe"]
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, small_dir)
    ids = {r["doc_id"] for r in kept.collect()}
    found = queries.QUERIES["op1_jaccard"](spark, small_dir).collect()
    assert ids == {r["doc_id"] for r in found if r["doc_id"] == r["component_id"]}
    left = corpus_pipeline.drop_benchmark(spark, docs, small_dir)
    hit = queries.QUERIES["op4_decontaminate"](spark, small_dir).collect()
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in hit if not r["contaminated"]}
    clean = corpus_pipeline.redact_secrets(spark, docs, small_dir)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.repository_of_source(), F.col("source")).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in clean.collect():
        text, at, out = before[r["doc_id"]], 0, ""
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[secret]"
            at = max(at, s["end"])
        assert r["text"] == (out + text[at:] if text is not None and spans[r["doc_id"]] else text)
    rows = corpus_pipeline.run(spark, small_dir).collect()
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, small_dir)
        assert stage.columns == docs.columns
    want = {r["doc_id"]: digest(library, r["text"]) for r in stage.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


def test_pipeline_encodes_texts_without_words_between_others(spark, library, small_dir):
    """The last stage reads many rows of one file at once; what the stages before may leave of a text is nothing or blanks."""
    texts = ["a b", None, "c  d", "", "key = [secret]\n\n  end", "   ", "x"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "bpe"
    assert {r["doc_id"]: tuple(r)[1:] for r in stage(spark, docs, small_dir).collect()} == {i: digest(library, t) for i, t in enumerate(texts)}


def test_pipeline_stages_on_odd_rows(spark, odd, none, small_dir):
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, none, small_dir).collect() == [], name
        assert f(spark, odd, small_dir).columns == odd.columns, name


def test_repeats_join_the_windows_of_a_bucket_once(monkeypatch):
    """A bucket gets a piece from every block of text; what is copied follows the windows, not windows times pieces."""
    text, n = np.frombuffer(bytes(range(97, 122)) * 8, np.uint8), 2000
    piece = lambda i: b"".join([np.array([1, 1], "<u4").tobytes(), np.array([i], "<i8").tobytes(), bytes(8), np.array([0, i % 7, 10], "<u4").tobytes(), text[i % 25 : i % 25 + 110].tobytes()])
    table = pa.table({"packed": [piece(i) for i in range(n)], "kind": [repeats._PLAIN] * n})
    copied, plain = [], np.concatenate

    def counted(parts, *more, **named):
        out = plain(parts, *more, **named)
        copied.append(out.nbytes)
        return out

    monkeypatch.setattr(np, "concatenate", counted)
    found = repeats._windows(100)(None, table)
    windows = n * 11
    assert sum(copied) < 100 * windows * repeats._WINDOW.itemsize
    # The text comes again every 25 bytes, so the first documents hold every string first and the others have nothing of their own.
    spans = {i: np.frombuffer(x, "<u4").tolist() for i, x in zip(found.column("id").to_pylist(), found.column("spans").to_pylist())}
    assert 0 not in spans and all(spans[i] == [i % 7, i % 7 + 110] for i in range(25, n))


def test_repeats_know_documents_of_one_key_by_all_bits_of_their_tag():
    ids, tags = np.full(3, repeats._NO_ID), np.array([5 << 40, (5 << 40) + 1, 5 << 40])
    assert repeats._rank(ids, tags).tolist() == [0, 1, 0]
    r = np.zeros(3, repeats._WINDOW)
    r["doc"], r["start"] = [0, 1, 1], [7, 8, 9]
    packed = [x for _, x in repeats._packed(np.zeros(3, np.int64), r, ids, tags)]
    got_ids, got_tags, got = repeats._unpacked(packed * 2, repeats._WINDOW)
    assert got_tags.tolist() == [5 << 40, (5 << 40) + 1] * 2 and set(got_ids) == {int(repeats._NO_ID)}
    assert got["doc"].tolist() == [0, 1, 1, 2, 3, 3] and got["start"].tolist() == [7, 8, 9] * 2
