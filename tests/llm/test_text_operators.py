"""Quality rules, language identification, trie encoding, the classifier: against plain Python, on odd texts too."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe_trie, catalog, language_id, nb_svm, quality_rules, vocabularies

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", "One two three four five six seven eight nine ten eleven twelve.", "to to to to to to to to to to to to",
    "x\ty\x0bz\x0cw\rv\nv\n v\nv ", "été où ça va bien aujourd'hui", "漢字 ありがとう 한국어 １２ ½ ² Ⅷ", "a\x1cb\x1dc d\x85e\xa0f g​h﻿i",
    "ΑΣ ΣΑΣ Σ İstanbul ǅ ſ", "#*$%&|<> #", "don't It'S we'LL 'S", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "🙂🙃 a🙂b", "aaaa" * 500, "w " * 3000,
    "line\nline\nother\nline", "42 17 3.14 $9,99",
]


def frame(spark, texts, **extra):
    """Documents with repeated rows, a null id, and columns named like results."""
    rows = [(n, t, "en" if n % 2 else None, f"src{n % 3}", 0.5, "x") for n, t in enumerate(texts)] + [(0, texts[0], None, None, None, None), (None, "some words", "en", "a", 1.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept string")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def words_of(text):
    return (text or "").encode().split()


def base_measures(text):
    words = [w.decode() for w in words_of(text)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_base_measures_and_tokens(spark):
    import sentencepiece

    documents = frame(spark, ODD).unionByName(table(spark, "documents").limit(60), allowMissingColumns=True)
    path = vocabularies.default_path("piece_bpe_32k.model")
    got = quality_rules.measure(documents, vocabularies.share_file(spark, path), "text").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for r in documents.collect():
        ids = [i for w in words_of(r.text) for i in model.encode(w.decode())]
        seen, n = Counter(ids), len(ids)
        even = 1.0 if n < 2 else -sum(c / n * math.log2(c / n) for c in seen.values()) / math.log2(n)
        bytes_share = sum(model.is_byte(i) or model.is_unknown(i) for i in ids) / max(n, 1)
        want[(r.doc_id, *base_measures(r.text), n, round(abs(even), 9), round(bytes_share, 9))] += 1
    assert want == Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, round(abs(r.evenness), 9), round(r.byte_share, 9)) for r in got
    )
    odd = quality_rules.measure(frame(spark, ODD), vocabularies.share_file(spark, path), "text").collect()
    scripts = {r.doc_id: r.script for r in odd}
    assert (scripts[8], scripts[11], scripts[12]) == ("latin", "latin", "none")


def test_bands_reject_what_the_vocabulary_cannot_hold(spark):
    rng = random.Random(5)
    common = "the and for with that this from have they will one all would there their what about which when make".split()
    clean = [" ".join(rng.choice(common) for _ in range(rng.randint(150, 220))) for _ in range(260)]
    noisy = [" ".join("".join(rng.choice("qxzjkvw#%&") for _ in range(14)) for _ in range(180)) for _ in range(8)]
    rows = [(n, t, "en") for n, t in enumerate(clean + noisy)] + [(900, "short text of few words", "en"), (901, None, None)]
    got = {r.doc_id: r for r in quality_rules.fertility_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[n].kept == (not got[n].base_failed) for n in range(260))
    assert not any(got[n].kept for n in range(260, 268)) and not any(got[n].base_failed for n in range(260, 268))
    assert got[900].base_failed and got[901].base_failed and not got[901].kept
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_rules.fertility_verdicts(empty).count() == 0


def test_quality_query_keeps_good_documents(spark):
    got = catalog.op1_quality_rules(spark, SMALL).join(table(spark, "labels"), "doc_id").where("not base_failed")
    by = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert by[1] > 0.99


def test_few_texts_are_judged_too(spark):
    rng = random.Random(6)
    common = "the and for with that this from have they will one all would there their what about which when make".split()

    def rows(n, texts):
        return [(k, t, "en") for k, t in enumerate(" ".join(rng.choice(common) for _ in range(200)) for _ in range(n))] + [(1000 + k, t, lang) for k, (t, lang) in enumerate(texts)]

    held_by_bytes = " ".join("".join(chr(rng.randint(0x12000, 0x12300)) for _ in range(6)) for _ in range(80))
    noisy = " ".join("".join(rng.choice("qxzjkvw#%&") for _ in range(14)) for _ in range(180))
    for n in (30, 90):
        odd = [(held_by_bytes, "sux"), (noisy, "xx")]
        documents = spark.createDataFrame(rows(n, odd), "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in quality_rules.fertility_verdicts(documents).collect()}
        assert all(got[k].kept for k in range(n)) and not any(got[k].base_failed for k in (1000, 1001))
        assert not got[1000].kept and not got[1001].kept


def test_quality_query_rejects_junk_and_keeps_good(spark):
    """Shares by label, and tables of invented words, whose symbols exceed a tenth of their letters."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = catalog.op1_quality_rules(spark, folder).where("not base_failed").join(labels, "doc_id", "left").select("quality", "n_symbols", "word_chars", "kept").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.2
    assert got[got.n_symbols > 0.1 * got.word_chars].kept.mean() < 0.15


def test_word_grams_are_those_of_padded_words():
    words = ["ab", "c", "défg", "x"]
    for order, (bucket, counts) in zip(language_id.ORDERS, language_id.word_grams(words)):
        padded = [f" {w} " for w in words]
        grams = [[p[i : i + order] for i in range(len(p) - order + 1) if order > 1 or p[i] != " "] for p in padded]
        assert counts.tolist() == [len(g) for g in grams]
        flat = [g for gs in grams for g in gs]
        assert len({(g, b) for g, b in zip(flat, bucket.tolist())}) == len(set(flat))


def test_bayes_equals_plain_counts(spark):
    documents = table(spark, "documents").limit(80)
    model = language_id.train(documents)
    totals, texts = {}, Counter()
    for r in documents.collect():
        texts[r.lang] += 1
        for (bucket, _) in language_id.word_grams([w.decode() for w in words_of(r.text)]):
            totals[r.lang] = totals.get(r.lang, 0) + np.bincount(bucket, minlength=language_id.BUCKETS)
    for n, lang in enumerate(model.languages):
        want = np.log((totals[lang] + 0.5) / (totals[lang] + 0.5).sum())
        assert np.allclose(model.log_probability[:, n], want, atol=1e-5)
        assert math.isclose(model.log_prior[n], math.log(texts[lang] / sum(texts.values())))


def test_language_of_held_out_documents(spark):
    got = catalog.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    documents = frame(spark, ODD)
    model = language_id.train(table(spark, "documents"))
    got = language_id.predict(documents, model).collect()
    assert len(got) == len(ODD) + 2 and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "kept", "lang_pred", "score"}
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == lettered and (lettered or r.score == 0)
    nothing = language_id.train(documents.where("lang = 'none'"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(documents, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(documents.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabularies.default_path("word_bpe_49k.json"))


def test_trie_walk_equals_library(library):
    with open(vocabularies.default_path("word_bpe_49k.json"), "rb") as f:
        encoder = bpe_trie.ChunkEncoder(f.read())
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzeeeaaattthhnnss'1.,!é ßü\n"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    for text, (ids, decoded) in zip(texts, encoder.encode(pa.array(texts, pa.large_string()))):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_settled_characters_are_prepared_alike(library):
    for c in map(chr, range(0x9, 0x460)):
        if bpe_trie.PLAIN.fullmatch(c) and c.strip():
            assert c.lower() == library.normalizer.normalize_str(c), hex(ord(c))


def test_trie_query(spark, library):
    for r in catalog.op3_bpe_trie(spark, SMALL).join(table(spark, "documents"), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe_trie.encode(frame(spark, ODD), vocabularies.default_path("word_bpe_49k.json")).collect()
    assert len(whole) == len(ODD) + 2
    nulls = [r for r in whole if r.doc_id == 0]
    assert len(nulls) == 2 and {(bytes(r.ids), r.decoded) for r in nulls} == {(b"", "")}


def test_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(0, 40, 6) + (40 if n % 2 else 0) * (rng.random() < 0.9)) for n in range(80)]
    labels = np.arange(80) % 2
    model = nb_svm.fit(features, labels, rounds=400, tolerance=1e-6)
    raw = [n + 1 for n in (np.zeros(nb_svm.BUCKETS), np.zeros(nb_svm.BUCKETS))]
    for f, y in zip(features, labels):
        raw[y][f] += 1
    ratio = np.log(raw[1] / raw[1].sum()) - np.log(raw[0] / raw[0].sum())
    assert np.allclose(model.square, ratio**2)
    rows = np.zeros((80, 81))
    for n, f in enumerate(features):
        rows[n, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    rows[:, 80], sign = 1, np.where(labels == 1, 1.0, -1.0)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (rows @ w)).sum()

    best = np.append(model.weight[:80] / ratio[:80], model.bias)
    start = loss(best)
    for _ in range(300):
        assert loss(best + rng.normal(0, 0.02, 81)) >= start - 1e-3


def test_classifier_query(spark):
    folder = "/root/testdata/sf0.01"
    got = catalog.op10_nb_svm(spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert got.count() == 1000


def test_classifier_on_odd_rows(spark):
    documents = frame(spark, ODD)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (7, None), (8, 3), (None, 1), (8, 1), (17, 0)], "doc_id long, quality int")
    model = nb_svm.train(documents, labels)
    got = nb_svm.score(documents, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[5] > 0.5 > score[6]
    for rows, want in (([(5, 1)], 1), ([(6, 0)], 0), ([], 0.5)):
        one = nb_svm.train(documents, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert {round(r.score, 6) for r in nb_svm.score(documents, one).collect()} == {want}
    assert nb_svm.score(documents.limit(0), model).count() == 0
