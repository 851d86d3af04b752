"""The fitted operators and the signatures against plain recomputations, and their awkward cases with a fitted model."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from huegrain.llm import fingerprints as fp
from huegrain.llm import language_id as lid
from huegrain.llm import license_scan as ls
from huegrain.llm import packing
from huegrain.llm import toxicity as tox
from huegrain.llm.contracts import tokenizer_file
from huegrain.llm.wordbag import features

M64 = (1 << 64) - 1
LONG = " ".join(f"river{i % 313} stone{i % 17}" for i in range(30_000))
AWKWARD = [None, "", " \n\t", "42 !", "tree", LONG, "one more line", "Ünï çödé", "tree", "tree"]


def mix(x):
    x &= M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def table(spark, texts, lang=None):
    rows = [(i, t, lang, "x", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score int, label double").repartition(3)


# ---------------------------------------------------------------- order min-hash


def plain_signature(text, k=8, sketches=32, size=2):
    """Occurrence-numbered k-mers as tuples; for each sketch the ``size`` smallest by hash, put back in text order, folded to one number."""
    if not text:
        return [0] * sketches
    k = min(k, len(text))
    seen, mers = collections.Counter(), []
    for i in range(len(text) - k + 1):
        mer = text[i : i + k]
        h = 0
        for c in mer:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
        mers.append(mix(h + seen[mer] * 0xD1B54A32D192ED03))
        seen[mer] += 1
    out = []
    for s in range(1, sketches + 1):
        a, b = ((mix(s * seed) >> 32) | 1 for seed in (0x51ED270B, 0x85EBCA77))

        def small(m):
            h = ((m >> 32) * a) & 0xFFFFFFFF
            return ((h ^ (h >> 15)) * b) & 0xFFFFFFFF

        chosen = sorted(sorted(range(len(mers)), key=lambda i: (small(mers[i]), i))[:size])
        x = 0
        for i in chosen:
            x = mix(x * 31 + mers[i])
        out.append(x >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abab" * 30, "the quick brown fox jumps over the lazy dog " * 3, "日本語テキスト" * 9, "z" * 200])
def test_order_minhash_by_hand(text):
    assert fp.order_minhash(text).tolist() == plain_signature(text)


def test_order_minhash_is_sensitive_to_order():
    random = np.random.default_rng(4)
    words = ["".join(random.choice(list("abcdefgh"), 7)) for _ in range(300)]
    text, turned = " ".join(words), " ".join(words[150:] + words[:150])
    near = " ".join(w if i % 60 else "zz" for i, w in enumerate(words))
    far = " ".join("".join(random.choice(list("ijklmnop"), 7)) for _ in range(300))
    like = lambda a, b: fp.likeness(fp.order_minhash(a, sketches=256), fp.order_minhash(b, sketches=256))
    assert like(text, text) == 1 and like(text, near) > 0.6 > like(text, turned) > like(text, far) == 0  # the turned one has nearly the same k-mers


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(5, "five " * 9), (5, "five b " * 9), (None, "none " * 9), (1, None), (9, LONG), (5, "five " * 9)]
    got = fp.neighbour_fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, [-ord(c) for c in r[1] or ""]))
    want = []
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        e = fp.edited(x or "", y or "")
        want.append((i, len(x or ""), hashlib.sha256(e.encode()).hexdigest()))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == collections.Counter(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


# ---------------------------------------------------------------- toxicity and language


def plain_word(word, table, grams):
    """The mean of the rows of a word's features, one word at a time."""
    _, buckets = features([word], grams, len(table))
    return table[buckets].astype(float).mean(axis=0)


def plain_toxicity(model, text):
    words, n = (text or "").lower().split(), model.segment
    scores = [float(plain_word(w, model.table(), tox.GRAMS)[0]) for w in words]
    z = [n * sum(scores[i : i + n]) / max(len(scores[i : i + n]), n / 2) + model.bias for i in range(0, max(1, len(words)), n)]
    weights = [math.exp(2 * (x - max(z))) for x in z]
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, z)) / sum(weights)))


@pytest.fixture(scope="module")
def toxic_model(spark):
    random = np.random.default_rng(5)
    plain = [" ".join(random.choice(["the", "tree", "river", "of", "stone", "and", "walks"], 40)) for _ in range(240)]
    df = spark.createDataFrame([(i, t + (" blockhead fool" if i % 3 == 0 else "")) for i, t in enumerate(plain)], "doc_id long, text string")
    return tox.fit(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(5, None), (3, 1)], "doc_id long, toxic int"))


def test_toxicity_by_hand(spark, toxic_model):
    texts = [*AWKWARD[:5], *AWKWARD[6:], "you blockhead", "BLOCKHEAD!", "bl0ckhead of a tree", "the river walks " * 40 + "fool"]
    got = {r.doc_id: r for r in tox.toxicity(table(spark, texts), toxic_model).collect()}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(plain_toxicity(toxic_model, t), abs=1e-5)
        assert got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[texts.index("you blockhead")].predicted == got[len(texts) - 1].predicted == 1 and got[4].predicted == 0


def test_toxicity_of_awkward_tables(spark, toxic_model):
    got = tox.toxicity(table(spark, AWKWARD), toxic_model).collect()
    assert len(got) == len(AWKWARD) and len({r.score for r in got if AWKWARD[r.doc_id] == "tree"}) == 1 and {r.predicted for r in got} == {0}
    assert tox.toxicity(table(spark, []), toxic_model).count() == 0


@pytest.fixture(scope="module")
def language_model(spark):
    random = np.random.default_rng(6)
    words = {"aa": ["thorn", "with", "shall"], "bb": ["pflug", "nicht", "zwei"], "cc": ["queso", "niño", "llama"], "dd": ["tree", "river", "stone"]}
    rows = [(i, " ".join(random.choice(words[k], 12)), k) for i, k in enumerate(sorted(words) * 60)]
    return lid.fit(spark.createDataFrame([*rows, rows[0], (None, "shall", "aa")], "doc_id long, text string, lang string"))


def plain_language(model, text):
    """Bit margins from a plain mean over words, loss-weighted decoding code by code."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    words = text.lower().split()
    f = lid.SCALE * np.mean([plain_word(w, model.table, lid.GRAMS) for w in words], axis=0) + model.bias
    loss = [sum(w * math.log1p(math.exp(-max(-40, min(40, c * x)))) for c, x, w in zip(code, f, weight)) for code, weight in zip(model.codes, model.weight)]
    best = min(range(len(loss)), key=lambda i: loss[i])
    return model.languages[best], 1 / sum(math.exp(-model.codes.shape[1] * (x - min(loss))) for x in loss)


def test_language_by_hand(spark, language_model):
    texts = [*AWKWARD[:5], *AWKWARD[6:], "shall thorn", "nicht zwei pflugg", "el niño y la llama", "treeriver", "thorn nicht"]
    for r in lid.language_id(table(spark, texts, "zz"), language_model).collect():
        want, score = plain_language(language_model, texts[r.doc_id])
        assert (r.lang_pred, r.held_out) == (want, zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.score == pytest.approx(score, abs=1e-4)


def test_language_of_awkward_tables(spark, language_model):
    got = {r.doc_id: r for r in lid.language_id(table(spark, AWKWARD), language_model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and got[5].lang_pred == "dd" and got[4].score == got[8].score == got[9].score
    assert lid.language_id(table(spark, []), language_model).count() == 0
    nobody = lid.train([], [])
    assert {r.lang_pred for r in lid.language_id(table(spark, AWKWARD), nobody).collect()} == {"und"}
    tied = lid.decode(language_model, np.zeros((1, language_model.codes.shape[1])))  # no evidence: ambiguous, the first of the equally near
    assert tied[2][0] and tied[0][0] == int(np.argmin((np.log(2) * language_model.weight).sum(axis=1)))


# ---------------------------------------------------------------- licences


def plain_scan(texts, templates, header_lines=8):
    """For every text the best TF-IDF cosine of all runs of lines and the whole text with all templates."""
    bag = lambda t: collections.Counter(ls._WORD.findall(t.lower().encode()))
    df, n = collections.Counter(w for t in texts for w in set(bag(t or ""))), len(texts)
    vector = lambda c: {w: k * (math.log((n + 2) / (df[w] + 1)) + 1) for w, k in c.items()}

    def cosine(x, y):
        both = sum(v * y.get(w, 0) for w, v in x.items())
        return both / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if both else 0.0

    known = [(name, vector(bag(t))) for name, ts in sorted(templates.items()) for t in ts]
    out = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if bag(x)]
        runs = [" \n".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 1, min(a + header_lines, len(lines)) + 1)] + ["\n".join(lines)]
        best = max(((round(cosine(vector(bag(run)), v), 6), name) for run in runs for name, v in known), key=lambda x: x[0], default=(0.0, None))
        out.append(best)
    return out


def test_licenses_against_all_pairs(spark):
    random = np.random.default_rng(8)
    words = "this that file grants anyone free use terms license public may copy share x1 y2 z3 of the under".split()
    templates = {f"L{k}": [" ".join(random.choice(words, random.integers(3, 9)))] for k in range(6)}
    texts = ["\n".join(" ".join(random.choice(words, random.integers(1, 7))) for _ in range(random.integers(1, 12))) for _ in range(150)]
    texts += [t[0] for t in templates.values()] + ["this source code form is subject to the terms of the public v 2.0", None, "", "a\n\n b"]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    want = plain_scan(texts, templates)
    for r in ls.license_scan(df, templates=templates).collect():
        score, _ = want[r.id]
        assert (r.license is not None) == (score >= 0.6), (texts[r.id], r, want[r.id])
        if score >= 0.6 + 1e-6:
            assert r.score == pytest.approx(score, abs=2e-6)
    own = "everything here belongs to zed and may be used by anyone who asks"
    assert ls.license_scan(spark.createDataFrame([(1, "a/b", own)], "doc_id long, path string, text string"), templates={"Z": [own]}).first().license == "Z"


def test_licenses_of_awkward_tables(spark):
    schema = "doc_id long, path string, text string, license string, score string, found string"
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (1, "a/LICENSE", mit), (2, "a/x", LONG + "\n" + mit), (3, "a/NOTICE", "Licensed under the Apache License, Version 2.0."), (4, "a/y", "plain"), (None, None, mit), (6, "", None), (7, "/", mit)]
    got = collections.Counter((r.id, r.license, r.how) for r in ls.license_scan(spark.createDataFrame([(*r, "", "", "") for r in rows], schema)).collect())
    assert got[1, "MIT", "file"] == 2 and got[2, "MIT", "header"] == 1 and got[None, "MIT", "file"] == got[7, "MIT", "file"] == 1 and sum(got.values()) == len(rows)
    assert got[4, "MIT", "inherited"] + got[4, "Apache-2.0", "inherited"] == 1
    assert ls.license_scan(spark.createDataFrame([], schema)).count() == 0


# ---------------------------------------------------------------- tokens of the packing


def test_both_encoders_give_the_same_ids():
    e = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    random = np.random.default_rng(9)
    texts = [*packing._AWKWARD, *("".join(map(chr, random.integers(1, 0x2FF, 200))) for _ in range(200)), "".join(chr(c) for c in random.integers(0x1F300, 0x1FAFF, 50))]
    assert all(e.fast(t).tolist() == e.slow(t).tolist() == e(t).tolist() for t in texts)
    long = "ab cd 12 " * (packing.Encoder.LONG // 9 + 1)
    assert len(long) >= packing.Encoder.LONG and e(long).tolist() == e.fast(long).tolist()


def test_a_large_vocabulary_is_refused(spark, monkeypatch):
    class Many:
        def get_vocab_size(self, with_added_tokens):
            return 70_000

    monkeypatch.setattr(packing, "tokenizer", lambda path: Many())
    with pytest.raises(ValueError, match="65,536"):
        packing.retrieval_pack(table(spark, ["a"]), "file")


def test_packing_of_ties_and_repeated_rows(spark):
    texts = ["same words here", "same words here", "same words here", None, "", LONG]
    got = packing.retrieval_pack(spark.createDataFrame([(i % 3, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, key int"), tokenizer_file("byte_bpe_50k.json")).collect()
    e = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in enumerate(texts):
        want[i % 3] += len(e(t or "")) + 1
    have = collections.Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
