"""The text operators against brute force, over small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from huegrain.llm import language_id as lid
from huegrain.llm import toxicity as tox
from huegrain.llm.bpe import encode_decode
from huegrain.llm.chat_format import render_chats
from huegrain.llm.components import components
from huegrain.llm.contracts import tokenizer_file
from huegrain.llm.exact_dedup import exact_dedup
from huegrain.llm.fingerprints import edited, neighbour_fingerprints, order_minhash
from huegrain.llm.jaccard_join import jaccard_components
from huegrain.llm.license_scan import license_scan
from huegrain.llm.line_dedup import PerfectHash, line_dedup
from huegrain.llm.packing import Bm25, best, fill_windows, retrieval_pack

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(9000))
LINE = "This line is the same in Every document"
TEXTS = [None, "", " \n\t", "short", LONG, LONG + " tail", LINE + "\nown one", "  " + LINE.lower() + " \nown two", LINE + "\n" + LINE, "a b İÉ don't  \n\n x", "a b İÉdon't \n x", "one two three four five six seven eight nine ten", "One TWO three four five six seven eight nine ten", "<|endoftext|> and <|startoftext|>x", "日本語 テキスト 12345"]
SCHEMA = "doc_id long, text string, n_lines string, shard long, row_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", i, "y") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(1).integers(0, 2**63, (2, 5000)).astype(np.uint64)
    m = PerfectHash.build(*h)
    assert sorted(m.slot(*h)) == list(range(5000))
    assert (PerfectHash.load(*m.dump()).slot(*h) == m.slot(*h)).all()


def test_line_dedup(docs, none):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t in enumerate(TEXTS):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                seen[key(x)].add(i)
    for r in line_dedup(docs).collect():
        lines = (TEXTS[r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < 3 or max(seen[key(x)]) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256, r.text) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept))
    assert line_dedup(none).count() == 0


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    rows = list(enumerate(TEXTS)) + [(3, "short"), (99, "sh ort  ")]
    more = docs.unionByName(docs.sparkSession.createDataFrame([(3, "short", "", 0, ""), (99, "sh ort  ", "", 0, "")], SCHEMA))
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    got = exact_dedup(more, block_bytes=64).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    want = {i: (min(m)[1], len(m), sha(bare)) for bare, m in groups.items() for _, i in m}
    assert all(want[r.doc_id] == (r.keep_id, r.group_size, r.text_sha256) for r in got)
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("words,pct,few", [(4, 85, 256), (5, 80, 2), (2, 60, 2)])
def test_jaccard(spark, none, words, pct, few):
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in random.integers(0, 300, 120)]
    texts = list(TEXTS)
    for _ in range(25):  # a chain-like group of near copies
        at = random.integers(0, 120, 3)
        texts.append(" ".join("z" + w if i in at else w for i, w in enumerate(base)))
    texts += [" ".join(base)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= pct * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, words=words, pct=pct, few=few).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard_components(none, words=words, pct=pct).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (201, 200), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200}


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for r in encode_decode(docs, path, max_words=50).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded, r.decoded_sha256) == (ids, len(ids), text, sha(text))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encode_decode(none, path).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = retrieval_pack(docs, path).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert retrieval_pack(none, path).count() == 0


def _bags(n, seed=5):
    """A block of documents as the packing holds it, its inverse frequencies, and every pair's BM25 score by brute force (weights in steps of 1/64)."""
    random = np.random.default_rng(seed)
    bags = [{int(t): int(c) for t, c in zip(*np.unique(random.zipf(1.3, 60) % 500, return_counts=True))} for _ in range(n - 1)] + [{}]
    df = collections.Counter(t for x in bags for t in x)
    idf = np.zeros(65536, np.float32)
    for t, c in df.items():
        idf[t] = np.log(1 + (n - c + 0.5) / (c + 0.5))
    table = pa.table({"terms": [np.array(sorted(x), np.uint16).tobytes() for x in bags], "tfs": [np.array([x[t] for t in sorted(x)], np.uint32).tobytes() for x in bags], "doc_tokens": pa.array([sum(x.values()) for x in bags], pa.int64())})
    score = [[sum(round(64 * float(idf[t]) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / 60))) / 64 for t in q if t in d) for d in bags] for q in bags]
    return Bm25(table, idf, 60.0), np.array(score)


def test_bm25_of_some_documents():
    corpus, score = _bags(60)
    some = np.arange(3, 60, 2)
    got = corpus.index(some).scores(np.array([5, 0, 59, 41]))
    assert (got == score[[5, 0, 59, 41]][:, some]).all() and not got[2].any()
    assert best(np.array([0.0, 2, 3, 2, 0, 2]), 3).tolist() == [2, 1, 3] and best(np.array([0.0, 1, 0]), 9).tolist() == [1] and not len(best(np.zeros(3), 2))


@pytest.mark.parametrize("n, batch", [(60, 1), (60, 16), (400, 64), (1, 4)])
def test_windows_hold_the_best_unused(n, batch):
    """Every window is replayed against brute-force scores: the best unused, best first, the last one cut; full unless nothing is left."""
    corpus, score = _bags(n)
    size = np.random.default_rng(n).integers(1, 101, n)
    used = np.zeros(n, int)
    bare, loose = [i for i in range(n) if not score[i, i]], 0
    for items in fill_windows(corpus, size, 100, 3, batch):
        seed, room = items[0][0], 100
        for i, (d, a, b) in enumerate(items):
            left = [x for x in np.flatnonzero(used < size) if x not in bare and x != seed]
            if i:
                assert score[seed, d] == max(score[seed, left])
            assert a == used[d] and b == min(size[d], a + room)
            used[d], room = b, room - (b - a)
        left = [x for x in np.flatnonzero(used < size) if x not in bare]
        assert not room or seed in bare or not left or not max(score[seed, left])
        loose += room > 0
    assert (used == size).all() and loose <= len(bare) + 3


def test_packing_neighbours(spark):
    """Near copies meet, wherever they are, in one shard and in many; groups of copies are no hot shard; results are the same however rows are dealt."""
    random = np.random.default_rng(5)
    words = [" ".join(f"q{c}x{w}" for w in random.integers(0, 40, 110)) for c in range(450) for _ in range(2)]  # pairs of one topic
    path = tokenizer_file("byte_bpe_50k.json")
    for shard_docs in (4096, 100):
        pairs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
        seqs, results = collections.defaultdict(set), []
        for parts in (5, 2):
            results.append(retrieval_pack(pairs.repartition(parts), path, shard_docs=shard_docs).filter("sequence_id >= 0").collect())
        for r in results[0]:
            seqs[r.doc_id].add(r.sequence_id)
        assert sum(bool(seqs[i] & seqs[i + 1]) for i in range(0, 900, 2)) > 270
        assert sorted(results[0]) == sorted(results[1])
    group = spark.createDataFrame([(i, "the same text " * 40) for i in range(700)], "doc_id long, text string")
    assert len({tuple(sorted(retrieval_pack(group.repartition(parts), path, shard_docs=50).collect())) for parts in (5, 2)}) == 1
    copies = spark.createDataFrame([(7, "the same text " * 40) for i in range(700)] + [(None, None), (None, "x")], "doc_id long, text string").repartition(3)
    got = retrieval_pack(copies, path, shard_docs=50).collect()
    lots = collections.Counter()
    for r in got:
        lots[r.sequence_id >> 32] += r.length
    assert len(lots) > 8 and max(lots.values()) < 3 * sum(lots.values()) / len(lots) and sum(lots.values()) == 702 + sum(r.doc_tokens - 1 for r in got if not r.start)


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in neighbour_fingerprints(docs).collect()}
    ids = sorted(range(len(TEXTS)), reverse=True)
    for n, i in enumerate(ids):
        x, y = TEXTS[i] or "", TEXTS[ids[(n + 1) % len(ids)]] or ""
        e = edited(x, y)
        a, b, c = order_minhash(x), order_minhash(e), order_minhash(y)
        assert (got[i].n_chars, got[i].edited_sha256, got[i].near_edited, got[i].near_next) == (len(x), sha(e), (a == b).mean(), (a == c).mean())
    assert neighbour_fingerprints(none).count() == 0
    assert (order_minhash("abcdefghij" * 9) == order_minhash("abcdefghij" * 9)).all()


def test_toxicity(spark, docs, none):
    random = np.random.default_rng(5)
    plain = [" ".join(random.choice(["the", "tree", "river", "of", "stone", "and", "walks"], 40)) for _ in range(300)]
    texts = [t + (" blockhead" if i % 3 == 0 else "") + t for i, t in enumerate(plain)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(7, None)], "doc_id long, toxic int")
    model = tox.fit(df, labels)
    got = tox.toxicity(df, model).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = spark.createDataFrame([(0, "you blockheaad of stone"), (1, None), (2, "")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in tox.toxicity(odd, model).collect()}
    assert score[0] > score[1] == score[2] and all(0 <= s <= 1 for s in score.values())
    assert all(r.predicted == 0 for r in tox.toxicity(docs, tox.fit(none, labels)).collect())


def test_language_id(spark, docs, none):
    random = np.random.default_rng(6)
    words = {"aa": ["thorn", "with", "shall"], "bb": ["pflug", "nicht", "zwei"], "cc": ["queso", "niño", "llama"]}
    rows = [(i, " ".join(random.choice(words[k], 12)), k) for i, k in enumerate(sorted(words) * 60)]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", "bb"), (902, "nicht", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lid.language_id(df, lid.fit(df)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "bb")
    assert {r.lang_pred for r in lid.language_id(docs, lid.fit(none.withColumnRenamed("n_lines", "lang"))).collect()} == {"und"}


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x = 1"), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\nx"), (4, "z.py", None), (5, None, ""), (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "a/q/e.py", "plain words")]
    got = {r.id: (r.license, r.how, r.from_path) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "file", "a/LICENSE") and got[3] == ("Apache-2.0", "header", "a/b/d.py")
    assert got[2] == ("GPL-3.0", "inherited", "a/b/LICENSE") and got[7] == ("MIT", "inherited", "a/LICENSE")
    assert got[4] == (None, "none", None) and got[5] == (None, "none", None)


def test_license_weights(spark):
    """Scores by the frequencies of all words over all files: against brute force, for notices that stand among other words."""
    import math

    from huegrain.llm.license_scan import _WORD, TEMPLATES

    texts = ["Copyright 2024 Jane Doe. Licensed under the Apache License, Version 2.0.", "This file is licensed under the MIT license by Acme Corporation."]
    texts += ["copyright 2024 jane doe this file by acme corporation"] * 60 + ["plain"] * 20
    got = {r.id: r for r in license_scan(spark.createDataFrame([(i, f"d{i}/x.py", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()}
    bags = [collections.Counter(_WORD.findall(t.lower().encode())) for t in texts]
    df = collections.Counter(w for b in bags for w in b)
    vector = lambda c: {w: k * (math.log((len(texts) + 2) / (df[w] + 1)) + 1) for w, k in c.items()}
    cos = lambda x, y: sum(x[w] * y.get(w, 0) for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    for i, name in enumerate(["Apache-2.0", "MIT"]):
        want = max(cos(vector(bags[i]), vector(collections.Counter(_WORD.findall(t.encode())))) for ts in TEMPLATES.values() for t in ts)
        assert (got[i].license, got[i].score) == (name, pytest.approx(want, abs=1e-5)) and want >= 0.6


def test_license_candidates(spark):
    """No candidate is lost: short notices, templates of one's own, notices over several comment lines."""
    gpl = "// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation; either version {} of the License, or\n// (at your option) any later version.\nint x;"
    texts = ["CC BY-SA 4.0", gpl.format(2), gpl.format(3), "int x;"]
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in enumerate(texts)] + [(9, "d9/y", "frobnicate freely forever")], "doc_id long, path string, text string")
    got = {r.id: r.license for r in license_scan(df).collect()}
    assert got == {0: "CC-BY-SA-4.0", 1: "GPL-2.0", 2: "GPL-3.0", 3: None, 9: None}
    assert {r.id: r.license for r in license_scan(df, templates={"own": ["frobnicate freely forever"]}).collect()}[9] == "own"


def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    logged = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [(None, None)], 7: [("", "")], 8: [a, c]}
    rows = [(k, i, *t) for k, v in logged.items() for i, t in enumerate(v)] + [(None, 0, "user", "lost")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in render_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {3: (3, 2), 5: (1, 1), 6: (1, 1), 7: (1, 1), 8: (2, 1), None: (1, 1)}
