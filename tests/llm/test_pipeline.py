"""The stages of the corpus pipeline against brute force, with null and repeated ids, and the whole of them."""

import collections
import re

import pytest

import corpus_pipeline as cp
from huegrain.llm import language_id as lid
from huegrain.llm import toxicity as tox
from huegrain.llm.contracts import tokenizer_file
from huegrain.llm.packing import encoder

LONG = [f"w{i}" for i in range(60)]
ROWS = [(None, "only one"), (None, "same text"), (4, "same text"), (4, "another of id four"), (7, "another  of id four"), (7, "kept for seven"), (None, None), (8, ""), (9, "x y"), (9, "x y")]


def test_exact(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, k long").repartition(3)
    groups = {}
    for k, (i, t) in enumerate(ROWS):
        groups.setdefault(re.sub(r"\s", "", t or ""), []).append((-len(t or ""), i is None, i or 0, t))
    want = sorted(repr((None if m[1] else m[2], m[3])) for m in map(min, groups.values()))
    assert sorted(repr((r.doc_id, r.text)) for r in cp.exact(spark, docs, "").collect()) == want


def test_near(spark):
    near = [" ".join("z" if j == at else w for j, w in enumerate(LONG)) for at in (0, 59)]
    rows = [(None, " ".join(LONG)), (3, near[0]), (3, "a text of its own that nothing else is like"), (5, near[1]), (None, "another text of its own that has no id at all"), (5, "five words of id five here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [rows[i] for i in (1, 2, 4, 5)]
    assert sorted(map(repr, map(tuple, cp.near(spark, docs, "").collect()))) == sorted(map(repr, want))


# ---------------------------------------------------------------- the stages with models, and the whole

WORDS = {"aa": "thorn with shall wherever morning".split(), "bb": "pflug nicht zwei schnell morgen".split()}


def corpus(spark):
    """Documents of two languages, toxic ones, letterless ones, copies and near copies, with ids that are null or repeat."""
    import numpy as np

    random, rows = np.random.default_rng(1), []
    for i in range(160):
        lang = sorted(WORDS)[i % 2]
        text = " ".join(random.choice(WORDS[lang], 50)) + (" blockhead fool" if i % 5 == 0 else "")
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    base = " ".join(f"shall{i}" for i in range(120))
    rows += [(200, base, "aa", "s", 0), (201, "  " + base, "aa", "s", 0), (202, base + " morning", "aa", "s", 0), (None, "thorn with no id of its own", None, None, None), (7, "12 + 34 !", "aa", "s", 0), (None, None, None, None, None), (8, "", "bb", "s", 0), (8, "schnell morgen nicht", "bb", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    corpus(spark).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(160)] + [(7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_model_stages_follow_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = {(r.text,): r for r in lid.language_id(docs.select("doc_id", "text"), lid.fit(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()}
    kept = cp.by_language(spark, docs, folder)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert "thorn with no id of its own" in texts and "schnell morgen nicht" in texts and not {None, "", "12 + 34 !"} & set(texts)
    clear = [r.text for r in docs.collect() if r.text and re.search("[a-z]", r.text) and r.doc_id is not None and r.doc_id < 160 and r.doc_id not in (7, 8) and not said[r.text,].ambiguous]
    assert len(clear) > 100 and not set(clear) - set(texts)
    model = tox.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r.text for r in docs.collect()]
    score = dict(zip(want, tox.score_texts([tox.words_of(t or "") for t in want], tox.WordScores(model.table(), tox.GRAMS), model.bias, model.segment)))
    assert sorted(map(repr, (r.text for r in cp.not_toxic(spark, docs, folder).collect()))) == sorted(repr(t) for t in want if score[t] < 0.5)
    assert not any("blockhead" in t for t in want if t and score[t] < 0.5)


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = docs.collect()
    assert [r.text for r in kept if "shall0 " in (r.text or "")] in ([r.text] for r in corpus(spark).collect() if r.doc_id in (200, 201, 202))
    encode = encoder(tokenizer_file("byte_bpe_50k.json"))
    tokens = collections.Counter()
    for r in kept:
        tokens[r.doc_id] += len(encode(r.text or "")) + 1
    pieces, seqs = collections.Counter(), collections.defaultdict(list)
    for r in cp.run(spark, folder).collect():
        pieces[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert pieces == tokens
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name


def test_stages_keep_columns_of_any_name(spark, folder):
    """Columns named as the stages' own come through with their values; an empty table goes through with its columns."""
    from pyspark.sql import functions as F

    extra = {"_row": "r", "_Score": "s", "_said": "l", "_group": "g", "_place": "p", "keep_id": "k", "component_id": "c"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c, v in extra.items()})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == v + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c, v in extra.items()), name
        if name in ("exact_dedup", "ngram_jaccard"):
            assert stage(spark, docs.limit(0), folder).count() == 0
