"""Language ID by error-correcting output codes over character n-grams.

Every language has a codeword; one binary linear classifier a bit predicts it from the mean of the words' hashed n-gram
weights. Decoding weighs each bit's logistic loss by how well that bit is told apart in the sample, takes the codeword of
least loss, and flags texts whose two best codewords are close. The sample is bounded by ``per_language``.

Defined cases: null text and text without a letter are ``und`` with score 0 (never ambiguous); ties go to the first language by
name; without any labelled row all are ``und``; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, in_one_task, text_input
from .toxicity import held_out
from .wordbag import Adam, Vocabulary, WordScores, features, scatter_means, word_means, words_of

GRAMS = (1, 2, 3)
SCALE = 20.0
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +-1: all splits of the languages in two while they are few, else random columns that split them evenly."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if i == 0 or m >> (i - 1) & 1 else -1 for i in range(n)] for m in range(2 ** (n - 1) - 1)]
    else:
        random, half = np.random.default_rng(seed), np.array([1] * (n // 2) + [-1] * (n - n // 2))
        columns = [random.permutation(half) for _ in range(int(12 * np.ceil(np.log2(n))))]
    return np.array(columns, float).T


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray
    table: np.ndarray  # (buckets, bits)
    bias: np.ndarray
    weight: np.ndarray  # (languages, bits)
    margin: float


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, epochs: int = 30, margin: float = 0.15) -> LanguageModel:
    names = tuple(sorted(set(langs)))
    codes = codewords(len(names))
    table, bias = np.zeros((buckets, codes.shape[1])), np.zeros(codes.shape[1])
    if len(names) < 2:
        return LanguageModel(names, codes, table.astype(np.float32), bias, np.ones_like(codes), margin)
    target = codes[[names.index(x) for x in langs]]
    vocabulary = Vocabulary(texts)
    owner, bucket = features(vocabulary.words, GRAMS, buckets)
    word, count = np.concatenate(vocabulary.texts), np.array([len(t) for t in vocabulary.texts])
    doc, n = np.repeat(np.arange(len(texts)), count), np.maximum(count, 1)[:, None]
    share = 1 / np.unique(langs, return_counts=True)[1][[names.index(x) for x in langs]] / len(names)
    adam = Adam(0.05)
    for _ in range(epochs):
        vectors = word_means(owner, bucket, len(vocabulary.words), table)
        f = SCALE * np.stack([np.bincount(doc, weights=vectors[word, c], minlength=len(texts)) for c in range(table.shape[1])], axis=1) / n + bias
        d_f = -target / (1 + np.exp(np.clip(target * f, -40, 40))) * share[:, None]
        d_word = SCALE * (d_f / n)[doc]
        d_vectors = np.stack([np.bincount(word, weights=d_word[:, c], minlength=len(vocabulary.words)) for c in range(table.shape[1])], axis=1)
        adam.tick()
        table = adam.step("table", table, scatter_means(owner, bucket, d_vectors, buckets) + 1e-6 * table)
        bias = adam.step("bias", bias, d_f.sum(axis=0))
    right = (np.sign(f) == target).astype(float)
    weight = np.stack([right[[x == name for x in langs]].mean(axis=0) for name in names]) + 1e-3
    return LanguageModel(names, codes, table.astype(np.float32), bias, weight / weight.sum(axis=1, keepdims=True), margin)


def decode(model: LanguageModel, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each row of bit margins."""
    loss = np.log1p(np.exp(-np.clip(model.codes[None] * f[:, None, :], -40, 40)))
    total = (loss * model.weight[None]).sum(axis=2)
    best = total.argmin(axis=1)
    e = np.exp(-model.codes.shape[1] * (total - total.min(axis=1, keepdims=True)))
    ranked = np.sort(total, axis=1)
    close = ranked[:, 1] - ranked[:, 0] < model.margin if total.shape[1] > 1 else np.zeros(len(f), bool)
    return best, 1 / e.sum(axis=1), close


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict_texts(model: LanguageModel, scores: WordScores, raw: list[bytes]) -> list[tuple[str, float, bool]]:
    texts = [t.decode("utf-8", "replace") for t in raw]
    if not model.languages:
        return [("und", 0.0, False)] * len(texts)
    words = [words_of(t) for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    flat, doc = scores(words), np.repeat(np.arange(len(texts)), count)
    f = SCALE * np.stack([np.bincount(doc, weights=flat[:, c], minlength=len(texts)) for c in range(flat.shape[1])], axis=1) / np.maximum(count, 1)[:, None] + model.bias
    known = [_LETTER.search(t) is not None for t in texts]
    return [(model.languages[b], float(s), bool(c)) if k else ("und", 0.0, False) for k, b, s, c in zip(known, *decode(model, f))]


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model.table, GRAMS)
        for part, raw in doc_chunks(batches):
            rows = predict_texts(model, scores, raw)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_OUT)[2:]))], schema=_OUT)

    return run


def predictor(model: LanguageModel):
    """A column function: (lang_pred, score, ambiguous) of each text, for filters that keep the other columns in place."""
    kind = pa.struct([_OUT.field(i) for i in (2, 3, 4)])

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = WordScores(model.table, GRAMS)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch], names=["text"])
            found = [r for _, raw in doc_chunks([rows]) for r in predict_texts(model, scores, raw)]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in found], kind.field(i).type) for i in range(3)], fields=list(kind))

    return predict


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, folds: int = 3, fold: int = 1) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold, chosen by hash."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, folds, fold))
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row a language
    if not sizes:
        return train([], [])
    # a share of the hash range that holds half as many again as are wanted; the smallest hashes of it are used
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1.5 * per_language / r["count"])])
    picked = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.element_at(share, F.col(lang_col)))
    sample = picked.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))

    def kept(rows: list[dict]) -> LanguageModel:
        texts: dict[str, list[str]] = {}
        for row in sorted(rows, key=lambda r: (r["h"], r["doc_id"], r["text"])):
            if len(mine := texts.setdefault(row["lang"], [])) < per_language:
                mine.append(row["text"])
        return train([t for name in sorted(texts) for t in texts[name]], [name for name in sorted(texts) for _ in texts[name]])

    return in_one_task(sample, kept)


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per input row."""
    src = text_input(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", folds, fold))
    return src.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
