"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, so a misspelling shares most of its vector with the word it
is made from. A text is read in segments of ``segment`` words; each segment's mean goes through the softmax, and a text is
as toxic as its segments' softly largest logit, so that length does not water down an insult. The sample of labelled texts
that the model is fitted on is bounded by ``per_class``; scoring covers whole texts.

Defined cases: null, empty and wordless texts have the score of an empty segment (the bias); repeated rows are scored alike;
null labels are not learnt from; without labels of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, in_one_task, text_input
from .wordbag import Adam, Vocabulary, WordScores, features, scatter_means, word_means, words_of

GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class ToxicityModel:
    embeddings: np.ndarray  # (buckets, width)
    softmax: np.ndarray  # (width, 2)
    bias: float
    segment: int

    def table(self) -> np.ndarray:
        """The buckets' part in the logit of class 1 against class 0: the softmax is linear in the embeddings."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0]))[:, None].astype(np.float32)


def _pool(z: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's softly largest logit and the weights of its segments."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, z)
    e = np.exp(2 * (z - top[doc]))
    weight = e / np.bincount(doc, weights=e, minlength=n)[doc]
    return np.bincount(doc, weights=weight * z, minlength=n), weight


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], labels: np.ndarray, buckets: int = 1 << 16, width: int = 2, segment: int = 6, epochs: int = 60, seed: int = 1) -> ToxicityModel:
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (buckets, width))
    out = random.normal(0, 1.0, (width, 2))
    bias = np.array([-2.0])
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(table * 0, out, -40.0, segment)
    vocabulary = Vocabulary(texts)
    owner, bucket = features(vocabulary.words, GRAMS, buckets)
    n_words = len(vocabulary.words)
    word = np.concatenate(vocabulary.texts)
    doc, seg, base = [], [], 0
    for d, t in enumerate(vocabulary.texts):
        k = max(1, -(-len(t) // segment))
        doc += [d] * k
        seg.append(base + np.arange(len(t)) // segment)
        base += k
    doc, seg = np.array(doc), np.concatenate(seg)
    size = np.maximum(np.bincount(seg, minlength=base), segment / 2)
    y, adam = labels.astype(float), Adam(0.1)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 0.5 + 0.5 / len(y)
    for _ in range(epochs):
        direction = out[:, 1] - out[:, 0]
        vectors = word_means(owner, bucket, n_words, table)
        score = vectors @ direction
        z = segment * np.bincount(seg, weights=score[word], minlength=base) / size + bias[0]
        logit, weight = _pool(z, doc, len(y))
        d_z = ((_sigmoid(logit) - y) * share)[doc] * weight
        d_score = np.bincount(word, weights=(segment * d_z / size)[seg], minlength=n_words)
        d_direction = vectors.T @ d_score
        d_table = scatter_means(owner, bucket, d_score[:, None] * direction, buckets)
        adam.tick()
        table = adam.step("table", table, d_table + 1e-7 * table)
        out = adam.step("out", out, np.stack([-d_direction, d_direction], axis=1))
        bias = adam.step("bias", bias, np.array([d_z.sum()]))
    return ToxicityModel(table.astype(np.float32), out.astype(np.float32), float(bias[0]), segment)


def score_texts(words: list[list[str]], scores: WordScores, bias: float, segment: int) -> np.ndarray:
    flat = scores(words)[:, 0].astype(float)
    count = np.array([len(w) for w in words], np.int64)
    segments = np.maximum(1, -(-count // segment))
    base = np.concatenate([[0], np.cumsum(segments)]).astype(np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    seg = np.repeat(base[:-1], count) + inside // segment
    size = np.maximum(np.bincount(seg, minlength=base[-1]), segment / 2)
    z = segment * np.bincount(seg, weights=flat, minlength=base[-1]) / size + bias
    logit, _ = _pool(z, np.repeat(np.arange(len(words)), segments), len(words))
    return _sigmoid(logit)


def scorer(model: ToxicityModel):
    """A column function: the score of each text, for filters that keep the other columns in place."""
    table, bias, segment = model.table(), model.bias, model.segment

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = WordScores(table, GRAMS)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch], names=["text"])
            yield pa.array(np.concatenate([score_texts([words_of(t.decode("utf-8", "replace")) for t in texts], scores, bias, segment) for _, texts in doc_chunks([rows])] or [np.zeros(0)]))

    return score


def _score(table: np.ndarray, bias: float, segment: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(table, GRAMS)
        for part, texts in doc_chunks(batches):
            words = [words_of(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score_texts(words, scores, bias, segment))], schema=schema)

    return run


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, folds: int = 5, fold: int = 0) -> ToxicityModel:
    """Fit on at most ``per_class`` toxic and twice as many other labelled documents outside the held-out fold, chosen by hash."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col, folds, fold)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    chosen = known.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(known.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class))
    # at most 3 per_class ids
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return in_one_task(sample, lambda rows: train([r["text"] for r in rows], np.array([r["label"] for r in rows], int)))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    src = text_input(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", folds, fold))
    scored = src.mapInArrow(_score(model.table(), model.bias, model.segment), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
