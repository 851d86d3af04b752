"""Order MinHash (Marcais et al., 2019): signatures sensitive to edit distance, not only to the set of k-mers.

k-mers are numbered by occurrence, each of ``sketches`` hash functions picks the ``tuple_size`` smallest, which are put back
into text order; the hash of the ordered tuple is one entry of the signature. Likeness is the share of equal entries.

The neighbour query compares each document with an edited copy and with the document of the next smaller id (after the
smallest: the largest). Documents travel once, by ranges of ids; each range also gets the first document of the range after it.

Defined cases: null text is empty; an empty text has the signature of no k-mers (likeness 1 with itself); a text shorter than
``k`` is one k-mer; null ids come last; repeated ids are neighbours in the order of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, mix64, shuffle_width, text_input

_FIRST = -(2**63)


def _odd(seed: int, n: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def order_minhash(text: str, k: int = 8, sketches: int = 32, tuple_size: int = 2) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(sketches, np.uint32)
    width = min(k, len(points))
    mers = np.zeros(len(points) - width + 1, np.uint64)
    for j in range(width):
        mers = mers * np.uint64(0x9E3779B97F4A7C15) + points[j : j + len(mers)]
    n = len(mers)
    order = np.argsort(mers, kind="stable")
    ranked = mers[order]
    place = np.arange(n)
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    mers = mix64(mers + occurrence * np.uint64(0xD1B54A32D192ED03))
    small = (mers >> np.uint64(32)).astype(np.uint32)
    a, b = _odd(0x51ED270B, sketches), _odd(0x85EBCA77, sketches)
    out, step = np.zeros(sketches, np.uint64), max(1, (1 << 22) // n)
    for i in range(0, sketches, step):
        h = small[None, :] * a[i : i + step, None]
        h ^= h >> np.uint32(15)
        h *= b[i : i + step, None]
        rows, chosen = np.arange(len(h)), []
        for _ in range(min(tuple_size, n)):
            at = h.argmin(axis=1)
            h[rows, at] = np.uint32(0xFFFFFFFF)
            chosen.append(at)
        for at in np.sort(np.array(chosen), axis=0):
            out[i : i + step] = mix64(out[i : i + step] * np.uint64(31) + mers[at])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _neighbours(k: int, sketches: int, tuple_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, signature) of the row before
        for part, texts in doc_chunks(batches):
            rows = []
            for doc, where, borrowed, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), texts):
                text = raw.decode("utf-8", "replace")
                if borrowed and (held is None or held[0] != where):
                    continue  # a second row of a borrowed id
                sign = order_minhash(text, k, sketches, tuple_size)
                if held is not None and held[0] == where:
                    changed = edited(held[2], text)
                    other = order_minhash(changed, k, sketches, tuple_size)
                    rows.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[3].astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(held[3], other), likeness(held[3], sign)))
                held = None if borrowed else (where, doc, text, sign)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def _place(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([_FIRST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            where = np.searchsorted(bounds, ids, side="right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], names=[*batch.schema.names, "where"])

    return run


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, sketches: int = 32, tuple_size: int = 2) -> DataFrame:
    """The signature of each document, of its edited copy, and their likeness to each other and to the next document."""
    spark = docs.sparkSession
    src = text_input(docs, id_col, text_col)
    ranges = 4 * shuffle_width(spark)
    ids = src.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("key"))
    cuts = ids.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts, np.int64))
    placed = src.mapInArrow(_place(bounds), "doc_id long, text binary, where long")
    # one row a range: which document its last one borrows (the largest of the next lower range that has any)
    tops = sorted(src.select("doc_id").mapInArrow(_place(bounds), "doc_id long, where long").groupBy("where").agg(F.max(F.coalesce("doc_id", F.lit(_FIRST))).alias("top")).collect())
    lends = [(tops[i - 1].top, r.where) for i, r in enumerate(tops)]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    lent = spark.createDataFrame(lends, "key long, where long")
    borrowed = src.join(F.broadcast(lent), F.coalesce("doc_id", F.lit(_FIRST)) == F.col("key")).select("doc_id", "text", "where", F.lit(True).alias("borrowed"))
    rows = placed.withColumn("borrowed", F.lit(False)).unionByName(borrowed)
    dealt = rows.repartition("where").sortWithinPartitions("where", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    return dealt.mapInArrow(_neighbours(k, sketches, tuple_size), schema)
