"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint and count arrays.

Lines are reduced to 128-bit hashes; their document counts are a plain (partially aggregated) ``groupBy``. The counted
hashes are dealt to shards of bounded size; each shard becomes one row holding a minimal perfect hash and three arrays
(fingerprint, count, keeper). Documents send hashes, never lines, to the shards and probe the arrays there.

Defined cases: null or empty text is one empty line; a row with a null id is no evidence and returned as it is; repeated
rows of one id count once and lose the same lines; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, materialize, mix64, shuffle_width, text_input


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, ASCII-lower-cased line, if it has ``min_chars`` code points. bytes.strip takes off exactly [\\x20\\x09-\\x0D]."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


class PerfectHash:
    """A minimal perfect hash by levels of bit arrays: keys alone in their cell of a level are placed there, the rest go on.

    A key's slot is the rank of its bit over all levels, so n keys take slots 0..n-1.
    """

    GAMMA = 2.0

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.base = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.rank = [np.concatenate([[0], np.cumsum(b)]).astype(np.int64) for b in bits]

    @staticmethod
    def cell(h1: np.ndarray, h2: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix64(h1 ^ mix64(h2 + np.uint64(level * 2 + 1))) % np.uint64(width)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        bits = []
        while len(h1):
            width = max(64, int(len(h1) * cls.GAMMA))
            at = cls.cell(h1, h2, len(bits), width)
            alone = np.bincount(at, minlength=width) == 1
            bits.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(bits)

    def slot(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, bits in enumerate(self.bits):
            at = self.cell(h1[todo], h2[todo], level, len(bits))
            here = bits[at]
            out[todo[here]] = self.base[level] + self.rank[level][at[here]]
            todo = todo[~here]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.bits], b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def load(cls, widths: list[int], blob: bytes) -> "PerfectHash":
        bits, at = [], 0
        for w in widths:
            n = (w + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, n, at), count=w).astype(bool))
            at += n
        return cls(bits)


def _u(series) -> np.ndarray:
    return np.asarray(series, np.int64).view(np.uint64)


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix64(h2 + h1 * np.uint64(3)) >> np.uint64(32)).astype(np.uint32)


_HASHES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])


def _split128(n: int) -> tuple[int, int]:
    return n >> 64, n & 0xFFFFFFFFFFFFFFFF


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in doc_chunks(batches):
            hi, lo, ids = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), texts):
                if doc is None:
                    continue
                seen = {xxhash.xxh3_128_intdigest(k) for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                for n in seen:
                    a, b = _split128(n)
                    hi.append(a), lo.append(b), ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.array(ids, pa.int64())], schema=_HASHES)

    return run


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = _u(pdf.h1), _u(pdf.h2)
    mph = PerfectHash.build(h1, h2)
    slot = mph.slot(h1, h2)
    fp, count, keeper = np.empty(len(slot), np.uint32), np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
    fp[slot], count[slot], keeper[slot] = fingerprint(h1, h2), pdf.n_docs, pdf.keeper
    widths, blob = mph.dump()
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "load": [int(count.sum())], "widths": [widths], "mph": [blob], "fp": [fp.tobytes()], "counts": [np.minimum(count, 2**32 - 1).astype(np.uint32).tobytes()], "keepers": [keeper.tobytes()]})


_INDEX = "shard long, load long, widths array<long>, mph binary, fp binary, counts binary, keepers binary"


def _probe(min_docs: int):
    def run(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(probes):
            return pd.DataFrame({"doc_id": [], "h1": [], "h2": []}).astype("int64")
        row = index.iloc[0]
        mph = PerfectHash.load(list(row.widths), row.mph)
        h1, h2 = _u(probes.h1), _u(probes.h2)
        slot = mph.slot(h1, h2)
        member = (slot >= 0) & (np.frombuffer(row.fp, np.uint32)[slot] == fingerprint(h1, h2))
        drop = member & (np.frombuffer(row.counts, np.uint32)[slot] >= min_docs) & (np.frombuffer(row.keepers, np.int64)[slot] != probes.doc_id.to_numpy())
        return probes.loc[drop, ["doc_id", "h1", "h2"]]

    return run


def _rewrite(min_chars: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in doc_chunks(batches):
            drops = part.column(part.schema.get_field_index("drops")).to_pylist()
            rows = []
            for doc, text, drop in zip(part.column(0).to_pylist(), texts, drops):
                lines = kept = text.split(b"\n")
                if drop:
                    gone = {(d["h1"], d["h2"]) for d in drop}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _signed(xxhash.xxh3_128_intdigest(k)) not in gone]
                out = text if len(kept) == len(lines) else b"\n".join(kept)
                rows.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(out).hexdigest()) + ((out.decode("utf-8", "replace"),) if with_text else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return run


def _signed(n: int) -> tuple[int, int]:
    a, b = _split128(n)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 500_000, probes_per_group: int = 500_000, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, text]): lines whose key is in ``min_docs`` documents stay in the largest id only."""
    src = text_input(docs, id_col, text_col)
    hashes = materialize(src.mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc_id long").distinct(), "line_hashes")
    n = hashes.count()
    shards = max(min(shuffle_width(docs.sparkSession), n // 2000), math.ceil(n / keys_per_shard), 1)
    sharded = F.pmod(F.col("h1"), F.lit(shards))
    counted = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).withColumn("shard", sharded)
    index = materialize(counted.groupBy("shard").applyInPandas(_build_shard, _INDEX), "line_index")
    # a shard that more documents probe than others is probed by several groups, each with its own copy of the arrays
    per_group = max(1, min(probes_per_group, math.ceil(1.5 * n / shards)))
    groups = index.select("shard", F.ceil(F.col("load") / per_group).cast("long").alias("groups"))
    probes = hashes.withColumn("shard", sharded).join(F.broadcast(groups), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("groups")))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("load") / per_group).cast("long") - 1)))
    dropped = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_probe(min_docs), "doc_id long, h1 long, h2 long")
    drops = dropped.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    rows = src.filter("doc_id is not null").join(drops, "doc_id", "left")
    rows = rows.unionByName(src.filter("doc_id is null"), allowMissingColumns=True)  # they meet in no task of the join
    return rows.mapInArrow(_rewrite(min_chars, with_text), schema)
