"""BPE encoding and decoding through a distinct-word table.

Documents are cut into words (runs without ASCII white space, which no pre-token of the tokenizer crosses) and written as
blocks: a word list and, per document, positions into it. A list is in the order of its words' hashes, so that each of the
shards by hash is a stretch of it. Stretches, not documents, cross the network; a shard encodes each distinct word once,
and the ids come back by block and stretch. The ids that a block holds join the tokenizer's id-to-piece table, and its documents
are decoded with what that join gives. The blocks are a table bucketed by block, so that the answers go to them.

A word that all documents have is sent once a block. The number of shards follows the blocks' words, ``per_shard`` each.

Defined cases: null text is encoded as empty (no ids, digests of nothing); special tokens' strings in a text become their
ids, as in the tokenizers library; repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, doc_chunks, materialize, release, shuffle_width, text_input


def ascii_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(words a text, the words of all of them, dictionary-encoded): runs without [\\x20\\x09-\\x0D]."""
    raw = pa.array(texts, pa.large_binary())
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), raw.buffers()))
    words, cuts = lists.flatten().view(pa.large_binary()), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return np.diff(np.concatenate([[0], np.cumsum(some)])[cuts]), words.filter(pa.array(some)).dictionary_encode()


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _pack(values: np.ndarray) -> bytes:
    """zstd of the byte planes of unsigned 32-bit integers."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("codes", pa.binary()), ("order", pa.binary()), ("n_words", pa.int64()), ("words", pa.binary())])


def _blocks(max_words: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, codes, seen, size = [], [], [], {}, 0

        def done() -> pa.RecordBatch:
            words = sorted((zlib.crc32(w), w) for w in seen)
            place = np.zeros(len(words), np.uint32)
            place[np.fromiter((seen[w] for _, w in words), np.int64, len(words))] = np.arange(len(words))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # small numbers for frequent words compress well
            rank = np.zeros(len(words), np.uint32)
            rank[often] = np.arange(len(words))
            row = (ids, _pack(np.array(counts, np.uint32)), _pack(rank[flat]), _pack(place[often]), len(words), zstandard.compress(b" ".join(w for _, w in words), 3))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for part, texts in doc_chunks(batches, max_bytes=1 << 20):
            n, words = ascii_words([t.decode("utf-8", "replace").encode() for t in texts])
            mine = np.fromiter((seen.setdefault(w, len(seen)) for w in words.dictionary.to_pylist()), np.uint32, len(words.dictionary))
            codes.append(mine[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint32))
            ids += part.column(0).to_pylist()
            counts += n.tolist()
            size += sum(map(len, texts))
            if size >= max_bytes or len(seen) >= max_words:
                yield done()
                ids, counts, codes, seen, size = [], [], [], {}, 0
        if ids:
            yield done()

    return run


def _words(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split()


def _stretches(bits: int):
    """A row for each shard (the first ``bits`` bits of the words' hashes) that a block has words of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row["words"])
                shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> (32 - bits)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(words) else []
                some = [(int(shard[a]), row["block"], zstandard.compress(b" ".join(words[a:z]), 3)) for a, z in zip(cuts[:-1], cuts[1:])]
                for a in range(0, len(some), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some[a : a + 64]), (pa.int64(), pa.int64(), pa.binary()))], names=["shard", "block", "words"])

    return run


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary, special tokens too: as many rows as the tokenizer has, whatever the data."""
    return spark.createDataFrame([(i, p) for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()], "id int, piece string")


_BACK = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n_ids", pa.binary()), ("token_ids", pa.binary())])


def _encode(path: str):
    """Shards come one after another; each distinct word of one is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    at, known = row["shard"], {}
                words = _words(row["words"])
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch([w.decode() for w in new], add_special_tokens=False))))
                ids = [known[w] for w in words]
                out = (row["block"], row["shard"], _pack(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), _pack(np.frombuffer(b"".join(ids), "<u4")))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, _BACK)], schema=_BACK)

    return run


def _distinct_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: the ids that its words have."""
    for batch in batches:
        for row in batch.to_pylist():
            found = np.flatnonzero(np.bincount(np.concatenate([_unpack(x["token_ids"]) for x in row["back"]]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([found], pa.list_(pa.int32()))], names=["block", "ids"])


def _assemble(with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                back = sorted(row["back"] or (), key=lambda b: b["shard"])  # the order of the words
                n_ids = np.concatenate([np.zeros(0, np.int64), *(_unpack(b["n_ids"]) for b in back)]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, "<u4"), *(_unpack(b["token_ids"]) for b in back)]).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(n_ids)])
                piece = {p["id"]: p["piece"].encode() for p in row["pieces"] or ()}
                spelt = [piece[i] for i in flat.tolist()]
                text_of = np.array([b" ".join(spelt[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())], object)
                del spelt
                codes, order, at, out = _unpack(row["codes"]), _unpack(row["order"]).astype(np.int64), 0, []
                for doc, n in zip(row["ids"], _unpack(row["counts"]).tolist()):
                    mine = order[codes[at : at + n]]
                    at += n
                    size = n_ids[mine]
                    total = int(size.sum())
                    ids = flat[np.arange(total) + np.repeat(cuts[mine] - (np.cumsum(size) - size), size)]
                    text = b" ".join(text_of[mine[size > 0]].tolist())
                    out.append((doc, total, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()) + ((ids.astype(np.int32), text.decode()) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, max_words: int = 400_000, max_bytes: int = 32 << 20, per_shard: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) under the tokenizer file ``path``.

    ``path`` must exist on the workers. The tokenizer must drop white space and decode by joining pieces with a space."""
    spark = docs.sparkSession
    raw = text_input(docs, id_col, text_col).mapInArrow(_blocks(max_words, max_bytes), "ids array<long>, counts binary, codes binary, order binary, n_words long, words binary")
    blocks = bucketed(raw.withColumn("block", F.monotonically_increasing_id()), "block", "word_blocks")
    n_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = min(max(n_words // per_shard, shuffle_width(spark), 2).bit_length(), 30)
    sent = blocks.select("block", "words").mapInArrow(_stretches(bits), "shard long, block long, words binary")
    back = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_encode(path), "block long, shard long, n_ids binary, token_ids binary")
    parts = materialize(back.groupBy("block").agg(F.collect_list(F.struct("shard", "n_ids", "token_ids")).alias("back")), "encoded")  # at most a block's words
    held = parts.mapInArrow(_distinct_ids, "block long, ids array<int>").select("block", F.explode("ids").alias("id"))
    spelt = materialize(held.join(F.broadcast(pieces(spark, path)), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces")), "spelt")  # at most the vocabulary
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    answers = parts.join(spelt, "block", "left")
    return blocks.select("block", "ids", "counts", "codes", "order").join(answers, "block", "left").mapInArrow(_assemble(with_ids), schema)
