"""Exact dedup by deterministic block naming: no hash decides that two texts are equal.

A text without its white space is cut into blocks of ``block_bytes``. Distinct blocks are sorted and get integer names; the
names of adjacent pairs are named in turn until one name is left per document: equal names then mean equal texts of the
same number of blocks. Blocks travel as lossless zstd frames, so equality of frames is equality of blocks.

Documents are read in chunks. A chunk sends each of its distinct blocks once and gets the names back by position, so that a
block of a third of all documents is sent once a chunk, and no document's text is joined.

Defined cases: null text counts as empty; all empty texts are one group; of equal texts the longest original stays, then
the smallest id (null ids last); repeated rows are members like any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, materialize, scratch, text_input

SPACE = b" \t\n\x0b\x0c\r"
_ROW = pa.struct([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("at", pa.list_(pa.int32()))])
_CHUNK = "rows array<struct<doc_id:bigint,n_chars:bigint,text_sha256:string,at:array<int>>>, blocks array<binary>"


def _blocks(block_bytes: int, max_bytes: int):
    schema = pa.schema([("rows", pa.list_(_ROW)), ("blocks", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress
        rows, seen, size = [], {}, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rows], schema.field(0).type), pa.array([list(seen)], schema.field(1).type)], schema=schema)

        for part, texts in doc_chunks(batches, max_bytes=1 << 20):
            for doc, text in zip(part.column(0).to_pylist(), texts):
                bare = text.translate(None, SPACE)
                at = [seen.setdefault(pack(bare[i : i + block_bytes]), len(seen)) for i in range(0, max(1, len(bare)), block_bytes)]
                rows.append({"doc_id": doc, "n_chars": len(text.decode("utf-8", "replace")), "text_sha256": hashlib.sha256(bare).hexdigest(), "at": at})
            if (size := size + sum(map(len, texts))) >= max_bytes or len(rows) >= 1 << 20:
                yield done()
                rows, seen, size = [], {}, 0
        if rows:
            yield done()

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for blocks that come sorted: the shard's number and the block's rank in the shard."""
    base, rank, last = TaskContext.get().partitionId() << 40, -1, None
    for batch in batches:
        names = []
        for block in batch.column(0).to_pylist():
            if block != last:
                rank, last = rank + 1, block
            names.append(base + rank)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names, pa.int64())], names=["chunk", "pos", "name"])


def _named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sequence of names, from its chunk's places and the names that came back."""
    for batch in batches:
        for chunk in batch.to_pylist():
            name = np.zeros(len(chunk["named"]), np.int64)
            for x in chunk["named"]:
                name[x["pos"]] = x["name"]
            rows = chunk["rows"]
            first = (chunk["chunk"] >> 33 << 41) + ((chunk["chunk"] & (1 << 33) - 1) << 21)  # the partition's number, the chunk's, the row's
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + i for i in range(len(rows))], pa.int64()), *(pa.array([r[k] for r in rows], _ROW.field(k).type) for k in ("doc_id", "n_chars", "text_sha256")), pa.array([name[r["at"]] for r in rows], pa.list_(pa.int64()))],
                names=["row_id", "doc_id", "n_chars", "text_sha256", "names"],
            )


def _pair_names(seqs: DataFrame, level: int) -> DataFrame:
    """(row_id, names): every pair of neighbours in a sequence replaced by its name; an odd last one is paired with -1."""
    steps = F.transform(F.sequence(F.lit(0), F.expr("size(names) - 1"), F.lit(2)), lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")))
    pairs = materialize(seqs.filter(F.size("names") > 1).select("row_id", F.posexplode(steps).alias("pos", "p")).select("row_id", "pos", "p.a", "p.b"), f"pairs{level}")
    unique = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).sortWithinPartitions("a", "b")
    names = materialize(unique.select("a", "b", F.monotonically_increasing_id().alias("name")), f"names{level}")
    renamed = pairs.join(names, ["a", "b"]).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("s"))
    return materialize(renamed.select("row_id", F.transform("s", lambda x: x["name"]).alias("names")), f"seqs{level}")


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192, chunk_bytes: int = 16 << 20) -> DataFrame:
    """(row_id, doc_id, n_chars, text_sha256, level, name): (level, name) is the collision-free identity of the normalised text."""
    raw = text_input(docs, id_col, text_col).mapInArrow(_blocks(block_bytes, chunk_bytes), _CHUNK)
    chunks = materialize(raw.withColumn("chunk", F.monotonically_increasing_id()), "blocks")
    sent = chunks.select("chunk", F.posexplode("blocks").alias("pos", "block")).repartition("block").sortWithinPartitions("block")
    named = materialize(sent.select("block", "chunk", "pos").mapInArrow(_number, "chunk long, pos int, name long"), "names0")
    back = named.groupBy("chunk").agg(F.collect_list(F.struct("pos", "name")).alias("named"))  # one entry a block of the chunk
    rows = materialize(chunks.select("chunk", "rows").join(back, "chunk").mapInArrow(_named_rows, "row_id long, doc_id long, n_chars long, text_sha256 string, names array<long>"), "seqs0")
    seqs, level = rows.select("row_id", "names"), 0
    longest = rows.agg(F.max(F.size("names"))).first()[0] or 1
    done = [seqs.filter(F.size("names") == 1).select("row_id", F.lit(0).alias("level"), F.col("names")[0].alias("name"))]
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        seqs = _pair_names(seqs, level)
        done.append(seqs.filter(F.size("names") == 1).select("row_id", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return rows.select("row_id", "doc_id", "n_chars", "text_sha256").join(ids, "row_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    with scratch() as keep:
        named = keep(materialize(block_names(docs, id_col, text_col, block_bytes), "identities"))
    best = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    groups = materialize(named.groupBy("level", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("level", "name", "group_size", F.col("best.row_id").alias("keep_row"), F.col("best.doc_id").alias("keep_id"))
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
