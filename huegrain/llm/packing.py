"""Lexical retrieval packing: BM25 neighbours of each seed document fill its window.

Whole windows of a document stand alone. The rests are dealt to shards of some thousand documents by their words: the nearest of
some centres (k-means over hashed BM25 vectors, fitted on a bounded sample), and within a centre by the weightiest term, so that
copies meet. Each shard holds an inverted index of its documents, with document frequencies and mean length of the whole corpus. Its
documents are seeds in turn: a seed's best unused neighbours under all its terms go into its window, best first; the last is cut at the
window's end, and its rest stays unused, to be found by another. The search is exact within a shard; a neighbour in another shard is not
seen, so that work grows with documents, not with their square. Windows for which the shard has nothing unused with a common term are
joined end to end; what is left of that is cut into sequences of powers of two, so that nothing is padded.

Defined cases: null text is empty (one token, the separator); an empty table gives no pieces; repeated rows are packed each
by itself; documents of equal score are taken in the order of a hash of their content, equal ones of that in any order; texts of
any length are packed whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import doc_chunks, in_one_task, materialize, mix64, shuffle_width, text_input

#: the pre-tokenisation of byte-level BPE files that use their library's own pattern (public, as in the first such vocabulary)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: compared at load: contractions, runs of space, digits, scripts, marks, control characters, special tokens, no text
_AWKWARD = ("", " ", "  a  b ", "I'll they've DON'T 's", "a\n\n b\t\tc \r\n", "x1234567890 12.5%", "naïve Ünïcode ß İ ſ", "日本語のテキスト 漢字", "e\u0301 \u200b\ufeff", "🙂👩‍👩‍👧", "\x00\x1c\x85\u2028z", "<|endoftext|> a<|endoftext|>b", "----====____", "العربية עברית हिन्दी")


class Encoder:
    """The ids that the tokenizers library gives for the file. Byte-level files whose ids are in the order of their merges are
    run by tiktoken, which gives the same ids four times as fast, if it does so on awkward texts; any other file by tokenizers
    itself, and so are texts of four million characters and more, on which the fast one's regular expression may overflow."""

    LONG = 1 << 22

    def __init__(self, path: str):
        self._slow, self._fast = tokenizer(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        if model["type"] == "BPE" and level and plain and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            byte, special = _byte_of(), {x["content"]: x["id"] for x in added}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
                import tiktoken

                self._special = set(special)
                self._fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
                if any(self.fast(x).tolist() != self.slow(x).tolist() for x in _AWKWARD):
                    self._fast = None

    def fast(self, text: str) -> np.ndarray:
        return self._fast.encode_to_numpy(text, allowed_special=self._special)

    def slow(self, text: str) -> np.ndarray:
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        return self.fast(text) if self._fast is not None and len(text) < self.LONG else self.slow(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.binary()), ("terms", pa.binary()), ("tfs", pa.binary())])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenize(path: str, window: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part, texts in doc_chunks(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), texts):
                ids = np.append(encode(text.decode("utf-8", "replace")).astype(np.uint16), np.uint16(separator))
                whole = len(ids) // window
                terms, tfs = np.unique(ids[:-1], return_counts=True)
                rows.append((doc, len(ids), [_crc(ids[i * window : (i + 1) * window]) for i in range(whole)], ids[whole * window :].tobytes(), terms.tobytes(), tfs.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65536, np.int64)
    for batch in batches:
        blob = b"".join(x or b"" for x in batch.column(0).to_pylist())
        total += np.bincount(np.frombuffer(blob, np.uint16), minlength=65536)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])


def _postings(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, term) of every term in a column of term lists."""
    blobs = lists.to_pylist()
    return np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs]), np.frombuffer(b"".join(blobs), np.uint16)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1024 in integers: products of two of them are exact, however they are added."""
    return np.rint(x * (1024 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))).astype(np.float32)


class Bm25:
    """The weights of terms in documents, from statistics of the whole corpus, and inverted indexes of some of the documents. Weights are
    multiples of 1/64, so that sums of up to 2^18 are exact in whatever order they are added, and ties are ties on every machine."""

    def __init__(self, docs: pa.Table, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = docs.num_rows
        doc, term = _postings(docs["terms"])
        tf = np.frombuffer(b"".join(docs["tfs"].to_pylist()), np.uint32).astype(np.float32)
        length = docs["doc_tokens"].to_numpy().astype(np.float32)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        self._term, self._weight = term, (np.rint(weight * 64) / 64).astype(np.float32)
        self._doc, self._ends = doc, np.searchsorted(doc, np.arange(self.n + 1))

    def _of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``docs``, place in the postings) of their terms."""
        size = self._ends[docs + 1] - self._ends[docs]
        return np.repeat(np.arange(len(docs)), size), np.arange(size.sum()) + np.repeat(self._ends[docs] - (np.cumsum(size) - size), size)

    def index(self, docs: np.ndarray) -> Index:
        place, at = self._of(docs)
        return Index(self, len(docs), place, self._term[at], self._weight[at])

    def terms(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, at = self._of(docs)
        return place, self._term[at]

    def vectors(self) -> np.ndarray:
        """Every document as a vector of length 1024, in integers: each term's weight goes to one of ``DIMS`` places with a sign, both from its hash."""
        h = mix64(np.arange(65536))
        sign = np.where(h >> np.uint64(63), np.float32(1), np.float32(-1))
        flat = self._doc * DIMS + (h % np.uint64(DIMS)).astype(np.int64)[self._term]
        x = np.bincount(flat, self._weight * sign[self._term], self.n * DIMS).reshape(self.n, DIMS)
        return _scaled(x)

    def signatures(self) -> np.ndarray:
        """Each document's weightiest term (ties: the smallest; -1: none): copies share it, near copies mostly."""
        order = np.lexsort((self._term, -self._weight, self._doc))
        out, some = np.full(self.n, -1), np.diff(self._ends) > 0
        out[some] = self._term[order[self._ends[:-1][some]]]
        return out


class Index:
    """Postings by term; terms that many of the documents have are held as a dense matrix."""

    def __init__(self, corpus: Bm25, n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self._corpus, self.n = corpus, n
        order = np.argsort(term, kind="stable")
        self._doc, self._weight = doc[order], weight[order]
        self._df = np.bincount(term, minlength=65536)
        self._at = np.cumsum(self._df) - self._df
        heavy = np.flatnonzero(self._df > max(n // 16, 8))
        self._column = np.full(65536, -1)
        self._column[heavy] = np.arange(len(heavy))
        self._dense = np.zeros((len(heavy), n), np.float32)
        has = self._column[term]
        self._dense[has[has >= 0], doc[has >= 0]] = weight[has >= 0]

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """The score of every document of the index under all terms of each seed."""
        owner, term = self._corpus.terms(seeds)
        column = self._column[term]
        x = np.zeros((len(seeds), len(self._dense)), np.float32)
        x[owner[column >= 0], column[column >= 0]] = 1
        score = x @ self._dense
        rare = (column < 0) & (self._df[term] > 0)
        owner, term = owner[rare], term[rare]
        size = self._df[term]
        at = np.arange(size.sum()) + np.repeat(self._at[term] - (np.cumsum(size) - size), size)
        score += np.bincount(np.repeat(owner * self.n, size) + self._doc[at], self._weight[at], len(seeds) * self.n).reshape(score.shape)
        return score


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores above zero, best first (ties: the first place)."""
    floor = np.partition(score, len(score) - k)[len(score) - k] if k < len(score) else 0
    near = np.flatnonzero((score >= floor) & (score > 0))
    return near[np.argsort(-score[near], kind="stable")[:k]]


def fill_windows(corpus: Bm25, size: np.ndarray, window: int, k: int, batch: int = 64) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, from, to). Each seed takes its best unused neighbours, best first; the last is cut at the window's end,
    and its rest stays unused. Whole documents are seeds before rests. Scores are worked out for some seeds at a time."""
    at = np.zeros(corpus.n, np.int64)  # what is used of each document
    bare = np.diff(corpus._ends) == 0  # no term: no neighbour
    windows = [[(int(r), 0, int(size[r]))] for r in np.flatnonzero(bare)]
    at[bare] = size[bare]
    live, index = np.zeros(0, np.int64), None

    def use(r: int, room: int) -> tuple[int, int, int]:
        a, at[r] = int(at[r]), min(at[r] + room, size[r])
        return r, a, int(at[r])

    while len(left := np.flatnonzero(at < size)):
        if index is None or 2 * len(left) < len(live):
            live, index = left, corpus.index(left)
        seeds = left[np.argsort(at[left] > 0, kind="stable")][: min(batch, max(len(left) // 8, 1))]
        for r, before, score in zip(seeds.tolist(), at[seeds].tolist(), index.scores(seeds)):
            if at[r] > before:
                continue  # an earlier seed has taken some of it
            items = [use(r, window)]
            room = window - (items[0][2] - items[0][1])
            while room and len(near := live[best(np.where(at[live] < size[live], score, 0), k)]):
                for d in near.tolist():
                    if room:
                        items.append(use(d, room))
                        room -= items[-1][2] - items[-1][1]
            windows.append(items)
    return windows


def _close(windows: list[list[tuple[int, int, int]]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences without padding: full windows as they are; the others end to end, cut anew, the last in powers of two."""
    loose: list[tuple[int, int, int]] = []
    for items in windows:
        if sum(b - a for _, a, b in items) == window:
            yield items
        else:
            loose += items
    left = sum(b - a for _, a, b in loose)
    loose.reverse()
    for size in [window] * (left // window) + [1 << b for b in range((left % window).bit_length() - 1, -1, -1) if left % window >> b & 1]:
        out, room = [], size
        while room:
            r, a, b = loose.pop()
            take = min(b - a, room)
            out.append((r, a, a + take))
            room -= take
            if a + take < b:
                loose.append((r, a + take, b))
        yield out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack_shards(idf: np.ndarray, mean: float, window: int, k: int, shard_docs: int, block_bytes: int = 64 << 20):
    """Rows sorted by shard. A shard is packed in one go; one that grew beyond twice its size, in memory or in rows, in blocks."""

    def pack(parts: list[pa.RecordBatch], lot: int, first: int) -> pa.RecordBatch:
        docs = pa.Table.from_batches(parts).combine_chunks()
        rest = [np.frombuffer(x, np.uint16) for x in docs["rest"].to_pylist()]
        tokens, ids, out = docs["doc_tokens"].to_pylist(), docs["doc_id"].to_pylist(), []
        windows = fill_windows(Bm25(docs, idf, mean), np.array([len(x) for x in rest]), window, k)
        for sequence, items in enumerate(_close(windows, window), (lot << 32) + first):
            offset = 0
            for r, a, b in items:
                out.append((ids[r], tokens[r] // window * window + a, b - a, _crc(rest[r][a:b]), tokens[r], sequence, offset))
                offset += b - a
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        lot, rows, weight, first = -1, 0, 0, 0
        for batch in batches:
            lots = batch["lot"].to_numpy()
            load = pc.binary_length(batch["terms"]).to_numpy(zero_copy_only=False)
            a = 0
            while a < batch.num_rows:
                same = int(np.searchsorted(lots, lots[a], side="right"))
                if held and (lots[a] != lot or rows >= 2 * shard_docs or weight >= block_bytes):
                    found = pack(held, lot, first)
                    yield found
                    first += found.num_rows
                    held, rows, weight = [], 0, 0
                if lots[a] != lot:
                    lot, first = int(lots[a]), 0
                z = min(same, a + 2 * shard_docs - rows, a + 1 + int(np.searchsorted(np.cumsum(load[a:same]), block_bytes - weight)))
                held.append(batch.slice(a, z - a))
                rows, weight, a = rows + z - a, weight + int(load[a:z].sum()), z
        if held:
            yield pack(held, lot, first)

    return run


#: places of the vectors that deal documents to shards
DIMS = 1024


def _centroids(leaves: int, turns: int = 12):
    """Spherical k-means over the sample's vectors, from evenly spaced rows; an empty cluster keeps its centre."""

    def fit(rows: list[dict]) -> np.ndarray:
        if not rows:
            return np.zeros((1, DIMS), np.float32)
        x = np.frombuffer(b"".join(r["vector"] for r in rows), np.float32).reshape(-1, DIMS)
        centre = x[np.unique(np.linspace(0, len(x) - 1, leaves).astype(int))].copy()
        for _ in range(turns):
            of = (x @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, of, x)
            centre = np.where(np.bincount(of, minlength=len(centre))[:, None] > 0, _scaled(total.astype(np.float64)), centre)
        return centre

    return fit


def _some(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def _vectorise(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some(batch):
                vectors = Bm25(pa.Table.from_batches([part]), idf, mean).vectors()
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([v.tobytes() for v in vectors], pa.binary())], names=["key", "vector"])

    return run


def _route(idf: np.ndarray, mean: float, centre: np.ndarray):
    """(node, key, leaf, signature): the nearest centre to each document, and what its copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some(batch):
                corpus = Bm25(pa.Table.from_batches([part]), idf, mean)
                leaf = (corpus.vectors() @ centre.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part["node"], part["key"], pa.array(leaf.astype(np.int32)), pa.array(corpus.signatures())], names=["node", "key", "leaf", "signature"])

    return run


def retrieval_pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, separator: int = 0, neighbours: int = 12, shard_docs: int = 4096, most_leaves: int = 256, sample_docs: int = 8192) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every token of every document in one piece. Ids are
    kept as 16 bits; a tokenizer of more than 65,536 ids is refused. Shards hold some ``shard_docs`` documents at every size of the
    table; the centres that deal documents to them (``most_leaves`` at most) are fitted on some ``sample_docs`` documents."""
    if (size := tokenizer(path).get_vocab_size(with_added_tokens=True)) > 1 << 16 or not 0 <= separator < 1 << 16:
        raise ValueError(f"{path} has {size} ids and the separator is {separator}: at most 65,536 ids can be packed")
    raw = text_input(docs, id_col, text_col).mapInArrow(_tokenize(path, window, separator), "doc_id long, doc_tokens long, crcs array<long>, rest binary, terms binary, tfs binary")
    key = F.xxhash64("doc_id", "rest", "terms", "tfs")  # of the content: partners do not depend on how rows are dealt
    rows = materialize(raw.withColumn("node", F.monotonically_increasing_id()).withColumn("key", key), "tokens")
    n, mean = rows.agg(F.count("*"), F.avg("doc_tokens")).first()
    mean = float(mean or 1)
    idf = np.zeros(65536, np.float32)  # as long as the vocabulary, whatever the data
    for term, df in rows.select("terms").mapInArrow(_term_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        idf[term] = math.log(1 + (n - df + 0.5) / (df + 0.5))
    rests = rows.filter(F.length("rest") > 0)
    few = rests.filter((F.length("terms") > 0) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(n, 1)) * (1 << 30))))
    leaves = min(most_leaves, math.ceil(n / shard_docs)) or 1
    vectors = few.select("key", "terms", "tfs", "doc_tokens").mapInArrow(_vectorise(idf, mean), "key long, vector binary")
    centre = in_one_task(vectors, _centroids(leaves), order="key")
    routed = rests.select("node", "key", "terms", "tfs", "doc_tokens").mapInArrow(_route(idf, mean, centre), "node long, key long, leaf int, signature long")
    routed = materialize(routed, "routed")
    counts = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    lots = [max(math.ceil(counts.get(i, 0) / shard_docs), 1) for i in range(len(centre))]
    base = np.cumsum([0, *lots])
    # what more than one row in 1024 share (1024 values at most) would make a hot shard: documents of such a term are dealt by content, rows
    # of such a content one by one
    dealt = routed
    for column, mark in (("signature", "hot"), ("key", "same")):
        many = routed.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > max(n / 1024, shard_docs / 4))
        dealt = dealt.join(F.broadcast(many.select(column, F.lit(True).alias(mark))), column, "left")
    leaf = F.col("leaf") + 1
    by = F.when(F.col("same"), F.xxhash64("key", "node")).when(F.col("hot"), F.xxhash64("key")).otherwise(F.xxhash64("signature"))
    lot = F.element_at(F.array(*[F.lit(int(b)) for b in base[:-1]]), leaf) + F.pmod(by, F.element_at(F.array(*[F.lit(c) for c in lots]), leaf))
    shards = rests.select("node", "doc_id", "doc_tokens", "rest", "terms", "tfs").join(dealt.select("node", "key", lot.cast("long").alias("lot")), "node")
    parts = max(shuffle_width(docs.sparkSession), math.ceil(int(base[-1]) / 4))
    shards = shards.repartition(parts, "lot").sortWithinPartitions("lot", "key", "node")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    whole = rows.select("doc_id", F.posexplode("crcs").alias("i", "ids_crc32"), "doc_tokens")
    whole = whole.select("doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shards.mapInArrow(_pack_shards(idf, mean, window, neighbours, shard_docs), schema).unionByName(whole)
