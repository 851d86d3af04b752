"""Phrase collocations: contiguous phrases of 2 to 4 words, counted exactly, scored against their best-bound cut.

Words found often enough are numbered for each language (a phrase is never more frequent than its words), and pieces are broken
at all others. Ids of an n-gram are packed into one fixed-width binary key: twelve 16-bit digits, three a word, zeros behind.
Each chunk of texts sorts its keys by radix and counts runs of equal ones, so a phrase travels once a chunk. Keys are dealt by ranges of
a scrambled leading digit, 256 ranges a round and as many rounds as it takes until a range fits ``keys_per_shard``; the last one
sorts each range by radix and adds up its runs.

Rows between Spark's stages are blocks of keys, at most 256 a chunk. No task holds more than a chunk or a range; a language of a third of all rows
is many chunks, a word of a third of all words is one row a chunk.

Defined cases: null texts are empty; null languages are ``und``, with rows that say so; repeated rows count again; a text of any length
is one row of one chunk; words are compared by their bytes; ties are ranked by count, then phrase; extra columns are ignored; an
empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_chunks, materialize, mix64, scratch

#: A-Z to a-z; marks between pieces to line feeds; the tabulator to a space.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
#: Words at most, and 16-bit digits of a word's id.
_WORDS, _WIDE = 4, 3
_ID_SHARDS = 4096


def _local(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, bytes]:
    """Distinct words, their counts, and the texts as numbers of these words from 1, 0 between pieces (int32, compressed)."""
    tokens = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    said, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    number, words = np.full(len(said), -1, np.int32), []
    for i, word in enumerate(said):
        if word == b"\n":
            number[i] = 0
        elif word:
            words.append(word)
            number[i] = len(words)
    stream = number[at]
    stream = stream[stream >= 0]
    return words, np.bincount(stream, minlength=len(words) + 1)[1:], zstandard.ZstdCompressor(level=3).compress(stream.tobytes())


_CHUNK = "lang string, words array<binary>, counts array<bigint>, n bigint, stream binary"


def _chunks(max_bytes: int):
    names = ["lang", "words", "counts", "n", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                words, counts, stream = _local(held.pop(lang))
                columns = [pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([int(counts.sum())], pa.int64()), pa.array([stream], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for part, texts in doc_chunks(batches, max_bytes=1 << 20):
            for lang, text in zip(part.column(0).to_pylist(), texts):
                held.setdefault(lang, []).append(text)
            if (size := size + sum(map(len, texts))) >= max_bytes:
                yield from done()
                size = 0
        yield from done()

    return run


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The stable order of keys by their 16-bit digits, the first row the most significant: one counting pass for each digit that varies."""
    order = np.arange(digits.shape[1])
    for digit in digits[::-1]:
        if digit.size and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit integers by radix
    return order


def run_lengths(digits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = radix_order(digits)
    digits = digits[:, order]
    first = np.ones(digits.shape[1], bool)
    first[1:] = (digits[:, 1:] != digits[:, :-1]).any(0)
    return digits[:, first], np.add.reduceat(counts[order], np.flatnonzero(first)) if len(order) else counts


def keys(ids: np.ndarray) -> np.ndarray:
    """(12, n) 16-bit digits of all 2- to 4-grams of a sequence of ids without a 0 in them."""
    found = []
    for n in range(2, _WORDS + 1):
        if len(ids) < n:
            break
        grams = np.lib.stride_tricks.sliding_window_view(ids, n)
        grams = grams[(grams != 0).all(1)]
        digits = np.zeros((_WORDS * _WIDE, len(grams)), np.uint16)
        for word in range(n):
            for place in range(_WIDE):
                digits[word * _WIDE + place] = grams[:, word] >> 16 * (_WIDE - 1 - place) & 0xFFFF
        found.append(digits)
    return np.concatenate(found, 1) if found else np.zeros((_WORDS * _WIDE, 0), np.uint16)


def _scrambled(digits: np.ndarray) -> np.ndarray:
    """A hash of each key; its leading byte deals the keys to ranges, the next byte those of a range, and so on."""
    found = np.zeros(digits.shape[1], np.uint64)
    for word in range(_WORDS):
        a, b, c = (digits[word * _WIDE + place].astype(np.uint64) for place in range(_WIDE))
        found = mix64(found ^ (a << np.uint64(32) | b << np.uint64(16) | c) + np.uint64(0x9E3779B97F4A7C15))
    return found


def _packed(digits: np.ndarray, counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(digits).view(np.uint8).reshape(len(digits), -1, 2).transpose(0, 2, 1).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    tall = _WORDS * _WIDE
    n = len(raw) // (2 * tall + 8)
    digits = np.ascontiguousarray(raw[: 2 * tall * n].reshape(tall, 2, n).transpose(0, 2, 1)).view(np.uint16)[:, :, 0]
    return digits, np.ascontiguousarray(raw[2 * tall * n :].reshape(8, n).T).view("<i8")[:, 0]


_BLOCK = "shard bigint, block binary"


def _ranges(digits: np.ndarray, counts: np.ndarray, shard: int, level: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the keys, one block for each range of the next leading digit."""
    lead = (_scrambled(digits) >> np.uint64(56 - 8 * level) & np.uint64(0xFF)).astype(np.uint16)
    dealt, counts = run_lengths(np.concatenate([lead[None], digits]), counts)
    cuts = np.flatnonzero(np.diff(dealt[0], prepend=-1) if dealt.shape[1] else [])
    ends = [*cuts[1:], dealt.shape[1]]
    blocks = [_packed(dealt[1:, a:b], counts[a:b]) for a, b in zip(cuts, ends)]
    yield pa.RecordBatch.from_arrays([pa.array([(shard << 8) + int(dealt[0, a]) for a in cuts], pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])


def _first_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(0)[i].as_py()), np.int32)
            named = batch.column(1)[i].values
            ids = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
            ids[named.field("pos").to_numpy() + 1] = named.field("id").to_numpy()
            found = keys(ids[stream])
            yield from _ranges(found, np.ones(found.shape[1], np.int64), 0, 0)


def _next_ranges(level: int, most: int):
    """Blocks of one range, dealt to ranges of its next digit, ``most`` keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (shard != at or size >= most):
                    yield from _ranges(*_joined(held), at, level)
                    held, size = [], 0
                at = shard
                held.append(_unpacked(block))
                size += held[-1][0].shape[1]
        if held:
            yield from _ranges(*_joined(held), at, level)

    return run


def _joined(held: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([d for d, _ in held], 1), np.concatenate([c for _, c in held])


def _frequent(least: int, most: int):
    """(w, f) of the keys of each range that are frequent enough; runs are added up whenever ``most`` keys more are held."""

    def told(held: list) -> pa.RecordBatch:
        digits, counts = run_lengths(*_joined(held))
        digits, counts = digits[:, counts >= least], counts[counts >= least]
        ids = [sum(digits[word * _WIDE + place].astype(np.int64) << 16 * (_WIDE - 1 - place) for place in range(_WIDE)) for word in range(_WORDS)]
        grams = np.stack(ids, 1)
        n = (grams != 0).sum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(grams[grams != 0], pa.int64()))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts, pa.int64())], names=["w", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bound, at = [], 0, most, None
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and shard != at:
                    yield told(held)
                    held, size, bound = [], 0, most
                at = shard
                held.append(_unpacked(block))
                if (size := size + held[-1][0].shape[1]) >= bound:
                    held = [run_lengths(*_joined(held))]
                    size = held[0][0].shape[1]
                    bound = max(most, 2 * size)
        if held:
            yield told(held)

    return run


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words found often enough; ids count from 1 in shards of hashed words, no task numbers them all."""
    often = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    shard = F.pmod(F.xxhash64("lang", "word"), F.lit(_ID_SHARDS))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("lang", "word")).cast("long") - 1
    return materialize(often.withColumn("shard", shard).select("lang", "word", "f", (place * _ID_SHARDS + F.col("shard") + 1).alias("id")), "vocabulary")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, chunk_bytes: int = 8 << 20, keys_per_shard: int = 2 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent phrases (w: ids, f), the vocabulary (lang, word, f, id), and the number of words (lang, n)."""
    told = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    with scratch() as keep:
        chunks = materialize(told.mapInArrow(_chunks(chunk_bytes), _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
        words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("chunk", "lang", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
        vocab = keep(vocabulary(words, least))
        totals = keep(materialize(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals"))
        n_words, last_id = totals.agg(F.sum("n")).first()[0] or 0, vocab.agg(F.max("id")).first()[0] or 0
        if last_id >> 16 * _WIDE:
            raise ValueError(f"id {last_id} does not fit into {16 * _WIDE} bits")
        back = words.join(vocab, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("named"))  # one entry a word of the chunk
        blocks = chunks.select("chunk", "stream").join(back, "chunk").select("stream", "named").mapInArrow(_first_ranges, _BLOCK)
        rounds = max(1, math.ceil(math.log(max(1, (_WORDS - 1) * n_words / keys_per_shard), 256)))
        if rounds > 7:
            raise ValueError(f"{rounds} rounds of ranges for {n_words} words; the hash has 8 bytes")
        for level in range(1, rounds):
            blocks = blocks.repartition("shard", F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("shard").mapInArrow(_next_ranges(level, keys_per_shard), _BLOCK)
        found = blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_frequent(least, keys_per_shard), "w array<bigint>, f bigint")
        grams = keep(materialize(found, "phrases"))
    return grams, vocab, totals


def _big(column: str):
    return F.col(column).cast("decimal(20,0)")


def open_phrases(grams: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The phrases (w, a) that no longer frequent phrase around them has at least ``share`` of the occurrences of."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))))
    around = grams.filter(F.size("w") > 2).select(F.explode(inner).alias("w"), "f").groupBy("w").agg(F.max("f").alias("longer"))
    kept = F.col("longer").isNull() | (_big("longer") * share[1] < _big("f") * share[0])
    return grams.join(around, "w", "left").filter(kept).select("w", F.col("f").alias("a"))


def _part(n: int, first: int, words: int):
    """The count of the part of a phrase of n words that starts at word ``first`` (from 0)."""
    return F.element_at("counts", F.lit(10 * first + words))


def _lowest_cut(n: int):
    """The lowest-scoring cut of a phrase of n words as (score, k, l, r); in decimals, since products may pass 64 bits."""
    cuts = []
    for k in range(1, n):
        left, right = _part(n, 0, k), _part(n, k, n - k)
        twice = F.lit(2_000_000).cast("decimal(10,0)") * _big("a")
        score = F.call_function("div", twice, left.cast("decimal(20,0)") + right.cast("decimal(20,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def scored_phrases(phrases: DataFrame, grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases (w, a): the counts of their parts and their words come by one join on the parts."""
    at = lambda first, words: F.struct(F.lit(10 * first + words).alias("slot"), F.slice("w", first + 1, words).alias("part"))
    asked = {n: F.array(*([at(i, 1) for i in range(n)] + [at(0, k) for k in range(2, n)] + [at(k, n - k) for k in range(1, n - 1)])) for n in range(2, _WORDS + 1)}
    by_size = F.coalesce(*[F.when(F.size("w") == n, slots) for n, slots in asked.items()])
    parts = phrases.select("w", "a", F.explode(by_size).alias("x")).select("w", "a", "x.slot", "x.part")
    known = vocab.select(F.array("id").alias("part"), "f", "lang", "word").unionByName(grams.filter(F.size("w") < _WORDS).select(F.col("w").alias("part"), "f"), allowMissingColumns=True)
    found = F.collect_list(F.struct("slot", "f"))  # eight entries at most
    words = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("slot", "word"))))
    whole = parts.join(known, "part").groupBy("w", "a").agg(F.map_from_entries(found).alias("counts"), words.alias("words"), F.max("lang").alias("lang"))
    cut = F.coalesce(*[F.when(F.size("w") == n, _lowest_cut(n)) for n in range(2, _WORDS + 1)])
    phrase = F.array_join(F.transform("words", lambda x: x["word"].cast("string")), " ")
    return whole.select("lang", phrase.alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_phrases(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank, by a knock-out in shards: a language's phrases never meet in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for shards in (4096, 64, 1):
        shard = F.pmod(F.xxhash64("phrase"), F.lit(shards))
        rank = F.row_number().over(Window.partitionBy("lang", shard).orderBy(*order)).cast("long")
        scored = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return scored


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, chunk_bytes: int = 8 << 20, keys_per_shard: int = 2 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of at least ``least`` occurrences."""
    grams, vocab, totals = phrase_counts(docs, lang_col, text_col, least, chunk_bytes, keys_per_shard)
    best = best_phrases(scored_phrases(open_phrases(grams), grams, vocab), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
