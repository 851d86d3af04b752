"""N-gram Jaccard join by several global orders of the shingles.

Two sets with Jaccard likeness of at least pct/100 share a token in their prefixes of n - ceil(pct n / 100) + 1 tokens under
*any* global order. Each order puts common shingles last (by a hashed document-frequency table of bounded size, counted over
all documents) and breaks ties by its own hash. The first order's prefixes are an inverted index; a candidate pair must also
share a prefix token under each further order, and the bits in which the sets' tables of parities differ, which are at most as
many as the shingles that only one has, must leave room for a link, before its whole sets are compared.

Identical sets are one class beforehand. Then every class is compared with one class of each index token, its lead; what
that links is one component, and the pairs inside it are never listed. A link that is still missing joins two classes of
tokens whose classes are in several components. Where such a token has more than ``few`` classes, these are indexed anew
under a further order, by the exact number of them that have a shingle: rare shingles come first, so the places of two
classes' first common shingle bound their intersection. Dealt to small cells of a token, they are compared with the leads
of these, which joins nearly all groups. In the end all pairs of different components that share a token of the new index
and whose bound allows a link, or that share a token of few classes, are compared: no link between components is lost. A token of c classes has up to c * c / 2
pairs, and its classes' new index a few rows for each of their shingles: up to some hundred classes, the pairs are fewer.

Defined cases: null, empty or wordless text has an empty set and no links; a text of fewer than ``words`` words has its
whole sequence as one shingle; rows are told apart by position, so an id may repeat; extra columns are ignored. Shingles
are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, materialize, mix64, release, scratch, text_input
from .components import components

ORDERS = (0x51ED270B, 0x9E3779B9, 0x85EBCA77)
PARTS = 32


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of its runs of ``k`` words. bytes.lower and the split are ASCII-only, as the words are
    defined; each distinct word of the texts is hashed once."""
    lowered = pa.array([t.lower() for t in texts], pa.large_binary())
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), lowered.buffers()))
    words, cuts = lists.flatten().view(pa.large_binary()), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(some)])
    counts = np.diff(upto[cuts])
    total = int(counts.sum())
    coded = words.filter(pa.array(some)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = hashes[coded.indices.to_numpy()] if total else np.zeros(0, np.uint64)
    runs = np.zeros(0, np.uint64)
    if total >= k:
        runs = flat[: total - k + 1]
        for j in range(1, k):
            runs = mix64(runs * np.uint64(0x9E3779B97F4A7C15) + flat[j : total - k + 1 + j])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(_distinct(runs[at : at + n - k + 1]))
        elif n:
            short = xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def slots_for(n_docs: int) -> int:
    """Counters of the document-frequency table: twice the documents, between 2^18 and 2^21, so that the table that every task
    gets stays within 2 MiB."""
    return 1 << min(21, max(18, (2 * n_docs).bit_length()))


def prefix_length(n: int, pct: int) -> int:
    return n - (pct * n + 99) // 100 + 1


def _count_slots(k: int, slots: int):
    """The table of a task's documents, in PARTS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(slots, np.int64), [], 0

        def add() -> None:
            nonlocal table, held, size
            if held:
                table += np.bincount((np.concatenate(held) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                held, size = [], 0

        for _, texts in doc_chunks(batches):
            sets = shingle_sets(texts, k)
            held += sets
            if (size := size + sum(map(len, sets))) >= 2 * slots:
                add()
        add()
        if table.any():
            yield _parts(enumerate(table.reshape(PARTS, -1)))

    return run


def _parts(rows) -> pa.RecordBatch:
    rows = [(i, zstandard.compress(x.astype("<i8").tobytes(), 1)) for i, x in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' rows of a part, one at a time, to one."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(zstandard.decompress(row["counts"]), "<i8")
            total[row["part"]] = total[row["part"]] + counts if row["part"] in total else counts
    if total:
        yield _parts(total.items())


def shingle_ranks(src: DataFrame, k: int) -> np.ndarray:
    """A byte for each slot of shingles' hashes: how common they are over all documents, in steps of a quarter of a doubling."""
    slots = slots_for(src.count())
    counts = src.select("doc_id", "text").mapInArrow(_count_slots(k, slots), "part int, counts binary").repartition("part").mapInArrow(_sum_parts, "part int, counts binary")
    common = np.zeros((PARTS, slots // PARTS))
    for part, blob in counts.collect():  # PARTS rows
        common[part] += np.frombuffer(zstandard.decompress(blob), "<i8")
    common = common.ravel()
    return np.floor(4 * np.log2(1 + common / max(1.0, float(np.median(common))))).clip(0, 255).astype(np.uint8)


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bit for each slot of about twice as many slots as shingles: whether an odd number of them fall there. The bits in which two
    sets' tables differ are at most as many as the shingles that only one of them has."""
    width = 1 << max(6, (2 * len(hashes)).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two tables differ; the larger one is folded to the smaller one's width, which keeps parities."""
    x, y = sorted((x, y), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(folded ^ np.frombuffer(x, np.uint8)).sum())


def _prefixes(k: int, pct: int, rank: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary()), ("index", pa.list_(pa.int64())), *((f"p{i}", pa.list_(pa.int32())) for i in range(1, len(ORDERS)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in doc_chunks(batches):
            sets = shingle_sets(texts, k)
            every = np.concatenate(sets)
            own = [mix64(every ^ np.uint64(seed)) for seed in ORDERS]
            common = rank[(every & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
            order = [common | x >> np.uint64(8) for x in own]
            n, k1, k2, bits, prefixes, at = [], [], [], [], [[] for _ in ORDERS], 0
            for s in sets:
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                here = slice(at, at := at + len(s))
                n.append(len(s)), k1.append((key >> 64) - (1 << 63)), k2.append((key & (1 << 64) - 1) - (1 << 63)), bits.append(parity_bits(own[1][here]))
                p = prefix_length(len(s), pct) if len(s) else 0
                for i in range(len(ORDERS)):
                    mine = order[i][here]
                    first = np.argpartition(mine, p - 1)[:p] if 0 < p < len(s) else np.arange(p)
                    prefixes[i].append(mine[first].view(np.int64) if not i else own[i][here][first].astype(np.uint32).view(np.int32))
            lists = [pa.array(x, pa.list_(pa.int64() if not i else pa.int32())) for i, x in enumerate(prefixes)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary()), *lists], schema=schema)

    return run


def _hashes(k: int):
    schema = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in doc_chunks(batches):
            sets = pa.array([s.view(np.int64) for s in shingle_sets(texts, k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), sets], schema=schema)

    return run


def _rare_first(open_: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """(token, row_id, n, root, left): the prefixes of the open classes, rarest shingles first; ``left`` is how many of the
    class's shingles the order does not put before the token. A shingle that one class alone has is counted, not kept."""
    classes = materialize(open_.select("row_id", "n", "root").distinct(), "open_classes")
    text = _only(texts, classes.select("row_id")).join(classes, "row_id").select("row_id", "n", "root", "text")
    body = materialize(text.mapInArrow(_hashes(k), "row_id long, n long, root long, hashes array<long>"), "open_sets")
    all_ = body.select("row_id", F.explode("hashes").alias("token"))
    twice = materialize(all_.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "open_counts")
    order = F.array_sort(F.collect_list(F.struct("df", "token")))  # at most a text's shingles
    mine = all_.join(twice, "token").groupBy("row_id").agg(order.alias("rare"))
    length = F.expr(f"n - (({pct} * n + 99) div 100) + 1")
    lone = F.col("n") - F.size("rare")
    kept = body.select("row_id", "n", "root").join(mine, "row_id").withColumn("lone", lone).filter(F.col("lone") < length)
    kept = kept.select("row_id", "n", "root", "lone", F.posexplode(F.slice("rare", F.lit(1), (length - F.col("lone")).cast("int"))).alias("at", "token"))
    kept = kept.select(F.col("token.token").alias("token"), "row_id", "n", "root", (F.col("n") - F.col("lone") - F.col("at")).alias("left"))
    return materialize(kept, "open_prefixes")


def _verify(k: int, pct: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, np.zeros(0, np.uint64)
        for part, texts in doc_chunks(batches):
            links = []
            for a, b, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(texts, k)):
                if b is None:
                    at, base = a, s
                    continue
                assert a == at, "a pair came before its base"
                where = np.searchsorted(base, s)
                both = int((base[np.minimum(where, len(base) - 1)] == s).sum()) if len(base) else 0
                if 100 * both >= pct * (len(base) + len(s) - both) and both:
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _only(rows: DataFrame, ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows of a table of distinct ``ids``, without moving the others: up to ``most`` ids are broadcast, more are joined."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, "row_id", "left_semi")


def _bounded(pct: int):
    """The pairs whose tables of parities leave room for the intersection that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            kept = [i for i, n in enumerate(map(int.__add__, na, nb)) if (n - differing(x[i], y[i])) * (100 + pct) >= 2 * pct * n]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in kept], pa.int64()) for c in (a, b)], names=["a", "b"])

    return run


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row_id")).unionByName(pairs.select(F.col("b").alias("row_id"))).distinct()


def _checked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, pct: int, per_group: int = 256) -> DataFrame:
    """The links among ``pairs`` (a, b): the further orders' prefixes must meet and the tables of parities leave room for a link;
    then the texts' whole sets are compared.

    Pairs travel to their base ``a``; a base of many pairs is dealt to several groups, each with a copy of its text."""
    more = ["n", "bits", *(f"p{i}" for i in range(1, len(ORDERS)))]
    ids = materialize(_ids(pairs), "asked")
    sketch = materialize(_only(sets.select("row_id", *more), ids), "sketches")
    left = sketch.select(F.col("row_id").alias("a"), *(F.col(c).alias(f"{c}a") for c in more))
    right = sketch.select(F.col("row_id").alias("b"), *(F.col(c).alias(f"{c}b") for c in more))
    meet = pairs.join(left, "a").join(right, "b")
    for c in more[2:]:
        meet = meet.filter(F.arrays_overlap(f"{c}a", f"{c}b"))
    meet = materialize(meet.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_bounded(pct), "a long, b long"), "candidates")
    release(ids, sketch)
    ids = materialize(_ids(meet), "asked")
    body = materialize(_only(texts, ids), "bodies")
    dealt = materialize(meet.groupBy("a").agg(F.ceil(F.count("*") / per_group).cast("long").alias("groups")), "bases")
    probes = meet.join(dealt, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("salt")).join(body, F.col("b") == F.col("row_id")).select("a", "b", "text", "salt")
    bases = dealt.join(body, F.col("a") == F.col("row_id")).select("a", F.lit(None).cast("long").alias("b"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
    rows = bases.unionByName(probes).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = materialize(rows.select("a", "b", "text").mapInArrow(_verify(k, pct), "a long, b long"), "links")
    release(ids, body, dealt, meet)
    return links


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, pct: int = 80, rounds: int = 3, deals: int = 6, few: int = 256, numbered: bool = False) -> DataFrame:
    """(row_id, doc_id, n_shingles, root): root is the row that stands for the row's component. Where the rows are ``numbered``, their ids are
    distinct and ``docs`` is a written table: the id tells them apart, and texts are read from there again instead of being copied."""
    src = text_input(docs, id_col, text_col)
    fields = "doc_id long, text binary, n long, k1 long, k2 long, bits binary, index array<long>" + "".join(f", p{i} array<int>" for i in range(1, len(ORDERS)))
    prefixes = src.mapInArrow(_prefixes(words, pct, shingle_ranks(src, words)), fields)
    rows = materialize(prefixes.drop("text").withColumn("row_id", F.col("doc_id")) if numbered else prefixes.withColumn("row_id", F.monotonically_increasing_id()), "prefixes")
    texts = src.select(F.col("doc_id").alias("row_id"), "text") if numbered else rows.select("row_id", "text")
    whole = materialize(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("row_id").alias("rep")), "classes")
    member = materialize(rows.select("row_id", "doc_id", "n", "k1", "k2").join(whole, ["k1", "k2"], "left").select("row_id", "doc_id", "n", F.coalesce("rep", "row_id").alias("rep")), "members")
    tokens = rows.select("row_id", "n", "index").join(whole.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select(F.explode("index").alias("token"), "row_id", "n")
    near = lambda x, y: (100 * F.least(x, y) >= pct * F.greatest(x, y))
    many = tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token")
    shared = materialize(tokens.join(many, "token"), "shared_tokens")  # the tokens that two classes have
    enough = lambda x, y, nx, ny: F.least(x, y) * (100 + pct) >= pct * (nx + ny)  # noqa: E731  the intersection that a link needs

    def rooted(tokens: DataFrame) -> DataFrame:
        return tokens.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").select("token", "row_id", "n", "left", F.coalesce("root", "row_id").alias("root"))

    def crossing(x: DataFrame) -> DataFrame:
        other = x.select("token", F.col("row_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("left").alias("leftb"))
        return x.join(other, (x.token == other.token) & (F.col("row_id") < F.col("b")) & (F.col("root") != F.col("rb")) & near(F.col("n"), F.col("nb")) & enough(F.col("left"), F.col("leftb"), F.col("n"), F.col("nb"))).select("row_id", "b")

    links = tested = None
    index = shared.withColumn("left", F.col("n"))
    open_ = index.withColumn("root", F.col("row_id"))
    for turn in range(rounds + 1):
        if turn == rounds:
            pairs = crossing(open_).unionByName(crossing(rooted(direct.drop("root"))))
        else:
            if not turn:  # the same order of classes for all tokens, so that the leads of a group of copies are few
                cells, first = open_.withColumn("cell", F.lit(0)), F.xxhash64("row_id")
            else:  # classes that could link to one of their size by this token are dealt by chance, ``deals`` times, to cells of about eight
                fit = open_.filter(enough(F.col("left"), F.col("left"), F.col("n"), F.col("n")))
                wide = materialize(fit.groupBy("token").agg(F.ceil(F.count("*") / 8).alias("wide")), "cells")
                cells = fit.join(wide, "token").withColumn("deal", F.explode(F.array(*map(F.lit, range(deals)))))
                cells = materialize(cells.withColumn("cell", F.col("wide") * F.col("deal") + F.pmod(F.xxhash64("row_id", "token", "deal", F.lit(turn)), "wide")).drop("wide", "deal"), "celled")
                # by turns, the class with least of its own leads, which is nearest to the others, or any class
                first = 2 * pct * F.col("n") - F.col("left") * (100 + pct) if turn % 2 else F.xxhash64("row_id", "cell")
            lead = cells.groupBy("token", "cell").agg(F.min_by(F.struct("row_id", "n", "root", "left"), F.struct(first, "row_id")).alias("lead"))
            pairs = cells.join(materialize(lead, "leads"), ["token", "cell"]).filter((F.col("root") != F.col("lead.root")) & near(F.col("n"), F.col("lead.n")) & enough(F.col("left"), F.col("lead.left"), F.col("n"), F.col("lead.n")))
            pairs = pairs.select(F.least("row_id", "lead.row_id").alias("row_id"), F.greatest("row_id", "lead.row_id").alias("b"))
        pairs = pairs.select(F.col("row_id").alias("a"), "b").distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _checked(pairs, rows, texts, words, pct)
        links = found if links is None else links.unionByName(found)
        roots = materialize(components(links), "roots")
        if turn == rounds:
            break
        part = materialize(rooted(index), "token_roots")
        split = part.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
        open_ = materialize(part.join(split, "token", "left_semi"), "open_tokens")
        if not turn:
            many = materialize(open_.groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") > few).select("token"), "hot_tokens")
            direct = materialize(open_.join(many, "token", "left_anti"), "direct")
            open_ = _rare_first(open_.join(many, "token", "left_semi"), texts, words, pct)
            index = open_.drop("root")
    return member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("root"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, pct: int = 80, few: int = 256, numbered: bool = False) -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id): the smallest id reachable by links."""
    with scratch() as keep:
        rows = keep(materialize(jaccard_classes(docs, id_col, text_col, words, pct, few=few, numbered=numbered), "rows"))
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("row_id", "doc_id", "n_shingles", "component_id")
