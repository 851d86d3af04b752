"""Collocations, mixing and conversation repair against brute force, with nulls, empty and long texts, ties, repeated rows, empty
tables and columns of clashing names."""

import collections
import hashlib
import heapq
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from huegrain.llm.chat_repair import damaged, faulted, repair, repair_report, repaired_lines, solve
from huegrain.llm.collocations import collocations, keys, phrase_counts, radix_order, run_lengths
from huegrain.llm.mixing import mix_plan, mixture

SCHEMA = "doc_id long, text string, lang string, source string, size string, w string, chunk string, n string, rank string, block string, rate string"


def rows_of(texts, langs, sources=None):
    return [(i, t, l, s, *"abcdefg") for i, (t, l, s) in enumerate(zip(texts, langs, sources or [None] * len(texts)))]


def brute_phrases(texts, langs, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        best = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return found


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 2000, "keys_per_shard": 1}, {"chunk_bytes": 500, "keys_per_shard": 40}])
def test_collocations(spark, how):
    random = np.random.default_rng(5)
    common = ["new", "York", "CITY", "of", "the", "é", "日本", "x\x00y", "'"]
    texts = [" ".join(random.choice(common, 40, p=[0.2, 0.2, 0.15, 0.15, 0.1, 0.05, 0.05, 0.05, 0.05])) + random.choice([". ", "\n", "\t", " rare%d " % i, ""]) for i in range(30)]
    texts += [None, "", " \t \n", "new York city", "new york; city", "the of the of the of " * 3000, "one" * 5000 + " of the"] + ["same words again and again"] * 5
    langs = ["en" if i % 3 else None for i in range(len(texts))]
    langs[4], langs[7] = "und", ""
    docs = spark.createDataFrame(rows_of(texts, langs), SCHEMA).repartition(3)
    got = [tuple(r) for r in collocations(docs, least=4, top=25, **how).collect()]
    want = brute_phrases(texts, langs, 4, 25)
    assert sorted(got) == sorted(want) and len(want) > 40
    assert collocations(docs.limit(0)).count() == 0 and collocations(docs, least=10**9).count() == 0


def test_collocations_where_products_pass_64_bits(spark):
    from huegrain.llm.collocations import open_phrases, scored_phrases

    big = 2**55
    grams = spark.createDataFrame([([1, 2], big), ([1, 2, 1], (big * 80) // 100), ([2, 1], big)], "w array<long>, f long")
    vocab = spark.createDataFrame([("en", b"a", 3 * big, 1), ("en", b"b", 2 * big, 2)], "lang string, word binary, f long, id long")
    kept = open_phrases(grams)
    assert sorted(r.w for r in kept.collect()) == [[1, 2], [1, 2, 1], [2, 1]]  # 80 % is rounded down, one short
    got = {r.phrase: (r.l, r.r, r.score) for r in scored_phrases(kept, grams, vocab).collect()}
    assert got["a b"] == (3 * big, 2 * big, 2000000 * big // (5 * big))
    assert got["a b a"] == min(((3 * big, big, 2000000 * (big * 80 // 100) // (4 * big)), (big, 3 * big, 2000000 * (big * 80 // 100) // (4 * big))), key=lambda x: x[2])


def test_radix_and_runs():
    random = np.random.default_rng(2)
    ids = random.integers(0, 4, 4000) * 70000
    digits = keys(ids)
    order = radix_order(digits)
    rows = list(map(tuple, digits.T))
    assert [rows[i] for i in order] == sorted(rows)
    runs, counts = run_lengths(digits, np.ones(len(rows), np.int64))
    assert dict(zip(map(tuple, runs.T), counts)) == collections.Counter(rows)
    assert keys(np.zeros(9, np.int64)).shape == (12, 0) and keys(np.array([5])).shape == (12, 0)


def test_phrases_are_counted_alike_in_any_number_of_rounds(spark):
    random = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in random.zipf(1.5, 300) % 200) for _ in range(40)]
    docs = spark.createDataFrame(rows_of(texts, ["a"] * 20 + ["b"] * 20), SCHEMA).repartition(5)
    found = []
    for how in ({}, {"keys_per_shard": 100}, {"keys_per_shard": 1, "chunk_bytes": 1}):  # one, two and two rounds
        grams, vocab, totals = phrase_counts(docs, least=3, **how)
        word = {r.id: (r.lang, bytes(r.word)) for r in vocab.collect()}
        found.append({tuple(word[i] for i in r.w): r.f for r in grams.collect()})
        assert {r.lang: r.n for r in totals.collect()} == {"a": 6000, "b": 6000}
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, closed = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in closed)
        open_ = [s for s in names if s not in closed]
        target = {s: Fraction(2 * sizes[s]) if s in closed else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        if not (over := {s for s in open_ if target[s] > 2 * sizes[s]}):
            return {s: float(t) for s, t in target.items()}
        closed |= over


def test_mixing(spark):
    random = np.random.default_rng(4)
    texts, sources = [], []
    for source, n in [("b", 400), ("a", 150), (None, 30), ("", 60), ("é", 25), ("Z", 3), ("empty", 2)]:
        for _ in range(n):
            texts.append("" if source == "empty" else " ".join(["w"] * int(random.zipf(1.6) % 3000)) + random.choice(["", "\n", "\x0b x\t"]))
            sources.append(source)
    texts[5], texts[6] = None, " \n"
    docs = spark.createDataFrame([*(rows := rows_of(texts, sources, sources)), rows[9], (None, "a b", "a", "b", *"abcdefg"), (None, "a b", "a", "b", *"abcdefg")], SCHEMA).repartition(4)
    plan = mix_plan(docs, block=64).collect()
    assert len(plan) == docs.count()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = brute_targets(size)
    taken, largest = collections.Counter(), collections.Counter()
    for r in plan:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and int(rate) <= r.copies <= int(rate) + (rate % 1 > 0) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for source in size:  # a block misses by its largest document at most; eight blocks of the largest source
        assert abs(taken[source] - target[source]) <= largest[source] * (8 if source == "b" else 4) + 1
    again = mix_plan(docs.repartition(7), block=64).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, plan))
    mixed = mixture(docs, block=64)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.copies
    got = collections.Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert got == +want
    assert mix_plan(docs.limit(0)).count() == 0 and mixture(docs.limit(0)).count() == 0


def test_draws_have_their_probability(spark):
    """Of many sources of two documents each, a fraction of 1/2 draws each document about half the time."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id div 2) AS source", "if(id % 2 = 0, 'a b c', 'a b') AS text")
    plan = mix_plan(docs, weights=(1,), share=(1, 2)).collect()
    assert 900 < sum(r.copies for r in plan if r.size == 3) < 1100 and 900 < sum(r.copies for r in plan if r.size == 2) < 1100


def cheapest(signature):
    """Dijkstra over (turns used, roles emitted), whole audits compared as strings; no more than the turns and two insertions each."""
    role_of = {"user": "u", "assistant": "a"}
    ends = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"(s|s?(ua)*u?)?")
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, used, said = heapq.heappop(heap)
        if (used, said) in done:
            continue
        done.add((used, said))
        if used == len(signature) and ends.fullmatch(said):
            return cost, audit
        steps = [(5, "I", used, said + r) for r in role_of.values()] if len(said) < 2 * len(signature) + 2 else []
        if used < len(signature):
            x = signature[used]
            steps.append((2, "D", used + 1, said))
            if x != "-":
                steps += [(5 * x.isupper(), "K", used + 1, said + x.lower())] + [(1 + 5 * x.isupper(), "R", used + 1, said + r) for r in role_of.values()]
        for more, initial, used_, said_ in steps:
            if prefix.fullmatch(said_):
                heapq.heappush(heap, (cost + more, audit + initial, used_, said_))
    raise AssertionError(signature)


def test_every_short_signature_is_solved():
    for n in range(5):
        for signature in map("".join, itertools.product("suaoSUO-", repeat=n)):
            cost, edits = solve(signature)
            assert (cost, re.sub("[usa]", "", "".join(edits))) == cheapest(signature), signature
            lines = [line.split(":")[0] for x, e in zip([*signature, ""], edits) for line in repaired_lines(x.lower(), "t", e)]
            assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and len(edits) == n + 1
    assert solve("ua" * 200_000)[0] == 0  # no recursion limit


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn is not None, turn or 0, ("user" if fault == 4 else role).encode(), text.encode())] * (2 if fault == 3 else 1)
        kept.sort()
        letters, seen, counts, roles = "", set(), collections.Counter(), []
        for _, _, role, text in kept:
            bare = re.sub("[\x20\x09-\x0d]", "", text.decode())
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            ini = role.decode()[:1]
            roles.append(ini)
            kind = ini if ini in tuple("sua") else "o"
            letters += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cheapest(letters)
        lines, at = [], 0
        said = "s" if (k := re.match("[ID]*K", audit)) and audit.strip("D")[0] == "K" and roles[len(k[0]) - 1] == "s" else ""
        want = itertools.cycle(["user", "assistant"])
        for e in audit:
            _, _, role, text = kept[at] if e != "I" else (0, 0, b"", b"")
            at += e != "I"
            if e == "D":
                continue
            name = role.decode() if said == "s" and not lines else next(want)
            lines.append(f"{role.decode() if e == 'K' else name}:{text.decode()}")
        turns = [t for there, t, _, _ in kept if there]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, conv string, pos string, fault string, letter string, edits string"


def test_repair(spark):
    random = np.random.default_rng(6)
    rows = []
    for conv in range(300):
        n = int(random.integers(1, 9))
        for turn in range(n):
            role = random.choice(["user", "assistant", "system", "tool", "", "Agent", "assistant"], p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05])
            rows.append((conv if conv % 50 else None, int(turn) if random.random() > 0.05 else None, str(role) if random.random() > 0.03 else None, random.choice(["Hi.", "What? \n", "cut", "", " \t", "é!", "x\x00.", None], p=[0.5, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(1001, 0, "user", "long " * 100_000 + ".")] + [(1002, 5, "user", "same.")] * 3 + [(2**62, None, None, None)]
    rows = [(c, t, r, None if x is None else str(x)) for c, t, r, x in rows]
    long = [r for r in rows if r[0] == 1000]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], TURNS).repartition(4)
    want = brute_repair([r for r in rows if r[0] != 1000])
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(damaged(df), df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, x in want.items():
        assert got[conv] == x, (conv, got[conv], x)
    assert len(got[1000][6]) >= len(long) * 0.9
    empty = df.limit(0)
    assert repair_report(damaged(empty), empty).count() == 0


def test_a_signature_is_solved_once_and_replayed(spark):
    rows = [(i, t, "user" if t % 2 else "assistant", f"conversation {i} turn {t}.") for i in range(50) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, edited = repair(turns)
    assert whole.select("signature").distinct().count() == 1 and {r.audit for r in whole.collect()} == {solve("auau")[1] and re.sub("[ua]", "", "".join(solve("auau")[1]))}
    assert {r.letter for r in faulted(turns).collect()} == {"u", "a"}
    report = repair_report(turns).collect()
    assert len(report) == 50 and len({r.repaired_sha256 for r in report}) == 50
    assert edited.filter("edits like '%K'").count() > 0
