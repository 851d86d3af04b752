"""Repair of conversations whose role order is broken, by signatures.

Each turn becomes one letter: its role's class (s, u, a, o for others), capital where the text is truncated, or ``-`` where the turn must go (blank, or
a copy of an earlier one). A conversation is the string of its letters. Each distinct string is solved once: a recursion over (turn, role emitted
last), memoised from the last turn back, finds the cheapest edits that leave ``(s?(ua)+)?``. The solutions are joined back by the string, and
replayed over the turns.

Edits: keep (K, 0), give the turn another role (R, 1), delete it (D, 2), insert an empty turn (I, 5); a truncated turn that stays costs 5 more. Of equally
cheap ones the ASCII-least string of initials is taken; it settles the roles as well.

Turns are numbered and put in order by Spark's sort, which spills; texts are hashed as they stream by, so that a conversation
of any length is never held. What is held is one letter a turn. A string that a third of all conversations share is solved once; the join
that gives it back has fresh exchanges on both sides, which adaptive execution splits.

Defined cases: turns come by turn (nulls first), then role, then text; a null role or text is one space, so a null text is blank and a null role is another
role; a null conversation id is one conversation; a null turn has no part in gaps; repeated rows are duplicates; conversations without turns
(or with none left) have zeros, an empty audit and the hash of the empty string; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

_BLANK = " "
#: What may follow a role: the states of ``(s?(ua)+)?``; an insertion goes from one to the next.
_AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 1, 2, 5, 5


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults dealt by crc32 of ``conv_id:turn``: see the cases below, one in twenty each."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(_BLANK))
    told = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), F.pmod(F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faulted(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, pos, turn, role, text, fault, letter, illegal, new_turn): turns in order, with their first fault."""
    keyed = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(_BLANK)).alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit(_BLANK)).alias("role"), F.coalesce("text", F.lit(_BLANK)).alias("text")).withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv").orderBy(*order)
    placed = keyed.repartition("conv").withColumn("pos", F.row_number().over(whole)).withColumn("before", F.lag(F.substring("role", 1, 1)).over(whole)).withColumn("last", F.lag("turn").over(whole))
    # the first of equal (role, text) is the one of the least place: a second sort within the same partitions
    marked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "said").orderBy("pos")))
    left = F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " "))  # trailing white space goes, all of it as spaces
    fault = F.when(left == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(left, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    illegal = (F.col("pos") > 1) & ~F.concat("before", initial).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & (F.col("last").isNull() | (F.col("last") != F.col("turn")))
    return marked.withColumn("fault", fault).select("conv", "conv_id", "pos", "turn", "role", "text", "fault", letter.alias("letter"), illegal.alias("illegal"), new_turn.alias("new_turn"))


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation: its string of letters and what is counted over it."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")  # one letter a turn
    of = lambda name: F.count_if(F.col("fault") == name).alias(name)
    span = F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1, F.lit(0)) - F.count_if("new_turn")
    return rows.groupBy("conv").agg(letters.alias("signature"), span.alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count_if("illegal").alias("illegal"))


def solve(signature: str) -> tuple[int, list[str]]:
    """The cost, and for each turn its edits: insertions as ``Iu``/``Ia``, then ``K``, ``D`` or ``Ru``/``Ra``; at last the insertions behind the last turn.

    memo[i][state] is the best (cost, initials, edits, next state) of what happens until turn i is used up; two choices of equal cost never have the same
    initials, and none's are the beginning of another's, so the ASCII-least audit is settled turn by turn."""
    ways = {}  # state -> insertions before a turn: (cost, initials, edits, state)
    for state in _AFTER:
        at, found = state, [(0, "", "", state)]
        for n in (1, 2):  # a third insertion would lead back to where the first one did
            at = _NEXT[at]
            found.append((n * _INSERT, "I" * n, found[-1][2] + "I" + at, at))
        ways[state] = found
    ends = {state: min((w for w in ways[state] if w[3] in ("", "a")), key=lambda w: w[:2]) for state in _AFTER}
    cost, memo = {state: w[0] for state, w in ends.items()}, []
    for letter in reversed(signature):
        stays = _TRUNCATED * letter.isupper()
        best = {}
        for state in _AFTER:
            options = []
            for spent, initials, edits, at in ways[state]:
                options.append((spent + _DELETE + cost[at], initials + "D", edits + "D", at))
                if letter != "-":
                    if (kept := _AFTER[at].get(letter.lower())) is not None:
                        options.append((spent + _KEEP + stays + cost[kept], initials + "K", edits + "K", kept))
                    to = _NEXT[at]
                    options.append((spent + _REROLE + stays + cost[to], initials + "R", edits + "R" + to, to))
            best[state] = min(options)
        cost = {state: b[0] for state, b in best.items()}
        memo.append({state: b[2:] for state, b in best.items()})
    state, told = "", []
    for best in reversed(memo):
        edits, state = best[state]
        told.append(edits)
    return cost[""], [*told, ends[state][2]]


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for signature in batch.column(0).to_pylist():
            cost, edits = solve(signature)
            columns = [pa.array([signature], pa.string()), pa.array([cost], pa.int64()), pa.array([re.sub("[usa]", "", "".join(edits))], pa.string()), pa.array([edits], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "cost", "audit", "edits"])


def solutions(convs: DataFrame) -> DataFrame:
    """(signature, cost, audit, edits) of each distinct signature."""
    return convs.select("signature").distinct().mapInArrow(_solutions, "signature string, cost bigint, audit string, edits array<string>")


_ROLE = {"u": "user", "a": "assistant"}


def repaired_lines(role: str | None, text: str | None, edits: str) -> list[str]:
    """The lines that a turn's edits leave: insertions, then the turn itself with its own role or another."""
    told = [f"{_ROLE[x[1]]}:" for x in re.findall("I[ua]", edits)]
    if edits.endswith("K"):
        told.append(f"{role}:{text}")
    elif found := re.search("R([ua])$", edits):
        told.append(f"{_ROLE[found[1]]}:{text}")
    return told


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, which come in order."""
    at, digest, empty = None, hashlib.sha256(), True

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    for batch in batches:
        for conv, role, text, edits in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv != at:
                if at is not None:
                    yield told()
                at, digest, empty = conv, hashlib.sha256(), True
            for line in repaired_lines(role, text, edits):
                digest.update(line.encode() if empty else b"\n" + line.encode())
                empty = False
    if at is not None:
        yield told()


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text): the conversations (conv, signature, gaps, blank, duplicate, truncated, illegal, cost, audit), and their
    turns with edits (conv, pos, role, text, edits), the edits behind the last turn as one more without role and text."""
    with scratch() as keep:
        rows = keep(materialize(faulted(turns), "turns"))
        convs = materialize(signatures(rows), "signatures")
        solved = materialize(solutions(convs), "solutions")
        whole = keep(materialize(convs.join(solved, "signature"), "repairs"))
    edits = whole.select("conv", F.posexplode("edits").alias("at", "edits")).select("conv", (F.col("at") + 1).alias("pos"), "edits")
    return whole.drop("edits"), edits.join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left").select("conv", "pos", "role", "text", "edits")


def repair_report(turns: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation of ``original`` (else of ``turns``)."""
    whole, edited = repair(turns)
    lines = edited.filter("edits <> 'D'").select("conv", "role", "text", "edits", "pos")
    hashed = lines.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "role", "text", "edits").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    everyone = (turns if original is None else original).groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(_BLANK)).alias("conv"))
    found = everyone.join(whole, "conv", "left").join(hashed, "conv", "left")
    counts = [F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
