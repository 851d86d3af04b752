"""Palette merge, significance, archetypes and saturation, in code that Spark generates.

A product's colours (at most five) are laid side by side in one row; which of them are one is told by a mask of five bits a colour, and
the transitive closure is two rounds of bit operations. Nothing is collected into lists or walked by lambdas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C

MAX_COLORS = 5
PLACES = range(1, MAX_COLORS + 1)
PAIRS = [(i, j) for i in PLACES for j in PLACES if i < j]
KINDS = ("MONO", "DOM_ACC", "DUAL_BAL", "MULTI_DOM", "MULTI_BAL")
#: fixed values: hue gap, low chroma, its lightness guard, neutral chroma
RULE = {"hue_merge": 25, "low_chroma_merge": 15, "low_chroma_max_delta_l": 35, "neutral_chroma": 8}


def wide(palette: DataFrame, *by: str) -> DataFrame:
    """One row a product: l1, a1, b1, p1 to l5, a5, b5, p5 by cluster_rank, null where there is no colour."""
    cols = {"l": "lab_l", "a": "lab_a", "b": "lab_b", "p": "perc"}
    return palette.groupBy(*by).agg(*(F.max(F.when(F.col("cluster_rank") == i, F.col(c))).alias(f"{k}{i}") for i in PLACES for k, c in cols.items()))


def with_measures(w: DataFrame) -> DataFrame:
    """Chroma c1..c5 and hue angle t1..t5 (not yet null for neutral colours) of each place."""
    w = w.withColumns({f"c{i}": F.expr(C.chroma(f"a{i}", f"b{i}")) for i in PLACES})
    return w.withColumns({f"t{i}": F.expr(f"CASE WHEN atan2(b{i}, a{i}) < 0 THEN degrees(atan2(b{i}, a{i})) + 360 ELSE degrees(atan2(b{i}, a{i})) END") for i in PLACES})


def pair_measures(w: DataFrame) -> DataFrame:
    """Of each pair of places: dl (lightness), dh (hue), lo and hi (smaller and larger chroma); null where a colour is missing."""
    cols = {}
    for i, j in PAIRS:
        cols |= {f"dl{i}{j}": f"abs(l{i} - l{j})", f"dh{i}{j}": C.hue_difference(f"t{i}", f"t{j}"), f"lo{i}{j}": f"least(c{i}, c{j}) + 0 * (l{i} - l{j})", f"hi{i}{j}": f"greatest(c{i}, c{j}) + 0 * (l{i} - l{j})"}
    return w.withColumns({k: F.expr(x) for k, x in cols.items()})


def merges(i: int, j: int, guard: bool = True, **rule) -> str:
    """Whether two places of ``pair_measures`` are one: near-greys by lightness, others by hue. Both colours below the neutral chroma,
    or both below the low one, are compared by lightness (without the guard: always one); a neutral one is no other's."""
    r = RULE | rule
    close = f"dl{i}{j} <= {r['low_chroma_max_delta_l']}" if guard else "TRUE"
    return (f"coalesce(CASE WHEN hi{i}{j} IS NULL THEN FALSE WHEN hi{i}{j} < {r['low_chroma_merge']} THEN {close} WHEN hi{i}{j} < {r['neutral_chroma']} THEN {close} "
            f"WHEN lo{i}{j} < {r['neutral_chroma']} THEN FALSE ELSE dh{i}{j} < {r['hue_merge']} END, FALSE)")


def near_lab(i: int, j: int, radius: float) -> str:
    return f"coalesce(sqrt(power(l{i} - l{j}, 2) + power(a{i} - a{j}, 2) + power(b{i} - b{j}, 2)) < {radius}, FALSE)"


def closure(w: DataFrame, pair, name: str = "g") -> DataFrame:
    """``w`` with <name>1..<name>5: the smallest place (from 0) that each colour reaches over the pairs for which ``pair`` (i, j) holds."""
    w = w.withColumns({f"_n{i}{j}": F.expr(pair(i, j)) for i, j in PAIRS})
    bit = lambda i, j: f"CASE WHEN _n{min(i, j)}{max(i, j)} THEN {1 << (j - 1)} ELSE 0 END"
    w = w.withColumns({f"_m{i}": F.expr(f"{1 << (i - 1)} | " + " | ".join(bit(i, j) for j in PLACES if j != i)) for i in PLACES})
    at = "_m"
    for to in ("_u", "_v"):  # two steps, then four
        w = w.withColumns({f"{to}{i}": F.expr(" | ".join(f"CASE WHEN {at}{i} & {1 << (j - 1)} <> 0 THEN {at}{j} ELSE 0 END" for j in PLACES)) for i in PLACES})
        at = to
    low = lambda i: "CASE " + " ".join(f"WHEN {at}{i} & {1 << k} <> 0 THEN {k}" for k in range(MAX_COLORS)) + " END"
    w = w.withColumns({f"{name}{i}": F.expr(low(i)) for i in PLACES})
    return w.drop(*(f"_n{i}{j}" for i, j in PAIRS), *(f"{k}{i}" for k in ("_m", "_u", "_v") for i in PLACES))


def closed_pairs() -> list[int]:
    """For each set of pairs (a bit each, in the order of PAIRS), the set of pairs that are in one group by its transitive closure."""
    out = []
    for mask in range(1 << len(PAIRS)):
        group = {i: i for i in PLACES}
        for k, (i, j) in enumerate(PAIRS):
            if mask >> k & 1:
                a, b = group[i], group[j]
                group = {x: a if g == b else g for x, g in group.items()}
        out.append(sum(1 << k for k, (i, j) in enumerate(PAIRS) if group[i] == group[j]))
    return out


def long(w: DataFrame, by: list[str], **cols: str) -> DataFrame:
    """One row a colour again: ``by``, cluster_rank, perc, lab_* and further columns (name -> prefix)."""
    names = {"perc": "p", "lab_l": "l", "lab_a": "a", "lab_b": "b", **cols}
    rows = ", ".join(f"{i}, " + ", ".join(f"{k}{i}" for k in names.values()) for i in PLACES)
    return w.select(*by, F.expr(f"stack({MAX_COLORS}, {rows}) AS (cluster_rank, {', '.join(names)})")).filter("perc IS NOT NULL")


def merge_groups(palette: DataFrame, pair=merges, by: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    """(by, cluster_rank, perc, lab_*, grp): the transitive closure of a pair predicate within each product; grp is the smallest
    place that a colour reaches."""
    w = closure(pair_measures(with_measures(wide(palette, *by))), pair)
    return long(w, list(by), grp="g")


def merge_palette(palette: DataFrame, pair=merges, by: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    """(by, grp, perc, lab_*, n_merged): one row a merged colour, its place the coverage-weighted mean. Groups without coverage go,
    but a palette of one colour stays as it is."""
    w = lambda c: F.expr(f"CASE WHEN sum(perc) > 0 THEN sum({c} * perc) / sum(perc) ELSE avg({c}) END").alias(c)
    groups = merge_groups(palette, pair, by)
    merged = groups.groupBy(*by, "grp").agg(F.sum("perc").alias("total"), w("lab_l"), w("lab_a"), w("lab_b"), F.count("*").alias("n_merged"))
    merged = merged.withColumn("n_all", F.sum("n_merged").over(Window.partitionBy(*by)))
    return merged.filter("total > 0 OR n_all = 1").select(*by, "grp", F.expr(C.to("total", 6)).alias("perc"), "lab_l", "lab_a", "lab_b", "n_merged")


#: share of coverage that a colour needs against the dominant one (aliases d_a, d_b), by their hue difference
_H, _D = C.hue("lab_a", "lab_b"), C.hue("d_a", "d_b")
THRESHOLD = "(CASE WHEN _h IS NULL AND _d IS NULL THEN 5 WHEN _h IS NULL OR _d IS NULL THEN 1 WHEN _gap > 90 THEN 1 WHEN _gap > 45 THEN 3 ELSE 5 END)"
ARCHETYPE = "(CASE WHEN coalesce(n, 0) <= 1 THEN 'MONO' WHEN n = 2 THEN CASE WHEN c1 >= 2 * c2 THEN 'DOM_ACC' ELSE 'DUAL_BAL' END WHEN total - c1 < 10 THEN 'DOM_ACC' WHEN c1 >= 50 THEN 'MULTI_DOM' ELSE 'MULTI_BAL' END)"


def merged_places(palette: DataFrame, pair=merges) -> DataFrame:
    """merge_palette with its place by falling coverage, saturation, band and whether the colour is significant."""
    order = Window.partitionBy("instance_id").orderBy(F.desc("perc"), "grp")
    m = merge_palette(palette, pair).withColumn("place", F.row_number().over(order)).withColumn("d_a", F.first("lab_a").over(order)).withColumn("d_b", F.first("lab_b").over(order))
    m = C.with_saturation(m).withColumn("band", F.expr(C.hsb_class("sat")))
    return C.staged(m, [("_h", _H), ("_d", _D), ("_gap", C.hue_difference("_h", "_d")), ("_ok", f"perc >= {THRESHOLD}")], {"significant": "_ok"})


def archetypes(palette: DataFrame, pair=merges) -> DataFrame:
    """(instance_id, archetype, n_colors, coverage_1, has_saturated, saturation_sequence): the structure of each product's merged palette."""
    m = merged_places(palette, pair).withColumn("rk", F.expr("CASE WHEN significant THEN sum(cast(significant as int)) OVER (PARTITION BY instance_id ORDER BY place) END"))
    letter = lambda i: f"coalesce(max(CASE WHEN place = {i} THEN upper(substring(band, 1, 1)) END), '')"
    shape = m.groupBy("instance_id").agg(
        F.expr("count(rk)").alias("n"), F.expr("max(CASE WHEN rk = 1 THEN perc END)").alias("c1"), F.expr("max(CASE WHEN rk = 2 THEN perc END)").alias("c2"), F.expr("sum(CASE WHEN rk IS NOT NULL THEN perc END)").alias("total"),
        F.expr("max(band = 'saturated')").alias("has_saturated"), F.expr("concat(" + ", ".join(letter(i) for i in PLACES) + ")").alias("saturation_sequence"),
    )
    return shape.select("instance_id", F.expr(ARCHETYPE).alias("archetype"), F.col("n").alias("n_colors"), F.expr(C.to("coalesce(c1, 0)")).alias("coverage_1"), "has_saturated", "saturation_sequence")
