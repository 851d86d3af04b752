"""Orders of zones, samples by distance, trees: what needs a matrix of one bounded group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _zones, to
from .operators import cluster as K
from .operators import orders as O
from .operators import palette as P
from .reports import SWEEPS, labelled, pairs_of
from .sources import catalogue as src
from .sources.files import handed_on, release

E = F.expr
LAB = ["lab_l", "lab_a", "lab_b"]


def _per_segment(zones: DataFrame, run, out: str) -> DataFrame:
    def sorted_run(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values("zone", ignore_index=True))

    return zones.groupBy("segment").applyInPandas(sorted_run, out)


def _placed(pdf: pd.DataFrame, order: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"segment": pdf["segment"].iloc[order].to_numpy(), "zone": pdf["zone"].iloc[order].to_numpy(), "place": np.arange(len(order))})


_PLACES = "segment string, zone long, place long"


def zone_chain(spark, d):
    """Zones as a chain of nearest neighbours under CIEDE2000 from the darkest."""
    return _per_segment(_zones(spark, d), lambda pdf: _placed(pdf, O.chain(pdf[LAB].to_numpy(float))), _PLACES)


def zone_leaf_order(spark, d):
    """Zones in the optimal leaf order of their average-linkage tree under CIEDE2000."""
    return _per_segment(_zones(spark, d), lambda pdf: _placed(pdf, O.leaf_order(K.de00(pdf[LAB].to_numpy(float), pdf[LAB].to_numpy(float)))), _PLACES)


def thumbnail_order(spark, d):
    """Zones from the darkest, each as far as possible from those before it in LAB."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[LAB].to_numpy(float)
        return _placed(pdf, O.farthest(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), int(x[:, 0].argmin()), len(x)))

    return _per_segment(_zones(spark, d), run, _PLACES)


def diverse_zones(spark, d, most: int = 20):
    """At most twenty zones of each brand, as far apart as possible under CIEDE2000, from the one nearest the mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[LAB].to_numpy(float)
        first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        return _placed(pdf, list(range(len(x))) if len(x) <= most else O.farthest(K.de00(x, x), first, most))

    return _per_segment(_zones(spark, d), run, _PLACES)


def family_stats(spark, d, radius: float = 7.0):
    """Hue families by size: how many there are, how many zones they hold, their largest spread on the a*b* plane and range of lightness."""
    z = K.hue_families(_zones(spark, d), radius).join(_zones(spark, d), ["segment", "zone"])
    f = z.groupBy("segment", "family").agg(F.count("*").alias("n"), E("max(lab_l) - min(lab_l)").alias("l_range"))
    x, y = (z.select("segment", "family", *(F.col(c).alias(f"{c}_{k}") for c in ("zone", "lab_a", "lab_b"))) for k in "xy")
    spread = x.join(y, ["segment", "family"]).filter("zone_x < zone_y").groupBy("segment", "family").agg(E("max(sqrt(power(lab_a_x - lab_a_y, 2) + power(lab_b_x - lab_b_y, 2)))").alias("spread"))  # within a family
    f = f.join(spread, ["segment", "family"], "left")
    return f.groupBy("segment").agg(E("count_if(n > 1)").alias("n_groups"), E("sum(CASE WHEN n > 1 THEN n ELSE 0 END)").alias("n_grouped"), E("count_if(n = 1)").alias("n_singletons"), to("coalesce(max(spread), 0)", 3, "max_spread"), to("coalesce(max(CASE WHEN n > 1 THEN l_range END), 0)", 3, "max_l_range"))


def pixel_palettes(spark, d, k: int = 5):
    """Pixels of an image (here the lines of a supplier's parts) in five clusters, by falling share; an image of under five pixels has none.
    Centres are whole numbers, shares have two digits."""
    p = src.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), E("cast(l_partkey % 101 as double)").alias("lab_l"), E("cast((l_partkey * 7) % 161 - 80 as double)").alias("lab_a"), E("cast((l_partkey * 11) % 161 - 80 as double)").alias("lab_b"))
    p = p.groupBy("image", *LAB).agg(F.count("*").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(LAB, ignore_index=True)
        x, w = pdf[LAB].to_numpy(float), pdf["w"].to_numpy(float)
        if w.sum() < k:
            return pd.DataFrame({"image": [], "cluster_rank": [], "lab_l": [], "lab_a": [], "lab_b": [], "perc": []})
        centers, label = K.weighted_kmeans(x, w, k)
        share = np.bincount(label, w, len(centers)) / w.sum() * 100
        order = [i for i in np.lexsort((centers[:, 2], centers[:, 1], centers[:, 0], -share)) if share[i] > 0]
        return pd.DataFrame({"image": pdf["image"].iloc[0], "cluster_rank": np.arange(1, len(order) + 1), **{c: np.round(centers[order, i]) for i, c in enumerate(LAB)}, "perc": np.round(share[order], 2)})

    return p.groupBy("image").applyInPandas(run, "image long, cluster_rank int, lab_l double, lab_a double, lab_b double, perc double")


TREE = ["dl", "dchroma", "dhue", "min_chroma", "max_chroma", "far"]


def merge_tree(spark, d):
    """A decision tree of depth 3, 20 pairs a leaf at least, of the labels on the pairs' features: its rules and the features' importances.
    A missing hue difference counts as 180."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    p = pairs_of(labelled(spark, d), "instance_id").withColumn("far", E("sqrt(power(l1 - l2, 2) + power(a1 - a2, 2) + power(b1 - b2, 2))"))
    p = handed_on(p.select(*TREE, E("cast(same as double)").alias("label")).fillna(180.0, "dhue"))  # the fit reads it several times
    tree = DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=20, seed=42).fit(VectorAssembler(inputCols=TREE, outputCol="features").transform(p))
    release(p)
    text = tree.toDebugString.split("\n", 1)[1]
    for i, name in enumerate(TREE):
        text = text.replace(f"(feature {i} ", f"({name} ")
    return spark.createDataFrame([(name, float(round(tree.featureImportances[i], 4)), text) for i, name in enumerate(TREE)], "feature string, importance double, rules string")


MEASURES = ("dl", "dh", "lo", "hi")


def laid_out(w: DataFrame, folds: int = 5) -> DataFrame:
    """A product's fold, which of its pairs there are (``pairs``), which the labels make one (``same``), a bit each, and its pairs' measures as
    bytes, written once: every step of the tuning reads them. The rule's constants are whole numbers from 0 to 126, so x < v is floor(x) < v and
    x <= v is ceil(x) <= v, and no more than 127 need be told apart."""
    bits = lambda said: E(" + ".join(f"CASE WHEN {said(i, j)} THEN {1 << k} ELSE 0 END" for k, (i, j) in enumerate(P.PAIRS))).cast("short")
    byte = lambda k, i, j: E(f"cast(coalesce(least({'ceil' if k == 'dl' else 'floor'}({k}{i}{j}), 127), 127) as tinyint)").alias(f"{k}{i}{j}")
    return handed_on(w.select(F.pmod(F.xxhash64("instance_id"), F.lit(folds)).cast("tinyint").alias("fold"), bits(lambda i, j: f"dl{i}{j} IS NOT NULL").alias("pairs"), bits(lambda i, j: f"dl{i}{j} IS NOT NULL AND u{i} = u{j}").alias("same"), *(byte(k, i, j) for k in MEASURES for i, j in P.PAIRS)))


def _accuracy(t: DataFrame, constant: str, values: list[int], rule: dict[str, int], folds: int = 5) -> DataFrame:
    """(fold, candidate, right, pairs) of each value of one constant over ``laid_out`` products, the others as in ``rule``; groups by closure."""
    assert all(isinstance(v, int) and 0 <= v <= 126 for v in (*values, *rule.values())), "the measures are told apart from 0 to 126"
    closed, ones = np.array(P.closed_pairs(), "int16"), np.array([m.bit_count() for m in range(1 << len(P.PAIRS))], "int8")

    def run(batches):
        right, pairs = np.zeros((len(values), folds)), np.zeros(folds)
        for batch in batches:
            fold, there, same = (batch.column(c).to_numpy() for c in ("fold", "pairs", "same"))
            dl, dh, lo, hi = (np.stack([batch.column(f"{k}{i}{j}").to_numpy() for i, j in P.PAIRS]) for k in MEASURES)
            pairs += np.bincount(fold, ones[there], folds)
            for at, value in enumerate(values):
                r = {**rule, constant: value}
                grey = hi < max(r["low_chroma_merge"], r["neutral_chroma"])
                one = np.where(grey, dl <= r["low_chroma_max_delta_l"], (lo >= r["neutral_chroma"]) & (dh < r["hue_merge"]))
                mask = np.zeros(len(fold), "int16")
                for k, said in enumerate(one):
                    mask |= said.astype("int16") << k
                right[at] += np.bincount(fold, ones[there & ~(closed[mask & there] ^ same)], folds)
        rows = [(k, v, int(right[at, k]), int(pairs[k])) for at, v in enumerate(values) for k in range(folds) if pairs[k]]
        yield pa.RecordBatch.from_pylist([dict(zip(("fold", "candidate", "right", "pairs"), row)) for row in rows], pa.schema([("fold", pa.int64()), ("candidate", pa.int32()), ("right", pa.int64()), ("pairs", pa.int64())]))

    return t.mapInArrow(run, "fold long, candidate int, right long, pairs long").groupBy("fold", "candidate").agg(F.sum("right").alias("right"), F.sum("pairs").alias("pairs"))


def tune_rule(spark, d, rounds: int = 3, folds: int = 5):
    """The merge rule's constants tuned to the labels one after another, three times (greedy coordinate descent): each step's best value,
    its accuracy, and the mean gain on held-out folds of products when the value is chosen on the others."""
    t = laid_out(labelled(spark, d), folds)
    rule, steps, settled = dict(P.RULE), [], False
    for turn in range(rounds):
        if settled:  # a round that changed nothing: so will the next
            break
        settled = True
        for constant, values in SWEEPS.items():
            counts = _accuracy(t, constant, sorted({*values, rule[constant]}), rule, folds).collect()  # a row a fold and candidate
            score = lambda v, keep: (lambda r, p: r / p if p else 0.0)(*(sum(x[c] for x in counts if x.candidate == v and keep(x.fold)) for c in ("right", "pairs")))
            best = max([rule[constant], *values], key=lambda v: score(v, lambda f: True))  # the present value wins ties, then the first
            held = [(score(max([rule[constant], *values], key=lambda v: score(v, lambda f: f != k)), lambda f: f == k), score(rule[constant], lambda f: f == k)) for k in range(folds)]
            gain = round(sum(a - b for a, b in held) / folds, 6)
            steps.append((turn, constant, rule[constant], best, round(score(best, lambda f: True), 6), gain))
            settled, rule = settled and best == rule[constant], {**rule, constant: best}
    release(t)
    return spark.createDataFrame(steps, "round int, constant string, before int, best int, accuracy double, held_out_gain double")


ALL = [zone_chain, zone_leaf_order, thumbnail_order, diverse_zones, family_stats, pixel_palettes, merge_tree, tune_rule]
