"""Hue families, agreement of labellings and the forest against plain recomputations."""

import collections
import math

import numpy as np
import pytest

from huegrain import zones
from huegrain.operators import forest
from huegrain.operators.cluster import hue_families
from huegrain.catalog import _zones

SF = "/root/testdata/sf0.001"


def test_families(spark):
    """The same families as linkage over whole matrices, those of one cell unassigned; a pair of unassigned cells is never one zone."""
    got = {(r.brand, r.cluster): r.zone for r in zones.zone_families(spark, SF).collect()}
    want = collections.defaultdict(list)
    for r in hue_families(_zones(spark, SF), 7.0).collect():
        want[r.segment, r.family].append(r.zone)
    assert len(got) == sum(map(len, want.values()))
    for (brand, _), cells in want.items():
        assert {got[brand, c] for c in cells} == {min(cells) if len(cells) > 1 else None}
    pairs = zones.zone_pair_labels(spark, SF).collect()
    assert all(r.same_zone == (got[r.brand, r.cluster_a] is not None and got[r.brand, r.cluster_a] == got[r.brand, r.cluster_b]) for r in pairs)
    listed = zones.family_zones(spark, SF).collect()
    assert sum(r.n_clusters for r in listed) + sum({r.brand: r.unassigned for r in listed}.values()) == sum({r.brand: r.total_clusters for r in listed}.values())


def plain_agreement(pairs):
    n, c = len(pairs), lambda k: k * (k - 1) / 2
    both, a, b = collections.Counter(pairs), collections.Counter(x for x, _ in pairs), collections.Counter(y for _, y in pairs)
    cx, ca, cb = (sum(map(c, t.values())) for t in (both, a, b))
    chance = ca * cb / c(n) if n > 1 else 0
    ari = 1.0 if (ca + cb) / 2 == chance else (cx - chance) / ((ca + cb) / 2 - chance)
    ha, hb = (-sum(k / n * math.log(k / n) for k in t.values()) for t in (a, b))
    mutual = sum(k / n * math.log(k * n / (a[x] * b[y])) for (x, y), k in both.items())
    return ari, 2 * mutual / (ha + hb) if ha + hb > 1e-12 else 1.0


def test_agreement(spark):
    random = np.random.default_rng(4)
    groups = {"random": [(int(a) or None, int(b)) for a, b in random.integers(0, 4, (200, 2))], "same": [(i % 5, -(i % 5)) for i in range(60)], "one": [(1, 1)], "flat": [(1, 2)] * 9, "apart": [(i, 0) for i in range(7)]}
    rows = [(k, a, b) for k, pairs in groups.items() for a, b in pairs]
    got = {r.brand: r for r in zones.agreement(spark.createDataFrame(rows, "brand string, a long, b long"), "brand", "a", "b").collect()}
    for k, pairs in groups.items():
        ari, nmi = plain_agreement(pairs)
        assert got[k].ari == pytest.approx(ari, abs=1e-4) and got[k].nmi == pytest.approx(nmi, abs=1e-4), k
        assert got[k].n_a == len({a for a, _ in pairs}) and got[k].n == len(pairs)
    assert got["same"].ari == got["same"].nmi == 1.0


def test_folds_and_bins():
    y = np.arange(100) % 10 == 0
    fold = forest.stratified_folds(y, np.random.default_rng(1).permutation(100), 5)
    assert collections.Counter(fold[y].tolist()) == {k: 2 for k in range(5)} and collections.Counter(fold[~y].tolist()) == {k: 18 for k in range(5)}
    x = np.random.default_rng(2).normal(size=(1000, 2))
    bins = forest.binned(x)
    for i in range(2):
        order = np.argsort(x[:, i])
        assert (np.diff(bins[i, order].astype(int)) >= 0).all() and bins[i].max() == 63 and np.bincount(bins[i]).max() <= 17
    assert forest.binned(np.zeros((0, 2))).shape == (2, 0) and (forest.binned(np.ones((9, 1))) == 0).all()


def test_a_tree_is_the_best_split_of_its_rows():
    """Depth one over one feature: the split of the lowest weighted Gini impurity among all bins, both sides of ten rows at least."""
    random = np.random.default_rng(3)
    for turn in range(20):
        x, y = random.integers(0, 64, (1, 90)).astype(np.uint8), random.random(90)
        y = (y < 0.2 + 0.6 * (x[0] > random.integers(5, 60))).astype(float)
        times = random.integers(0, 3, 90)
        weight = times * np.where(y, 2.0, 0.5)
        feature, cut, value = forest.grow(x, y, times, weight, 1, 10, np.random.default_rng(0))
        score = {}
        for t in range(64):
            sides = [(x[0] <= t), (x[0] > t)]
            if min(times[s].sum() for s in sides) >= 10:
                score[t] = sum((weight[s] * y[s]).sum() * (weight[s] * (1 - y[s])).sum() / weight[s].sum() for s in sides)
        assert feature[0] == 0 and score[cut[0]] == pytest.approx(min(score.values()))
        for child, s in ((1, x[0] <= cut[0]), (2, x[0] > cut[0])):
            assert value[child] == pytest.approx((weight[s] * y[s]).sum() / weight[s].sum())
        assert (forest.vote((feature, cut, value), x) == np.where(x[0] <= cut[0], value[1], value[2])).all()


def test_votes_do_not_depend_on_tasks(spark):
    random = np.random.default_rng(5)
    rows = [("b", int(i), int(j), bool(abs(i - j) < 4), *map(float, [abs(i - j) + random.normal(), *random.random(10)])) for i in range(30) for j in range(i + 1, 30)]
    pairs = spark.createDataFrame(rows, "brand string, cluster_a long, cluster_b long, same boolean, " + ", ".join(f"{c} double" for c in forest.FEATURES))
    told = [{(r.cluster_a, r.cluster_b): round(r.p, 9) for r in forest.out_of_fold(pairs.repartition(k), "same", ["brand", "cluster_a", "cluster_b"], trees=20, block=block, folds=3).collect()} for k, block in ((1, 20), (4, 3))]
    assert told[0] == told[1] and len(told[0]) == len(rows)
    p, y = np.array([told[0][r[1], r[2]] for r in rows]), np.array([r[3] for r in rows])
    assert (p[y][:, None] > p[~y][None]).mean() > 0.97  # area under the curve


def test_decisions_on_samples(spark):
    from huegrain.intake import decided

    asked = spark.createDataFrame([(1, "a", 42, False), (2, "a", 42, False), (3, "a", 42, False), (4, "a", 42, False), (5, "a", 42, True), (6, "a", 42, True), (7, None, None, False)], "run long, strata string, seed long, resample boolean")
    held = spark.createDataFrame([(2, "a", 42), (3, "a", 7), (4, "b", 42), (5, "a", 42), (7, None, None)], "run long, held_strata string, held_seed long")
    assert {r.run: r.decision for r in decided(asked, held).collect()} == {1: "fresh", 2: "reuse", 3: "refuse", 4: "refuse", 5: "resample", 6: "fresh", 7: "reuse"}
