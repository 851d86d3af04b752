"""Every query against its SQL in DuckDB, at the smallest size; formulas against published values."""

import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pytest

from huegrain import catalog
from huegrain.functions import color as C
from huegrain.functions import stats as S
from huegrain.functions.exact import mcnemar_p, student_p
from huegrain.operators.cluster import complete_linkage, weighted_kmeans
from huegrain.operators.palette import archetypes, merge_palette
from huegrain.operators.transport import entropic_transport

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 3) + 0.0
    return int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in got.collect())
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in want.fetchall())


@pytest.mark.parametrize("lab1,lab2,want", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, -1, 2), (50, 0, 0), 2.3669), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)])
def test_de00_published(spark, lab1, lab2, want):
    df = spark.createDataFrame([tuple(map(float, (*lab1, *lab2)))], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    assert C.with_de00(df, "l1", "a1", "b1", "l2", "a2", "b2").first()["de00"] == pytest.approx(want, abs=1e-4)


def palette(spark, *colors):
    return spark.createDataFrame([(1, i + 1, float(p), float(l), float(a), float(b)) for i, (l, a, b, p) in enumerate(colors)], "instance_id long, cluster_rank int, perc double, lab_l double, lab_a double, lab_b double")


@pytest.mark.parametrize("colors,n,kind", [(((5, 0, 0, 60), (95, 0, 0, 40)), 2, "DUAL_BAL"), (((40, 1, 1, 60), (60, 1, 1, 40)), 1, "MONO"), (((20, 0, 0, 50), (55, 0, 0, 50)), 1, "MONO"), (((50, 40, 0, 40), (50, 37.6, 13.7, 30), (50, 30.6, 25.7, 30)), 1, "MONO"), (((50, 0, 0, 99), (50, 60, 40, 1)), 2, "DOM_ACC")])
def test_palette_rules(spark, colors, n, kind):
    assert merge_palette(palette(spark, *colors)).count() == n
    assert archetypes(palette(spark, *colors)).first()["archetype"] == kind


def test_statistics(spark):
    row = spark.createDataFrame([(260, 296)], "k int, n int").selectExpr(*S.wilson("(k * 1.0e0)", "n"), S.sample_size("1000"), S.sample_size("10"), S.normal_two_tailed("1.959964e0")).first()
    assert (round(row[0], 3), round(row[1], 3), row[2], row[3]) == (0.836, 0.911, 88, 10)
    assert row[4] == pytest.approx(0.05, abs=1e-5)


def test_grouped_numpy():
    x = np.array([0.0, 4.0, 8.0])
    assert complete_linkage(np.abs(x[:, None] - x), 5).tolist() == [0, 0, 1]


def test_transport():
    """Against the best of all permutations where the regularisation is small, against closed forms, and where parts of the plan hardly touch."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        cost = rng.uniform(0, 100, (n, n))
        got, met = entropic_transport(np.full(n, 1 / n), np.full(n, 1 / n), cost, reg=0.01)
        assert met and got == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))) / n, abs=1e-2)
    half = np.array([0.5, 0.5])
    got, met = entropic_transport(half, half, np.array([[0.0, 1.0], [1.0, 0.0]]), reg=0.5)
    assert met and got == pytest.approx(1 / (1 + math.e**2), abs=1e-8)
    got, met = entropic_transport(np.array([1.0]), np.array([0.2, 0.3, 0.5]), np.array([[10.0, 20.0, 30.0]]))
    assert met and got == pytest.approx(23.0)
    for a, b in (([0.3, 0.7], [0.7, 0.3]), ([1e-6, 1 - 1e-6], [0.5, 0.5])):  # what is too much on one side crosses a gap of 90
        got, met = entropic_transport(np.array(a), np.array(b), np.array([[0.0, 90.0], [90.0, 0.0]]))
        assert met and got == pytest.approx(90 * abs(a[0] - b[0]), abs=1e-5)
    a, b = rng.dirichlet(np.ones(30)), rng.dirichlet(np.ones(47))
    cost = rng.uniform(0, 60, (30, 47))
    assert entropic_transport(a, b, cost)[0] == pytest.approx(entropic_transport(b, a, cost.T)[0], abs=1e-9)


def test_exact_p_values():
    for b, c in [(0, 0), (0, 5), (3, 9), (7, 7), (40, 60)]:
        n = b + c
        want = min(1.0, 2 * min(0.5, sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)) if n else 1.0
        assert mcnemar_p(b, c) == pytest.approx(want, rel=1e-9)
    # one degree of freedom: Cauchy; two: closed form; tables for ten and thirty
    t = np.array([0.0, 0.5, 1.0, 12.7062, 1.0, 2.228139, 2.042272, -2.042272, 50.0])
    df = np.array([1, 1, 1, 1, 2, 10, 30, 30, 500.0])
    want = [1.0, 1 - 2 / math.pi * math.atan(0.5), 0.5, 0.05, 1 - 1 / math.sqrt(3), 0.05, 0.05, 0.05, 0.0]
    assert np.allclose(student_p(t, df), want, atol=1e-6)


def plain_kmeans(x, w, k):
    at = int(((x - np.average(x, axis=0, weights=w)) ** 2).sum(1).argmin())
    chosen = [at]
    while len(chosen) < k:
        near = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    centers, label = x[chosen].copy(), None
    for _ in range(51):
        now = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        if label is not None and (now == label).all():
            break
        label = now
        for c in set(label.tolist()):
            centers[c] = np.average(x[label == c], axis=0, weights=w[label == c])
    return centers, label


def test_weighted_kmeans():
    """The same as rounds over the whole table of distances, whatever the tile; repeated rows and fewer different rows than centres included."""
    x = np.array([[0.0, 0, 0], [1, 0, 0], [50, 0, 0], [52, 0, 0]])
    centers, label = weighted_kmeans(x, np.array([3.0, 1, 1, 1]), 2)
    assert sorted(centers[:, 0].round(6).tolist()) == [0.25, 51.0] and label[0] == label[1] != label[2] == label[3]
    rng = np.random.default_rng(4)
    for n, k in ((300, 7), (500, 40), (60, 1), (40, 40)):
        x, w = np.repeat(rng.uniform(0, 100, (n // 2, 3)), 2, axis=0), rng.uniform(0.1, 5, n)
        want = plain_kmeans(x, w, k)
        for tile in (1, 64, 1 << 20):
            got = weighted_kmeans(x, w, k, tile=tile)
            assert (got[1] == want[1]).all() and np.allclose(got[0], want[0])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows
    for r in rows:
        for c, v in r.asDict().items():
            assert v is not None and not (isinstance(v, float) and math.isnan(v)), (c, r)


def test_downsample_keeps_coverage(spark):
    from pyspark.sql import functions as F

    from huegrain import reports
    from huegrain.sources import catalogue as src

    had = src.palette_colors(spark, SF).join(src.archives_of(spark, SF), "instance_id").agg(F.sum("perc")).first()[0]
    out = reports.downsample_palettes(spark, SF)
    assert out.agg(F.sum("perc")).first()[0] == pytest.approx(had) and out.groupBy("archive_id").count().agg(F.max("count")).first()[0] <= 60


def test_downsample_copies_small_archives(spark):
    from huegrain import reports
    from huegrain.operators.cluster import downsample
    from huegrain.sources import catalogue as src

    sf = "/root/testdata/sf0.1"  # at most 404 colours an archive, under the 1900 of the reference
    rows = src.palette_colors(spark, sf).join(src.archives_of(spark, sf), "instance_id")
    assert reports.downsample_palettes(spark, sf).count() == rows.count()
    few = spark.createDataFrame([(1, i, 1, float(50 * (i % 2) + i / 10), 0.0, 0.0, 1.0 + i) for i in range(6)], "archive_id long, instance_id long, cluster_rank long, lab_l double, lab_a double, lab_b double, perc double")
    got = sorted((round(r.lab_l, 6), r.perc) for r in downsample(few, 2).collect())
    assert got == [(round((0.2 * 3 + 0.4 * 5) / 9, 6), 9.0), (round((50.1 * 2 + 50.3 * 4 + 50.5 * 6) / 12, 6), 12.0)]


@pytest.mark.parametrize("lab1,lab2,want", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082), ((50, -0.001, 2.49), (50, 0.0009, -2.49), 4.8045)])
def test_de00_matrix(lab1, lab2, want):
    from huegrain.operators.cluster import de00

    assert de00(np.array([lab1], float), np.array([lab2], float))[0, 0] == pytest.approx(want, abs=1e-4)


def test_archive_drift_pairs(spark):
    """A row for each pair of archives; the distances by plain log-domain rounds over the pairs' whole palettes, all with their marginals met."""
    from huegrain import reports
    from huegrain.operators.cluster import de00

    got = {(r.base_id, r.archive_id): r for r in catalog.archive_drift(spark, SF).collect()}
    pairs = reports.drift_pairs(spark, SF).collect()
    colors = {}
    for r in reports.downsample_palettes(spark, SF).collect():
        colors.setdefault(r.archive_id, []).append((r.lab_l, r.lab_a, r.lab_b, r.perc))
    assert set(got) == {(r.base_id, r.archive_id) for r in pairs if r.base_id in colors and r.archive_id in colors} and len(got) > 20
    met = 0
    for base, later in sorted(got)[:8]:
        x, y = np.array(colors[base]), np.array(colors[later])
        a, b, cost = x[:, 3] / x[:, 3].sum(), y[:, 3] / y[:, 3].sum(), de00(x[:, :3], y[:, :3])
        f, g = np.zeros(len(a)), np.zeros(len(b))
        for _ in range(3000):
            f = np.log(a) - np.logaddexp.reduce(-cost / 0.1 + g[None], axis=1)
            g = np.log(b) - np.logaddexp.reduce(-cost / 0.1 + f[:, None], axis=0)
        plan = np.exp(-cost / 0.1 + f[:, None] + g[None])
        if np.abs(plan.sum(1) - a).max() < 1e-6:  # the plain rounds themselves may not have met the marginals
            met += 1
            assert got[base, later].distance == pytest.approx((plan * cost).sum(), abs=1e-3)
    assert all(r.converged for r in got.values()) and met > 0
