"""Orders, linkage, tuning and files against plain recomputations."""

import itertools
import json

import numpy as np
import pytest

from huegrain import arrangements as A
from huegrain.functions import color as C
from huegrain.operators import orders as O
from huegrain.operators import palette as P
from huegrain.operators.cluster import complete_linkage, de00
from huegrain.sources import files


@pytest.fixture
def points():
    return np.random.default_rng(2).uniform((0, -60, -60), (100, 60, 60), (40, 3))


def test_chain(points):
    far, left = de00(points, points), set(range(len(points)))
    want = [int(points[:, 0].argmin())]
    left.remove(want[0])
    while left:
        want.append(min(left, key=lambda i: (far[want[-1], i], i)))
        left.remove(want[-1])
    assert O.chain(points) == want


def test_farthest(points):
    far = de00(points, points)
    got = O.farthest(far, 3, 12)
    for n in range(1, 12):
        gap = far[:, got[:n]].min(axis=1)
        assert gap[got[n]] == pytest.approx(gap.max())
    assert sorted(O.farthest(far, 0, 99)) == list(range(len(points)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_leaf_order(n):
    x = np.random.default_rng(n).uniform(0, 10, (n, 2))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    length = lambda order: sum(far[a, b] for a, b in zip(order, order[1:]))
    groups = {i: {i} for i in range(n)}
    for new, (a, b) in enumerate(O.average_linkage(far) if n > 1 else [], n):
        groups[new] = groups[a] | groups[b]
    together = lambda order: all(max(p) - min(p) == len(g) - 1 for g in groups.values() for p in [[order.index(i) for i in g]])
    got = O.leaf_order(far)
    assert sorted(got) == list(range(n)) and together(got)
    assert length(got) == pytest.approx(min(length(p) for p in itertools.permutations(range(n)) if together(p)))


def test_linkage(points):
    far = de00(points, points)
    for cut in (0.0, 8.0, 20.0, 45.0, 500.0):
        plain, fast = complete_linkage(far, cut), O.nearest_chain_linkage(far, cut)
        assert len(set(zip(plain.tolist(), fast.tolist()))) == len(set(plain.tolist())) == len(set(fast.tolist()))
        assert all(far[np.ix_(fast == g, fast == g)].max() <= cut + 1e-4 for g in set(fast.tolist()))


def test_closed_pairs(spark):
    """The table of closures and the bit arithmetic of columns say the same for all sets of pairs."""
    w = spark.range(1 << len(P.PAIRS)).selectExpr("id", *(f"(id & {1 << k}) <> 0 AS e{i}{j}" for k, (i, j) in enumerate(P.PAIRS)))
    table = P.closed_pairs()
    for r in P.closure(w, lambda i, j: f"e{i}{j}").collect():
        assert table[r.id] == sum(1 << k for k, (i, j) in enumerate(P.PAIRS) if r[f"g{i}"] == r[f"g{j}"])
        assert table[r.id] & r.id == r.id


def test_tuning(spark):
    """Each step's value is the best of its candidates, by a plain union of a sample of products."""
    steps = A.tune_rule(spark, "/root/testdata/sf0.001").collect()
    accuracy = [r.accuracy for r in steps]
    assert accuracy == sorted(accuracy) and [r.constant for r in steps[:4]] == list(P.RULE)
    assert all(r.held_out_gain is not None for r in steps[:4]) and all(r.before == r.best for r in steps[-4:]) or len(steps) == 12
    sweep = {(r.constant, r.candidate): r.group_accuracy for r in __import__("huegrain.reports", fromlist=["merge_sweep"]).merge_sweep(spark, "/root/testdata/sf0.001").collect()}
    first = steps[0]
    assert sweep[first.constant, first.best] == pytest.approx(100 * first.accuracy, abs=1e-3) == pytest.approx(max(v for (c, _), v in sweep.items() if c == first.constant), abs=1e-3)


def test_tuning_reads_products_once(spark):
    """A step reads the table that was laid out, without the catalogue's lines, and counts what the rule's own expressions say, at values on
    the measures and between them."""
    w = A.labelled(spark, "/root/testdata/sf0.001")
    t = A.laid_out(w)
    values = [2, 8, 10, 25, 35, 60]
    for constant in P.RULE:
        got = A._accuracy(t, constant, values, P.RULE)
        assert "lineitem" not in got._jdf.queryExecution().toString()
        one = lambda v: [f"{P.merges(i, j, **{**P.RULE, constant: v})}" for i, j in P.PAIRS]  # noqa: B023, E731
        for v in (8, 25):
            g = P.closure(w, lambda i, j: one(v)[P.PAIRS.index((i, j))], "h")  # noqa: B023
            right = " + ".join(f"CASE WHEN dl{i}{j} IS NOT NULL AND (h{i} = h{j}) = (u{i} = u{j}) THEN 1 ELSE 0 END" for i, j in P.PAIRS)
            want = g.selectExpr("pmod(xxhash64(instance_id), 5) AS fold", f"{right} AS r").groupBy("fold").sum("r").collect()
            assert sorted(tuple(r) for r in want) == sorted((r.fold, r.right) for r in got.collect() if r.candidate == v)
    A.release(t)


def test_tree_reads_written_pairs(spark, monkeypatch):
    """The fit, which reads its rows several times, reads them from a table, which goes afterwards."""
    seen = []
    monkeypatch.setattr(A, "handed_on", lambda df: seen.append(files.handed_on(df)) or seen[-1])
    assert sum(r.importance for r in A.merge_tree(spark, "/root/testdata/sf0.001").collect()) == pytest.approx(1, abs=1e-3)
    assert [t.columns for t in seen] == [[*A.TREE, "label"]] and not files.exists(spark, seen[0]._written)


def test_colors_rounded_half_to_even(spark):
    rows = spark.createDataFrame([(0.5 / 255,), (1.5 / 255,), (2.5 / 255,), (254.6 / 255,)], "c double")
    assert [r[0] for r in rows.selectExpr(C.byte_of("c", True)).collect()] == [0, 2, 2, 255] and [r[0] for r in rows.selectExpr(C.byte_of("c")).collect()] == [0, 1, 2, 254]


def test_palette_of_one_colour_without_coverage(spark):
    one = spark.createDataFrame([(1, 1, 0.0, 50.0, 10.0, 10.0), (2, 1, 0.0, 50.0, 10.0, 10.0), (2, 2, 0.0, 51.0, 10.0, 10.0), (3, 1, 60.0, 5.0, 0.0, 0.0), (3, 2, 0.0, 95.0, 0.0, 0.0)], "instance_id long, cluster_rank int, perc double, lab_l double, lab_a double, lab_b double")
    assert sorted((r.instance_id, r.lab_l, r.perc) for r in P.merge_palette(one).collect()) == [(1, 50.0, 0.0), (3, 5.0, 60.0)]


def test_csv(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    files.write_csv(spark.createDataFrame([("x", "1", "2.5"), ("y", "one", "0"), ("z", "3", "n/a"), (None, "4", "-1")], "name string, n string, price string"), path)
    with pytest.raises(ValueError, match="lacks the columns gone"):
        files.read_csv(spark, path, "n int, gone int")
    with pytest.raises(ValueError, match="lacks the columns gone"):
        files.read_csv_lenient(spark, path, "gone int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_csv(spark, path, "n int").collect()
    got = files.read_csv_lenient(spark, path, "n int, price double, name string", required=("n",), positive=("price",)).collect()
    assert sorted(map(tuple, got)) == [(1, 2.5, "x"), (3, None, "z")]


def test_tables_grow_by_what_they_lack(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame(list(x), "k int, v string")
    assert files.append_missing(rows((1, "a"), (1, "b"), (2, "c")), path, "k") == 2
    assert files.append_missing(rows((1, "z"), (3, "d")), path, "k") == 1 and files.append_missing(rows((1, "z"), (3, "d")), path, "k") == 0
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_zone_files_are_not_clobbered(spark, tmp_path):
    path, zones = f"file://{tmp_path}/z", lambda n: spark.createDataFrame([(f"Group {n}", [1, 2]), ("Own name", [3])], "name string, cluster_ids array<long>")
    assert files.write_zones(zones(1), path, "20240101_000000") == path
    assert files.write_zones(zones(2), path, "20240102_000000") == f"{path}.20240102_000000"
    assert sorted(map(tuple, files.read_zones(spark, path).collect())) == [("Own name", 3), ("Zone 1", 1), ("Zone 1", 2)]
    assert files.write_zones(zones(3), path, "x", overwrite=True) == path and ("Zone 3", 1) in set(map(tuple, files.read_zones(spark, path).collect()))


def test_decisions_folders_and_connections(spark, tmp_path):
    assert files.read_decisions(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "d.json").write_text(json.dumps({"widget": "accepted", "gear": "rejected"}, indent=1))
    assert sorted(map(tuple, files.read_decisions(spark, f"file://{tmp_path}/d.json").collect())) == [("gear", "rejected"), ("widget", "accepted")]
    assert files.stamped("out/", "run", "20240102_030405") == "out/run_20240102_030405"
    with pytest.raises(ValueError):
        files.stamped("out", "run", "today")
    env = {"DB_HOST": "db", "DB_PORT": "6543", "DB_USER": "u", "DB_PASSWORD": "p"}
    assert files.jdbc_options("b", env)["url"] == "jdbc:postgresql://db:6543/b" and "READ ONLY" in files.jdbc_options("b", env)["sessionInitStatement"] and "sessionInitStatement" not in files.jdbc_options("b", env, write=True)


def test_forest_finds_zones(spark):
    """Three groups of clusters in each of two brands: probabilities are of folds that the forest has not seen, and linkage on them gives the groups."""
    from huegrain.operators import forest

    random = np.random.default_rng(7)
    rows = []
    for brand in "xy":
        place = [g * 40 + random.uniform(-4, 4) for g in range(3) for _ in range(12)]
        for i in range(36):
            for j in range(i + 1, 36):
                far = abs(place[i] - place[j])
                rows.append((brand, i, j, i // 12 == j // 12, *(float(far + x) for x in random.uniform(0, 1, 11))))
    pairs = spark.createDataFrame(rows, "brand string, cluster_a long, cluster_b long, same_zone boolean, " + ", ".join(f"{c} double" for c in forest.FEATURES))
    p = forest.out_of_fold(pairs, "same_zone", ["brand", "cluster_a", "cluster_b"], trees=12, depth=4, folds=3)
    got = p.collect()
    assert len(got) == len(rows) and sum((r.p > 0.5) == r.same_zone for r in got) >= 0.97 * len(rows)  # its thresholds are quantiles
    given = spark.createDataFrame([(r.brand, r.cluster_a, r.cluster_b, 0.9 if r.same_zone else 0.1) for r in got], "brand string, cluster_a long, cluster_b long, p double")
    zones = lambda pairs: {(r.brand, r.cluster): r.zone for r in forest.zones_from(pairs, "brand", "cluster_a", "cluster_b").collect()}
    assert zones(given) == {(b, i): i // 12 for b in "xy" for i in range(36)}
    lone = zones(given.filter("NOT (cluster_a = 0 AND cluster_b < 12)"))  # a pair that is not given is 1 apart: 0 joins nobody
    assert all((lone["x", 0] == lone["x", i]) == (i == 0) for i in range(36)) and lone["x", 1] == lone["x", 11]
    one = forest.out_of_fold(pairs.filter("same_zone"), "same_zone", ["brand", "cluster_a", "cluster_b"]).select("p").distinct().collect()
    assert [r.p for r in one] == [1.0]
