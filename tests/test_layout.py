"""The sheet of swatches against a cursor that walks each row."""

import collections
import math

import numpy as np
import pytest

from huegrain import layout

SF = "/root/testdata/sf0.001"


def walked(ideals, spacing):
    """Left edges: packed from the left, then each run of swatches that touch is centred on its ideals, right of 0 and of what stands before."""
    packed, at = [], 0.0
    for x in ideals:
        packed.append(max(x, at))
        at = packed[-1] + spacing
    runs = []
    for i, x in enumerate(ideals):
        if i and x < packed[i - 1] + spacing:
            runs[-1].append(i)
        else:
            runs.append([i])
    left = list(packed)
    for run in runs:
        if len(run) > 1:
            first = sum(ideals[i] for i in run) / len(run) - (len(run) - 1) * spacing / 2
            first = max(first, 0.0, left[run[0] - 1] + spacing if run[0] else 0.0)
            for k, i in enumerate(run):
                left[i] = first + k * spacing
    return left


def test_spread(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    shapes = [[0.0, 0.0, 0.0], [10.0], [100.0, 140.0, 180.0], [100.0, 139.0, 190.0], [764.0] * 4, [0.0, 30.0, 700.0, 710.0]]
    for item, ideals in enumerate(shapes + [sorted(rng.uniform(0, 764, rng.integers(1, 30)).tolist()) for _ in range(200)]):
        want[item] = walked(ideals, 40)
        rows += [("b", item, i, x) for i, x in enumerate(ideals)]
    got = collections.defaultdict(dict)
    for r in layout.spread(spark.createDataFrame(rows, "brand string, item long, cluster long, ideal double"), ["brand", "item"], ["ideal", "cluster"]).collect():
        got[r.item][r.place] = r.left
    for item, left in want.items():
        assert [got[item][i] for i in range(len(left))] == pytest.approx(left, abs=1e-9), shapes[item] if item < len(shapes) else item


def test_spread_of_nothing(spark):
    empty = spark.createDataFrame([], "brand string, item long, cluster long, ideal double")
    assert layout.spread(empty, ["brand", "item"], ["ideal", "cluster"]).collect() == []


def test_sheet(spark):
    """No two slots of a row overlap, rows do not overlap nor do labels, bands follow each other, and sizes go with products."""
    swatches, bands = layout.swatch_layout(spark, SF).collect(), layout.swatch_bands(spark, SF).collect()
    of = collections.defaultdict(list)
    for s in swatches:
        of[s.brand, s.row].append(s)
    rank = {"neutral": 0, "muted": 1, "saturated": 2}
    for row in of.values():
        row.sort(key=lambda s: s.place)
        assert len({(s.y, s.band) for s in row}) == 1 and row[0].x >= 18 and all(b.x - a.x >= 40 - 2e-3 for a, b in zip(row, row[1:]))
        assert len({s.zone for s in row}) == 1 and (row[0].zone is not None or len(row) == 1)
    for brand in {s.brand for s in swatches}:
        rows = [of[brand, i][0] for i in range(1, 1 + max(s.row for s in swatches if s.brand == brand))]
        height = {r.row: max(48.0, math.floor(max(s.size for s in of[brand, r.row]) * 600 + 0.5) / 1000) for r in rows}  # heights have three digits
        at, seen = 0.0, None
        for r in rows:
            assert seen is None or rank[seen] <= rank[r.band]
            if r.band != seen:
                at += 12 if seen else 0
                assert next(b.y for b in bands if (b.brand, b.band) == (brand, r.band)) == pytest.approx(at, abs=2e-3)
                at, seen = at + 56, r.band
            assert r.y == pytest.approx(at + height[r.row] / 2, abs=2e-3)
            at += height[r.row]
        assert all(b.sheet_height == pytest.approx(at + 50, abs=2e-3) for b in bands if b.brand == brand)
        assert max(s.size for s in swatches if s.brand == brand) == 600
    assert len(swatches) == len({(s.brand, s.cluster) for s in swatches}) and sum(b.n_rows for b in bands) == len(of)
