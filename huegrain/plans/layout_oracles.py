"""DuckDB SQL of the sheet of swatches: the cursor along a row as a recursion over its swatches, runs placed one after the other."""

from .cluster_oracles import KIN, recursive
from .report_oracles import _TURN
from .rules import tint, to

SHEET = KIN + f""",
cell AS (SELECT *, coalesce(zone, cluster) AS item, {to('600 * sqrt(n * 1e0 / max(n) OVER (PARTITION BY brand))', 3)} AS size, {to('lab_l', 6)} / 100 * 764 AS ideal FROM member),
centre AS (SELECT brand, item, max(size) AS largest, sum(lab_l * n) / sum(n) AS lab_l, sum(lab_a * n) / sum(n) AS lab_a, sum(lab_b * n) / sum(n) AS lab_b FROM cell GROUP BY ALL),
shown AS (SELECT *, CASE WHEN {to('sat', 6)} < 6 THEN 'neutral' WHEN {to('sat', 6)} < 50 THEN 'muted' ELSE 'saturated' END AS band, {to('greatest(48, largest * 0.6e0)', 3)} AS height FROM {tint('centre')}),
lined AS (SELECT brand, item, band, height, row_number() OVER (PARTITION BY brand ORDER BY CASE band WHEN 'neutral' THEN 0 WHEN 'muted' THEN 1 ELSE 2 END, {_TURN}, item) AS row FROM shown),
sheet AS (SELECT l.brand, l.item, l.band, l.row, l.height,
  (SELECT sum(height) FROM lined x WHERE x.brand = l.brand AND x.row <= l.row) - l.height + (SELECT 68 * count(DISTINCT band) - 12 FROM lined x WHERE x.brand = l.brand AND x.row <= l.row) AS top FROM lined l)"""

PLACED = SHEET + """,
nth AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY brand, item ORDER BY ideal, cluster) - 1 AS place FROM cell),
walk AS (
  SELECT brand, item, place, ideal AS pos, 1 AS run FROM nth WHERE place = 0
  UNION ALL SELECT n.brand, n.item, n.place, greatest(n.ideal, w.pos + 40), CASE WHEN n.ideal < w.pos + 40 THEN w.run ELSE w.run + 1 END
  FROM walk w JOIN nth n ON n.brand = w.brand AND n.item = w.item AND n.place = w.place + 1
),
runs AS MATERIALIZED (SELECT brand, item, run, count(*) AS len, avg(ideal) - (count(*) - 1) * 20 AS start FROM walk JOIN nth USING (brand, item, place) GROUP BY ALL),
settled AS (
  SELECT brand, item, run, len, greatest(start, 0) AS start FROM runs WHERE run = 1
  UNION ALL SELECT r.brand, r.item, r.run, r.len, greatest(r.start, s.start + s.len * 40) FROM settled s JOIN runs r ON r.brand = s.brand AND r.item = s.item AND r.run = s.run + 1
),
stood AS (SELECT w.brand, w.item, w.place, s.start + 40 * (w.place - min(w.place) OVER (PARTITION BY w.brand, w.item, w.run)) AS pos FROM walk w JOIN settled s ON s.brand = w.brand AND s.item = w.item AND s.run = w.run)"""

SQL = {
    "swatch_layout": recursive(PLACED, f"SELECT brand, cluster, zone, band, row, place, {to('pos + 18', 3)} AS x, {to('top + height / 2', 4)} AS y, size FROM stood JOIN nth USING (brand, item, place) JOIN sheet USING (brand, item)"),
    "swatch_bands": recursive(SHEET, f"SELECT brand, band, count(*) AS n_rows, {to('min(top) - 56', 3)} AS y, {to('max(max(top + height)) OVER (PARTITION BY brand) + 50', 3)} AS sheet_height FROM sheet GROUP BY brand, band"),
}
