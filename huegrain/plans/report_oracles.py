"""DuckDB SQL for the reports."""

from .oracles import P
from .rules import ARCH, BAND, EXCLUDED, GAP, GRID, HUED, KEYWORD_RE, KIND, LOOSE, MERGE, PAIRS, STRATUM, STRICT, closure, de00, q, rule, tint, to

COVER = f"""
banded AS (SELECT *, {BAND} AS band FROM {tint('palette')}),
near60 AS (
  SELECT x.instance_id, x.band, x.cluster_rank AS i, y.cluster_rank AS j FROM banded x JOIN banded y ON x.instance_id = y.instance_id AND x.band = y.band
  WHERE sqrt(power(x.lab_l - y.lab_l, 2) + power(x.lab_a - y.lab_a, 2) + power(x.lab_b - y.lab_b, 2)) < 60
), {closure('near60', 'instance_id, band', 'k')},
cov AS (
  SELECT instance_id, band, k4.g, {to('sum(perc)', 6)} AS perc FROM banded b JOIN k4 USING (instance_id, band) WHERE b.cluster_rank = k4.i GROUP BY ALL
), placed AS (SELECT c.*, brand, {STRICT} AS gender FROM cov c JOIN arch USING (instance_id) WHERE {STRICT} IS NOT NULL)"""

#: a candidate replaces one constant of the rule; the pairs' decisions and the groups that follow from them
SWEEP = f"""{PAIRS},
cand AS (
  SELECT 'hue_merge' AS constant, unnest(range(10, 46)) AS candidate UNION ALL SELECT 'low_chroma_merge', unnest(range(5, 31)) UNION ALL SELECT 'low_chroma_max_delta_l', unnest(range(10, 61)) UNION ALL SELECT 'neutral_chroma', unnest(range(2, 21))
), setting AS (
  SELECT *, CASE WHEN constant = 'hue_merge' THEN candidate ELSE 25 END AS hu, CASE WHEN constant = 'low_chroma_merge' THEN candidate ELSE 15 END AS lo, CASE WHEN constant = 'low_chroma_max_delta_l' THEN candidate ELSE 35 END AS li, CASE WHEN constant = 'neutral_chroma' THEN candidate ELSE 8 END AS ne FROM cand
), tried AS (
  SELECT x.instance_id, constant, candidate, x.cluster_rank AS i, y.cluster_rank AS j, x.cluster_rank = y.cluster_rank AS itself, {rule('hu', 'lo', 'li', 'ne')} AS one, x.u = y.u AS same, x.g = y.g AS was
  FROM marked x JOIN marked y ON x.instance_id = y.instance_id CROSS JOIN setting
), nearc AS (SELECT instance_id, constant, candidate, i, j FROM tried WHERE itself OR one), {closure('nearc', 'instance_id, constant, candidate', 'c')},
judged AS (
  SELECT t.instance_id, t.constant, t.candidate, t.one = t.same AS pair_ok, (a.g = b.g) = t.same AS group_ok, (a.g = b.g) <> t.was AS moved
  FROM tried t JOIN c4 a ON t.instance_id = a.instance_id AND t.constant = a.constant AND t.candidate = a.candidate AND t.i = a.i JOIN c4 b ON t.instance_id = b.instance_id AND t.constant = b.constant AND t.candidate = b.candidate AND t.j = b.i WHERE t.i < t.j
), scored AS (SELECT constant, candidate, count(DISTINCT instance_id) FILTER (moved) AS n_moved, sum(group_ok::INT) * 100e0 / count(*) AS ga, sum(pair_ok::INT) * 100e0 / count(*) AS pa FROM judged GROUP BY ALL)"""

ZONES = f"""
zones0 AS (SELECT brand, color_cluster AS zone, count(*) AS n, {to('avg(lab_l)', 6)} AS lab_l, {to('avg(lab_a)', 6)} AS lab_a, {to('avg(lab_b)', 6)} AS lab_b FROM dominant GROUP BY ALL),
zones1 AS (SELECT brand, zone, n, lab_l, lab_a, lab_b, {to('sat', 6)} AS sat FROM {tint('zones0')}),
zones AS (SELECT *, {BAND} AS band FROM zones1)"""

SAMPLE = f"""
hashed AS (SELECT archetype, brand, instance_id, has_saturated, md5('42:' || instance_id::VARCHAR) AS h FROM products JOIN arch USING (instance_id)),
ranked_h AS (SELECT *, row_number() OVER (PARTITION BY archetype, brand ORDER BY h, instance_id) > 4 AS late FROM hashed),
sample AS (SELECT archetype, brand, instance_id, place, has_saturated FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY late, h, instance_id) AS place FROM ranked_h) WHERE place <= 24)"""

SERIES = f"""
series AS (SELECT brand, {LOOSE} AS gender, query, archive_id, min(month) AS month FROM arch WHERE {LOOSE} IS NOT NULL GROUP BY ALL)"""

DEPTHS = """
disc AS (SELECT * FROM dominant WHERE discounted), d0 AS (SELECT avg(depth) AS d0 FROM disc),
dstat AS (SELECT color_cluster, count(*) AS n, avg(depth) AS mean, var_samp(depth) AS v FROM disc GROUP BY 1 HAVING count(*) >= 10 AND var_samp(depth) > 0)"""


_KEYS = KEYWORD_RE
_METRICS = {"precision": "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "recall": "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "accuracy": "coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0)"}
#: neutral zones by lightness, others by hue turned half round
_TURN = to("CASE WHEN band = 'neutral' THEN lab_l ELSE (CASE WHEN atan2(lab_b, lab_a) < 0 THEN degrees(atan2(lab_b, lab_a)) + 540 ELSE degrees(atan2(lab_b, lab_a)) + 180 END) % 360 END")
_TOKENS = "SELECT DISTINCT instance_id, brand, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(title_second, '')), '[\\p{L}\\p{N}_-]+')) AS token FROM inst"
_BANDS = "CASE WHEN sat < 20 THEN 0 WHEN sat < 45 THEN 1 WHEN sat < 70 THEN 2 ELSE 3 END"
_KINDS = ("MONO", "DOM_ACC", "DUAL_BAL", "MULTI_DOM", "MULTI_BAL")
_SHARES = ", ".join(f"{to(f'avg((archetype IN ({k}))::INT) * 100', 3)} AS {n}" for k, n in [*((f"'{k}'", k.lower()) for k in _KINDS), ("'MONO', 'DOM_ACC'", "simple")])

SQL = {
    "coverage_bimodal": q(COVER, f"SELECT brand, gender, band, count(*) AS n, {to('avg((perc >= 80 OR perc <= 20)::INT) * 100', 3)} AS bimodal_pct, {to('avg(perc)', 3)} AS mean_coverage FROM placed GROUP BY ALL"),
    "coverage_histogram": q(COVER, "SELECT band, CAST(least(39, floor(perc / 2.5::DOUBLE)) AS INTEGER) AS bin, count(*) AS n FROM placed GROUP BY ALL"),
    "pair_features": q(PAIRS, f"SELECT instance_id, i, j, {to('dl', 3)} AS dl, {to('dchroma', 3)} AS dchroma, {to('dhue', 3)} AS dhue, {to('mean_l', 3)} AS mean_l, {to('min_chroma', 3)} AS min_chroma, {to('max_chroma', 3)} AS max_chroma, merged, legacy FROM pairs"),
    "pair_merge_rates": q(PAIRS, f"SELECT {KIND} AS kind, count(*) AS n, {to('avg(merged::INT) * 100', 3)} AS merge_pct, {to('avg(legacy::INT) * 100', 3)} AS legacy_pct, {to('avg((merged = legacy)::INT) * 100', 3)} AS agree_pct, {to('median(dl)', 3)} AS median_dl FROM pairs GROUP BY 1"),
    "boundary_strata": q(PAIRS + f", st AS (SELECT instance_id, min({STRATUM}) AS stratum FROM pairs GROUP BY 1)", "SELECT brand, stratum, count(*) AS n FROM st JOIN arch USING (instance_id) GROUP BY ALL"),
    "merge_sweep": q(SWEEP + ", whole AS (SELECT count(DISTINCT instance_id) AS n_products FROM palette)", f"SELECT constant, CAST(candidate AS INTEGER) AS candidate, n_products, n_products - n_moved AS n_same, {to('ga')} AS group_accuracy, {to('pa')} AS pair_accuracy FROM scored, whole"),
    "depth_tests": q(GRID + "," + DEPTHS, f"SELECT color_cluster, n, {to('mean', 3)} AS depth_pct, {to('mean - d0', 3)} AS deviation, {to('(mean - d0) / sqrt(v / n)', 3)} AS t FROM dstat, d0"),
    "zone_discount_tests": q(GRID + ", b AS (SELECT brand, avg(discounted::INT) AS p0 FROM dominant GROUP BY 1), zs AS (SELECT brand, color_cluster // 10000 AS zone, count(*) AS n, CAST(sum(discounted::INT) AS BIGINT) AS x, avg(CASE WHEN discounted THEN depth END) AS depth FROM dominant GROUP BY ALL), zz AS (SELECT *, (x * 1.0e0 / n - p0) / greatest(sqrt(p0 * (1 - p0) / n), 1e-10) AS z FROM zs JOIN b USING (brand))", f"SELECT brand, zone, n, x AS n_discounted, {to('depth', 3)} AS depth_pct, {to('(x * 1.0e0 / n - p0) * 100', 3)} AS deviation, {to('z', 3)} AS z, {P} < 0.05 AS significant FROM zz"),
    "scale_bounds": q(GRID + ", b AS (SELECT brand, avg(discounted::INT) * 100 AS f0, avg(price_curr) AS p0 FROM dominant GROUP BY 1), zs AS (SELECT brand, color_cluster, avg(discounted::INT) * 100 AS f, avg(price_curr) AS p FROM dominant GROUP BY ALL)", "SELECT brand, CAST(greatest(10, ceil(max(abs(f - f0)) - 1e-9)) AS BIGINT) AS freq_bound, CAST(greatest(10, ceil(max(abs((p / p0 - 1) * 100)) - 1e-9)) AS BIGINT) AS price_bound FROM zs JOIN b USING (brand) GROUP BY 1"),
    "swatch_scales": q(GRID + ", zs AS (SELECT brand, color_cluster, count(*) AS n FROM dominant GROUP BY ALL), zm AS (SELECT *, max(n) OVER (PARTITION BY brand) AS mb, max(n) OVER () AS mg FROM zs)", f"SELECT brand, color_cluster, n, {to('600 * sqrt(n * 1.0e0 / mb)', 3)} AS size_brand, {to('600 * sqrt(n * 1.0e0 / mg)', 3)} AS size_overall, {to('log10(n + 1.0e0)')} AS heat FROM zm"),
    "selection_rollup": q(GRID + ", c AS (SELECT *, lab_l >= 40 AND lab_l < 60 AS chosen FROM dominant)", f"SELECT brand, count(*) FILTER (chosen) AS n, {to('avg(CASE WHEN chosen THEN discounted::INT END) * 100', 3)} AS freq_pct, {to('avg(CASE WHEN chosen AND discounted THEN depth END)', 3)} AS depth_pct, {to('avg(CASE WHEN chosen THEN price_curr END)', 3)} AS price, {to('avg(chosen::INT) * 100', 3)} AS share_pct FROM c GROUP BY 1"),
    "zone_order": q(GRID + "," + ZONES, f"SELECT brand, zone, band, row_number() OVER (PARTITION BY brand ORDER BY CASE band WHEN 'neutral' THEN 0 WHEN 'muted' THEN 1 ELSE 2 END, {_TURN}, zone) AS place FROM zones"),
    "saturation_bands": q(GRID + "," + ZONES, f"SELECT brand, {_BANDS} AS band_no, count(*) AS n_zones, CAST(sum(n) AS BIGINT) AS n_products FROM zones GROUP BY ALL"),
    "zone_ball": q(GRID + "," + ZONES + ", seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, zone) AS r FROM zones) WHERE r = 1), zp AS (SELECT z.brand, s.zone AS seed, z.zone, z.n, s.lab_l AS l1, s.lab_a AS a1, s.lab_b AS b1, z.lab_l AS l2, z.lab_a AS a2, z.lab_b AS b2 FROM zones z JOIN seeds s USING (brand))", f"SELECT brand, seed, zone, n, {to('de00', 3)} AS de00 FROM {de00('zp', 'l1', 'a1', 'b1', 'l2', 'a2', 'b2')} t WHERE de00 <= 15"),
    "nearest_zone": q(GRID + "," + ZONES + ", zp AS (SELECT x.brand, x.zone, y.zone AS other, x.lab_l AS l1, x.lab_a AS a1, x.lab_b AS b1, y.lab_l AS l2, y.lab_a AS a2, y.lab_b AS b2 FROM zones x JOIN zones y ON x.brand = y.brand AND x.zone <> y.zone)", f"SELECT brand, zone, other AS nearest, de AS de00 FROM (SELECT *, row_number() OVER (PARTITION BY brand, zone ORDER BY de, other) AS r FROM (SELECT *, {to('de00', 3)} AS de FROM {de00('zp', 'l1', 'a1', 'b1', 'l2', 'a2', 'b2')} t)) WHERE r = 1"),
    "mutual_information": q(GRID + ", c AS (SELECT color_cluster // 10000 AS a, color_cluster % 10 AS b, count(*)::DOUBLE AS n FROM dominant GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS nn FROM c)", f"SELECT {to('2 * sum(n / nn * ln(n * nn / (na * nb))) / (-sum(n / nn * ln(na / nn)) - sum(n / nn * ln(nb / nn)))')} AS nmi FROM t"),
    "archetype_row_pct": q(MERGE + "," + ARCH, f"SELECT coalesce(brand, 'Overall') AS brand, count(*) AS n, {_SHARES} FROM products JOIN arch USING (instance_id) GROUP BY ROLLUP (brand)"),
    "stratified_sample": q(MERGE + "," + ARCH + "," + SAMPLE, "SELECT * FROM sample"),
    "sample_fingerprint": q(MERGE + "," + ARCH + "," + SAMPLE, f"SELECT count(*) AS n, substr(sha1('archetype|42|' || string_agg(brand || ':' || instance_id, ',' ORDER BY brand || ':' || instance_id)), 1, 12) AS fingerprint FROM sample"),
    "sample_metadata": q(MERGE + "," + ARCH + "," + SAMPLE, "SELECT archetype, brand, has_saturated, count(*) AS n FROM sample GROUP BY GROUPING SETS ((archetype), (brand), (has_saturated), ())"),
    "round_robin": q(GRID + f", t AS (SELECT brand, color_cluster // 10000 AS zone, instance_id, {to('perc', 6)} AS perc FROM dominant), r AS (SELECT *, row_number() OVER (PARTITION BY brand, zone ORDER BY perc DESC, instance_id) AS r FROM t)", "SELECT brand, zone, instance_id, row_number() OVER (PARTITION BY brand ORDER BY r, zone) AS place FROM r WHERE r <= 3"),
    "drift_pairs": q(SERIES + ", f AS (SELECT *, first_value(archive_id) OVER (PARTITION BY brand, gender ORDER BY month, archive_id) AS base_id FROM series)", "SELECT brand, gender, base_id, archive_id, month FROM f WHERE archive_id <> base_id"),
    "longest_series": q(SERIES + ", n AS (SELECT brand, gender, query, count(*) AS n_archives, min(month) AS first_month, max(month) AS last_month FROM series GROUP BY ALL)", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY brand, gender ORDER BY n_archives DESC, query) AS r FROM n) WHERE r = 1"),
    "dataset_totals": q("", "SELECT count(*) AS n_products, count(DISTINCT month) AS n_months, CAST(floor(count(*) / 1000) * 1000 AS BIGINT) AS n_floor, min(month) AS first_month, max(month) AS last_month FROM arch"),
    "keyword_coverage": q(f", h AS (SELECT brand, regexp_matches(title, {_KEYS}) AS a, coalesce(regexp_matches(title_second, {_KEYS}), FALSE) AS b FROM inst WHERE title IS NOT NULL AND NOT regexp_matches(title, {EXCLUDED}))"[1:], "SELECT brand, count(*) AS n, count(*) FILTER (a) AS by_title, count(*) FILTER (b) AS by_second, count(*) FILTER (a OR b) AS by_either FROM h GROUP BY 1"),
    "term_signals": q(f", tk AS ({_TOKENS}), n AS (SELECT token, brand, count(*) AS n FROM tk GROUP BY ALL), t AS (SELECT token, CAST(sum(n) AS BIGINT) AS total, list(n ORDER BY n DESC) AS v, stddev_pop(n) / avg(n) AS cv FROM n GROUP BY 1 HAVING sum(n) >= 30), s AS (SELECT token, total, v[1] AS most, coalesce(v[2], 0) AS second, cv FROM t)"[1:], f"SELECT token, total, most, second, {to('cv')} AS cv, {to('(most + 1.0e0) / (second + 1)')} AS skew, {to('most * (most + 1.0e0) / (second + 1)')} AS score FROM s"),
    "label_metrics": f"WITH r AS (SELECT coalesce(lang, '-') AS lang, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT coalesce(lang, 'Overall') AS lang, count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tn FROM r GROUP BY ROLLUP (lang)) SELECT lang, tp, fp, fn, tn, {', '.join(f'{to(t)} AS {n}' for n, t in _METRICS.items())} FROM c",
    "archive_paths": q(", nm AS (SELECT DISTINCT replace(brand, ' ', '') || '_' || replace(query, ' ', '-') || '_' || archive_id || '_' || replace(month, '-', '') || lpad(CAST(instance_id % 28 + 1 AS VARCHAR), 2, '0') AS name FROM arch), p AS (SELECT name, string_split(name, '_') AS p FROM nm)"[1:], "SELECT p[1] AS brand, TRY_CAST(p[-2] AS BIGINT) AS archive_id, max(name) AS latest, count(*) AS n_folders FROM p WHERE len(p) >= 4 GROUP BY ALL"),
}
