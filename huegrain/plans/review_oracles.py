"""DuckDB SQL for the reviews, by hand."""

from .oracles import P
from .rules import ARCH, BAND, GAP, GRID, HI, HUED, KIND, LO, MERGE, PAIRS, STRATUM, STRICT, closure, near, q, rule, tint, to

HEX = lambda rounding=False: "'#' || " + " || ".join(f"lower(printf('%02x', CAST({'round_even(' + c + ' * 255, 0)' if rounding else 'floor(' + c + ' * 255)'} AS INTEGER)))" for c in "rgb")
HASH = "md5('42:' || instance_id::VARCHAR)"

CLUSTERS = f"""{GRID},
bc AS (
  SELECT brand, color_cluster, color_cluster // 10000 AS zone, count(*) AS n_products, count(*) FILTER (discounted) AS n_discounted, avg(depth) FILTER (discounted) AS depth,
    sum(lab_l * perc) / sum(perc) AS lab_l, sum(lab_a * perc) / sum(perc) AS lab_a, sum(lab_b * perc) / sum(perc) AS lab_b FROM dominant GROUP BY ALL
), cc AS (
  SELECT color_cluster, count(*) AS n_products, count(*) FILTER (discounted) AS n_discounted, avg(depth) FILTER (discounted) AS depth, stddev_samp(depth) FILTER (discounted) AS depth_std,
    sum(lab_l * perc) / sum(perc) AS lab_l, sum(lab_a * perc) / sum(perc) AS lab_a, sum(lab_b * perc) / sum(perc) AS lab_b FROM dominant GROUP BY ALL
), b AS (SELECT brand, avg(discounted::INT) AS p0, coalesce(avg(depth) FILTER (discounted), 0) AS d0, avg(price_std) FILTER (price_std > 0) AS pr0 FROM dominant GROUP BY 1)"""

ROLLUP = f"""{CLUSTERS},
zr AS (
  SELECT brand, zone, CAST(sum(n_products) AS BIGINT) AS n_products, CAST(sum(n_discounted) AS BIGINT) AS n_discounted, sum(depth * n_discounted) / nullif(sum(n_discounted) FILTER (depth IS NOT NULL), 0) AS depth FROM bc GROUP BY ALL
), zz AS (SELECT *, (n_discounted / n_products::DOUBLE - p0) / CASE WHEN p0 > 0 AND p0 < 1 THEN sqrt(p0 * (1 - p0) / n_products) ELSE 1e-10 END AS z FROM zr JOIN b USING (brand)),
zone_out AS (
  SELECT brand, zone, n_products, n_discounted, {to('n_discounted * 100e0 / n_products', 2)} AS freq_pct, {to('(n_discounted / n_products::DOUBLE - p0) * 100', 2)} AS freq_deviation_pp, {P} < 0.05 AS freq_significant,
    {to('coalesce(depth, 0)', 2)} AS depth_pct, {to('coalesce(depth - d0, 0)', 2)} AS depth_deviation_pp, depth IS NOT NULL AS has_depth FROM zz
)"""

WINDOW = f"""{GRID},
cube AS (SELECT brand, month, color_cluster // 10000 AS zone, count(*) AS n, count(*) FILTER (discounted) AS disc, sum(depth) AS ds, sum(price_std) FILTER (price_std > 0) AS ps, count(*) FILTER (price_std > 0) AS np FROM dominant GROUP BY ALL),
months AS (SELECT DISTINCT month FROM cube ORDER BY month DESC LIMIT 12), inside AS (SELECT * FROM cube WHERE month IN (SELECT month FROM months)),
wz AS (SELECT k.brand, k.zone, coalesce(sum(n), 0) AS n, coalesce(sum(disc), 0) AS disc, coalesce(sum(ds), 0) AS ds, coalesce(sum(ps), 0) AS ps, coalesce(sum(np), 0) AS np FROM (SELECT DISTINCT brand, zone FROM cube) k LEFT JOIN inside i ON k.brand = i.brand AND k.zone = i.zone GROUP BY ALL),
ever AS (SELECT brand, coalesce(sum(ds) / nullif(sum(disc), 0), 0) AS de FROM cube GROUP BY 1),
wb AS (SELECT brand, sum(disc) * 100e0 / sum(n) AS f0, sum(ds) / nullif(sum(disc), 0) AS d0, sum(ps) / nullif(sum(np), 0)::DOUBLE AS p0 FROM inside GROUP BY 1)"""

SAMPLED = f"""{GRID},
lasts AS (SELECT brand, archive_id FROM (SELECT brand, archive_id, row_number() OVER (PARTITION BY brand ORDER BY max(month) DESC, archive_id DESC) AS rk FROM dominant GROUP BY brand, archive_id) WHERE rk <= 6),
sampled AS (SELECT * FROM dominant WHERE archive_id IN (SELECT archive_id FROM lasts)),
sb AS (SELECT brand, avg(discounted::INT) * 100 AS f0, coalesce(avg(depth) FILTER (discounted), 0) AS d0 FROM sampled GROUP BY 1),
sc AS (SELECT brand, color_cluster, count(*) AS n, count(*) FILTER (discounted) AS x, avg(depth) FILTER (discounted) AS dp FROM sampled GROUP BY ALL),
mode AS (SELECT e.brand, e.color_cluster, coalesce(n, 0) AS n_products, coalesce(x, 0) AS n_discounted, {to('dp', 3)} AS depth_pct, {to('f0', 3)} AS baseline_freq_pct, {to('d0', 3)} AS baseline_depth_pct
  FROM (SELECT DISTINCT brand, color_cluster FROM dominant) e LEFT JOIN sc ON e.brand = sc.brand AND e.color_cluster = sc.color_cluster LEFT JOIN sb ON e.brand = sb.brand)"""

BOUNDARY = f"""{PAIRS},
strata AS (SELECT instance_id, min({STRATUM}) AS stratum FROM pairs GROUP BY 1),
near_sample AS (SELECT stratum, instance_id, place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}, instance_id) AS place FROM strata) WHERE place <= CASE stratum WHEN 1 THEN 60 WHEN 2 THEN 80 WHEN 3 THEN 60 ELSE 40 END)"""

#: the same palette under the rule without its lightness guards
LOOSE_MERGE = MERGE.replace(rule(), rule(guard=False))
assert LOOSE_MERGE != MERGE


def renamed(ctes: str, *names: str) -> str:
    import re

    for n in names:
        ctes = re.sub(rf"\b{n}\b", f"{n}_o", ctes)
    return ctes


LABELS = MERGE + "," + ARCH + "," + renamed(LOOSE_MERGE + "," + ARCH, "hued", "near", "g1", "g2", "g3", "g4", "merged0", "merged", "m0", "m1", "m", "s", "shape", "tone", "products") + """,
reviewed AS (
  SELECT instance_id, brand, p.archetype AS predicted, p.has_saturated, CASE WHEN month LIKE '%-03' THEN 'UNCERTAIN' WHEN month LIKE '%-06' THEN 'mono?' WHEN o.archetype = p.archetype THEN 'CORRECT' ELSE o.archetype END AS human
  FROM products p JOIN products_o o USING (instance_id) JOIN arch USING (instance_id)
), resolved AS (
  SELECT *, CASE WHEN human IN ('CORRECT', 'MONO', 'DOM_ACC', 'DUAL_BAL', 'MULTI_DOM', 'MULTI_BAL') THEN 'resolved' WHEN human = 'UNCERTAIN' THEN 'uncertain' ELSE 'unusable' END AS status,
    CASE WHEN human = 'CORRECT' THEN predicted WHEN human IN ('MONO', 'DOM_ACC', 'DUAL_BAL', 'MULTI_DOM', 'MULTI_BAL') THEN human END AS truth FROM reviewed
), kinds AS (SELECT unnest(['MONO', 'DOM_ACC', 'DUAL_BAL', 'MULTI_DOM', 'MULTI_BAL']) AS k),
confusion AS (SELECT a.k AS truth, b.k AS predicted, count(r.instance_id) AS n FROM kinds a CROSS JOIN kinds b LEFT JOIN resolved r ON r.truth = a.k AND r.predicted = b.k GROUP BY ALL),
scores AS (
  SELECT k AS archetype, (SELECT CAST(sum(n) AS BIGINT) FROM confusion WHERE truth = k) AS support, (SELECT CAST(sum(n) AS BIGINT) FROM confusion WHERE predicted = k) AS said, (SELECT CAST(sum(n) AS BIGINT) FROM confusion WHERE truth = k AND predicted = k) AS tp FROM kinds
), rated AS (SELECT *, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS re, coalesce(2 * tp / nullif(said + support, 0)::DOUBLE, 0) AS f FROM scores)"""

_rates = lambda x, name: f"{to(f'avg(({x})::INT) * 100', 3)} AS {name}"
_means = ", ".join(f"{to(f'{f}({c}) FILTER ({chr(32) if m else chr(78) + chr(79) + chr(84)} same)', 2)} AS {c}_{f}_{'merged' if m else 'apart'}" for c in ("dl", "dhue") for f in ("avg", "median") for m in (True, False))

SQL = {
    "cluster_summary": q(CLUSTERS + ", w AS (SELECT avg(discounted::INT) * 100 AS f0, avg(depth) FILTER (discounted) AS d0 FROM dominant)", f"SELECT color_cluster, n_products, n_discounted, {to('n_discounted * 100e0 / n_products', 3)} AS freq_pct, {to('n_discounted * 100e0 / n_products - f0', 3)} AS freq_deviation_pp, {to('depth', 3)} AS depth_pct, {to('depth - d0', 3)} AS depth_deviation_pp, {to('depth_std', 3)} AS depth_std, {to('lab_l', 3)} AS lab_l, {to('lab_a', 3)} AS lab_a, {to('lab_b', 3)} AS lab_b, {to('r', 3)} AS r, {to('g', 3)} AS g, {to('b', 3)} AS b, {HEX()} AS hex_color, {to('CASE WHEN atan2(lab_b, lab_a) < 0 THEN degrees(atan2(lab_b, lab_a)) + 360 ELSE degrees(atan2(lab_b, lab_a)) END', 3)} AS hue_angle, n_products >= 14 AS freq_testable, n_discounted >= 10 AS depth_testable FROM {tint('cc')}, w"),
    "centroid_colors": q(CLUSTERS + f", colored AS (SELECT color_cluster, {HEX()} AS hex_color FROM {tint('cc')} WHERE n_discounted >= 10)", "SELECT color_cluster, n_products, hex_color FROM cc LEFT JOIN colored USING (color_cluster) WHERE n_products >= 14"),
    "zone_centroids": q(CLUSTERS + ", zc AS (SELECT k.brand, k.zone, CAST(coalesce(sum(n_products), 0) AS BIGINT) AS n_products, coalesce(sum(lab_l * n_products) / sum(n_products), 0) AS lab_l, coalesce(sum(lab_a * n_products) / sum(n_products), 0) AS lab_a, coalesce(sum(lab_b * n_products) / sum(n_products), 0) AS lab_b FROM (SELECT DISTINCT x.brand, y.zone FROM bc x CROSS JOIN bc y) k LEFT JOIN bc ON k.brand = bc.brand AND k.zone = bc.zone GROUP BY ALL)", f"SELECT brand, zone, n_products, {to('lab_l', 3)} AS lab_l, {to('lab_a', 3)} AS lab_a, {to('lab_b', 3)} AS lab_b, {HEX(True)} AS hex_color FROM {tint('zc')}"),
    "zone_rollup": q(ROLLUP, "SELECT * FROM zone_out"),
    "zone_price_decisions": q(CLUSTERS + ", zp AS (SELECT brand, color_cluster // 10000 AS zone, count(*) AS n_priced, avg(price_std) AS mean, var_samp(price_std) AS v, any_value(pr0) AS pr0 FROM dominant JOIN b USING (brand) WHERE price_std > 0 GROUP BY ALL), zt AS (SELECT *, CASE WHEN n_priced >= 14 AND v > 0 THEN (mean - pr0) / sqrt(v / n_priced) END AS z FROM zp)", f"SELECT brand, zone, n_priced, {to('mean', 2)} AS price_mean, {to('(mean - pr0) / pr0 * 100', 2)} AS price_deviation_pct, coalesce({P} < 0.05, FALSE) AS price_significant FROM zt"),
    "window_stats": q(WINDOW, f"SELECT wz.brand, zone, CAST(n AS BIGINT) AS n_products, CAST(disc AS BIGINT) AS n_discounted, {to('CASE WHEN n > 0 THEN disc * 100e0 / n ELSE 0 END', 3)} AS freq_pct, {to('CASE WHEN n > 0 THEN disc * 100e0 / n ELSE 0 END - coalesce(f0, 0)', 3)} AS freq_deviation_pp, {to('CASE WHEN disc > 0 THEN ds / disc ELSE 0 END', 3)} AS depth_pct, {to('CASE WHEN disc > 0 THEN ds / disc ELSE 0 END - coalesce(d0, de)', 3)} AS depth_deviation_pp, {to('CASE WHEN p0 > 0 THEN (CASE WHEN np > 0 THEN ps / np::DOUBLE ELSE 0 END - p0) / p0 * 100 ELSE 0 END', 3)} AS price_deviation_pct, CASE WHEN n = 0 THEN 'empty' WHEN n < 14 THEN 'low power' ELSE 'ok' END AS power FROM wz LEFT JOIN wb USING (brand) JOIN ever USING (brand)"),
    "scale_limits": q(CLUSTERS + ", zl AS (SELECT brand, color_cluster // 10000 AS zone, avg(discounted::INT) * 100 AS f, avg(depth) FILTER (discounted) AS dp, avg(price_std) FILTER (price_std > 0) AS p FROM dominant GROUP BY ALL), bl AS (SELECT brand, avg(discounted::INT) * 100 AS f0, avg(depth) FILTER (discounted) AS dp0, avg(price_std) FILTER (price_std > 0) AS p0 FROM dominant GROUP BY ALL)", "SELECT CAST(ceil(greatest(10, max(abs(f - f0))) - 1e-9) AS BIGINT) AS freq_max, CAST(ceil(greatest(10, max(abs(coalesce(dp - dp0, 0)))) - 1e-9) AS BIGINT) AS depth_max, CAST(ceil(greatest(10, max(abs((p - p0) / p0 * 100))) - 1e-9) AS BIGINT) AS price_max FROM zl JOIN bl USING (brand)"),
    "deviation_colors": q(ROLLUP + ", tt AS (SELECT *, least(1, greatest(-1, freq_deviation_pp / 10)) AS t FROM zone_out)", "SELECT brand, zone, 'rgb(' || CAST(floor(CASE WHEN t < 0 THEN 247 + 214 * t ELSE 247 - 69 * t END + 0.5) AS INTEGER) || ',' || CAST(floor(CASE WHEN t < 0 THEN 247 + 145 * t ELSE 247 - 223 * t END + 0.5) AS INTEGER) || ',' || CAST(floor(CASE WHEN t < 0 THEN 247 + 75 * t ELSE 247 - 204 * t END + 0.5) AS INTEGER) || ')' AS color FROM tt"),
    "sample_mode": q(SAMPLED, "SELECT * FROM mode"),
    "sample_zones": q(SAMPLED, "SELECT brand, color_cluster // 10000 AS zone, CAST(sum(n_products) AS BIGINT) AS n_products, count(*) AS n_clusters, count(*) FILTER (n_products = 0) AS n_empty FROM mode GROUP BY ALL HAVING sum(n_products) > 0"),
    "lightness_bands": q(GRID, "SELECT brand, CASE WHEN lab_l >= 60 THEN 'light' WHEN lab_l >= 30 THEN 'mid' ELSE 'dark' END AS band, count(*) AS n FROM dominant GROUP BY ALL"),
    "palette_hex_rounded": q(HUED, f"SELECT instance_id, cluster_rank, {HEX(True)} AS hex, CASE WHEN c < 10 THEN 'N' WHEN c < 30 THEN 'M' ELSE 'S' END AS tone FROM {tint('hued')}"),
    "explorer_bands": q("", "SELECT CASE WHEN sat < 6 THEN 'neutral' WHEN sat < 50 THEN 'muted' ELSE 'saturated' END AS explorer, CASE WHEN sat < 5 THEN 'neutral' WHEN sat < 50 THEN 'muted' ELSE 'saturated' END AS tuner, count(*) AS n, " + to("avg(sat)", 3) + " AS mean_sat FROM " + tint("palette", cut="fx * fx * fx > 0.008856e0").replace("3.2404542e0 * cx - 1.5371385e0 * cy - 0.4985314e0 * cz", "cx * 3.2406e0 - cy * 1.5372e0 - cz * 0.4986e0").replace("-0.9692660e0 * cx + 1.8760108e0 * cy + 0.0415560e0 * cz", "cy * 1.8758e0 - cx * 0.9689e0 + cz * 0.0415e0").replace("0.0556434e0 * cx - 0.2040259e0 * cy + 1.0572252e0 * cz", "cx * 0.0557e0 - cy * 0.2040e0 + cz * 1.0570e0") + " GROUP BY ALL"),
    "lab_round_trip": q("", f"SELECT instance_id, cluster_rank, {to('116 * ty - 16', 2)} AS l2, {to('500 * (tx - ty)', 2)} AS a2, {to('200 * (ty - tz)', 2)} AS b2, abs(116 * ty - 16 - lab_l) < 0.5 AND abs(500 * (tx - ty) - lab_a) < 0.5 AND abs(200 * (ty - tz) - lab_b) < 0.5 AS in_gamut FROM (SELECT *, CASE WHEN r > 0.04045e0 THEN power((r + 0.055e0) / 1.055e0, 2.4e0) ELSE r / 12.92e0 END AS ir, CASE WHEN g > 0.04045e0 THEN power((g + 0.055e0) / 1.055e0, 2.4e0) ELSE g / 12.92e0 END AS ig, CASE WHEN b > 0.04045e0 THEN power((b + 0.055e0) / 1.055e0, 2.4e0) ELSE b / 12.92e0 END AS ib, (0.4124564e0 * ir + 0.3575761e0 * ig + 0.1804375e0 * ib) / 0.95047e0 AS ux, 0.2126729e0 * ir + 0.7151522e0 * ig + 0.0721750e0 * ib AS uy, (0.0193339e0 * ir + 0.1191920e0 * ig + 0.9503041e0 * ib) / 1.08883e0 AS uz, CASE WHEN ux > 0.008856e0 THEN power(ux, 1e0 / 3) ELSE 7.787e0 * ux + 16e0 / 116 END AS tx, CASE WHEN uy > 0.008856e0 THEN power(uy, 1e0 / 3) ELSE 7.787e0 * uy + 16e0 / 116 END AS ty, CASE WHEN uz > 0.008856e0 THEN power(uz, 1e0 / 3) ELSE 7.787e0 * uz + 16e0 / 116 END AS tz FROM {tint('palette')})"),
    "saturation_categories": q(CLUSTERS + f", ct AS (SELECT brand, color_cluster, lab_l, lab_a, lab_b, {to('sat', 6)} AS s0 FROM {tint('bc')}), cg AS (SELECT *, CASE WHEN s0 < 20 THEN 0 WHEN s0 < 45 THEN 1 WHEN s0 < 70 THEN 2 ELSE 3 END AS category FROM ct)", f"SELECT brand, color_cluster, category, row_number() OVER (PARTITION BY brand, category ORDER BY {to('CASE WHEN category = 0 THEN lab_l ELSE (CASE WHEN atan2(lab_b, lab_a) < 0 THEN degrees(atan2(lab_b, lab_a)) + 405 ELSE degrees(atan2(lab_b, lab_a)) + 45 END) % 360 END', 6)}, color_cluster) AS place FROM cg"),
    "saturation_metadata": q(MERGE + "," + ARCH, f"SELECT instance_id, {to('max(sat)', 3)} AS max_hsb_sat, bool_or(sat >= 50) AS has_saturated, {to('coalesce(sum(perc) FILTER (sat >= 50), 0)', 3)} AS saturated_coverage, {to('coalesce(sum(perc) FILTER (sat >= 12 AND sat < 50), 0)', 3)} AS muted_coverage, {to('coalesce(sum(perc) FILTER (sat < 12), 0)', 3)} AS neutral_coverage FROM m GROUP BY 1"),
    "coverage_columns": q(MERGE + "," + ARCH, "SELECT instance_id, " + ", ".join(f"{to(f'coalesce(max(perc) FILTER (rk = {i}), 0)', 3)} AS coverage_{i}" for i in range(1, 6)) + " FROM s GROUP BY 1"),
    "merge_group_ids": q(MERGE, 'SELECT instance_id, i + 1 AS cluster_rank, dense_rank() OVER (PARTITION BY instance_id ORDER BY g) - 1 AS "group" FROM g4'),
    "cluster_payload": q(MERGE + f', gi AS (SELECT instance_id, i + 1 AS cluster_rank, dense_rank() OVER (PARTITION BY instance_id ORDER BY g) - 1 AS grp_no FROM g4), tp AS (SELECT instance_id, cluster_rank, {HEX(True)} AS hex FROM {tint("palette")}), rw AS (SELECT instance_id, string_agg(cluster_rank || \' \' || grp_no || \' \' || hex, \', \' ORDER BY cluster_rank) AS raw, count(*) AS n_raw FROM tp JOIN gi USING (instance_id, cluster_rank) GROUP BY 1), mp AS (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY perc DESC, grp) AS place, {HEX(True)} AS hex FROM {tint("merged")})', "SELECT instance_id, any_value(raw) AS raw, string_agg(place || ' ' || hex, ', ' ORDER BY place) AS merged, CAST(any_value(n_raw) AS INTEGER) AS n_raw, CAST(count(*) AS INTEGER) AS n_merged FROM rw JOIN mp USING (instance_id) GROUP BY 1"),
    "archetype_brand_gender": q(MERGE + "," + ARCH, f"SELECT brand, {STRICT} AS gender, count(*) AS n, " + ", ".join(f"{to(f'count(*) FILTER (archetype = {chr(39)}{k}{chr(39)}) * 100e0 / count(*)', 3)} AS {k.lower()}" for k in ("MONO", "DOM_ACC", "DUAL_BAL", "MULTI_DOM", "MULTI_BAL")) + f", arg_min(n_colors, instance_id) AS first_n_colors FROM products JOIN arch USING (instance_id) WHERE {STRICT} IS NOT NULL GROUP BY ALL"),
    "labelled_pairs": q(PAIRS, f"SELECT instance_id, i, j, same AS user_should_merge, grouped AS algo_group_match, merged AS algo_pair_merge, legacy, same <> grouped AS user_disagrees, {to('dl', 3)} AS delta_l, {to('hue_1', 3)} AS hue_1, {to('hue_2', 3)} AS hue_2, {to('dhue', 3)} AS hue_diff, {to('c1', 2)} AS chroma_1, {to('c2', 2)} AS chroma_2, {to('min_chroma', 2)} AS chroma_min, {to('max_chroma', 2)} AS chroma_max, c1 < 15 AND c2 < 15 AS both_low_chroma, c1 < 8 AND c2 < 8 AS both_neutral, (c1 < 8) <> (c2 < 8) AS one_neutral, c1 >= 8 AND c2 >= 8 AS both_chromatic, {to('dchroma', 2)} AS delta_chroma, {to('p1', 3)} AS perc_1, {to('p2', 3)} AS perc_2, {to('least(p1, p2)', 3)} AS perc_min, {to('greatest(p1, p2)', 3)} AS perc_max, {to('far', 2)} AS lab_euclidean FROM pairs"),
    "pair_summary": q(PAIRS + f", pk AS (SELECT *, {KIND} AS k FROM pairs)", f"SELECT coalesce(k, 'all') AS kind, count(*) AS n, {_rates('same', 'user_merge_pct')}, {_rates('merged = same', 'live_accuracy')}, {_rates('legacy = same', 'legacy_accuracy')}, {_rates('grouped = same', 'group_accuracy')}, {_rates('grouped <> same', 'disagree_pct')}, {_means} FROM pk GROUP BY ROLLUP (k)"),
    "label_groups": q(PAIRS + ", lg AS (SELECT instance_id, cluster_rank, dense_rank() OVER (PARTITION BY instance_id ORDER BY u) - 1 AS no FROM marked)", "SELECT instance_id, string_agg(no::VARCHAR, ',' ORDER BY cluster_rank) AS groups, CAST(max(no) AS INTEGER) AS last_group FROM lg GROUP BY 1"),
    "boundary_sample": q(BOUNDARY, "SELECT stratum, instance_id, place, 'pair-features' AS strata_mode FROM near_sample"),
    "strata_banner": q(BOUNDARY + ", sm AS (SELECT brand, CASE WHEN s.instance_id IS NULL THEN 'archetype' ELSE 'pair-features' END AS strata_mode FROM arch LEFT JOIN near_sample s ON arch.instance_id = s.instance_id)", "SELECT brand, bool_or(strata_mode <> 'archetype') AS is_boundary, string_agg(DISTINCT strata_mode, ',' ORDER BY strata_mode) AS modes FROM sm GROUP BY 1"),
    "label_status": q(LABELS, "SELECT brand, status, count(*) AS n FROM resolved GROUP BY ALL"),
    "archetype_confusion": q(LABELS, 'SELECT truth, predicted, n FROM confusion'),
    "archetype_scores": q(LABELS + ", whole AS (SELECT CAST(sum(tp) AS BIGINT) AS k, CAST(sum(support) AS BIGINT) AS n, avg(f) AS f FROM rated)", f"SELECT archetype, support, {to('pr')} AS precision, {to('re')} AS recall, {to('f')} AS f1, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM rated UNION ALL SELECT 'all', n, {to('k / n::DOUBLE')}, {to('k / n::DOUBLE')}, {to('f')}, {to(LO)}, {to(HI)} FROM whole"),
    "misclassified_preview": q(LABELS, 'SELECT brand, instance_id, truth, predicted FROM resolved WHERE truth <> predicted ORDER BY brand, instance_id LIMIT 15'),
    "accuracy_by_brand": q(LABELS + ", ab AS (SELECT brand, has_saturated, count(*) AS n, count(*) FILTER (truth = predicted) AS k FROM resolved WHERE status = 'resolved' GROUP BY ALL)", f"SELECT brand, has_saturated, n, k, {to(LO)} AS lo, {to(HI)} AS hi FROM ab"),
}
