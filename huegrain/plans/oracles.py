"""DuckDB SQL for the library's queries."""

from .rules import ARCH, BAND, EXCLUDED, GRID, HI, HUED, KEYWORDS, LO, LOOSE, MERGE, STRICT, de00, q, tint, to

#: two-tailed normal p by the error function's approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)
P = "(1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0))) * (0.254829592e0 + (1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0))) * (-0.284496736e0 + (1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0))) * (1.421413741e0 + (1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0))) * (-1.453152027e0 + (1 / (1 + 0.3275911e0 * abs(z) / sqrt(2e0))) * 1.061405429e0)))) * exp(-z * z / 2)"
TESTS = f"""
base AS (SELECT count(*) AS n_all, sum(discounted::INT) * 1.0::DOUBLE / count(*) AS p0 FROM dominant),
stats AS (SELECT color_cluster, count(*) AS n_products, CAST(sum(discounted::INT) AS BIGINT) AS n_discounted, avg(CASE WHEN discounted THEN depth END) AS depth FROM dominant GROUP BY 1),
z AS (SELECT *, CASE WHEN n_products >= 14 THEN (n_discounted * 1.0::DOUBLE / n_products - p0) / greatest(sqrt(p0 * (1 - p0) / n_products), 1e-10) END AS z FROM stats, base),
p AS (SELECT *, {P} AS pval FROM z),
ranked_p AS (SELECT *, CASE WHEN z IS NOT NULL THEN row_number() OVER (PARTITION BY z IS NOT NULL ORDER BY pval, color_cluster) END AS rk, count(z) OVER () AS tested FROM p),
bh AS (SELECT *, max(CASE WHEN pval <= rk * 0.05::DOUBLE / tested THEN pval END) OVER () AS cut FROM ranked_p)"""


_WORDS = "unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(title_second, '')), '[\\p{L}\\p{N}_-]+'))"

SQL = {
    "palette_hsb_coverage": q("", f"SELECT brand, {STRICT} AS gender, {BAND} AS band, count(*) AS n_colors, {to('sum(perc)', 2)} AS coverage FROM {tint('palette')} JOIN arch USING (instance_id) GROUP BY ALL"),
    "palette_hex": q(HUED, f"SELECT instance_id, cluster_rank, CAST(floor(r * 255) AS INTEGER) AS r, CAST(floor(g * 255) AS INTEGER) AS g, CAST(floor(b * 255) AS INTEGER) AS b, {to('c')} AS chroma, {to('CASE WHEN c >= 8 THEN h END')} AS hue FROM {tint('hued')}"),
    "palette_merge": q(MERGE, f"SELECT instance_id, grp, {to('perc', 3)} AS perc, {to('lab_l', 3)} AS lab_l, {to('lab_a', 3)} AS lab_a, {to('lab_b', 3)} AS lab_b, n_merged FROM merged"),
    "archetype_products": q(MERGE + "," + ARCH, "SELECT * FROM products"),
    "archetype_distribution": q(MERGE + "," + ARCH, f"SELECT brand, {STRICT} AS gender, archetype, count(*) AS n_products, CAST(sum(has_saturated::INT) AS BIGINT) AS n_with_saturated, {to('count(*) * 100.0e0 / sum(count(*)) OVER (PARTITION BY brand, ' + STRICT + ')')} AS pct_products FROM products JOIN arch USING (instance_id) WHERE {STRICT} IS NOT NULL GROUP BY brand, {STRICT}, archetype"),
    "archetype_crosstab": q(MERGE + "," + ARCH, "SELECT coalesce(brand, 'ALL') AS brand, coalesce(archetype, 'ALL') AS archetype, count(*) AS n FROM products JOIN arch USING (instance_id) GROUP BY CUBE (brand, archetype)"),
    "coverage_quantiles": q(MERGE + "," + ARCH, f"SELECT coalesce(brand, 'Overall') AS brand, {to('avg(coverage_1)', 3)} AS mean_1, {to('median(coverage_1)', 3)} AS median_1, {to('avg((coverage_1 >= 70)::INT) * 100', 3)} AS pct_70, {to('avg((coverage_1 >= 80)::INT) * 100', 3)} AS pct_80, {to('avg((coverage_1 >= 90)::INT) * 100', 3)} AS pct_90 FROM products JOIN arch USING (instance_id) GROUP BY ROLLUP (brand)"),
    "gender_rules": q("", f"SELECT query, {STRICT} AS strict, {LOOSE} AS loose, coalesce({LOOSE}, 'unknown') AS loose_or_unknown, count(*) AS n FROM arch GROUP BY ALL"),
    "discount_baseline": q(GRID, f"SELECT brand, count(*) AS n, CAST(sum(discounted::INT) AS BIGINT) AS n_discounted, {to('avg(discounted::INT) * 100')} AS freq_pct, {to('avg(CASE WHEN discounted THEN depth END)')} AS depth_pct, {to('avg(price_curr)')} AS price FROM dominant GROUP BY 1"),
    "cluster_tests": q(GRID + "," + TESTS, f"SELECT color_cluster, n_products, n_discounted, {to('depth', 3)} AS depth_pct, {to('z', 3)} AS freq_z, z IS NOT NULL AS freq_testable, coalesce(pval <= cut, FALSE) AS freq_significant FROM bh"),
    "cluster_centroids": q(GRID, f"SELECT color_cluster, count(*) AS n_products, {to('sum(lab_l * perc) / sum(perc)', 3)} AS lab_l, {to('sum(lab_a * perc) / sum(perc)', 3)} AS lab_a, {to('sum(lab_b * perc) / sum(perc)', 3)} AS lab_b FROM dominant GROUP BY 1"),
    "temporal_cube": q(GRID, f"SELECT brand, month, color_cluster // 10000 AS zone, count(*) AS n, CAST(sum(discounted::INT) AS BIGINT) AS disc, {to('sum(depth)', 2)} AS depth_sum, CAST(sum(price_curr) AS BIGINT) AS price_sum, count(CASE WHEN price_curr > 0 THEN 1 END) AS n_priced FROM dominant GROUP BY ALL"),
    "month_window": q(GRID + ", cube AS (SELECT brand, (year(CAST(month || '-01' AS DATE)) * 12 + month(CAST(month || '-01' AS DATE))) AS m, count(*) AS n, sum(discounted::INT) AS disc FROM dominant GROUP BY ALL)", f"SELECT brand, CAST(m AS BIGINT) AS m, CAST(sum(n) OVER w AS BIGINT) AS n, {to('sum(disc) OVER w * 100.0e0 / sum(n) OVER w')} AS freq_pct FROM cube WINDOW w AS (PARTITION BY brand ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "smoothed_deviation": q(GRID + ", zones AS (SELECT brand, color_cluster AS zone, count(*) AS n, avg(discounted::INT) * 100 AS freq, avg(lab_l) AS l, avg(lab_a) AS a, avg(lab_b) AS b FROM dominant GROUP BY ALL), base AS (SELECT brand, sum(freq * n) / sum(n) AS f0 FROM zones GROUP BY 1), kappa AS (SELECT brand, list_sort(list(n))[len(list(n)) // 2 + 1] AS kappa FROM zones GROUP BY 1), pairs AS (SELECT x.brand, x.zone, x.n, x.freq, y.freq AS fy, y.n * (1 - sqrt(power(x.l - y.l, 2) + power(x.a - y.a, 2) + power(x.b - y.b, 2)) / 15) AS w FROM zones x JOIN zones y ON x.brand = y.brand AND x.zone <> y.zone AND sqrt(power(x.l - y.l, 2) + power(x.a - y.a, 2) + power(x.b - y.b, 2)) < 15), prior AS (SELECT brand, zone, sum(w * fy) / sum(w) AS prior FROM pairs GROUP BY ALL)", f"SELECT z.brand, z.zone, z.n, {to('z.freq - f0', 3)} AS deviation, {to('CASE WHEN prior IS NULL THEN z.freq - f0 ELSE (z.n * (z.freq - f0) + kappa * (prior - f0)) * 1.0e0 / (z.n + kappa) END', 3)} AS smoothed FROM zones z JOIN base USING (brand) JOIN kappa USING (brand) LEFT JOIN prior USING (brand, zone)"),
    "palette_pair_de00": q(", pp AS (SELECT x.instance_id, x.cluster_rank AS i, y.cluster_rank AS j, x.lab_l AS l1, x.lab_a AS a1, x.lab_b AS b1, y.lab_l AS l2, y.lab_a AS a2, y.lab_b AS b2 FROM palette x JOIN palette y ON x.instance_id = y.instance_id AND x.cluster_rank < y.cluster_rank)"[1:], f"SELECT instance_id, i, j, {to('de00', 3)} AS de00 FROM {de00('pp', 'l1', 'a1', 'b1', 'l2', 'a2', 'b2')} q"),
    "keyword_exclusion": q("", f"SELECT instance_id, CASE WHEN regexp_matches(title, {EXCLUDED}) THEN regexp_extract(title, {EXCLUDED}, 1) ELSE regexp_extract(title_second, {EXCLUDED}, 1) END AS keyword, CASE WHEN regexp_matches(title, {EXCLUDED}) THEN 'title' ELSE 'title_second' END AS field FROM inst WHERE regexp_matches(title, {EXCLUDED}) OR regexp_matches(title_second, {EXCLUDED})"),
    "keyword_map": q(f", tokens AS (SELECT DISTINCT instance_id, {_WORDS} AS token FROM inst)"[1:], f"SELECT brand, class, count(DISTINCT instance_id) AS n FROM tokens JOIN {KEYWORDS} AS k(keyword, class) ON token = keyword JOIN arch USING (instance_id) GROUP BY ALL"),
    "term_statistics": q(f", tokens AS (SELECT instance_id, {_WORDS} AS token FROM inst)"[1:], "SELECT token, count(*) AS occurrences, count(DISTINCT instance_id) AS products, count(DISTINCT brand) AS brands FROM tokens JOIN arch USING (instance_id) GROUP BY 1"),
    "attrition": q(", staged AS (SELECT i.instance_id, brand, CASE WHEN p.instance_id IS NOT NULL AND i.instance_id % 17 <> 0 THEN 0 WHEN title IS NULL THEN 1 WHEN regexp_matches(title, '(?i)\\b(gizmo|hot|rod)\\b') THEN 2 WHEN i.instance_id % 17 = 0 THEN 3 ELSE 4 END AS stage_no FROM inst i LEFT JOIN (SELECT DISTINCT instance_id FROM palette) p ON i.instance_id = p.instance_id), c AS (SELECT brand, stage_no, count(*) AS n FROM staged GROUP BY ALL)"[1:], f"SELECT brand, stage_no, n, {to('n * 100.0e0 / sum(n) OVER (PARTITION BY brand)', 3)} AS pct, CAST(sum(CASE WHEN stage_no > 0 THEN n ELSE 0 END) OVER (PARTITION BY brand ORDER BY stage_no) AS BIGINT) AS dropped FROM c"),
    "label_confusion": f"WITH c AS (SELECT d.lang, count(*) AS n, count(CASE WHEN (quality = 0) = (toxic = 1) THEN 1 END) AS k FROM labels JOIN documents d USING (doc_id) GROUP BY 1) SELECT lang, n, k, {to(LO)} AS lo, {to(HI)} AS hi FROM c",
    "sample_sizes": q(GRID, "SELECT color_cluster, count(*) AS n_products, CAST(ceil(96.04e0 / (1 + 95.04e0 / count(*))) AS INTEGER) AS wanted FROM dominant GROUP BY 1"),
    "unprocessed_archives": q("", "SELECT archive_id FROM arch EXCEPT SELECT archive_id FROM arch JOIN palette USING (instance_id)"),
    "recent_archives": q("", "SELECT brand, archive_id, rk FROM (SELECT brand, archive_id, row_number() OVER (PARTITION BY brand ORDER BY max(month) DESC, archive_id DESC) AS rk FROM arch GROUP BY brand, archive_id) WHERE rk <= 3"),
    "zone_price_tests": q(GRID + ", base AS (SELECT avg(price_curr) AS p0 FROM dominant)", f"SELECT color_cluster // 10000 AS zone, count(*) AS n, {to('avg(price_curr)', 3)} AS mean_price, {to('(avg(price_curr) / max(p0) - 1) * 100', 3)} AS dev_pct, {to('(avg(price_curr) - max(p0)) / sqrt(var_samp(price_curr) / count(*))', 3)} AS t FROM dominant, base GROUP BY 1 HAVING count(*) >= 14"),
    "rand_index": q(GRID + ", pairs AS (SELECT color_cluster // 10000 AS a, color_cluster % 10 AS b, count(*) AS n FROM dominant GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM pairs) AS nij, (SELECT sum(x * (x - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS x FROM pairs GROUP BY a)) AS na, (SELECT sum(x * (x - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS x FROM pairs GROUP BY b)) AS nb, (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM pairs) AS nn)", f"SELECT {to('(nij - na * nb / nn) / ((na + nb) / 2 - na * nb / nn)')} AS ari FROM s"),
}
