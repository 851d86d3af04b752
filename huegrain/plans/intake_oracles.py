"""DuckDB SQL for the intake queries, by hand."""

from ..sources.catalogue import OUTCOME_CTES

from .report_oracles import SQL as REPORTS
from .review_oracles import HASH, SAMPLED
from .rules import EXCLUDED, GRID, HI, KEYWORD_RE, LO, LOOSE, de00, q, tint, to

BRAND_HASH = "md5('42:' || brand || ':' || instance_id::VARCHAR)"
SAMPLE_IDS = "SELECT instance_id FROM (" + REPORTS["stratified_sample"] + ")"

DETECTIONS = """
detections AS (
  SELECT l_orderkey AS instance_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS no, p_name AS class_name, 1 - l_discount AS conf,
    (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 30)::DOUBLE AS y1, l_partkey % 40 + 4 + l_quantity::DOUBLE AS x2, l_suppkey % 30 + 10e0 * l_linenumber AS y2 FROM lineitem JOIN part ON l_partkey = p_partkey
), routed AS (
  SELECT *, CASE WHEN list_has_any(string_split(lower(class_name), ' '), ['ring', 'plate', 'bolt']) THEN 'garment' WHEN list_has_any(string_split(lower(class_name), ' '), ['red', 'blue', 'small']) THEN 'attribute' ELSE 'none' END AS route FROM detections
)"""

STAGED = OUTCOME_CTES + f""",
reasons AS (SELECT *, CASE priority WHEN '1-URGENT' THEN 'yolo_no_masks' WHEN '2-HIGH' THEN 'yolo_no_garment' WHEN '3-MEDIUM' THEN 'yolo_file_not_found' WHEN '4-NOT SPECIFIED' THEN 'yolo_other' END AS reason FROM outcomes),
logged AS (SELECT DISTINCT archive_id FROM reasons WHERE NOT segmented AND reason IS NOT NULL),
staged AS (
  SELECT r.*, coalesce({LOOSE}, 'unknown') AS gender, CASE WHEN (final OR clustered) AND {LOOSE} IS NULL THEN 'gender_unknown' WHEN final THEN 'final_palette' WHEN clustered THEN 'dominant_merge_failed' WHEN segmented THEN 'clustering_failed'
    WHEN trim(coalesce(title, '') || ' ' || coalesce(title_second, '')) = '' THEN 'null_title' WHEN regexp_matches(coalesce(title, '') || ' ' || coalesce(title_second, ''), {EXCLUDED}) THEN 'heraldic_filter'
    WHEN NOT regexp_matches(coalesce(title, '') || ' ' || coalesce(title_second, ''), {KEYWORD_RE}) THEN 'keyword_map_miss' WHEN archive_id NOT IN (SELECT archive_id FROM logged) THEN 'archive_unsegmented' ELSE coalesce(reason, 'yolo_unlogged') END AS stage FROM reasons r
)"""
_STAGE_NO = "list_position(['null_title', 'heraldic_filter', 'keyword_map_miss', 'archive_unsegmented', 'yolo_no_masks', 'yolo_no_garment', 'yolo_file_not_found', 'yolo_other', 'yolo_unlogged', 'clustering_failed', 'gender_unknown', 'dominant_merge_failed', 'final_palette'], stage)"

TERMS = """
shown AS (SELECT instance_id, brand, array_to_string(list_transform(string_split(title, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS text FROM inst WHERE title IS NOT NULL UNION ALL SELECT instance_id, brand, title_second FROM inst WHERE title_second IS NOT NULL),
tok AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\w\\s''-]', ' ', 'g'), '[\\s-]+'), lambda x: length(x) >= 2 AND regexp_full_match(lower(x), '\\p{L}+')) AS t FROM shown),
ones AS (SELECT instance_id, brand, text, unnest(t) AS x FROM tok),
twos AS (SELECT instance_id, brand, text, t[i] AS a, t[i + 1] AS b FROM (SELECT *, unnest(range(1, len(t))) AS i FROM tok WHERE len(t) > 1)),
terms AS (
  SELECT 'unigram' AS kind, lower(x) AS term, regexp_matches(x, '^\\p{Lu}') AS cap, instance_id, brand, text FROM ones WHERE lower(x) NOT IN ('new', 'old', 'and', 'the')
  UNION ALL SELECT 'bigram', lower(a) || ' ' || lower(b), TRUE, instance_id, brand, text FROM twos WHERE regexp_matches(a, '^\\p{Lu}') AND regexp_matches(b, '^\\p{Lu}') AND lower(a) NOT IN ('new', 'old', 'and', 'the') AND lower(b) NOT IN ('new', 'old', 'and', 'the')
)"""

SIGNALS = TERMS + """,
per_brand AS (SELECT kind, term, brand, count(DISTINCT instance_id) AS n, count(*) AS occ, count(*) FILTER (cap) AS caps FROM terms GROUP BY ALL),
signals AS (
  SELECT kind, term, CAST(sum(n) AS BIGINT) AS total, sum(occ) AS occ, sum(caps) AS caps, CASE WHEN count(*) > 1 THEN stddev_pop(n) / avg(n) ELSE 0 END AS cv, max(n) AS most, coalesce(list_reverse_sort(list(n))[2], 0) AS second,
    (kind = 'unigram' AND term IN ('gizmo', 'hot', 'rod', 'large')) OR (kind = 'bigram' AND term IN ('blue ring', 'hot rod')) AS in_filter FROM per_brand GROUP BY kind, term HAVING sum(n) >= 30
)"""

JUDGED = f", judged AS (SELECT instance_id, brand, title, regexp_matches(title, {EXCLUDED}) AS catches, title LIKE '%rod' OR title = 'hot plate' AS label FROM inst WHERE title IS NOT NULL)"[1:]

FLAGS = f"""{GRID},
flagged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {BRAND_HASH}, instance_id) AS place FROM dominant) WHERE place <= 20),
centres AS (SELECT color_cluster AS other, sum(lab_l * perc) / sum(perc) AS l2, sum(lab_a * perc) / sum(perc) AS a2, sum(lab_b * perc) / sum(perc) AS b2 FROM dominant GROUP BY 1),
met AS (SELECT brand, instance_id, color_cluster, other, lab_l, {to('de00', 2)} AS de FROM {de00('(SELECT f.brand, f.instance_id, f.color_cluster, f.lab_l, f.lab_a, f.lab_b, c.* FROM flagged f CROSS JOIN centres c)', 'lab_l', 'lab_a', 'lab_b', 'l2', 'a2', 'b2')}),
nearest AS (SELECT *, row_number() OVER (PARTITION BY brand, instance_id ORDER BY de, other) AS r FROM met WHERE other <> color_cluster),
flags AS (
  SELECT m.brand, m.instance_id, m.color_cluster, m.de AS dist_to_own, n.other AS nearest_alt, n.de AS dist_to_alt, {to('m.de - n.de', 2)} AS delta, CASE WHEN m.lab_l >= 60 THEN 'light' WHEN m.lab_l >= 30 THEN 'mid' ELSE 'dark' END AS lightness
  FROM met m JOIN nearest n ON m.brand = n.brand AND m.instance_id = n.instance_id AND n.r = 1 WHERE m.other = m.color_cluster
)"""

ZONE_PAIRS = f"""{GRID},
bz AS (SELECT brand, color_cluster, count(*) AS n, sum(lab_l * perc) / sum(perc) AS lab_l, sum(lab_a * perc) / sum(perc) AS lab_a, sum(lab_b * perc) / sum(perc) AS lab_b FROM dominant GROUP BY ALL),
bt AS (SELECT brand, color_cluster AS z, n, lab_l, lab_a, lab_b, sat, sqrt(lab_a * lab_a + lab_b * lab_b) AS c, CASE WHEN atan2(lab_b, lab_a) < 0 THEN degrees(atan2(lab_b, lab_a)) + 360 ELSE degrees(atan2(lab_b, lab_a)) END AS h FROM {tint('bz')}),
bp AS (SELECT x.brand, x.z AS z1, y.z AS z2, x.n AS n1, y.n AS n2, x.lab_l AS l1, y.lab_l AS l2, x.lab_a AS a1, y.lab_a AS a2, x.lab_b AS b1, y.lab_b AS b2, x.sat AS s1, y.sat AS s2, x.c AS c1, y.c AS c2, x.h AS h1, y.h AS h2 FROM bt x JOIN bt y ON x.brand = y.brand AND x.z < y.z)"""

SQL = {
    "image_metadata": q("", f"SELECT l_orderkey AS instance_id, arg_max('P' || lpad(l_partkey::VARCHAR, 8, '0'), (l_linenumber, l_suppkey, 'P' || lpad(l_partkey::VARCHAR, 8, '0'))) AS pid, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN ({SAMPLE_IDS}) GROUP BY 1"),
    "palette_lists": q("", f"SELECT instance_id, string_agg(cluster_rank || ':' || lab_l::INT, ' ' ORDER BY cluster_rank) AS colors FROM palette WHERE instance_id IN ({SAMPLE_IDS}) GROUP BY 1"),
    "archive_segments": q(OUTCOME_CTES + ", segs AS (SELECT l_orderkey AS instance_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)", "SELECT archive_id, count(*) AS n_instances, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_segments FROM outcomes LEFT JOIN segs USING (instance_id) WHERE archive_id IN (SELECT archive_id FROM outcomes WHERE NOT clustered) GROUP BY 1"),
    "pending_pairs": "SELECT brand, gender, base_id, archive_id FROM (" + REPORTS["drift_pairs"] + ") WHERE month >= '1998-01'",
    "recent_assigned_archives": q(SAMPLED, "SELECT brand, archive_id, count(*) AS n FROM sampled GROUP BY ALL"),
    "brand_union": q("", "SELECT brand, month, count(*) AS n FROM arch GROUP BY ALL"),
    "bundle_sync": q(OUTCOME_CTES + ", files AS (SELECT brand, instance_id, final AS wanted, segmented AND priority <> '5-LOW' AS there, clustered AND priority <> '1-URGENT' AS had FROM outcomes)", "SELECT brand, what, count(*) AS n FROM (SELECT brand, CASE WHEN wanted AND there AND had THEN 'kept' WHEN wanted AND there THEN 'copied' WHEN wanted THEN 'missing' END AS what FROM files UNION ALL SELECT brand, 'orphans' FROM files WHERE had AND NOT wanted) WHERE what IS NOT NULL GROUP BY ALL"),
    "lenient_assignments": q(OUTCOME_CTES, "SELECT instance_id, CASE WHEN priority <> '1-URGENT' THEN price_std::DOUBLE END AS price_std, price_curr::DOUBLE AS price_curr FROM outcomes WHERE priority NOT IN ('2-HIGH', '5-LOW') AND (priority = '1-URGENT' OR price_std IS NULL OR price_std > 0)"),
    "image_paths": q(OUTCOME_CTES, "SELECT brand, count(*) AS n, count(*) FILTER (segmented OR priority <> '3-MEDIUM') AS n_found, min(replace(brand, ' ', '') || '/' || archive_id || '/' || archive_id || '-' || instance_id || '-0-1.jpg') AS first_file FROM outcomes GROUP BY 1"),
    "contract_names": q(OUTCOME_CTES + ", dn AS (SELECT o.instance_id, priority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN outcomes o ON o.instance_id = l_orderkey)", "SELECT CAST(CASE priority WHEN '4-NOT SPECIFIED' THEN 3 WHEN '1-URGENT' THEN 5 ELSE 7 END AS INTEGER) AS n_parts, CASE WHEN priority = '4-NOT SPECIFIED' THEN 'filename_format_error' ELSE 'ok' END AS status, CASE WHEN priority <> '4-NOT SPECIFIED' THEN 'pid9' END AS pid, CASE WHEN priority NOT IN ('4-NOT SPECIFIED', '1-URGENT') THEN 'm1' END AS model, count(*) AS n, min(instance_id) AS first_instance FROM dn GROUP BY ALL"),
    "formatted_totals": q(OUTCOME_CTES, "SELECT brand, format('{:,}', count(*)) AS products, printf('%.1f', round_even(count(*) FILTER (final) * 100e0 / count(*), 1)) || '%' AS visible FROM outcomes GROUP BY 1"),
    "log_reasons": q(STAGED, "SELECT brand, reason, count(*) AS n FROM reasons WHERE NOT segmented AND reason IS NOT NULL GROUP BY ALL"),
    "attrition_stages": q(STAGED + f", sn AS (SELECT brand, gender, CAST({_STAGE_NO} AS INTEGER) AS stage_no, stage, count(*) AS n FROM staged GROUP BY ALL)", f"SELECT brand, gender, stage_no, stage, n, {to('n * 100e0 / sum(n) OVER (PARTITION BY brand, gender)', 3)} AS pct, {to('coalesce(sum(n) FILTER (stage_no < 13) OVER (PARTITION BY brand, gender ORDER BY stage_no), 0) * 100e0 / sum(n) OVER (PARTITION BY brand, gender)', 3)} AS lost_pct FROM sn"),
    "analysis_modes": q(STAGED, "SELECT brand, gender, count(*) AS n, count(*) FILTER (stage = 'final_palette') AS palette, count(price_std) FILTER (stage = 'final_palette') AS freq, count(*) FILTER (stage = 'final_palette' AND price_curr < price_std AND price_std > 0) AS depth FROM staged GROUP BY ALL"),
    "reclamation": q(STAGED + ", lost AS (SELECT stage, CASE WHEN stage IN ('heraldic_filter', 'gender_unknown', 'yolo_file_not_found', 'yolo_other', 'null_title') THEN 'intentional' ELSE 'reclaimable' END AS kind, count(*) AS n FROM staged WHERE stage <> 'final_palette' GROUP BY ALL), opp AS (SELECT CASE WHEN stage IN ('yolo_no_garment', 'yolo_no_masks') THEN 'detection' WHEN stage = 'keyword_map_miss' THEN 'keyword map' WHEN stage = 'archive_unsegmented' THEN 'pending archives' END AS stage, CAST(sum(n) AS BIGINT) AS n FROM lost GROUP BY 1)", "SELECT kind, stage, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, stage) AS place FROM lost UNION ALL SELECT 'opportunity', stage, n, row_number() OVER (ORDER BY n DESC, stage) FROM opp WHERE stage IS NOT NULL"),
    "processing_counts": q(STAGED, "SELECT brand, count(*) AS total, " + ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in ("yolo_no_masks", "yolo_no_garment", "yolo_file_not_found", "yolo_other", "yolo_unlogged")) + " FROM staged WHERE NOT segmented GROUP BY 1"),
    "garment_routing": q(DETECTIONS, f"SELECT class_name, route, count(*) AS n, {to('avg(conf)')} AS mean_conf FROM routed GROUP BY ALL"),
    "main_garments": q(DETECTIONS + ", garments AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY instance_id ORDER BY (x2 - x1) * (y2 - y1) DESC, no) AS r, count(*) OVER (PARTITION BY instance_id) AS n_garments FROM routed WHERE route = 'garment'), laps AS (SELECT m.instance_id, m.class_name AS main, m.n_garments, o.no = m.no AS itself, (o.x2 - o.x1) * (o.y2 - o.y1) AS area, m.area AS marea, CASE WHEN least(o.x2, m.x2) > greatest(o.x1, m.x1) AND least(o.y2, m.y2) > greatest(o.y1, m.y1) THEN (least(o.x2, m.x2) - greatest(o.x1, m.x1)) * (least(o.y2, m.y2) - greatest(o.y1, m.y1)) ELSE 0 END AS lap FROM garments m JOIN routed o USING (instance_id) WHERE m.r = 1 AND o.route <> 'none')", f"SELECT instance_id, any_value(main) AS main, any_value(n_garments) AS n_garments, count(*) FILTER (NOT itself) AS n_candidates, count(*) FILTER (NOT itself AND main <> 'hot rod' AND lap / (area + marea - lap) > 0.15) AS n_merged, {to('coalesce(avg(lap / (area + marea - lap)) FILTER (NOT itself), 0)')} AS mean_iou FROM laps GROUP BY 1"),
    "color_shift": f"WITH px AS (SELECT l_returnflag AS image, abs(l_suppkey % 3 - 1)::DOUBLE AS r, CASE WHEN l_returnflag = 'R' THEN l_linenumber % 2 ELSE 0 END::DOUBLE AS g, CASE WHEN l_returnflag = 'A' THEN l_partkey % 4 ELSE 0 END::DOUBLE AS b FROM lineitem) SELECT image, count(*) AS n_pixels, {to('avg((r + g + b) / 3)')} AS mean_diff, max(greatest(r, g, b)) AS max_diff, {to('avg(r)')} AS mean_r, {to('avg(g)')} AS mean_g, {to('avg(b)')} AS mean_b, avg((r + g + b) / 3) > 0.5 AS shifted FROM px GROUP BY 1",
    "term_samples": q(TERMS + ", tt AS (SELECT kind, term, title, row_number() OVER (PARTITION BY kind, term ORDER BY title) AS r FROM (SELECT DISTINCT kind, term, '[' || brand || '] ' || text AS title FROM terms)), ts AS (SELECT kind, term, string_agg(title, ' || ' ORDER BY title) AS titles FROM tt WHERE r <= 12 GROUP BY ALL)", "SELECT t.kind, t.term, count(*) AS occurrences, count(*) FILTER (cap) AS capitalised, count(DISTINCT (brand, instance_id)) AS products, any_value(titles) AS titles FROM terms t JOIN ts ON t.kind = ts.kind AND t.term = ts.term GROUP BY t.kind, t.term"),
    "term_candidates": q(SIGNALS + ", sc AS (SELECT *, (most + 1e0) / (second + 1) AS skew, CASE WHEN in_filter THEN 0e0 ELSE most * ((most + 1e0) / (second + 1)) END AS score FROM signals)", f"SELECT kind, term, in_filter, total, {to('score', 1)} AS score, {to('skew', 2)} AS skew, {to('cv', 2)} AS cv, {to('caps / occ::DOUBLE', 3)} AS cap_rate FROM sc WHERE NOT (kind = 'unigram' AND term IN ('widget', 'gear')) ORDER BY in_filter, {to('score', 1)} DESC, kind, term LIMIT 10"),
    "accepted_terms": q(TERMS + ", kw AS (SELECT * FROM (VALUES ('gizmo', 'list'), ('hot', 'list'), ('rod', 'list'), ('large', 'list'), ('blue ring', 'list'), ('hot rod', 'list'), ('widget', 'accepted')) AS v(term, origin)), tn AS (SELECT term, count(DISTINCT (brand, instance_id)) AS n FROM terms GROUP BY 1)", "SELECT term, origin, coalesce(n, 0) AS n FROM kw LEFT JOIN tn USING (term)"),
    "keyword_delta": q(f", kd AS (SELECT brand, instance_id, regexp_matches(concat_ws(' ', title, title_second), {EXCLUDED}) AS a, regexp_matches(concat_ws(' ', title, title_second), '(?i)\\b(widget|gizmo|hot|rod)\\b') AS b FROM inst)"[1:], "SELECT coalesce(brand, 'all') AS brand, count(DISTINCT instance_id) AS n, count(DISTINCT instance_id) FILTER (a) AS present, count(DISTINCT instance_id) FILTER (b) AS expanded, count(DISTINCT instance_id) FILTER (b) - count(DISTINCT instance_id) FILTER (a) AS delta FROM kd GROUP BY ROLLUP (brand)"),
    "uncovered_titles": q("", f"SELECT instance_id, brand, title FROM inst WHERE title IS NOT NULL AND NOT regexp_matches(title, {EXCLUDED}) AND NOT regexp_matches(concat_ws(' ', title, title_second), {KEYWORD_RE}) ORDER BY instance_id LIMIT 2000"),
    "keyword_sample": q(JUDGED + f", pl AS (SELECT *, row_number() OVER (PARTITION BY brand, catches ORDER BY {BRAND_HASH}, instance_id) AS place FROM judged), nc AS (SELECT brand, least(20, count(*)) AS caught FROM judged WHERE catches GROUP BY 1)", "SELECT brand, catches, instance_id, place FROM pl LEFT JOIN nc USING (brand) WHERE place <= CASE WHEN catches THEN 20 ELSE 40 - coalesce(caught, 0) END"),
    "keyword_filter_metrics": q(JUDGED + ", jm AS (SELECT coalesce(brand, 'all') AS brand, count(*) FILTER (catches AND label) AS tp, count(*) FILTER (catches AND NOT label) AS fp, count(*) FILTER (NOT catches AND label) AS fn, count(*) FILTER (NOT catches AND NOT label) AS tn, count(*) AS n, count(*) FILTER (catches = label) AS k FROM judged GROUP BY ROLLUP (brand))", f"SELECT brand, tp, fp, fn, tn, {to('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS precision, {to('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall, {to('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)')} AS f1, {to('k / n::DOUBLE')} AS accuracy, {to(LO)} AS lo, {to(HI)} AS hi FROM jm"),
    "keyword_filter_errors": q(JUDGED, "SELECT brand, instance_id, title, CASE WHEN label THEN 'FN' ELSE 'FP' END AS error FROM judged WHERE catches <> label"),
    "cluster_samples": q(GRID + f", cs AS (SELECT color_cluster, instance_id, row_number() OVER (PARTITION BY color_cluster ORDER BY {HASH}, instance_id) AS place, count(*) OVER (PARTITION BY color_cluster) AS n FROM dominant)", "SELECT color_cluster, instance_id, place FROM cs WHERE place <= ceil(96.04e0 / (1 + 95.04e0 / n))"),
    "sample_decisions": q("", "SELECT DISTINCT archive_id AS run, CASE WHEN archive_id % 5 = 0 THEN 'fresh' WHEN archive_id % 7 = 0 THEN 'resample' WHEN (archive_id % 3 = 0) = (archive_id % 2 = 0) AND archive_id % 2 = 1 THEN 'reuse' ELSE 'refuse' END AS decision FROM arch"),
    "flag_distances": q(FLAGS, "SELECT * FROM flags"),
    "flag_analysis": q(FLAGS, f"SELECT coalesce(lightness, 'all') AS lightness, count(*) AS n, {to('avg(dist_to_own)', 2)} AS mean_own, {to('avg(dist_to_alt)', 2)} AS mean_alt, count(*) FILTER (delta > 0) AS closer_to_alt FROM flags GROUP BY ROLLUP (lightness)"),
    "flag_pairs": q(FLAGS, "SELECT color_cluster, nearest_alt, count(*) AS n FROM flags GROUP BY ALL ORDER BY n DESC, color_cluster, nearest_alt LIMIT 10"),
    "flag_effect": q(FLAGS + ", fe AS (SELECT d.color_cluster, count(*) AS n_products, count(f.instance_id) AS n_flagged, avg(d.discounted::INT) * 100 AS f, avg(d.discounted::INT) FILTER (f.instance_id IS NULL) * 100 AS clean FROM dominant d LEFT JOIN flagged f ON d.instance_id = f.instance_id GROUP BY 1 HAVING count(f.instance_id) > 0)", f"SELECT color_cluster, n_products, n_flagged, {to('f', 2)} AS freq_all, {to('clean', 2)} AS freq_clean, {to('clean - f', 2)} AS delta_pp FROM fe"),
    "zone_pair_features": q(ZONE_PAIRS, f"SELECT brand, z1 AS cluster_a, z2 AS cluster_b, {to('de00', 3)} AS ciede2000, {to('abs(l1 - l2)', 2)} AS delta_l, {to('abs(c1 - c2)', 2)} AS delta_chroma, {to('least(abs(h1 - h2), 360 - abs(h1 - h2))', 2)} AS delta_hue, {to('(l1 + l2) / 2', 1)} AS mean_l, {to('(c1 + c2) / 2', 1)} AS mean_chroma, {to('least(c1, c2)', 1)} AS min_chroma, {to('greatest(c1, c2)', 1)} AS max_chroma, {to('(s1 + s2) / 2', 1)} AS mean_hsb_sat, {to('abs(s1 - s2)', 1)} AS delta_hsb_sat, {to('least(n1, n2) / greatest(n1, n2)::DOUBLE', 3)} AS product_ratio, z1 // 10000 = z2 // 10000 AS same_zone FROM {de00('bp', 'l1', 'a1', 'b1', 'l2', 'a2', 'b2')}"),
}

