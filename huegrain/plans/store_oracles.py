"""DuckDB SQL for what is written and read again, by hand."""

from ..sources.catalogue import OUTCOME_CTES
from .review_oracles import SQL as REVIEWS
from .intake_oracles import STAGED
from .rules import GRID, q, to

SQL = {
    # copies: no archive of the tables has over 1900 colours, beyond which centres take their place
    "downsample_palettes": q("", "SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY instance_id, cluster_rank) - 1 AS place, CAST(lab_l AS DOUBLE) AS lab_l, CAST(lab_a AS DOUBLE) AS lab_a, CAST(lab_b AS DOUBLE) AS lab_b, CAST(perc AS DOUBLE) AS perc FROM palette JOIN arch USING (instance_id)"),
    "log_files": q(STAGED, "SELECT archive_id, query, 'fpyolo11l241114_20240201' AS run_dir, reason, count(*) AS n, count(*) AS n_agreed FROM reasons WHERE NOT segmented AND reason IS NOT NULL GROUP BY ALL"),
    "streamed_palettes": q("", "SELECT archive_id, count(*) AS n_colors, count(DISTINCT instance_id) AS n_products FROM palette JOIN arch USING (instance_id) GROUP BY 1"),
    "csv_round_trip": "SELECT color_cluster, n_products, freq_pct, depth_pct, hex_color FROM (" + REVIEWS["cluster_summary"] + ")",
    "lenient_csv": q(OUTCOME_CTES, "SELECT instance_id, CASE WHEN priority <> '1-URGENT' THEN price_std::DOUBLE END AS price_std FROM outcomes WHERE priority NOT IN ('2-HIGH', '5-LOW') AND (priority = '1-URGENT' OR price_std IS NULL OR price_std > 0)"),
    "stored_palettes": q("", "SELECT archive_id, count(*) AS n_colors, (SELECT count(DISTINCT archive_id) FROM palette JOIN arch USING (instance_id) WHERE month < '1999-01') AS first_run, (SELECT count(*) FROM (SELECT archive_id FROM palette JOIN arch USING (instance_id) GROUP BY 1 HAVING min(month) >= '1999-01')) AS second_run FROM palette JOIN arch USING (instance_id) GROUP BY 1"),
    "stored_comp": q("", f"SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY instance_id, cluster_rank) - 1 AS place, CAST(round_even(lab_l, 0) AS INTEGER) AS lab_l, CAST(round_even(lab_a, 0) AS INTEGER) AS lab_a, CAST(round_even(lab_b, 0) AS INTEGER) AS lab_b, {to('perc', 2)} AS perc, count(*) OVER (PARTITION BY archive_id) AS n_clusters_combined FROM palette JOIN arch USING (instance_id)"),
    "zone_files": q(GRID, "SELECT DISTINCT 'Zone ' || (color_cluster // 10000) AS zone, color_cluster AS cluster_id, TRUE AS kept FROM dominant"),
    "zone_summary": q(GRID + ", zs AS (SELECT brand, 'Group ' || (color_cluster // 10000 + 1) AS name, count(DISTINCT color_cluster) AS n_clusters, count(*) AS n_products FROM dominant GROUP BY ALL)", "SELECT brand, name, n_clusters, n_products, CAST(sum(n_clusters) OVER (PARTITION BY brand) AS BIGINT) AS total_clusters, CAST(sum(n_products) OVER (PARTITION BY brand) AS BIGINT) AS total_products, 0 AS unassigned FROM zs"),
}
