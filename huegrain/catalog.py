"""The registry of the library's queries: name -> callable and name -> DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import color as C
from .functions import stats as S
from .functions import text as T
from .operators import cluster as K
from .operators import palette as P
from .operators.transport import pair_distances, palettes_in_rows
from .sources import catalogue as src
from .sources.files import handed_on, once

E = F.expr


def to(text: str, digits: int, name: str):
    return E(C.to(text, digits)).alias(name)


def dominant(spark: SparkSession, d: str) -> DataFrame:
    """Each product with the heaviest colour of its merged palette and that colour's merged coverage, grid cell and discount: a table, written
    once a session for the same files, since most queries read it, some of them several times."""
    return once(spark, "dominant", src.paths(d), lambda: handed_on(_dominant(spark, d)))


def _dominant(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("instance_id").orderBy(F.desc("perc"), "grp")
    p = P.merge_palette(src.palette_colors(spark, d)).withColumn("place", F.row_number().over(order)).filter("place = 1").select("instance_id", "perc", "lab_l", "lab_a", "lab_b")
    rows = src.instances(spark, d).join(p, "instance_id")
    cell = "cast(floor(lab_l / 20) * 10000 + (floor(lab_a / 20) + 10) * 100 + floor(lab_b / 20) + 10 as bigint)"
    return rows.withColumn("color_cluster", E(cell)).withColumn("discounted", E("coalesce(price_curr < price_std AND price_std > 0, false)")).withColumn("depth", E("CASE WHEN discounted THEN (price_std - price_curr) * 100.0D / price_std ELSE 0 END"))


def palette_hsb_coverage(spark, d):
    rows = C.with_saturation(src.palette_colors(spark, d)).join(src.archives_of(spark, d), "instance_id")
    return rows.groupBy("brand", E(T.GENDER_STRICT).alias("gender"), E(C.hsb_class("sat")).alias("band")).agg(F.count("*").alias("n_colors"), to("sum(perc)", 2, "coverage"))


def palette_hex(spark, d):
    rows = C.with_rgb(src.palette_colors(spark, d))
    return rows.select("instance_id", "cluster_rank", *(E(C.byte_of(c)).alias(c) for c in "rgb"), to(C.chroma("lab_a", "lab_b"), 4, "chroma"), to(C.hue("lab_a", "lab_b"), 4, "hue"))


def palette_merge(spark, d):
    return P.merge_palette(src.palette_colors(spark, d)).select("instance_id", "grp", to("perc", 3, "perc"), to("lab_l", 3, "lab_l"), to("lab_a", 3, "lab_a"), to("lab_b", 3, "lab_b"), "n_merged")


def archetype_products(spark, d):
    return P.archetypes(src.palette_colors(spark, d))


def _placed(spark, d):
    return archetype_products(spark, d).join(src.archives_of(spark, d), "instance_id")


def archetype_distribution(spark, d):
    rows = _placed(spark, d).withColumn("gender", E(T.GENDER_STRICT)).filter("gender is not null")
    counted = rows.groupBy("brand", "gender", "archetype").agg(F.count("*").alias("n_products"), F.sum(F.col("has_saturated").cast("int")).alias("n_with_saturated"))
    return counted.withColumn("of", F.sum("n_products").over(Window.partitionBy("brand", "gender"))).select("brand", "gender", "archetype", "n_products", "n_with_saturated", to("n_products * 100.0e0 / of", 4, "pct_products"))


def archetype_crosstab(spark, d):
    return _placed(spark, d).cube("brand", "archetype").agg(F.count("*").alias("n")).select(F.coalesce("brand", F.lit("ALL")).alias("brand"), F.coalesce("archetype", F.lit("ALL")).alias("archetype"), "n")


def coverage_quantiles(spark, d):
    share = lambda t: to(f"avg(cast(coverage_1 >= {t} as int)) * 100", 3, f"pct_{t}")
    return _placed(spark, d).rollup("brand").agg(to("avg(coverage_1)", 3, "mean_1"), to("median(coverage_1)", 3, "median_1"), share(70), share(80), share(90)).withColumn("brand", F.coalesce("brand", F.lit("Overall")))


def gender_rules(spark, d):
    return src.archives_of(spark, d).groupBy("query", E(T.GENDER_STRICT).alias("strict"), E(T.GENDER_LOOSE).alias("loose"), E(f"coalesce({T.GENDER_LOOSE}, 'unknown')").alias("loose_or_unknown")).agg(F.count("*").alias("n"))


def discount_baseline(spark, d):
    return dominant(spark, d).groupBy("brand").agg(F.count("*").alias("n"), E("sum(cast(discounted as int))").alias("n_discounted"), to("avg(cast(discounted as int)) * 100", 4, "freq_pct"), to("avg(CASE WHEN discounted THEN depth END)", 4, "depth_pct"), to("avg(price_curr)", 4, "price"))


def cluster_tests(spark, d):
    """Frequency z-test of every colour cluster against the baseline, with Benjamini-Hochberg over the testable ones. The
    windows without partitions run over clusters, at most one row a grid cell."""
    rows = dominant(spark, d)
    stats = rows.groupBy("color_cluster").agg(F.count("*").alias("n_products"), E("sum(cast(discounted as int))").alias("n_discounted"), E("avg(CASE WHEN discounted THEN depth END)").alias("depth"))
    base = rows.agg(E("sum(cast(discounted as int)) * 1.0D / count(*)").alias("p0"))
    z = stats.crossJoin(F.broadcast(base)).withColumn("z", E("CASE WHEN n_products >= 14 THEN (n_discounted * 1.0D / n_products - p0) / greatest(sqrt(p0 * (1 - p0) / n_products), 1e-10) END")).withColumn("pval", E(S.normal_two_tailed("z")))
    tested = z.filter("z is not null").withColumn("rk", F.row_number().over(Window.orderBy("pval", "color_cluster"))).withColumn("m", F.count("*").over(Window.partitionBy()))
    cut = tested.filter("pval <= rk * 0.05D / m").agg(F.max("pval").alias("cut"))
    return z.crossJoin(F.broadcast(cut)).select("color_cluster", "n_products", "n_discounted", to("depth", 3, "depth_pct"), to("z", 3, "freq_z"), E("z is not null").alias("freq_testable"), E("coalesce(pval <= cut, false)").alias("freq_significant"))


def cluster_centroids(spark, d):
    mean = lambda c: to(f"sum({c} * perc) / sum(perc)", 3, c)
    return dominant(spark, d).groupBy("color_cluster").agg(F.count("*").alias("n_products"), mean("lab_l"), mean("lab_a"), mean("lab_b"))


def temporal_cube(spark, d):
    return dominant(spark, d).groupBy("brand", "month", E("color_cluster div 10000").alias("zone")).agg(F.count("*").alias("n"), E("sum(cast(discounted as int))").alias("disc"), to("sum(depth)", 2, "depth_sum"), F.sum("price_curr").alias("price_sum"), E("count(CASE WHEN price_curr > 0 THEN 1 END)").alias("n_priced"))


def month_window(spark, d):
    months = dominant(spark, d).groupBy("brand", E("cast(substr(month, 1, 4) as bigint) * 12 + cast(substr(month, 6, 2) as bigint)").alias("m")).agg(F.count("*").alias("c"), E("sum(cast(discounted as int))").alias("x"))
    w = Window.partitionBy("brand").orderBy("m").rangeBetween(-2, 0)
    return months.select("brand", "m", F.sum("c").over(w).alias("n"), F.sum("x").over(w).alias("s")).select("brand", "m", "n", to("s * 100.0e0 / n", 4, "freq_pct"))


def smoothed_deviation(spark, d):
    """Each zone's deviation shrunk towards its colour neighbours' (within 15 units of LAB); zones of a brand are grid cells."""
    zones = dominant(spark, d).groupBy("brand", F.col("color_cluster").alias("zone")).agg(F.count("*").alias("n"), E("avg(cast(discounted as int)) * 100").alias("freq"), F.avg("lab_l").alias("l"), F.avg("lab_a").alias("a"), F.avg("lab_b").alias("b"))
    base = zones.groupBy("brand").agg(E("sum(freq * n) / sum(n)").alias("f0"), E("element_at(array_sort(collect_list(n)), cast(count(*) div 2 + 1 as int))").alias("kappa"))
    y = zones.select("brand", F.col("zone").alias("zy"), F.col("n").alias("ny"), F.col("freq").alias("fy"), F.col("l").alias("ly"), F.col("a").alias("ay"), F.col("b").alias("by_"))
    dist = E("sqrt(power(l - ly, 2) + power(a - ay, 2) + power(b - by_, 2))")
    near = zones.join(y, "brand").filter("zone <> zy").withColumn("dist", dist).filter("dist < 15").withColumn("w", E("ny * (1 - dist / 15)"))
    prior = near.groupBy("brand", "zone").agg(E("sum(w * fy) / sum(w)").alias("prior"))
    out = zones.join(base, "brand").join(prior, ["brand", "zone"], "left")
    return out.select("brand", "zone", "n", to("freq - f0", 3, "deviation"), to("CASE WHEN prior IS NULL THEN freq - f0 ELSE (n * (freq - f0) + kappa * (prior - f0)) * 1.0e0 / (n + kappa) END", 3, "smoothed"))


def palette_pair_de00(spark, d):
    p = src.palette_colors(spark, d)
    x = p.select("instance_id", F.col("cluster_rank").alias("i"), F.col("lab_l").alias("l1"), F.col("lab_a").alias("a1"), F.col("lab_b").alias("b1"))
    y = p.select("instance_id", F.col("cluster_rank").alias("j"), F.col("lab_l").alias("l2"), F.col("lab_a").alias("a2"), F.col("lab_b").alias("b2"))
    return C.with_de00(x.join(y, "instance_id").filter("i < j"), "l1", "a1", "b1", "l2", "a2", "b2").select("instance_id", "i", "j", to("de00", 3, "de00"))


def keyword_exclusion(spark, d):
    """Products that a keyword excludes, with the keyword as it stands there and the title it was found in, the first before the second."""
    pattern = T.keyword_pattern(T.EXCLUDED)
    field = F.when(F.col("title").rlike(pattern), "title").when(F.col("title_second").rlike(pattern), "title_second")
    found = src.instances(spark, d).withColumn("field", field).filter("field is not null")
    return found.select("instance_id", F.regexp_extract(F.when(F.col("field") == "title", F.col("title")).otherwise(F.col("title_second")), pattern, 1).alias("keyword"), "field")


def _tokens(spark, d):
    both = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("title_second", F.lit(""))))
    return src.instances(spark, d).select("instance_id", "brand", F.explode(F.regexp_extract_all(both, F.lit(r"(?U)([\w-]+)"))).alias("token"))


def keyword_map(spark, d):
    keys = spark.createDataFrame(list(T.KEYWORDS), "token string, class string")
    return _tokens(spark, d).join(F.broadcast(keys), "token").groupBy("brand", "class").agg(F.countDistinct("instance_id").alias("n"))


def term_statistics(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("occurrences"), F.countDistinct("instance_id").alias("products"), F.countDistinct("brand").alias("brands"))


def attrition(spark, d):
    """The first stage that lost each product; stage 0 is the final palette."""
    seen = src.palette_colors(spark, d).select("instance_id").distinct().withColumn("has", F.lit(True))
    rows = src.instances(spark, d).join(seen, "instance_id", "left")
    stage = F.when(E("has AND instance_id % 17 <> 0"), 0).when(F.col("title").isNull(), 1).when(F.col("title").rlike(T.keyword_pattern(T.EXCLUDED)), 2).when(E("instance_id % 17 = 0"), 3).otherwise(4)
    counted = rows.groupBy("brand", stage.alias("stage_no")).agg(F.count("*").alias("n"))
    brand = Window.partitionBy("brand")
    return counted.withColumn("of", F.sum("n").over(brand)).withColumn("dropped", F.sum(E("CASE WHEN stage_no > 0 THEN n ELSE 0 END")).over(brand.orderBy("stage_no"))).select("brand", "stage_no", "n", to("n * 100.0e0 / of", 3, "pct"), "dropped")


def label_confusion(spark, d):
    rows = src.read(spark, d, "labels").join(src.read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    lo, hi = S.wilson("(k * 1.0e0)", "n")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), E("count(CASE WHEN (quality = 0) = (toxic = 1) THEN 1 END)").alias("k")).select("lang", "n", "k", to(lo, 4, "lo"), to(hi, 4, "hi"))


def sample_sizes(spark, d):
    return dominant(spark, d).groupBy("color_cluster").agg(F.count("*").alias("n_products")).withColumn("wanted", E(S.sample_size("n_products")))


def unprocessed_archives(spark, d):
    a = src.archives_of(spark, d)
    done = a.join(src.palette_colors(spark, d).select("instance_id"), "instance_id", "left_semi")
    return a.select("archive_id").subtract(done.select("archive_id"))


def recent_archives(spark, d):
    seen = src.archives_of(spark, d).groupBy("brand", "archive_id").agg(F.max("month").alias("month"))
    return seen.withColumn("rk", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("month"), F.desc("archive_id")))).filter("rk <= 3").select("brand", "archive_id", "rk")


def zone_price_tests(spark, d):
    rows = dominant(spark, d)
    base = rows.agg(F.avg("price_curr").alias("p0"))
    stats = rows.groupBy(E("color_cluster div 10000").alias("zone")).agg(F.count("*").alias("n"), F.avg("price_curr").alias("mean"), F.var_samp("price_curr").alias("v")).filter("n >= 14")
    return stats.crossJoin(F.broadcast(base)).select("zone", "n", to("mean", 3, "mean_price"), to("(mean / p0 - 1) * 100", 3, "dev_pct"), to("(mean - p0) / sqrt(v / n)", 3, "t"))


def rand_index(spark, d):
    cells = dominant(spark, d).groupBy(E("color_cluster div 10000").alias("a"), E("color_cluster % 10").alias("b")).agg(F.count("*").alias("n"))
    pairs = "sum(n * (n - 1) / 2.0D)"
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(E(pairs).alias(f"n{c}")) for c in "ab")
    whole = cells.agg(E(pairs).alias("nij"), E("sum(n) * (sum(n) - 1) / 2.0D").alias("nn"))
    return whole.crossJoin(rows).crossJoin(cols).select(to("(nij - na * nb / nn) / ((na + nb) / 2 - na * nb / nn)", 4, "ari"))


def _zones(spark, d):
    return dominant(spark, d).groupBy(F.col("brand").alias("segment"), F.col("color_cluster").alias("zone")).agg(*(F.avg(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")))


def hue_families(spark, d):
    return K.hue_families(_zones(spark, d), 7.0)


def farthest_points(spark, d):
    return K.farthest_points(_zones(spark, d), 10)


def archive_drift(spark, d):
    """Transport distance of each later archive's down-sampled palette, weighted by coverage, to that of the earliest archive of
    its brand and gender, under CIEDE2000 and regularisation 0.1; a row is one pair of archives."""
    from .reports import downsample_palettes, drift_pairs

    palettes = handed_on(palettes_in_rows(downsample_palettes(spark, d), ["place"]))
    return pair_distances(drift_pairs(spark, d).select("brand", "gender", "base_id", "archive_id", "month"), palettes)


_ALL = [palette_hsb_coverage, palette_hex, palette_merge, archetype_products, archetype_distribution, archetype_crosstab, coverage_quantiles, gender_rules, discount_baseline, cluster_tests, cluster_centroids, temporal_cube, month_window, smoothed_deviation, palette_pair_de00, keyword_exclusion, keyword_map, term_statistics, attrition, label_confusion, sample_sizes, unprocessed_archives, recent_archives, zone_price_tests, rand_index, hue_families, farthest_points, archive_drift]


def queries() -> dict:
    from . import arrangements, clusters, intake, layout, reports, reviews, stores, zones

    return {f.__name__: f for f in [*_ALL, *reports.ALL, *reviews.ALL, *intake.ALL, *arrangements.ALL, *clusters.ALL, *zones.ALL, *layout.ALL, *stores.ALL]}


def oracle_sql() -> dict[str, str]:
    from .plans.oracles import SQL
    from .plans import cluster_oracles, intake_oracles, layout_oracles, report_oracles, review_oracles, store_oracles

    return {**SQL, **report_oracles.SQL, **review_oracles.SQL, **intake_oracles.SQL, **cluster_oracles.SQL, **layout_oracles.SQL, **store_oracles.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archetype_distribution(spark, sf_dir)
