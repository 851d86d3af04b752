"""Cluster and zone summaries, sampling modes, labels and their validation, detections, terms and attrition.

Hand labels, detections and logs of the production catalogue are private; stand-ins are derived from the star-schema tables by the
adapters below, and the same rules are applied to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import archetype_products, dominant, to
from .functions import color as C
from .functions import stats as S
from .functions import text as T
from .operators import palette as P
from .operators.sampling import first_of, seeded
from .reports import KIND, STRATUM, labelled, pairs_of
from .sources import catalogue as src

E = F.expr


# ---------------------------------------------------------------- clusters and zones


def _cluster_stats(rows: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: E(f"CASE WHEN sum(perc) > 0 THEN sum({c} * perc) / sum(perc) ELSE avg({c}) END").alias(c)
    return rows.groupBy(*by, "color_cluster").agg(F.count("*").alias("n_products"), E("count_if(discounted)").alias("n_discounted"), E("avg(CASE WHEN discounted THEN depth END)").alias("depth"), E("stddev_samp(CASE WHEN discounted THEN depth END)").alias("depth_std"), *map(mean, ("lab_l", "lab_a", "lab_b")))


def cluster_summary(spark, d):
    """Each colour cluster: counts, discount frequency and its deviation, depth and its spread, weighted centre, its sRGB, hex and hue."""
    rows = dominant(spark, d)
    base = rows.agg(E("avg(cast(discounted as int)) * 100").alias("f0"), E("avg(CASE WHEN discounted THEN depth END)").alias("d0"))
    c = C.with_rgb(_cluster_stats(rows)).crossJoin(F.broadcast(base)).withColumn("freq", E("n_discounted * 100.0D / n_products"))
    return c.select("color_cluster", "n_products", "n_discounted", to("freq", 3, "freq_pct"), to("freq - f0", 3, "freq_deviation_pp"), to("depth", 3, "depth_pct"), to("depth - d0", 3, "depth_deviation_pp"), to("depth_std", 3, "depth_std"),
                    *(to(x, 3, x) for x in ("lab_l", "lab_a", "lab_b", "r", "g", "b")), E(C.hex_of()).alias("hex_color"), to("pmod(degrees(atan2(lab_b, lab_a)), 360.0D)", 3, "hue_angle"), E("n_products >= 14").alias("freq_testable"), E("n_discounted >= 10").alias("depth_testable"))


def centroid_colors(spark, d):
    """Test results of clusters that can be tested, with the centroid's colour where there is one."""
    c = _cluster_stats(dominant(spark, d))
    tests = c.filter("n_products >= 14").select("color_cluster", "n_products")
    colors = C.with_rgb(c.filter("n_discounted >= 10")).select("color_cluster", E(C.hex_of()).alias("hex_color"))
    return tests.join(colors, "color_cluster", "left")


def zone_centroids(spark, d):
    """Zones' centres weighted by their clusters' products; a zone without products is black."""
    c = _cluster_stats(dominant(spark, d), "brand").withColumn("zone", E("color_cluster div 10000"))
    n = c.select("zone").distinct().crossJoin(F.broadcast(c.select("brand").distinct())).join(c, ["brand", "zone"], "left").withColumn("w", E("coalesce(n_products, 0)"))
    mean = lambda x: E(f"CASE WHEN sum(w) > 0 THEN sum({x} * w) / sum(w) ELSE 0 END").alias(x)
    z = C.with_rgb(n.groupBy("brand", "zone").agg(F.sum("w").alias("n_products"), *map(mean, ("lab_l", "lab_a", "lab_b"))))
    return z.select("brand", "zone", "n_products", *(to(x, 3, x) for x in ("lab_l", "lab_a", "lab_b")), E(C.hex_of(rounding=True)).alias("hex_color"))


def zone_rollup(spark, d):
    """Zones from their clusters: depth is the clusters' weighted by discounted products; z-test of the frequency against the brand."""
    rows = dominant(spark, d)
    base = rows.groupBy("brand").agg(E("avg(cast(discounted as int))").alias("p0"), E("coalesce(avg(CASE WHEN discounted THEN depth END), 0)").alias("d0"))
    c = _cluster_stats(rows, "brand").withColumn("zone", E("color_cluster div 10000"))
    z = c.groupBy("brand", "zone").agg(F.sum("n_products").alias("n_products"), F.sum("n_discounted").alias("n_discounted"), E("sum(depth * n_discounted) / sum(CASE WHEN depth IS NOT NULL THEN n_discounted END)").alias("depth")).join(F.broadcast(base), "brand")
    z = z.withColumn("z", E("(n_discounted * 1.0D / n_products - p0) / CASE WHEN p0 > 0 AND p0 < 1 THEN sqrt(p0 * (1 - p0) / n_products) ELSE 1e-10 END"))
    return z.select("brand", "zone", "n_products", "n_discounted", to("n_discounted * 100.0D / n_products", 2, "freq_pct"), to("(n_discounted * 1.0D / n_products - p0) * 100", 2, "freq_deviation_pp"), E(f"{S.normal_two_tailed('z')} < 0.05").alias("freq_significant"),
                    to("coalesce(depth, 0)", 2, "depth_pct"), to("coalesce(depth - d0, 0)", 2, "depth_deviation_pp"), E("depth IS NOT NULL").alias("has_depth"))


def zone_price_decisions(spark, d):
    """Zones' mean price against the brand's: one-sample t under the normal approximation, for 14 prices at least."""
    rows = dominant(spark, d).filter("price_std > 0")
    base = rows.groupBy("brand").agg(F.avg("price_std").alias("p0"))
    z = rows.groupBy("brand", E("color_cluster div 10000").alias("zone")).agg(F.count("*").alias("n_priced"), F.avg("price_std").alias("mean"), F.var_samp("price_std").alias("v")).join(F.broadcast(base), "brand")
    z = z.withColumn("t", E("CASE WHEN n_priced >= 14 AND v > 0 THEN (mean - p0) / sqrt(v / n_priced) END"))
    return z.select("brand", "zone", "n_priced", to("mean", 2, "price_mean"), to("(mean - p0) / p0 * 100", 2, "price_deviation_pct"), E(f"coalesce({S.normal_two_tailed('t')} < 0.05, false)").alias("price_significant"))


def window_stats(spark, d):
    """Zones over the last twelve months of the catalogue, against the same months' baselines; depth falls back to the brand's of all
    time where nothing is discounted. A zone without products in the window is empty, under 14 its power is low."""
    rows = dominant(spark, d).withColumn("zone", E("color_cluster div 10000"))
    cube = rows.groupBy("brand", "month", "zone").agg(F.count("*").alias("n"), E("count_if(discounted)").alias("disc"), F.sum("depth").alias("depth_sum"), E("sum(CASE WHEN price_std > 0 THEN price_std END)").alias("price_sum"), E("count_if(price_std > 0)").alias("n_priced"))
    months = cube.select("month").distinct().orderBy(F.desc("month")).limit(12)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "disc", "depth_sum", "price_sum", "n_priced")]
    inside = cube.join(F.broadcast(months), "month", "left_semi")
    w = cube.select("brand", "zone").distinct().join(inside, ["brand", "zone"], "left").groupBy("brand", "zone").agg(*sums)
    ever = cube.groupBy("brand").agg(E("coalesce(sum(depth_sum) / nullif(sum(disc), 0), 0)").alias("d_ever"))
    base = inside.groupBy("brand").agg(E("sum(disc) * 100.0D / sum(n)").alias("f0"), E("sum(depth_sum) / nullif(sum(disc), 0)").alias("d0"), E("sum(price_sum) * 1.0D / nullif(sum(n_priced), 0)").alias("p0"))
    w = w.join(F.broadcast(base), "brand", "left").join(F.broadcast(ever), "brand").withColumns({"freq": E("CASE WHEN n > 0 THEN disc * 100.0D / n ELSE 0 END"), "depth": E("CASE WHEN disc > 0 THEN depth_sum / disc ELSE 0 END"), "price": E("CASE WHEN n_priced > 0 THEN price_sum * 1.0D / n_priced ELSE 0 END")})
    return w.select("brand", "zone", F.col("n").alias("n_products"), F.col("disc").alias("n_discounted"), to("freq", 3, "freq_pct"), to("freq - coalesce(f0, 0)", 3, "freq_deviation_pp"), to("depth", 3, "depth_pct"), to("depth - coalesce(d0, d_ever)", 3, "depth_deviation_pp"),
                    to("CASE WHEN p0 > 0 THEN (price - p0) / p0 * 100 ELSE 0 END", 3, "price_deviation_pct"), E("CASE WHEN n = 0 THEN 'empty' WHEN n < 14 THEN 'low power' ELSE 'ok' END").alias("power"))


def scale_limits(spark, d):
    """The colour scales' bounds over all brands: ten at least, else the largest deviation rounded up."""
    rows = dominant(spark, d).withColumn("zone", E("color_cluster div 10000"))
    aggs = {"f": "avg(cast(discounted as int)) * 100", "dp": "avg(CASE WHEN discounted THEN depth END)", "p": "avg(CASE WHEN price_std > 0 THEN price_std END)"}
    z = rows.groupBy("brand", "zone").agg(*(E(x).alias(k) for k, x in aggs.items()))
    b = rows.groupBy("brand").agg(*(E(x).alias(f"{k}0") for k, x in aggs.items()))
    bound = lambda x, name: E(f"cast(ceil(greatest(10, max(abs({x}))) - 1e-9) as bigint)").alias(name)
    return z.join(F.broadcast(b), "brand").agg(bound("f - f0", "freq_max"), bound("coalesce(dp - dp0, 0)", "depth_max"), bound("(p - p0) / p0 * 100", "price_max"))


def deviation_colors(spark, d):
    """Deviations as colours: blue below, red above, grey at none."""
    z = zone_rollup(spark, d).withColumn("t", E("greatest(-1, least(1, freq_deviation_pp / 10))"))
    channel = lambda mid, low, high: f"cast(floor(CASE WHEN t < 0 THEN {mid} + ({mid} - {low}) * t ELSE {mid} - ({mid} - {high}) * t END + 0.5) as int)"
    return z.select("brand", "zone", E(f"concat('rgb(', {channel(247, 33, 178)}, ',', {channel(247, 102, 24)}, ',', {channel(247, 172, 43)}, ')')").alias("color"))


def recent_sample(spark: SparkSession, d: str, recent: int = 6) -> DataFrame:
    """The products of the most recent archives of each brand, among archives that have assigned products."""
    rows = dominant(spark, d)
    last = rows.groupBy("brand", "archive_id").agg(F.max("month").alias("m")).withColumn("rk", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("m"), F.desc("archive_id")))).filter(f"rk <= {recent}")
    return rows.join(F.broadcast(last.select("archive_id")), "archive_id", "left_semi")


def sample_mode(spark, d):
    """Clusters as the sample of recent archives has them: those without a product there are zero."""
    s = recent_sample(spark, d)
    base = s.groupBy("brand").agg(E("avg(cast(discounted as int)) * 100").alias("f0"), E("coalesce(avg(CASE WHEN discounted THEN depth END), 0)").alias("d0"))
    c = s.groupBy("brand", "color_cluster").agg(F.count("*").alias("n"), E("count_if(discounted)").alias("x"), E("avg(CASE WHEN discounted THEN depth END)").alias("dp"))
    every = dominant(spark, d).select("brand", "color_cluster").distinct()
    return every.join(c, ["brand", "color_cluster"], "left").join(F.broadcast(base), "brand", "left").select("brand", "color_cluster", F.coalesce("n", F.lit(0)).alias("n_products"), F.coalesce("x", F.lit(0)).alias("n_discounted"), to("dp", 3, "depth_pct"), to("f0", 3, "baseline_freq_pct"), to("d0", 3, "baseline_depth_pct"))


def sample_zones(spark, d):
    """Zones that keep a product in the sample."""
    return sample_mode(spark, d).groupBy("brand", E("color_cluster div 10000").alias("zone")).agg(F.sum("n_products").alias("n_products"), F.count("*").alias("n_clusters"), E("count_if(n_products = 0)").alias("n_empty")).filter("n_products > 0")


def lightness_bands(spark, d):
    return dominant(spark, d).groupBy("brand", E("CASE WHEN lab_l < 30 THEN 'dark' WHEN lab_l < 60 THEN 'mid' ELSE 'light' END").alias("band")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- colours


def palette_hex_rounded(spark, d):
    rows = C.with_rgb(src.palette_colors(spark, d))
    tone = f"CASE WHEN {C.chroma('lab_a', 'lab_b')} >= 30 THEN 'S' WHEN {C.chroma('lab_a', 'lab_b')} >= 10 THEN 'M' ELSE 'N' END"
    return rows.select("instance_id", "cluster_rank", E(C.hex_of(rounding=True)).alias("hex"), E(tone).alias("tone"))


def explorer_bands(spark, d):
    """The explorer's variant: its own matrix, a branch on the cube, neutral below 6 (the tuner: below 5)."""
    f = lambda t: f"CASE WHEN {t} * {t} * {t} > 0.008856D THEN {t} * {t} * {t} ELSE ({t} - 16.0D / 116) / 7.787D END"
    # fixed values: the variant's matrix
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    steps = [("_fy", "(lab_l + 16) / 116.0D"), ("_fx", "lab_a / 500.0D + _fy"), ("_fz", "_fy - lab_b / 200.0D"), ("_x", f"0.95047D * ({f('_fx')})"), ("_y", f("_fy")), ("_z", f"1.08883D * ({f('_fz')})")]
    steps += [(f"_l{c}", f"_x * {m[0]}D + _y * {m[1]}D + _z * {m[2]}D") for c, m in zip("rgb", rows)]
    steps += [(f"_{c}", f"greatest(0.0D, least(1.0D, CASE WHEN _l{c} <= 0.0031308D THEN 12.92D * _l{c} ELSE 1.055D * power(greatest(_l{c}, 0.0D), 1 / 2.4D) - 0.055D END))") for c in "rgb"]
    steps += [("_most", "greatest(_r, _g, _b)"), ("_sat", "CASE WHEN _most > 0 THEN (_most - least(_r, _g, _b)) / _most * 100 ELSE 0 END")]
    p = C.staged(src.palette_colors(spark, d), steps, {"sat": "_sat"})
    return p.groupBy(E(C.hsb_class("sat", muted=6)).alias("explorer"), E(C.hsb_class("sat", muted=5)).alias("tuner")).agg(F.count("*").alias("n"), to("avg(sat)", 3, "mean_sat"))


def lab_round_trip(spark, d):
    """Colours in sRGB back to CIELAB (D65): the share that comes back within half a unit, which is what the gamut holds."""
    p = C.with_rgb(src.palette_colors(spark, d))
    lin = lambda c: f"CASE WHEN {c} <= 0.04045D THEN {c} / 12.92D ELSE power(({c} + 0.055D) / 1.055D, 2.4D) END"
    # fixed values: the inverse matrix of the standard
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    f = lambda t: f"CASE WHEN {t} > 0.008856D THEN power({t}, 1 / 3.0D) ELSE 7.787D * {t} + 16.0D / 116 END"
    steps = [(f"_i{c}", lin(c)) for c in "rgb"] + [(f"_{k}", f"({m[0]}D * _ir + {m[1]}D * _ig + {m[2]}D * _ib) / {w}D") for k, m, w in zip("xyz", rows, (0.95047, 1.0, 1.08883))] + [(f"_f{k}", f(f"_{k}")) for k in "xyz"]
    p = C.staged(p, [*steps, ("_l", "116 * _fy - 16"), ("_a", "500 * (_fx - _fy)"), ("_b", "200 * (_fy - _fz)")], {"l2": "_l", "a2": "_a", "b2": "_b"})
    return p.select("instance_id", "cluster_rank", *(to(x, 2, x) for x in ("l2", "a2", "b2")), E("abs(l2 - lab_l) < 0.5 AND abs(a2 - lab_a) < 0.5 AND abs(b2 - lab_b) < 0.5").alias("in_gamut"))


def saturation_categories(spark, d):
    """Zones in the user's bands of saturation (20, 45, 70); the lowest by lightness, others by hue turned by 45 degrees."""
    z = C.with_saturation(_cluster_stats(dominant(spark, d), "brand")).withColumn("s", E(C.to("sat", 6))).withColumn("category", E("CASE WHEN s < 20 THEN 0 WHEN s < 45 THEN 1 WHEN s < 70 THEN 2 ELSE 3 END"))
    z = z.withColumn("key", E(C.to("CASE WHEN category = 0 THEN lab_l ELSE (pmod(degrees(atan2(lab_b, lab_a)), 360.0D) + 45) % 360 END", 6)))
    return z.select("brand", "color_cluster", "category", F.row_number().over(Window.partitionBy("brand", "category").orderBy("key", "color_cluster")).alias("place"))


def saturation_metadata(spark, d):
    """Saturation of each product's merged palette: largest, coverage of each class, whether any is saturated, the sequence."""
    m = P.merged_places(src.palette_colors(spark, d))
    cover = lambda b: to(f"sum(CASE WHEN band = '{b}' THEN perc ELSE 0 END)", 3, f"{b}_coverage")
    return m.groupBy("instance_id").agg(to("max(sat)", 3, "max_hsb_sat"), E("max(band = 'saturated')").alias("has_saturated"), cover("saturated"), cover("muted"), cover("neutral"))


def coverage_columns(spark, d):
    """The five largest significant coverages of each product side by side, 0 where there are fewer."""
    m = P.merged_places(src.palette_colors(spark, d)).filter("significant").withColumn("rk", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("perc"), "grp")))
    return m.groupBy("instance_id").agg(*(to(f"coalesce(max(CASE WHEN rk = {i} THEN perc END), 0)", 3, f"coverage_{i}") for i in P.PLACES))


def merge_group_ids(spark, d):
    """Each raw colour's merge group, numbered from 0 in the order of first appearance."""
    g = P.merge_groups(src.palette_colors(spark, d))
    return g.select("instance_id", "cluster_rank", (F.dense_rank().over(Window.partitionBy("instance_id").orderBy("grp")) - 1).alias("group"))


def cluster_payload(spark, d):
    """What a reviewer sees of each product: raw colours with their group and hex, merged colours with hex and coverage, as JSON."""
    raw = C.with_rgb(P.merge_groups(src.palette_colors(spark, d)))
    raw = raw.withColumn("group", F.dense_rank().over(Window.partitionBy("instance_id").orderBy("grp")) - 1).groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("cluster_rank", "group", E(C.hex_of(rounding=True)).alias("hex")))).alias("raw"))
    merged = C.with_rgb(P.merge_palette(src.palette_colors(spark, d))).withColumn("place", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("perc"), "grp")))
    merged = merged.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("place", E(C.hex_of(rounding=True)).alias("hex")))).alias("merged"))
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[n].cast("string") for n in names))), ", ")
    return raw.join(merged, "instance_id").select("instance_id", text("raw", "cluster_rank", "group", "hex").alias("raw"), text("merged", "place", "hex").alias("merged"), F.size("raw").alias("n_raw"), F.size("merged").alias("n_merged"))


def archetype_brand_gender(spark, d):
    """Archetypes of each brand and gender side by side in percent, with the number of products and the first product's colours."""
    rows = archetype_products(spark, d).join(src.archives_of(spark, d), "instance_id").withColumn("gender", E(T.GENDER_STRICT)).filter("gender is not null")
    return rows.groupBy("brand", "gender").agg(F.count("*").alias("n"), *(to(f"count_if(archetype = '{k}') * 100.0D / count(*)", 3, k.lower()) for k in P.KINDS), F.min_by("n_colors", "instance_id").alias("first_n_colors"))


# ---------------------------------------------------------------- labelled pairs


def labelled_pairs(spark, d):
    """Labelled pairs with all that is said of them."""
    p = pairs_of(labelled(spark, d), "instance_id")
    return p.select("instance_id", "i", "j", F.col("same").alias("user_should_merge"), F.col("grouped").alias("algo_group_match"), F.col("merged").alias("algo_pair_merge"), "legacy", E("same <> grouped").alias("user_disagrees"), to("dl", 3, "delta_l"),
                    *(to(f"CASE WHEN c{k} >= 8 THEN t{k} END", 3, f"hue_{k}") for k in (1, 2)), to("dhue", 3, "hue_diff"), *(to(f"c{k}", 2, f"chroma_{k}") for k in (1, 2)), to("min_chroma", 2, "chroma_min"), to("max_chroma", 2, "chroma_max"),
                    E("max_chroma < 15").alias("both_low_chroma"), E("max_chroma < 8").alias("both_neutral"), E("min_chroma < 8 AND max_chroma >= 8").alias("one_neutral"), E("min_chroma >= 8").alias("both_chromatic"), to("dchroma", 2, "delta_chroma"),
                    *(to(f"p{k}", 3, f"perc_{k}") for k in (1, 2)), to("least(p1, p2)", 3, "perc_min"), to("greatest(p1, p2)", 3, "perc_max"), to("sqrt(power(l1 - l2, 2) + power(a1 - a2, 2) + power(b1 - b2, 2))", 2, "lab_euclidean"))


def pair_summary(spark, d):
    """Merge rate, accuracies of the rule, the older rule and the groups, by kind of pair and overall; features of merged and other pairs."""
    p = pairs_of(labelled(spark, d), "instance_id").withColumn("kind", E(KIND))
    rate = lambda x, name: to(f"avg(cast({x} as int)) * 100", 3, name)
    means = [to(f"{f}(CASE WHEN {'' if m else 'NOT '}same THEN {c} END)", 2, f"{c}_{f}_{'merged' if m else 'apart'}") for c in ("dl", "dhue") for f in ("avg", "median") for m in (True, False)]
    return p.rollup("kind").agg(F.count("*").alias("n"), rate("same", "user_merge_pct"), rate("merged = same", "live_accuracy"), rate("legacy = same", "legacy_accuracy"), rate("grouped = same", "group_accuracy"), rate("grouped <> same", "disagree_pct"), *means).withColumn("kind", F.coalesce("kind", F.lit("all")))


def label_groups(spark, d):
    """Labels put together again: each product's colours in order with their groups, renumbered from 0 by first appearance."""
    u = P.long(labelled(spark, d), ["instance_id"], u="u")
    u = u.withColumn("group", F.dense_rank().over(Window.partitionBy("instance_id").orderBy("u")) - 1)
    lists = u.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("cluster_rank", "group"))).alias("x"))
    return lists.select("instance_id", F.array_join(F.transform("x", lambda x: x["group"].cast("string")), ",").alias("groups"), F.array_max(F.transform("x", lambda x: x["group"])).alias("last_group"))


def boundary_sample(spark, d):
    """A sample near the borders of the merge rule: 60 products near a chroma threshold, 80 near the hue gap, 60 near the lightness
    guard, 40 clear ones, in seeded order. Each task keeps its own first of a stratum before they meet."""
    s = pairs_of(labelled(spark, d), "instance_id").groupBy("instance_id").agg(F.min(E(STRATUM)).alias("stratum")).withColumn("h", seeded("instance_id"))
    want = "CASE stratum WHEN 1 THEN 60 WHEN 2 THEN 80 WHEN 3 THEN 60 ELSE 40 END"
    return first_of(s, ["stratum"], want).withColumn("strata_mode", F.lit("pair-features")).select("stratum", "instance_id", "place", "strata_mode")


def strata_banner(spark, d):
    """Whether a set of labels holds products of a boundary sample, so that its accuracy is none of the real world."""
    near = boundary_sample(spark, d).select("instance_id", "strata_mode")
    rows = src.archives_of(spark, d).join(F.broadcast(near), "instance_id", "left").withColumn("strata_mode", F.coalesce("strata_mode", F.lit("archetype")))
    return rows.groupBy("brand").agg(E("max(strata_mode <> 'archetype')").alias("is_boundary"), F.array_join(F.array_sort(F.collect_set("strata_mode")), ",").alias("modes"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, brand, predicted, human): what a reviewer wrote. Stand-in: the archetype without the lightness guards, CORRECT where
    it is the same, UNCERTAIN or a typing error where the archive's month is the first or second of a quarter's end."""
    old = P.archetypes(src.palette_colors(spark, d), lambda i, j: P.merges(i, j, guard=False)).select("instance_id", F.col("archetype").alias("other"))
    rows = archetype_products(spark, d).select("instance_id", F.col("archetype").alias("predicted"), "has_saturated").join(old, "instance_id").join(src.archives_of(spark, d), "instance_id")
    human = "CASE WHEN substr(month, 6, 2) = '03' THEN 'UNCERTAIN' WHEN substr(month, 6, 2) = '06' THEN 'mono?' WHEN other = predicted THEN 'CORRECT' ELSE other END"
    return rows.select("instance_id", "brand", "predicted", "has_saturated", E(human).alias("human"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    kinds = ", ".join(f"'{k}'" for k in P.KINDS)
    v = _validated(spark, d)
    return v.withColumn("status", E(f"CASE WHEN human = 'CORRECT' OR human IN ({kinds}) THEN 'resolved' WHEN human = 'UNCERTAIN' THEN 'uncertain' ELSE 'unusable' END")).withColumn("truth", E("CASE WHEN status = 'resolved' THEN CASE WHEN human = 'CORRECT' THEN predicted ELSE human END END"))


def label_status(spark, d):
    return _resolved(spark, d).groupBy("brand", "status").agg(F.count("*").alias("n"))


def archetype_confusion(spark, d):
    """True against predicted archetype, every cell of the five by five."""
    kinds = spark.createDataFrame([(k,) for k in P.KINDS], "k string")
    grid = kinds.withColumnRenamed("k", "truth").crossJoin(F.broadcast(kinds.withColumnRenamed("k", "predicted")))
    counts = _resolved(spark, d).filter("status = 'resolved'").groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").fillna(0, "n")


def archetype_scores(spark, d):
    """Support, precision, recall and F1 of each archetype, their macro mean, and the accuracy with Wilson's interval."""
    c = archetype_confusion(spark, d)
    one = c.groupBy(F.col("truth").alias("archetype")).agg(F.sum("n").alias("support"), E("sum(CASE WHEN truth = predicted THEN n ELSE 0 END)").alias("tp"))
    said = c.groupBy(F.col("predicted").alias("archetype")).agg(F.sum("n").alias("said"))
    s = one.join(said, "archetype").withColumns({"recall": E("coalesce(tp * 1.0D / nullif(support, 0), 0)"), "precision": E("coalesce(tp * 1.0D / nullif(said, 0), 0)"), "f1": E("coalesce(2.0D * tp / nullif(support + said, 0), 0)")})
    each = s.select("archetype", "support", to("precision", 4, "precision"), to("recall", 4, "recall"), to("f1", 4, "f1"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    lo, hi = S.wilson("(k * 1.0D)", "n")
    whole = s.agg(F.sum("tp").alias("k"), F.sum("support").alias("n"), F.avg("f1").alias("f1"))
    return each.unionByName(whole.select(F.lit("all").alias("archetype"), F.col("n").alias("support"), to("k * 1.0D / n", 4, "precision"), to("k * 1.0D / n", 4, "recall"), to("f1", 4, "f1"), to(lo, 4, "lo"), to(hi, 4, "hi")))


def misclassified_preview(spark, d):
    """The first fifteen wrong ones, by brand."""
    return _resolved(spark, d).filter("truth <> predicted").select("brand", "instance_id", "truth", "predicted").orderBy("brand", "instance_id").limit(15)


def accuracy_by_brand(spark, d):
    r = _resolved(spark, d).filter("status = 'resolved'").groupBy("brand", "has_saturated").agg(F.count("*").alias("n"), E("count_if(truth = predicted)").alias("k"))
    lo, hi = S.wilson("(k * 1.0D)", "n")
    return r.select("brand", "has_saturated", "n", "k", to(lo, 4, "lo"), to(hi, 4, "hi"))


ALL = [cluster_summary, centroid_colors, zone_centroids, zone_rollup, zone_price_decisions, window_stats, scale_limits, deviation_colors, sample_mode, sample_zones, lightness_bands, palette_hex_rounded, explorer_bands, lab_round_trip, saturation_categories, saturation_metadata, coverage_columns, merge_group_ids, cluster_payload, archetype_brand_gender, labelled_pairs, pair_summary, label_groups, boundary_sample, strata_banner, label_status, archetype_confusion, archetype_scores, misclassified_preview, accuracy_by_brand]
