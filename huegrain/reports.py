"""Reports over the catalogue: coverage merge, colour pairs, rule sweeps, zones, samples, terms, labels and paths.

Wherever rows are compared with each other, the pairs are within one product (at most five colours) or among one brand's
zones (at most one a grid cell), so no report's pairs grow with the square of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import archetype_products, dominant, to
from .functions import color as C
from .functions import exact as X
from .functions import stats as S
from .functions import text as T
from .operators import cluster as K
from .operators import palette as P
from .operators.sampling import SEED, first_of, seeded
from .sources import catalogue as src

E = F.expr

BANDS = (20, 45, 70)
#: fixed values: the candidates of each constant of the merge rule
SWEEPS = {"hue_merge": range(10, 46), "low_chroma_merge": range(5, 31), "low_chroma_max_delta_l": range(10, 61), "neutral_chroma": range(2, 21)}
#: hand labels are private; colours that chains of steps under so many units of LAB join stand in for a person's groups
LABEL_RADIUS = 30
PAIR = {
    "dl": "abs(l1 - l2)", "dchroma": "abs(c1 - c2)", "dhue": f"CASE WHEN least(c1, c2) >= 8 THEN {C.hue_difference('t1', 't2')} END",
    "mean_l": "(l1 + l2) / 2", "min_chroma": "least(c1, c2)", "max_chroma": "greatest(c1, c2)",
}
KIND = "(CASE WHEN max_chroma < 15 THEN 'low' WHEN min_chroma < 8 THEN 'mixed' ELSE 'chromatic' END)"
#: the first border that a pair lies near, in priority: a chroma threshold (within 4), the hue gap, the lightness guard (within 8); 4 when clear of all
STRATUM = "(CASE WHEN abs(max_chroma - 15) <= 4 OR abs(max_chroma - 8) <= 4 OR abs(min_chroma - 15) <= 4 OR abs(min_chroma - 8) <= 4 THEN 1 WHEN abs(dhue - 25) <= 8 THEN 2 WHEN max_chroma < 15 AND abs(dl - 35) <= 8 THEN 3 ELSE 4 END)"


def _coverages(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each merged colour: within a product and saturation band, colours closer than 60 are one."""
    banded = C.with_saturation(src.palette_colors(spark, d)).withColumn("band", E(C.hsb_class("sat")))
    merged = P.merge_palette(banded, lambda i, j: P.near_lab(i, j, 60), ("instance_id", "band")).select("instance_id", "band", "perc")
    return merged.join(src.archives_of(spark, d), "instance_id").withColumn("gender", E(T.GENDER_STRICT)).filter("gender is not null")


def coverage_bimodal(spark, d):
    return _coverages(spark, d).groupBy("brand", "gender", "band").agg(F.count("*").alias("n"), to("avg(cast(perc >= 80 OR perc <= 20 as int)) * 100", 3, "bimodal_pct"), to("avg(perc)", 3, "mean_coverage"))


def coverage_histogram(spark, d):
    """Forty bins of 2.5 on 0..100; the last holds 100."""
    return _coverages(spark, d).groupBy("band", E("cast(least(39, floor(perc / 2.5e0)) as int)").alias("bin")).agg(F.count("*").alias("n"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """One row a product: its colours side by side, their measures, the rule's groups g1..g5 and the labelled ones u1..u5."""
    w = P.pair_measures(P.with_measures(P.wide(src.palette_colors(spark, d), "instance_id")))
    return P.closure(P.closure(w, P.merges), lambda i, j: P.near_lab(i, j, LABEL_RADIUS), "u")


def pairs_of(w: DataFrame, *by: str) -> DataFrame:
    """One row a pair of a product's colours, i < j: both colours' columns (1 and 2), what is said of them, and whether the rule, the
    older rule without the lightness guards, the rule's groups and the labels make them one."""
    rows = ", ".join(f"{i}, {j}, " + ", ".join(f"{k}{n}" for n in (i, j) for k in "labpctgu") + f", {P.merges(i, j)}, {P.merges(i, j, guard=False)}" for i, j in P.PAIRS)
    names = ", ".join(f"{k}{n}" for n in (1, 2) for k in "labpctgu")
    long = w.select(*by, E(f"stack({len(P.PAIRS)}, {rows}) AS (i, j, {names}, merged, legacy)")).filter("l1 IS NOT NULL AND l2 IS NOT NULL")
    return long.withColumns({n: E(t) for n, t in PAIR.items()}).withColumn("grouped", E("g1 = g2")).withColumn("same", E("u1 = u2"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(labelled(spark, d), "instance_id")


def pair_features(spark, d):
    return _pairs(spark, d).select("instance_id", "i", "j", *(to(n, 3, n) for n in PAIR), "merged", "legacy")


def pair_merge_rates(spark, d):
    rate = lambda x, name: to(f"avg(cast({x} as int)) * 100", 3, name)
    return _pairs(spark, d).groupBy(E(KIND).alias("kind")).agg(F.count("*").alias("n"), rate("merged", "merge_pct"), rate("legacy", "legacy_pct"), rate("merged = legacy", "agree_pct"), to("median(dl)", 3, "median_dl"))


def boundary_strata(spark, d):
    """Products by the border of the merge rule that one of their pairs lies nearest to in priority."""
    of = _pairs(spark, d).groupBy("instance_id").agg(F.min(E(STRATUM)).alias("stratum"))
    return of.join(src.archives_of(spark, d), "instance_id").groupBy("brand", "stratum").agg(F.count("*").alias("n"))


def merge_sweep(spark, d):
    """Every candidate of every constant of the rule: products whose groups are those of the default rule, and the share of pairs that
    the groups and the bare predicate get right against the labels. A product's colours are laid out once; each candidate is bit arithmetic on them."""
    w = labelled(spark, d)
    bits = lambda said: E(" + ".join(f"CASE WHEN {said(i, j)} THEN {1 << k} ELSE 0 END" for k, (i, j) in enumerate(P.PAIRS)))
    w = w.select(*(f"{k}{i}{j}" for k in ("dl", "dh", "lo", "hi") for i, j in P.PAIRS), bits(lambda i, j: f"dl{i}{j} IS NOT NULL").alias("pairs"), bits(lambda i, j: f"dl{i}{j} IS NOT NULL AND u{i} = u{j}").alias("same"), bits(lambda i, j: f"dl{i}{j} IS NOT NULL AND g{i} = g{j}").alias("was"))
    w = w.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(name).alias("constant"), F.lit(v).alias("candidate")) for name, values in SWEEPS.items() for v in values))))
    w = w.withColumns({"constant": F.col("_c.constant"), "candidate": F.col("_c.candidate")}).withColumns({f"r_{name}": E(f"CASE WHEN constant = '{name}' THEN candidate ELSE {default} END") for name, default in P.RULE.items()})
    w = w.select("constant", "candidate", "pairs", "same", "was", bits(lambda i, j: P.merges(i, j, **{name: f"r_{name}" for name in P.RULE})).alias("one"))
    w = w.withColumn("grouped", F.element_at(F.array(*map(F.lit, P.closed_pairs())), F.col("one") + 1))
    right = lambda x: f"sum(bit_count(pairs & ~({x} ^ same))) * 100.0e0 / sum(bit_count(pairs))"
    return w.groupBy("constant", "candidate").agg(F.count("*").alias("n_products"), E("count_if(grouped = was)").alias("n_same"), to(right("grouped"), 4, "group_accuracy"), to(right("one"), 4, "pair_accuracy"))


def rule_mcnemar(spark, d):
    """McNemar's exact p of the present rule against the older one, by kind of pair, under the labels."""
    right = _pairs(spark, d).select(E("merged = same").alias("now"), E("legacy = same").alias("old"), E(KIND).alias("kind"))
    counts = right.groupBy("kind").agg(E("count_if(now AND NOT old)").alias("b"), E("count_if(old AND NOT now)").alias("c"))
    return counts.withColumn("p", X.mcnemar(F.col("b"), F.col("c")))


def _depths(spark: SparkSession, d: str) -> DataFrame:
    rows = dominant(spark, d).filter("discounted")
    base = rows.agg(F.avg("depth").alias("d0"))
    stats = rows.groupBy("color_cluster").agg(F.count("*").alias("n"), F.avg("depth").alias("mean"), F.var_samp("depth").alias("v")).filter("n >= 10 AND v > 0")
    return stats.crossJoin(F.broadcast(base)).withColumn("t", E("(mean - d0) / sqrt(v / n)"))


def depth_tests(spark, d):
    return _depths(spark, d).select("color_cluster", "n", to("mean", 3, "depth_pct"), to("mean - d0", 3, "deviation"), to("t", 3, "t"))


def depth_p_values(spark, d):
    """Student's p of every testable cluster with its Benjamini-Hochberg decision. The windows run over clusters."""
    p = _depths(spark, d).select("color_cluster", "n", X.student(F.col("t"), (F.col("n") - 1).cast("double")).alias("p"))
    ranked = p.withColumn("rk", F.row_number().over(Window.orderBy("p", "color_cluster"))).withColumn("m", F.count("*").over(Window.partitionBy()))
    cut = ranked.agg(F.max(E("CASE WHEN p <= rk * 0.05D / m THEN p END")).alias("cut"))
    return p.crossJoin(F.broadcast(cut)).select("color_cluster", "n", "p", E("coalesce(p <= cut, false)").alias("significant"))


def zone_discount_tests(spark, d):
    rows = dominant(spark, d)
    base = rows.groupBy("brand").agg(E("avg(cast(discounted as int))").alias("p0"))
    zones = rows.groupBy("brand", E("color_cluster div 10000").alias("zone")).agg(F.count("*").alias("n"), E("sum(cast(discounted as int))").alias("x"), E("avg(CASE WHEN discounted THEN depth END)").alias("depth"))
    z = zones.join(F.broadcast(base), "brand").withColumn("z", E("(x * 1.0e0 / n - p0) / greatest(sqrt(p0 * (1 - p0) / n), 1e-10)"))
    return z.select("brand", "zone", "n", F.col("x").alias("n_discounted"), to("depth", 3, "depth_pct"), to("(x * 1.0e0 / n - p0) * 100", 3, "deviation"), to("z", 3, "z"), E(f"{S.normal_two_tailed('z')} < 0.05").alias("significant"))


def scale_bounds(spark, d):
    rows = dominant(spark, d)
    base = rows.groupBy("brand").agg(E("avg(cast(discounted as int)) * 100").alias("f0"), F.avg("price_curr").alias("p0"))
    zones = rows.groupBy("brand", "color_cluster").agg(E("avg(cast(discounted as int)) * 100").alias("f"), F.avg("price_curr").alias("p"))
    bound = lambda x, name: E(f"cast(greatest(10, ceil(max(abs({x})) - 1e-9)) as bigint)").alias(name)
    return zones.join(F.broadcast(base), "brand").groupBy("brand").agg(bound("f - f0", "freq_bound"), bound("(p / p0 - 1) * 100", "price_bound"))


def swatch_scales(spark, d):
    """Swatch size against the brand's largest and the overall largest cluster, and the heat-map scale."""
    zones = dominant(spark, d).groupBy("brand", "color_cluster").agg(F.count("*").alias("n"))
    most = lambda w: F.max("n").over(w)
    return zones.withColumn("mb", most(Window.partitionBy("brand"))).withColumn("mg", most(Window.partitionBy())).select("brand", "color_cluster", "n", to("600 * sqrt(n * 1.0e0 / mb)", 3, "size_brand"), to("600 * sqrt(n * 1.0e0 / mg)", 3, "size_overall"), to("log10(n + 1.0e0)", 4, "heat"))


def selection_rollup(spark, d):
    """The zones of middle lightness taken together: discount frequency, depth, price, and their share of the brand."""
    rows = dominant(spark, d).withColumn("chosen", E("lab_l >= 40 AND lab_l < 60"))
    pick = lambda x: f"CASE WHEN chosen THEN {x} END"
    return rows.groupBy("brand").agg(E("count_if(chosen)").alias("n"), to(f"avg({pick('cast(discounted as int)')}) * 100", 3, "freq_pct"), to("avg(CASE WHEN chosen AND discounted THEN depth END)", 3, "depth_pct"), to(f"avg({pick('price_curr')})", 3, "price"), to("avg(cast(chosen as int)) * 100", 3, "share_pct"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    zones = dominant(spark, d).groupBy("brand", F.col("color_cluster").alias("zone")).agg(F.count("*").alias("n"), *(E(C.to(f"avg({c})", 6)).alias(c) for c in ("lab_l", "lab_a", "lab_b")))
    return C.with_saturation(zones, name="sat0").withColumn("sat", E(C.to("sat0", 6))).drop("sat0").withColumn("band", E(C.hsb_class("sat")))


ZONE_KEY = C.to("CASE WHEN band = 'neutral' THEN lab_l ELSE (CASE WHEN degrees(atan2(lab_b, lab_a)) < 0 THEN degrees(atan2(lab_b, lab_a)) + 540 ELSE degrees(atan2(lab_b, lab_a)) + 180 END) % 360 END")
BAND_NO = "(CASE band WHEN 'neutral' THEN 0 WHEN 'muted' THEN 1 ELSE 2 END)"


def zone_order(spark, d):
    """Neutral zones by lightness, then muted, then saturated ones by hue turned half round."""
    zones = _zones(spark, d).withColumn("key", E(ZONE_KEY)).withColumn("band_no", E(BAND_NO))
    return zones.select("brand", "zone", "band", F.row_number().over(Window.partitionBy("brand").orderBy("band_no", "key", "zone")).alias("place"))


def saturation_bands(spark, d):
    band = "CASE " + " ".join(f"WHEN sat < {b} THEN {i}" for i, b in enumerate(BANDS)) + f" ELSE {len(BANDS)} END"
    return _zones(spark, d).groupBy("brand", E(band).alias("band_no")).agg(F.count("*").alias("n_zones"), F.sum("n").alias("n_products"))


def zone_ball(spark, d):
    """A brand's zones within 15 of CIEDE2000 of its largest zone."""
    zones = _zones(spark, d).select("brand", "zone", "n", "lab_l", "lab_a", "lab_b")
    seed = zones.groupBy("brand").agg(F.max_by(F.struct("zone", "lab_l", "lab_a", "lab_b"), F.struct("n", -F.col("zone"))).alias("s"))
    both = zones.join(F.broadcast(seed), "brand").select("brand", "zone", "n", "lab_l", "lab_a", "lab_b", F.col("s.zone").alias("seed"), F.col("s.lab_l").alias("l0"), F.col("s.lab_a").alias("a0"), F.col("s.lab_b").alias("b0"))
    far = C.with_de00(both, "l0", "a0", "b0", "lab_l", "lab_a", "lab_b")
    # a filter on an aggregate is not pushed into the formula, which inlined would outgrow a generated method
    return far.groupBy("brand", "seed", "zone", "n").agg(F.min("de00").alias("de00")).filter("de00 <= 15").select("brand", "seed", "zone", "n", to("de00", 3, "de00"))


def nearest_zone(spark, d):
    """Every zone's nearest other zone of its brand under CIEDE2000."""
    x = _zones(spark, d).select("brand", "zone", F.col("lab_l").alias("l1"), F.col("lab_a").alias("a1"), F.col("lab_b").alias("b1"))
    y = x.select("brand", F.col("zone").alias("other"), F.col("l1").alias("l2"), F.col("a1").alias("a2"), F.col("b1").alias("b2"))
    near = C.with_de00(x.join(y, "brand").filter("zone <> other"), "l1", "a1", "b1", "l2", "a2", "b2").withColumn("de", E(C.to("de00", 3)))
    return near.groupBy("brand", "zone").agg(F.min(F.struct("de", "other")).alias("m")).select("brand", "zone", F.col("m.other").alias("nearest"), F.col("m.de").alias("de00"))


def mutual_information(spark, d):
    """Normalised mutual information (by the arithmetic mean of the entropies) of two labellings of the products."""
    cells = dominant(spark, d).groupBy(E("color_cluster div 10000").alias("a"), E("color_cluster % 10").alias("b")).agg(E("cast(count(*) as double)").alias("n"))
    whole = lambda by: F.sum("n").over(Window.partitionBy(*by))
    t = cells.withColumn("na", whole(["a"])).withColumn("nb", whole(["b"])).withColumn("nn", whole([]))
    return t.agg(to("2 * sum(n / nn * ln(n * nn / (na * nb))) / (-sum(n / nn * ln(na / nn)) - sum(n / nn * ln(nb / nn)))", 4, "nmi"))


def archetype_row_pct(spark, d):
    rows = archetype_products(spark, d).join(src.archives_of(spark, d), "instance_id")
    share = lambda k, name: to(f"avg(cast(archetype IN ({k}) as int)) * 100", 3, name)
    return rows.rollup("brand").agg(F.count("*").alias("n"), *(share(f"'{k}'", k.lower()) for k in P.KINDS), share("'MONO', 'DOM_ACC'", "simple")).withColumn("brand", F.coalesce("brand", F.lit("Overall")))


def stratified_sample(spark, d, per_brand: int = 4, per_stratum: int = 24):
    """A sample of each archetype: the same number of every brand, filled up from all that remain, by a seeded hash. Of each archetype and
    brand only as many rows as could be chosen are ordered together."""
    rows = archetype_products(spark, d).join(src.archives_of(spark, d), "instance_id").select("archetype", "brand", "instance_id", "has_saturated", seeded("instance_id").alias("h"))
    rows = first_of(rows, ["archetype", "brand"], str(per_brand + per_stratum)).withColumn("late", E(f"cast(place > {per_brand} as int)"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("archetype").orderBy("late", "h", "instance_id"))).filter(f"place <= {per_stratum}").select("archetype", "brand", "instance_id", "place", "has_saturated")


def sample_fingerprint(spark, d):
    """A short name of the sample, whose size is bounded."""
    ids = stratified_sample(spark, d).select(F.concat_ws(":", "brand", F.col("instance_id").cast("string")).alias("k"))
    return ids.agg(F.count("*").alias("n"), E(f"substr(sha1(concat('archetype|{SEED}|', array_join(array_sort(collect_list(k)), ','))), 1, 12)").alias("fingerprint"))


def sample_metadata(spark, d):
    s = stratified_sample(spark, d)
    return s.groupingSets([[F.col("archetype")], [F.col("brand")], [F.col("has_saturated")], []], "archetype", "brand", "has_saturated").agg(F.count("*").alias("n"))


def round_robin(spark, d):
    """The three products of most coverage in every lightness zone of a brand, one of each zone at a time."""
    top = dominant(spark, d).select("brand", E("color_cluster div 10000").alias("zone"), "instance_id", E(C.to("perc", 6)).alias("perc"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("brand", "zone").orderBy(F.desc("perc"), "instance_id"))).filter("r <= 3")
    return top.select("brand", "zone", "instance_id", F.row_number().over(Window.partitionBy("brand").orderBy("r", "zone")).alias("place"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return src.archives_of(spark, d).withColumn("gender", E(T.GENDER_LOOSE)).filter("gender is not null").groupBy("brand", "gender", "query", "archive_id").agg(F.min("month").alias("month"))


def drift_pairs(spark, d):
    """Each later archive of a brand and gender with the earliest one."""
    s = _series(spark, d)
    first = F.first("archive_id").over(Window.partitionBy("brand", "gender").orderBy("month", "archive_id"))
    return s.withColumn("base_id", first).filter("archive_id <> base_id").select("brand", "gender", "base_id", "archive_id", "month")


def longest_series(spark, d):
    n = _series(spark, d).groupBy("brand", "gender", "query").agg(F.count("*").alias("n_archives"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("brand", "gender").orderBy(F.desc("n_archives"), "query"))).filter("r = 1").drop("r")


def dataset_totals(spark, d):
    a = src.archives_of(spark, d)
    return a.agg(F.count("*").alias("n_products"), F.countDistinct("month").alias("n_months"), E("floor(count(*) / 1000) * 1000").cast("long").alias("n_floor"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def keyword_coverage(spark, d):
    """Products left after the exclusion list, and how many of them the keyword table reaches by either title."""
    kept = src.instances(spark, d).filter(F.col("title").isNotNull() & ~F.col("title").rlike(T.keyword_pattern(T.EXCLUDED)))
    words = T.keyword_pattern(tuple(k for k, _ in T.KEYWORDS))
    hit = kept.select("brand", F.col("title").rlike(words).alias("a"), F.coalesce(F.col("title_second").rlike(words), F.lit(False)).alias("b"))
    return hit.groupBy("brand").agg(F.count("*").alias("n"), E("count_if(a)").alias("by_title"), E("count_if(b)").alias("by_second"), E("count_if(a OR b)").alias("by_either"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    both = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("title_second", F.lit(""))))
    return src.instances(spark, d).select("instance_id", "brand", F.explode(F.array_distinct(F.regexp_extract_all(both, F.lit(r"(?U)([\w-]+)")))).alias("token"))


def term_signals(spark, d):
    """How far a term leans to one brand: its largest and second count, their variation, skew and score."""
    n = _terms(spark, d).groupBy("token", "brand").agg(F.count("*").alias("n"))
    t = n.groupBy("token").agg(F.sum("n").alias("total"), F.reverse(F.array_sort(F.collect_list("n"))).alias("v"), E("stddev_pop(n) / avg(n)").alias("cv")).filter("total >= 30")
    t = t.withColumn("most", E("v[0]")).withColumn("second", E("coalesce(get(v, 1), 0)"))
    return t.select("token", "total", "most", "second", to("cv", 4, "cv"), to("(most + 1.0e0) / (second + 1)", 4, "skew"), to("most * (most + 1.0e0) / (second + 1)", 4, "score"))


def label_metrics(spark, d):
    """Low quality as a guess of toxicity: precision, recall, F1 and accuracy by language and overall."""
    rows = src.read(spark, d, "labels").join(src.read(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang")), "doc_id")
    c = rows.rollup("lang").agg(E("count_if(quality = 0 AND toxic = 1)").alias("tp"), E("count_if(quality = 0 AND toxic = 0)").alias("fp"), E("count_if(quality = 1 AND toxic = 1)").alias("fn"), E("count_if(quality = 1 AND toxic = 0)").alias("tn"))
    return c.select(F.coalesce("lang", F.lit("Overall")).alias("lang"), "tp", "fp", "fn", "tn", *(to(t, 4, n) for n, t in METRICS.items()))


METRICS = {
    "precision": "CASE WHEN tp + fp > 0 THEN tp * 1.0e0 / (tp + fp) ELSE 0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp * 1.0e0 / (tp + fn) ELSE 0 END",
    "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) ELSE 0 END",
    "accuracy": "CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) * 1.0e0 / (tp + fp + fn + tn) ELSE 0 END",
}


def archive_paths(spark, d):
    """Folder names of the form BRAND_query_archive_timestamp parsed back to archives; the last of an archive's folders counts."""
    a = src.archives_of(spark, d)
    stamp = F.concat(F.regexp_replace("month", "-", ""), F.lpad((F.col("instance_id") % 28 + 1).cast("string"), 2, "0"))
    names = a.select(F.concat_ws("_", F.regexp_replace("brand", " ", ""), F.regexp_replace("query", " ", "-"), F.col("archive_id").cast("string"), stamp).alias("name")).distinct()
    parts = names.withColumn("p", F.split("name", "_")).filter(F.size("p") >= 4)
    return parts.groupBy(F.element_at("p", 1).alias("brand"), E("try_cast(element_at(p, -2) as bigint)").alias("archive_id")).agg(F.max("name").alias("latest"), F.count("*").alias("n_folders"))


def downsample_palettes(spark, d):
    """Each archive's colours at most 1900: copied where they are so few, else weighted k-means."""
    rows = src.palette_colors(spark, d).join(src.archives_of(spark, d).select("instance_id", "archive_id"), "instance_id")
    return K.downsample(rows, 1900)


ALL = [coverage_bimodal, coverage_histogram, pair_features, pair_merge_rates, boundary_strata, merge_sweep, rule_mcnemar, depth_tests, depth_p_values, zone_discount_tests, scale_bounds, swatch_scales, selection_rollup, zone_order, saturation_bands, zone_ball, nearest_zone, mutual_information, archetype_row_pct, stratified_sample, sample_fingerprint, sample_metadata, round_robin, drift_pairs, longest_series, dataset_totals, keyword_coverage, term_signals, label_metrics, archive_paths, downsample_palettes]
