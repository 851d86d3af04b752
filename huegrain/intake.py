"""What happens before a palette exists: lookups, lenient parsing, logs, detections, title terms, attrition, review samples and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import dominant, to
from .functions import color as C
from .functions import stats as S
from .functions import text as T
from .operators.sampling import first_of, seeded
from .reports import drift_pairs, stratified_sample
from .reviews import recent_sample
from .sources import catalogue as src
from .sources import files, logs

E = F.expr
EXCLUDED = T.keyword_pattern(T.EXCLUDED)

# ---------------------------------------------------------------- lookups


def _sampled_ids(spark: SparkSession, d: str) -> DataFrame:
    return stratified_sample(spark, d).select("instance_id")


def image_metadata(spark, d):
    """Product codes of the sampled products from the appendix; the last appendix row of a product counts."""
    rows = src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), "l_linenumber", "l_suppkey", F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("pid"))
    return rows.join(F.broadcast(_sampled_ids(spark, d)), "instance_id", "left_semi").groupBy("instance_id").agg(F.max_by("pid", F.struct("l_linenumber", "l_suppkey", "pid")).alias("pid"), F.count("*").alias("n_rows"))


def palette_lists(spark, d):
    """The sampled products' colours as lists by rank."""
    p = src.palette_colors(spark, d).join(F.broadcast(_sampled_ids(spark, d)), "instance_id", "left_semi")
    lists = p.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("cluster_rank", F.col("lab_l").cast("int").alias("l")))).alias("x"))
    return lists.select("instance_id", F.array_join(F.transform("x", lambda c: F.concat_ws(":", c["cluster_rank"].cast("string"), c["l"].cast("string"))), " ").alias("colors"))


def archive_segments(spark, d):
    """Products and detections of the archives that are still to be processed, which are those with products that have no palette; no
    archive, no rows."""
    o = src.outcomes(spark, d)
    todo = o.filter("not clustered").select("archive_id").distinct()
    rows = o.join(todo, "archive_id", "left_semi").select("instance_id", "archive_id")
    n = src.detections(spark, d).groupBy("instance_id").agg(F.count("*").alias("n_segments"))
    return rows.join(n, "instance_id", "left").groupBy("archive_id").agg(F.count("*").alias("n_instances"), E("coalesce(sum(n_segments), 0)").alias("n_segments"))


def pending_pairs(spark, d):
    """Pairs of archives whose drift is not stored yet; pairs before 1998 are."""
    pairs = drift_pairs(spark, d)
    stored = pairs.filter("month < '1998-01'").select("base_id", "archive_id")
    return pairs.join(stored, ["base_id", "archive_id"], "left_anti").select("brand", "gender", "base_id", "archive_id")


def recent_assigned_archives(spark, d):
    """The six most recent archives of each brand that have assigned products, with their products."""
    return recent_sample(spark, d).groupBy("brand", "archive_id").agg(F.count("*").alias("n"))


def brand_union(spark, d):
    """Brands read one by one and put together again."""
    o = src.archives_of(spark, d)
    names = [r.r_name for r in src.read(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # a row a brand
    parts = [o.filter(F.col("brand") == name).groupBy("month").agg(F.count("*").alias("n")).select(F.lit(name).alias("brand"), "month", "n") for name in names]
    return reduce(DataFrame.unionByName, parts)


def bundle_sync(spark, d):
    """Thumbnails of a bundle: referenced ones that exist (kept or copied), that are missing, and orphans that nothing refers to."""
    o = src.outcomes(spark, d)
    wanted, there, had = (o.filter(x).select("brand", "instance_id") for x in ("final", "segmented AND priority <> '5-LOW'", "clustered AND priority <> '1-URGENT'"))
    both = wanted.intersect(there)
    sets = {"kept": both.intersect(had), "copied": both.subtract(had), "missing": wanted.subtract(there), "orphans": had.subtract(wanted)}
    return reduce(DataFrame.unionByName, [x.groupBy("brand").agg(F.count("*").alias("n")).withColumn("what", F.lit(k)) for k, x in sets.items()])


# ---------------------------------------------------------------- lenient parsing, paths, names


def lenient_assignments(spark, d):
    """Assignment lines as text, parsed leniently: what is no number is null, rows without an id or with a price of 0 or less go."""
    o = src.outcomes(spark, d)
    line = F.concat_ws(",", F.when(F.col("priority") == "2-HIGH", F.lit("x17")).otherwise(F.col("instance_id").cast("string")), F.when(F.col("priority") == "1-URGENT", F.lit("n/a")).when(F.col("priority") == "5-LOW", F.lit("-1")).otherwise(F.coalesce(F.col("price_std").cast("string"), F.lit(""))), F.coalesce(F.col("price_curr").cast("string"), F.lit("")))
    cells = o.select(F.split(line, ",").alias("c"))
    rows = cells.select(E("try_cast(c[0] AS bigint)").alias("instance_id"), E("try_cast(c[1] AS double)").alias("price_std"), E("try_cast(c[2] AS double)").alias("price_curr"))
    return rows.filter("instance_id IS NOT NULL AND NOT coalesce(price_std <= 0, false)")


def image_paths(spark, d):
    """Expected image files against the files that are there."""
    o = src.outcomes(spark, d)
    name = F.format_string("%s/%d/%d-%d-0-1.jpg", F.regexp_replace("brand", " ", ""), "archive_id", "archive_id", "instance_id")
    listing = o.filter("segmented OR priority <> '3-MEDIUM'").select(name.alias("file"))
    return o.select("brand", name.alias("file")).join(listing.withColumn("found", F.lit(True)), "file", "left").groupBy("brand").agg(F.count("*").alias("n"), E("count_if(found)").alias("n_found"), F.min("file").alias("first_file"))


def contract_names(spark, d):
    """File names by contract: archive, instance, family, rank, product code and perhaps model and segment; fewer than five parts are an error."""
    det = src.detections(spark, d).join(src.outcomes(spark, d).select("instance_id", "archive_id", "priority"), "instance_id")
    short = F.concat_ws("-", F.col("archive_id").cast("string"), F.col("instance_id").cast("string"), F.col("no").cast("string"))
    name = F.when(F.col("priority") == "4-NOT SPECIFIED", short).when(F.col("priority") == "1-URGENT", F.concat(short, F.lit("-2-pid9"))).otherwise(F.concat(short, F.lit("_2-pid9-m1-77")))
    p = det.select(F.split(name, "[-_]").alias("p"))
    return p.groupBy(F.size("p").alias("n_parts"), E("CASE WHEN size(p) BETWEEN 5 AND 7 THEN 'ok' ELSE 'filename_format_error' END").alias("status"), E("get(p, 4)").alias("pid"), E("get(p, 5)").alias("model")).agg(F.count("*").alias("n"), E("min(try_cast(p[1] AS bigint))").alias("first_instance"))


def formatted_totals(spark, d):
    """Counts and shares as a report prints them."""
    o = src.outcomes(spark, d)
    return o.groupBy("brand").agg(F.format_number(F.count("*"), 0).alias("products"), F.concat(F.format_number(E("count_if(final) * 100.0D / count(*)"), 1), F.lit("%")).alias("visible"))


# ---------------------------------------------------------------- logs and attrition

# The stages' names, in the order of the report.
STAGES = ["null_title", "heraldic_filter", "keyword_map_miss", "archive_unsegmented", "yolo_no_masks", "yolo_no_garment", "yolo_file_not_found", "yolo_other", "yolo_unlogged", "clustering_failed", "gender_unknown", "dominant_merge_failed", "final_palette"]
INTENTIONAL = ["heraldic_filter", "gender_unknown", "yolo_file_not_found", "yolo_other", "null_title"]
OPPORTUNITIES = [("detection", ["yolo_no_garment", "yolo_no_masks"]), ("keyword map", ["keyword_map_miss"]), ("pending archives", ["archive_unsegmented"])]


def latest_logs(lines: DataFrame) -> DataFrame:
    """The lines of each archive folder's latest log; a folder is BRAND_archive_timestamp."""
    parts = lines.withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("key", F.regexp_extract("folder", r"^(.*)_[^_]*$", 1))
    last = parts.groupBy("key").agg(F.max("path").alias("path"))
    return parts.join(last, ["key", "path"], "left_semi").select("path", "line_no", "line")


def parse_logs(lines: DataFrame) -> DataFrame:
    """(instance_id, reason) of log lines; an instance is in one archive, and each archive has one log here."""
    return logs.parse(lines).groupBy("instance_id").agg(F.min("reason").alias("reason"))


def logged_archives(lines: DataFrame) -> DataFrame:
    return logs.header_archive(lines).select("archive_id").distinct()


def log_reasons(spark, d):
    found = parse_logs(latest_logs(src.log_lines(spark, d)))
    return found.join(src.archives_of(spark, d), "instance_id").groupBy("brand", "reason").agg(F.count("*").alias("n"))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Each product with the stage that lost it: final outcomes first, then the filters in the order in which they run, then the logs."""
    lines = latest_logs(src.log_lines(spark, d))
    o = src.outcomes(spark, d).join(parse_logs(lines), "instance_id", "left").join(logged_archives(lines).withColumn("has_log", F.lit(True)), "archive_id", "left")
    title = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("title_second", F.lit(""))))
    o = o.withColumn("said", title).withColumn("gender", E(f"coalesce({T.GENDER_LOOSE}, 'unknown')"))
    stage = (F.when(F.col("final"), F.when(F.col("gender") == "unknown", "gender_unknown").otherwise("final_palette")).when(F.col("clustered"), F.when(F.col("gender") == "unknown", "gender_unknown").otherwise("dominant_merge_failed")).when(F.col("segmented"), "clustering_failed")
             .when(F.col("said") == "", "null_title").when(F.col("said").rlike(EXCLUDED), "heraldic_filter").when(~F.col("said").rlike(T.keyword_pattern(tuple(k for k, _ in T.KEYWORDS))), "keyword_map_miss").when(F.col("has_log").isNull(), "archive_unsegmented").otherwise(F.coalesce("reason", F.lit("yolo_unlogged"))))
    return o.withColumn("stage", stage)


def _stage_no():
    return F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")


def attrition_stages(spark, d):
    """Products lost at each of thirteen stages by brand and gender, their share, and what is lost up to there."""
    c = _staged(spark, d).withColumn("stage_no", _stage_no()).groupBy("brand", "gender", "stage_no", "stage").agg(F.count("*").alias("n"))
    by = Window.partitionBy("brand", "gender")
    lost = F.sum(F.when(F.col("stage") != "final_palette", F.col("n")).otherwise(0)).over(by.orderBy("stage_no"))
    return c.withColumn("of", F.sum("n").over(by)).withColumn("lost", lost).select("brand", "gender", "stage_no", "stage", "n", to("n * 100.0D / of", 3, "pct"), to("lost * 100.0D / of", 3, "lost_pct"))


def analysis_modes(spark, d):
    """Of the visible products, how many each kind of analysis has."""
    o = _staged(spark, d)
    return o.groupBy("brand", "gender").agg(F.count("*").alias("n"), E("count_if(stage = 'final_palette')").alias("palette"), E("count_if(stage = 'final_palette' AND price_std IS NOT NULL)").alias("freq"), E("count_if(stage = 'final_palette' AND price_curr < price_std AND price_std > 0)").alias("depth"))


def reclamation(spark, d):
    """What was lost by reclaimable and intentional stages, largest first, and the three largest opportunities."""
    c = _staged(spark, d).filter("stage <> 'final_palette'").groupBy("stage").agg(F.count("*").alias("n"))
    names = ", ".join(f"'{x}'" for x in INTENTIONAL)
    c = c.withColumn("kind", E(f"CASE WHEN stage IN ({names}) THEN 'intentional' ELSE 'reclaimable' END"))
    placed = c.select("kind", "stage", "n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "stage")).alias("place"))  # a row a stage
    which = F.create_map(*(F.lit(x) for name, stages in OPPORTUNITIES for s in stages for x in (s, name)))
    top = c.withColumn("stage", which[F.col("stage")]).filter("stage is not null").groupBy("stage").agg(F.sum("n").alias("n")).select(F.lit("opportunity").alias("kind"), "stage", "n", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "stage")).alias("place"))
    return placed.unionByName(top)


def processing_counts(spark, d):
    """Counters of a run over each brand."""
    o = _staged(spark, d).filter("not segmented")
    return o.groupBy("brand").agg(F.count("*").alias("total"), *(E(f"count_if(stage = '{s}')").alias(s) for s in ("yolo_no_masks", "yolo_no_garment", "yolo_file_not_found", "yolo_other", "yolo_unlogged")))


# ---------------------------------------------------------------- detections

GARMENTS = ("ring", "plate", "bolt")
ATTRIBUTES = ("red", "blue", "small")
KEPT_APART = ("hot rod",)


def _routed(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("class_name"), F.lit(r"(?U)([\w-]+)"))
    has = lambda names: F.arrays_overlap("words", F.array(*map(F.lit, names)))
    rows = src.detections(spark, d).withColumn("words", words)
    return rows.withColumn("route", F.when(has(GARMENTS), "garment").when(has(ATTRIBUTES), "attribute").otherwise("none"))


def garment_routing(spark, d):
    return _routed(spark, d).groupBy("class_name", "route").agg(F.count("*").alias("n"), to("avg(conf)", 4, "mean_conf"))


def main_garments(spark, d):
    """Each product's largest garment, and the other garments and attributes that overlap it by more than 0.15."""
    rows = _routed(spark, d).filter("route <> 'none'").withColumn("area", E("(x2 - x1) * (y2 - y1)"))
    box = F.struct("no", "class_name", "x1", "y1", "x2", "y2", "area")
    main = rows.filter("route = 'garment'").groupBy("instance_id").agg(F.min_by(box, F.struct(-F.col("area"), F.col("no"))).alias("m"), F.count("*").alias("n_garments"))
    other = rows.join(main, "instance_id").withColumn("wide", E("greatest(0, least(x2, m.x2) - greatest(x1, m.x1))")).withColumn("high", E("greatest(0, least(y2, m.y2) - greatest(y1, m.y1))")).withColumn("shared", E("wide * high"))
    other = other.withColumn("iou", E("CASE WHEN no <> m.no THEN shared / (area + m.area - shared) END"))
    apart = ", ".join(f"'{x}'" for x in KEPT_APART)
    return other.groupBy("instance_id").agg(E("min(m.class_name)").alias("main"), F.min("n_garments").alias("n_garments"), F.count("iou").alias("n_candidates"), E(f"count_if(iou > 0.15 AND lower(m.class_name) NOT IN ({apart}))").alias("n_merged"), to("coalesce(avg(iou), 0)", 4, "mean_iou"))


def color_shift(spark, d):
    """Pixels before and after masking: mean and largest difference, means by channel, and whether the shift is visible (over 0.5)."""
    lines = src.read(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", "l_linenumber")
    diff = {"r": "abs(l_suppkey % 3 - 1)", "g": "CASE WHEN l_returnflag = 'R' THEN l_linenumber % 2 ELSE 0 END", "b": "CASE WHEN l_returnflag = 'A' THEN l_partkey % 4 ELSE 0 END"}
    p = lines.select("l_returnflag", *(E(f"cast({t} as double)").alias(k) for k, t in diff.items()))
    return p.groupBy(F.col("l_returnflag").alias("image")).agg(F.count("*").alias("n_pixels"), to("avg((r + g + b) / 3)", 4, "mean_diff"), E("max(greatest(r, g, b))").alias("max_diff"), *(to(f"avg({c})", 4, f"mean_{c}") for c in "rgb"), E("avg((r + g + b) / 3) > 0.5").alias("shifted"))


# ---------------------------------------------------------------- title terms

NOISE = ("new", "old", "and", "the")
ALL_KEYS = (*T.EXCLUDED, "large", "blue-ring", "hot rod")


def single_words(keys) -> list[str]:
    """Entries of one alphabetic word."""
    return sorted({k.strip().lower() for k in keys if k.strip().isalpha()})


def phrases(keys) -> list[str]:
    """Entries of several words or with hyphens, hyphens as spaces."""
    return sorted({k.strip().lower().replace("-", " ") for k in keys if " " in k.strip() or "-" in k})


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, brand, text, t): each title's tokens of two letters and more, case kept."""
    clean = F.regexp_replace("text", r"[^\w\s\-']", " ")
    keep = lambda x: (F.length(x) >= 2) & F.lower(x).rlike(r"^\p{L}+$")
    return src.shown_titles(spark, d).withColumn("t", F.filter(F.split(clean, r"[\s\-]+"), keep))


def title_terms(spark: SparkSession, d: str) -> DataFrame:
    """(kind, term, cap, instance_id, brand, text): single words but noise, and pairs of neighbours that are both capitalised and no noise."""
    noise = F.array(*map(F.lit, NOISE))
    capital = lambda x: F.substring(x, 1, 1).rlike(r"\p{Lu}")
    t = _tokens(spark, d)
    one = t.select("instance_id", "brand", "text", F.explode("t").alias("x")).filter(~F.array_contains(noise, F.lower("x"))).select(F.lit("unigram").alias("kind"), F.lower("x").alias("term"), capital(F.col("x")).alias("cap"), "instance_id", "brand", "text")
    both = t.filter(F.size("t") > 1).select("instance_id", "brand", "text", F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x"))
    both = both.filter(capital(F.col("x.a")) & capital(F.col("x.b")) & ~F.array_contains(noise, F.lower("x.a")) & ~F.array_contains(noise, F.lower("x.b")))
    return one.unionByName(both.select(F.lit("bigram").alias("kind"), F.concat_ws(" ", F.lower("x.a"), F.lower("x.b")).alias("term"), F.lit(True).alias("cap"), "instance_id", "brand", "text"))


def term_samples(spark, d):
    """Terms with occurrences, capitals, products, and up to twelve titles. Titles are made distinct before they are collected."""
    t = title_terms(spark, d)
    n = t.groupBy("kind", "term").agg(F.count("*").alias("occurrences"), E("count_if(cap)").alias("capitalised"), F.countDistinct("brand", "instance_id").alias("products"))
    titles = t.select("kind", "term", F.concat(F.lit("["), F.col("brand"), F.lit("] "), F.col("text")).alias("title")).distinct()
    titles = titles.withColumn("r", F.row_number().over(Window.partitionBy("kind", "term").orderBy("title"))).filter("r <= 12")
    return n.join(titles.groupBy("kind", "term").agg(F.array_join(F.array_sort(F.collect_list("title")), " || ").alias("titles")), ["kind", "term"])


def _signals(spark: SparkSession, d: str) -> DataFrame:
    t = title_terms(spark, d)
    b = t.groupBy("kind", "term", "brand").agg(F.countDistinct("instance_id").alias("n"), F.count("*").alias("occ"), E("count_if(cap)").alias("caps"))
    s = b.groupBy("kind", "term").agg(F.sum("n").alias("total"), F.sum("occ").alias("occ"), F.sum("caps").alias("caps"), F.reverse(F.array_sort(F.collect_list("n"))).alias("v"), E("CASE WHEN count(*) > 1 THEN stddev_pop(n) / avg(n) ELSE 0 END").alias("cv")).filter("total >= 30")  # a number a brand
    known = lambda kind, names: (F.col("kind") == kind) & F.col("term").isin(names)
    s = s.withColumn("in_filter", known("unigram", single_words(ALL_KEYS)) | known("bigram", phrases(ALL_KEYS))).withColumn("most", E("v[0]")).withColumn("second", E("coalesce(get(v, 1), 0)"))
    return s.withColumn("skew", E("(most + 1.0D) / (second + 1)")).withColumn("score", E("CASE WHEN in_filter THEN 0 ELSE most * skew END"))


def term_candidates(spark, d):
    """The first ten candidates for the filter by score that no reviewer has decided on yet."""
    decided = spark.createDataFrame([("unigram", "widget", "accepted"), ("unigram", "gear", "rejected")], "kind string, term string, decision string")
    s = _signals(spark, d).join(F.broadcast(decided), ["kind", "term"], "left_anti").orderBy("in_filter", F.desc(E(C.to("score", 1))), "kind", "term").limit(10)
    return s.select("kind", "term", "in_filter", "total", to("score", 1, "score"), to("skew", 2, "skew"), to("cv", 2, "cv"), to("caps * 1.0D / occ", 3, "cap_rate"))


def accepted_terms(spark, d):
    """The filter's list with what reviewers accepted, and how many products each entry reaches."""
    words = spark.createDataFrame([(k, "list") for k in (*single_words(ALL_KEYS), *phrases(ALL_KEYS))] + [("widget", "accepted")], "term string, origin string")
    n = title_terms(spark, d).groupBy("term").agg(F.countDistinct("brand", "instance_id").alias("n"))
    return words.join(n, "term", "left").fillna(0, "n")


def keyword_delta(spark, d):
    """Distinct products under the present list and under the expanded one, by brand and overall."""
    said = F.concat_ws(" ", "title", "title_second")
    rows = src.instances(spark, d).select("brand", "instance_id", F.coalesce(said.rlike(EXCLUDED), F.lit(False)).alias("a"), F.coalesce(said.rlike(T.keyword_pattern((*T.EXCLUDED, "widget"))), F.lit(False)).alias("b"))
    return rows.rollup("brand").agg(F.countDistinct("instance_id").alias("n"), E("count(DISTINCT CASE WHEN a THEN instance_id END)").alias("present"), E("count(DISTINCT CASE WHEN b THEN instance_id END)").alias("expanded")).withColumn("delta", E("expanded - present")).withColumn("brand", F.coalesce("brand", F.lit("all")))


def uncovered_titles(spark, d):
    """The first 2000 titles that the exclusion list leaves and the keyword table does not reach."""
    words = T.keyword_pattern(tuple(k for k, _ in T.KEYWORDS))
    rows = src.instances(spark, d).filter(F.col("title").isNotNull() & ~F.col("title").rlike(EXCLUDED) & ~F.concat_ws(" ", "title", "title_second").rlike(words))
    return rows.select("instance_id", "brand", "title").orderBy("instance_id").limit(2000)


# ---------------------------------------------------------------- samples of the filter and of clusters


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, brand, title, catches, label): a reviewer's label stands in as: every rod, and every hot plate."""
    rows = src.instances(spark, d).filter("title is not null")
    return rows.select("instance_id", "brand", "title", F.col("title").rlike(EXCLUDED).alias("catches"), E("title LIKE '%rod' OR title = 'hot plate'").alias("label"))


def keyword_sample(spark, d, per_brand: int = 40):
    """Half that the filter catches and half that it misses of each brand; misses fill up what catches lack."""
    half = per_brand // 2
    rows = _judged(spark, d).withColumn("h", seeded("brand", "instance_id"))
    s = first_of(rows, ["brand", "catches"], str(per_brand))
    n = s.filter("catches").groupBy("brand").agg(E(f"least({half}, count(*))").alias("caught"))
    return s.join(F.broadcast(n), "brand", "left").filter(f"place <= CASE WHEN catches THEN {half} ELSE {per_brand} - coalesce(caught, 0) END").select("brand", "catches", "instance_id", "place")


def keyword_filter_metrics(spark, d):
    """The filter against the labels: counts, precision, recall, F1 and accuracy with Wilson's interval, by brand and overall."""
    c = _judged(spark, d).rollup("brand").agg(E("count_if(catches AND label)").alias("tp"), E("count_if(catches AND NOT label)").alias("fp"), E("count_if(NOT catches AND label)").alias("fn"), E("count_if(NOT catches AND NOT label)").alias("tn"))
    c = c.withColumn("k", E("tp + tn")).withColumn("n", E("tp + fp + fn + tn"))
    lo, hi = S.wilson("(k * 1.0D)", "n")
    return c.select(F.coalesce("brand", F.lit("all")).alias("brand"), "tp", "fp", "fn", "tn", to("coalesce(tp * 1.0D / nullif(tp + fp, 0), 0)", 4, "precision"), to("coalesce(tp * 1.0D / nullif(tp + fn, 0), 0)", 4, "recall"), to("coalesce(2.0D * tp / nullif(2 * tp + fp + fn, 0), 0)", 4, "f1"), to("k * 1.0D / n", 4, "accuracy"), to(lo, 4, "lo"), to(hi, 4, "hi"))


def keyword_filter_errors(spark, d):
    """What the filter misses and what it catches wrongly."""
    return _judged(spark, d).filter("catches <> label").select("brand", "instance_id", "title", E("CASE WHEN label THEN 'FN' ELSE 'FP' END").alias("error"))


def cluster_samples(spark, d):
    """A seeded sample of each colour cluster, as large as a proportion within ten points needs."""
    rows = dominant(spark, d).select("color_cluster", "instance_id").withColumn("h", seeded("instance_id"))
    sizes = rows.groupBy("color_cluster").agg(E(S.sample_size("count(*)")).alias("wanted"))
    return first_of(rows.join(F.broadcast(sizes), "color_cluster"), ["color_cluster"], "wanted").select("color_cluster", "instance_id", "place")


def decided(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(run, decision) of the samples asked for (run, strata, seed, resample): fresh where none is held, drawn again on demand, reused where the
    metadata held (run, held_strata, held_seed) are those asked for, refused where not."""
    same = "held_strata <=> strata AND held_seed <=> seed"
    return asked.join(held.withColumn("held", F.lit(True)), "run", "left").select("run", E(f"CASE WHEN held IS NULL THEN 'fresh' WHEN resample THEN 'resample' WHEN {same} THEN 'reuse' ELSE 'refuse' END").alias("decision"))


def sample_decisions(spark, d):
    """What becomes of stored samples: their metadata go through JSON files. A run stands for an archive; what it asks for and holds follow from
    its number."""
    runs = src.archives_of(spark, d).select(F.col("archive_id").alias("run")).distinct()
    asked = runs.select("run", E("CASE WHEN run % 3 = 0 THEN 'pair-features' ELSE 'archetype' END").alias("strata"), (F.lit(40) + E("run % 2")).alias("seed"), E("run % 7 = 0").alias("resample"))
    path = files.workspace(spark)
    runs.filter("run % 5 <> 0").select("run", E("CASE WHEN run % 2 = 0 THEN 'pair-features' ELSE 'archetype' END").alias("held_strata"), F.lit(41).alias("held_seed")).write.json(path)
    return decided(asked, spark.read.schema("run bigint, held_strata string, held_seed bigint").json(path))


# ---------------------------------------------------------------- flagged products


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's flags, twenty a brand: a person's, so their number does not grow with the catalogue."""
    return first_of(dominant(spark, d).withColumn("h", seeded("brand", "instance_id")), ["brand"], "20")


def flag_distances(spark, d):
    """Flagged products' distance to the centre of their own cluster and to the nearest other one under CIEDE2000. The centres, at most one a
    grid cell of the gamut, are broadcast."""
    mean = lambda c: E(f"sum({c} * perc) / sum(perc)").alias(f"{c[-1]}2")
    centres = dominant(spark, d).groupBy(F.col("color_cluster").alias("other")).agg(*map(mean, ("lab_l", "lab_a", "lab_b")))
    f = _flagged(spark, d).select("brand", "instance_id", "color_cluster", "lab_l", "lab_a", "lab_b")
    far = C.with_de00(f.join(F.broadcast(centres), F.lit(True)), "lab_l", "lab_a", "lab_b", "l2", "a2", "b2").withColumn("de", E(C.to("de00", 2)))
    own = E("min(CASE WHEN other = color_cluster THEN de END)").alias("dist_to_own")
    alt = F.min(F.when(F.col("other") != F.col("color_cluster"), F.struct("de", "other"))).alias("alt")
    g = far.groupBy("brand", "instance_id", "color_cluster", "lab_l").agg(own, alt)
    return g.select("brand", "instance_id", "color_cluster", "dist_to_own", F.col("alt.other").alias("nearest_alt"), F.col("alt.de").alias("dist_to_alt"), to("dist_to_own - alt.de", 2, "delta"), E("CASE WHEN lab_l < 30 THEN 'dark' WHEN lab_l < 60 THEN 'mid' ELSE 'light' END").alias("lightness"))


def flag_analysis(spark, d):
    return flag_distances(spark, d).rollup("lightness").agg(F.count("*").alias("n"), to("avg(dist_to_own)", 2, "mean_own"), to("avg(dist_to_alt)", 2, "mean_alt"), E("count_if(delta > 0)").alias("closer_to_alt")).withColumn("lightness", F.coalesce("lightness", F.lit("all")))


def flag_pairs(spark, d):
    """The ten commonest pairs of a flagged product's cluster and the nearest other one."""
    return flag_distances(spark, d).groupBy("color_cluster", "nearest_alt").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "color_cluster", "nearest_alt").limit(10)


def flag_effect(spark, d):
    """Discount frequency of clusters with flagged products, with and without these."""
    rows = dominant(spark, d).join(F.broadcast(_flagged(spark, d).select("instance_id", F.lit(True).alias("flagged"))), "instance_id", "left")
    c = rows.groupBy("color_cluster").agg(F.count("*").alias("n_products"), F.count("flagged").alias("n_flagged"), E("avg(cast(discounted as int)) * 100").alias("f"), E("avg(CASE WHEN flagged IS NULL THEN cast(discounted as int) END) * 100").alias("clean")).filter("n_flagged > 0")
    return c.select("color_cluster", "n_products", "n_flagged", to("f", 2, "freq_all"), to("clean", 2, "freq_clean"), to("clean - f", 2, "delta_pp"))


def zone_pair_features(spark, d):
    """All pairs of a brand's colour clusters with eleven features and whether both are in one zone; clusters are at most one a grid cell
    of the gamut, whatever the number of products."""
    mean = lambda c: E(f"sum({c} * perc) / sum(perc)").alias(c)
    z = C.with_saturation(dominant(spark, d).groupBy("brand", "color_cluster").agg(F.count("*").alias("n"), *map(mean, ("lab_l", "lab_a", "lab_b"))))
    z = z.withColumn("c", E(C.chroma("lab_a", "lab_b"))).withColumn("h", E("CASE WHEN atan2(lab_b, lab_a) < 0 THEN degrees(atan2(lab_b, lab_a)) + 360 ELSE degrees(atan2(lab_b, lab_a)) END"))
    side = lambda k: z.select("brand", *(F.col(c).alias(f"{n}{k}") for c, n in {"color_cluster": "z", "n": "n", "lab_l": "l", "lab_a": "a", "lab_b": "b", "sat": "s", "c": "c", "h": "h"}.items()))
    p = C.with_de00(side(1).join(side(2), "brand").filter("z1 < z2"), "l1", "a1", "b1", "l2", "a2", "b2")
    return p.select("brand", F.col("z1").alias("cluster_a"), F.col("z2").alias("cluster_b"), to("de00", 3, "ciede2000"), to("abs(l1 - l2)", 2, "delta_l"), to("abs(c1 - c2)", 2, "delta_chroma"), to(C.hue_difference("h1", "h2"), 2, "delta_hue"), to("(l1 + l2) / 2", 1, "mean_l"), to("(c1 + c2) / 2", 1, "mean_chroma"),
                    to("least(c1, c2)", 1, "min_chroma"), to("greatest(c1, c2)", 1, "max_chroma"), to("(s1 + s2) / 2", 1, "mean_hsb_sat"), to("abs(s1 - s2)", 1, "delta_hsb_sat"), to("least(n1, n2) * 1.0D / greatest(n1, n2)", 3, "product_ratio"), E("z1 div 10000 = z2 div 10000").alias("same_zone"))


ALL = [image_metadata, palette_lists, archive_segments, pending_pairs, recent_assigned_archives, brand_union, bundle_sync, lenient_assignments, image_paths, contract_names, formatted_totals, log_reasons, attrition_stages, analysis_modes, reclamation, processing_counts, garment_routing, main_garments, color_shift, term_samples, term_candidates, accepted_terms, keyword_delta, uncovered_titles, keyword_sample, keyword_filter_metrics, keyword_filter_errors, cluster_samples, sample_decisions, flag_distances, flag_analysis, flag_pairs, flag_effect, zone_pair_features]
