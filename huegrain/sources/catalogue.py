"""The logical catalogue tables, derived from star-schema tables: one product per order, one palette colour per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES = ("mens clothing", "womens", "women tops", "men", "kids")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(sf_dir: str) -> list[str]:
    """The files that products, their palettes and prices come from."""
    return [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "customer", "nation", "region", "part")]


def _ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    return lines.withColumn("rk", F.row_number().over(order)).filter("rk <= 5")


def palette_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, cluster_rank, perc, lab_l, lab_a, lab_b): at most five colours a product, by falling coverage."""
    kept = _ranked_lines(spark, sf_dir)
    share = 100 * F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    scale = F.when(F.expr("l_partkey % 3 = 0"), 10.0).otherwise(1.0)
    return kept.select(F.col("l_orderkey").alias("instance_id"), F.col("rk").alias("cluster_rank"), share.alias("perc"), F.expr("cast(l_partkey % 101 as double)").alias("lab_l"), (F.expr("(l_partkey * 7 + l_suppkey * 13) % 161 - 80") / scale).alias("lab_a"), (F.expr("(l_partkey * 11 + l_suppkey * 29) % 161 - 80") / scale).alias("lab_b"))


def archives_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, brand, query, month, archive_id): the dated crawl that saw each product."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(F.broadcast(read(spark, sf_dir, "region").select("r_regionkey", "r_name")), F.expr("n_regionkey = r_regionkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    q = F.expr("o_orderkey % 5")
    months = F.expr("(year(o_orderdate) - 1990) * 12 + month(o_orderdate)")
    joined = orders.join(customers, F.expr("o_custkey = c_custkey")).join(F.broadcast(nations), F.expr("c_nationkey = n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("instance_id"), F.col("r_name").alias("brand"), F.element_at(F.array(*map(F.lit, QUERIES)), (q + 1).cast("int")).alias("query"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("r_regionkey") * 100000 + q * 10000 + months).alias("archive_id"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archives_of plus (title, title_second, price_std, price_curr) from the product's first line; products without lines have none."""
    first = _ranked_lines(spark, sf_dir).filter("rk = 1").select("l_orderkey", "l_partkey", "l_discount")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    price = F.expr("cast(floor(p_retailprice + 0.5) as int)")
    told = first.join(part, F.expr("l_partkey = p_partkey")).select("l_orderkey", F.col("p_name").alias("title"), F.col("p_type").alias("title_second"), price.alias("price_std"), F.when(F.col("l_discount") >= 0.06, price - F.expr("cast(floor(p_retailprice * l_discount) as int)")).otherwise(price).alias("price_curr"))
    return archives_of(spark, sf_dir).join(told, F.expr("instance_id = l_orderkey"), "left").drop("l_orderkey")


#: the same tables for DuckDB
CTES = """
ranked AS (
  SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rk FROM lineitem) WHERE rk <= 5
), palette AS (
  SELECT l_orderkey AS instance_id, rk AS cluster_rank, 100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS perc,
    CAST(l_partkey % 101 AS DOUBLE) AS lab_l,
    ((l_partkey * 7 + l_suppkey * 13) % 161 - 80) / (CASE WHEN l_partkey % 3 = 0 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END) AS lab_a,
    ((l_partkey * 11 + l_suppkey * 29) % 161 - 80) / (CASE WHEN l_partkey % 3 = 0 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END) AS lab_b
  FROM ranked
), arch AS (
  SELECT o_orderkey AS instance_id, r_name AS brand, ['mens clothing', 'womens', 'women tops', 'men', 'kids'][o_orderkey % 5 + 1] AS query,
    strftime(o_orderdate, '%Y-%m') AS month, r_regionkey * 100000 + (o_orderkey % 5) * 10000 + (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS archive_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), inst AS (
  SELECT a.*, p_name AS title, p_type AS title_second, CAST(floor(p_retailprice + 0.5) AS INTEGER) AS price_std,
    CASE WHEN l_discount >= 0.06 THEN CAST(floor(p_retailprice + 0.5) AS INTEGER) - CAST(floor(p_retailprice * l_discount) AS INTEGER) ELSE CAST(floor(p_retailprice + 0.5) AS INTEGER) END AS price_curr
  FROM arch a LEFT JOIN (SELECT * FROM ranked JOIN part ON l_partkey = p_partkey WHERE rk = 1) f ON a.instance_id = f.l_orderkey
)"""


# ---------------------------------------------------------------- detections, logs and titles: stand-ins for what the catalogue's crawls write


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, no, class_name, conf, x1, y1, x2, y2): one detected object a line, with its box."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    box = {"x1": "cast(l_partkey % 40 as double)", "y1": "cast(l_suppkey % 30 as double)", "x2": "l_partkey % 40 + 4.0D + l_quantity", "y2": "l_suppkey % 30 + 10.0D * l_linenumber"}
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.join(part, F.expr("l_partkey = p_partkey")).select(F.col("l_orderkey").alias("instance_id"), F.row_number().over(order).alias("no"), F.col("p_name").alias("class_name"), (1 - F.col("l_discount")).alias("conf"), *(F.expr(t).alias(k) for k, t in box.items()))


#: which message a log writes for a product of an order priority; the fifth writes none
MESSAGES = {"1-URGENT": "no masks", "2-HIGH": "no garment detection", "3-MEDIUM": "file not found", "4-NOT SPECIFIED": "bad filename format"}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instances with what later steps hold of them: segmented, clustered, final; and the order's priority."""
    first = _ranked_lines(spark, sf_dir).filter("rk = 1").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount"])
    flag = first.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = instances(spark, sf_dir).join(flag, F.expr("instance_id = l_orderkey"), "left").join(orders, F.expr("instance_id = o_orderkey"))
    said = {"segmented": "flag IN ('A', 'N')", "clustered": "flag = 'A' OR (flag = 'N' AND o_orderstatus = 'P')", "final": "flag = 'A' AND o_orderstatus <> 'P'"}
    return rows.select("instance_id", "brand", "query", "month", "archive_id", "title", "title_second", "price_std", "price_curr", F.col("o_orderpriority").alias("priority"), *(F.expr(f"coalesce({t}, false)").alias(k) for k, t in said.items()))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line): the processing logs of the archives that were run. Each has a first log, which says that nothing was found,
    and a later one, whose header names the archive."""
    o = outcomes(spark, sf_dir).filter("not segmented").withColumn("said", F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))[F.col("priority")]).filter("said is not null")
    folder = F.concat(F.lit("logs/"), F.regexp_replace("brand", " ", ""), F.lit("_"), F.col("archive_id").cast("string"), F.lit("_"))
    name = F.concat_ws("-", F.col("archive_id").cast("string"), F.col("instance_id").cast("string"), F.lit("0"), F.lit("1"), F.lit("pid"))
    line = lambda stamp, said: o.select(F.concat(folder, F.lit(f"{stamp}/processing_log.txt")).alias("path"), (F.col("instance_id") + 1).alias("line_no"), F.concat(name, F.lit(": "), said).alias("line"))
    heads = o.select(folder.alias("f"), "archive_id").distinct().select(F.concat("f", F.lit("20240201/processing_log.txt")).alias("path"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Archive ID: "), F.col("archive_id").cast("string")).alias("line"))
    return heads.unionByName(line("20240101", F.lit("Skipping because no masks were found"))).unionByName(line("20240201", F.col("said")))


def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive_dir, run_dir, line_no, line): the same logs as files hold them, in folders BRAND_query_archive_month and runs. The first run
    has the older phrasing, the header comes first in every log."""
    o = outcomes(spark, sf_dir).filter("not segmented").withColumn("said", F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))[F.col("priority")]).filter("said is not null")
    place = F.min("month").over(Window.partitionBy("archive_id"))
    o = o.withColumn("archive_dir", F.concat_ws("_", F.regexp_replace("brand", " ", ""), F.regexp_replace("query", " ", "-"), F.col("archive_id").cast("string"), F.regexp_replace(place, "-", "")))
    name = F.concat_ws("-", F.col("archive_id").cast("string"), F.col("instance_id").cast("string"), F.lit("0"), F.lit("1"), F.lit("pid"))
    run = lambda stamp: F.lit(f"fpyolo11l241114_{stamp}")
    line = lambda stamp, said: o.select("archive_dir", run(stamp).alias("run_dir"), (F.col("instance_id") + 1).alias("line_no"), F.concat(name, F.lit(": "), said).alias("line"))
    head = lambda stamp: o.select("archive_dir", "archive_id").distinct().select("archive_dir", run(stamp).alias("run_dir"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Archive ID: "), F.col("archive_id").cast("string")).alias("line"))
    first, last = ("20240101", F.lit("Skipping because no masks were found")), ("20240201", F.col("said"))
    return head(first[0]).unionByName(head(last[0])).unionByName(line(*first)).unionByName(line(*last))


def shown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, brand, text): both titles as the shop shows them."""
    both = instances(spark, sf_dir).select("instance_id", "brand", F.explode(F.array(F.initcap("title"), F.col("title_second"))).alias("text"))
    return both.filter("text is not null")


OUTCOME_CTES = """
flagged_first AS (SELECT r.l_orderkey, min(l.l_returnflag) AS flag FROM ranked r JOIN lineitem l ON r.l_orderkey = l.l_orderkey AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_quantity = l.l_quantity AND r.l_discount = l.l_discount AND r.l_linenumber = l.l_linenumber AND r.l_shipdate = l.l_shipdate AND r.l_extendedprice = l.l_extendedprice WHERE rk = 1 GROUP BY 1),
outcomes AS (
  SELECT i.*, o_orderpriority AS priority, coalesce(flag IN ('A', 'N'), FALSE) AS segmented, coalesce(flag = 'A' OR (flag = 'N' AND o_orderstatus = 'P'), FALSE) AS clustered, coalesce(flag = 'A' AND o_orderstatus <> 'P', FALSE) AS final
  FROM inst i LEFT JOIN flagged_first f ON i.instance_id = f.l_orderkey JOIN orders o ON i.instance_id = o.o_orderkey
)"""
